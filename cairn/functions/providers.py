"""Models behind small interfaces, and deterministic stand-ins for tests and offline use."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import tokenize

EMBED_BATCH = 64


class TextEmbedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class TextGenerator(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Counts of hashed words and word beginnings: texts that share words are near each other."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", (t or "").lower()):
                for n, sign in _slots(w):
                    v[n % self.dimensions] += sign
            out.append(v)
        return out


@functools.lru_cache(1 << 17)
def _slots(word: str) -> tuple[tuple[int, float], ...]:
    """The hashed numbers and signs of a word and its beginning; a worker keeps those of the words it met last."""
    hashed = (hashlib.blake2b(part.encode(), digest_size=8).digest() for part in (word, word[:4]))
    return tuple((int.from_bytes(h[:4], "big"), 1.0 if h[4] & 1 else -1.0) for h in hashed)


class EchoGenerator:
    """Answers with the first source of a prompt, so that everything around a real model can be tested."""

    def generate(self, prompt: str) -> str:
        first = re.search(r"\[1\] \([^\n]*\)\n(.*)", prompt)
        return f"{first[1]} [1]" if first else prompt.strip().splitlines()[-1]


_GENERATORS: dict[str, Callable[[], TextGenerator]] = {"echo": EchoGenerator}


def register_generator(name: str, make: Callable[[], TextGenerator]) -> None:
    _GENERATORS[name] = make


def generator(name: str = "echo") -> TextGenerator:
    if name not in _GENERATORS:
        raise ValueError(f"no text generator is called {name}; there are {', '.join(sorted(_GENERATORS))}")
    return _GENERATORS[name]()


def embed_column(rows: DataFrame, make: Callable[[], TextEmbedder], text: str = "embedding_text", name: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """rows with the vectors of a text column; make() runs once in each worker, texts go to it in batches."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name] + [f"{name} array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            for i in range(0, len(b), 8 * batch):  # vectors leave a worker some batches at a time
                own = b.iloc[i : i + 8 * batch]
                texts = own[text].tolist()
                yield own.assign(**{name: [v for j in range(0, len(texts), batch) for v in model.embed(texts[j : j + batch])]})

    return rows.drop(name).mapInPandas(run, schema)


def lexical_pair_score(query: Column, text: Column) -> Column:
    """A stand-in for a pair scorer: the share of a query's distinct words that the text has."""
    q = F.array_distinct(tokenize(query))
    return F.coalesce(F.size(F.array_intersect(q, tokenize(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def standalone_question(question: str, history: str, model: TextGenerator, prompt: str) -> str:
    """The question rewritten to stand alone; as it is without a history or where the model returns nothing."""
    if not history:
        return question
    return model.generate(prompt.format(history=history, question=question)).strip() or question


def query_variations(question: str, model: TextGenerator, n: int = 3) -> list[str]:
    """Up to n other wordings of a question, a line each."""
    lines = [re.sub(r"^\s*(?:\d+[.)]|[-*])\s*", "", x).strip() for x in model.generate(f"Write {n} other wordings of this question, one a line.\n{question}").splitlines()]
    return [x for x in lines if x][:n]


METADATA_PROMPT = "Give the title, the section and a one-sentence summary of this text as a JSON object with the keys title, section and summary, and nothing else.\n\n{text}"
#: Generators that images may be sent to.
IMAGE_GENERATORS: set[str] = set()


def supports_images(name: str) -> bool:
    return name in IMAGE_GENERATORS


def generate_metadata(rows: DataFrame, make: Callable[[], TextGenerator], text: str = "piece", prompt: str = METADATA_PROMPT) -> DataFrame:
    """rows with title, section and summary from a model that is asked about each text; make() runs once in each task."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["_reply string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(_reply=[model.generate(prompt.format(text=t)) for t in b[text]])

    return chunk_metadata(rows.mapInPandas(run, schema), "_reply").drop("_reply")


def chunk_metadata(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """rows with title, section and summary from a model's reply, blank where it cannot be read."""
    from cairn.functions.text import repair_json

    return rows.withColumn("_m", repair_json(F.col(reply))).select("*", "_m.title", "_m.section", "_m.summary").drop("_m")
