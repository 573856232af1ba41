"""Splitters: text and tables into pieces of bounded size."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.vectors import cosine

# Fixed values of the query semantics: sizes in characters, the share of a piece before which it is not cut, and the boundaries
# to cut after, best first.
CHUNK_SIZE, CHUNK_OVERLAP, MIN_SPLIT_RATIO = 800, 100, 0.4
BOUNDARIES = ("\n\n", ". ", "? ", "! ", "\n", " ")
RECURSIVE_SEPARATORS, RECURSIVE_SIZE, PLAIN_SIZE = ("\n\n", "\n", ". ", " ", ""), 600, 1000
MERGE_SIMILARITY, MERGE_SIZE, BREAK_PERCENTILE = 0.70, 1000, 70
#: Texts whose pieces leave a Python worker together.
SLICE = 500


def windows(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, int]]:
    """Where the pieces of a text without white space at its ends start and end.

    A piece ends behind the last place of the best boundary that its later part holds, or at full size. The next one starts
    overlap characters earlier, at the beginning of a word, or at the end of the piece if that would not be further on.
    """
    # where each kind of boundary ends, once for the whole text; what a piece needs of them is found by bisection
    ends = [(len(b), [m.start() + len(b) for m in re.finditer(f"(?={re.escape(b)})", text)]) for b in BOUNDARIES]
    words, at, stop = ends[-1][1], 0, 0
    while stop < len(text):
        full = stop = min(at + size, len(text))
        if full < len(text):
            least = at + int(size * MIN_SPLIT_RATIO)
            latest = ((n, at_[k - 1]) for n, at_ in ends if (k := bisect.bisect_right(at_, full)))
            stop = next((end for n, end in latest if end - n >= least), full)
        yield at, stop
        again = max(0, stop - overlap)
        if again and not text[again - 1].isspace():
            k = bisect.bisect_right(words, again)
            again = words[k] if k < len(words) and words[k] <= stop else stop
        at = again if again > at else stop


def split_pieces(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    bare = (text or "").strip()
    pieces = [bare] if len(bare) <= size else [bare[a:b].strip() for a, b in windows(bare, size, overlap)]
    return [p for p in pieces if p]


def _splitter(split: Callable[[str | None], list[str]]):
    """A Pandas UDF from texts to arrays of pieces: each cut depends on the one before, which no built-in function expresses. Pieces
    leave a worker SLICE texts at a time, so that it holds one batch of texts but never all their pieces."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for i in range(0, max(len(texts), 1), SLICE):
                yield pd.Series([split(t) for t in texts.iloc[i : i + SLICE]], dtype=object)

    return run


def split_text(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    return _splitter(lambda t: split_pieces(t, size, overlap))


def explode_pieces(rows: DataFrame, pieces: Column, name: str = "piece") -> DataFrame:
    """A row for each piece, with its number from 0 in piece_index."""
    return rows.select("*", F.posexplode(pieces).alias("piece_index", name))


def split_table(text: Column, size: int = CHUNK_SIZE) -> Column:
    """An array of pieces of a table in Markdown: each has the lines above the table, its first two lines, and as many rows as
    fit, but one at least. Null where the text has no table of three lines; such text is for split_text()."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    first = F.array_position(F.transform(lines, lambda x: F.ltrim(x).startswith("|")), F.lit(True)).cast("int")  # 1-based, 0: none
    head = F.slice(lines, 1, first + 1)
    rows = F.slice(lines, first + 2, F.greatest(F.size(lines) - first - 1, F.lit(0)))
    taken = F.aggregate(head, F.lit(0), lambda a, x: a + F.length(x) + 1)

    def step(state, row):
        full = (F.size(state["rows"]) > 0) & (state["size"] + F.length(row) + 1 > size)
        done = F.when(full, F.concat(state["done"], F.array(F.array_join(state["rows"], "\n")))).otherwise(state["done"])
        rows_ = F.when(full, F.array(row)).otherwise(F.concat(state["rows"], F.array(row)))
        size_ = F.when(full, taken).otherwise(state["size"]) + F.length(row) + 1
        return F.struct(done.alias("done"), rows_.alias("rows"), size_.alias("size"))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("rows"), taken.alias("size"))
    bodies = F.aggregate(rows, start, step, lambda s: F.concat(s["done"], F.array(F.array_join(s["rows"], "\n"))))
    top = F.array_join(head, "\n")
    return F.when((first > 0) & (F.size(lines) - first >= 2), F.transform(bodies, lambda b: F.concat(top, F.lit("\n"), b)))


def _merge(parts: list[str], glue: str, size: int, overlap: int) -> list[str]:
    """Neighbouring parts put together up to size; with an overlap, the last parts of one piece that fit it begin the next."""
    out, now = [], []
    for p in parts:
        if now and sum(map(len, now)) + len(glue) * len(now) + len(p) > size:
            out.append(glue.join(now))
            while now and (sum(map(len, now)) + len(glue) * (len(now) - 1) > overlap or sum(map(len, now)) + len(glue) * len(now) + len(p) > size):
                now.pop(0)
        now.append(p)
    return [x for x in (*(s.strip() for s in out), glue.join(now).strip()) if x]


def split_by(text: str | None, size: int, separator: str = "\n\n", overlap: int = 0) -> list[str]:
    """Parts between separators, merged up to size; a part that is larger stays whole."""
    return _merge([p for p in (text or "").split(separator) if p], separator, size, overlap)


def split_recursive(text: str | None, size: int = RECURSIVE_SIZE, overlap: int = 0, separators: tuple[str, ...] = RECURSIVE_SEPARATORS) -> list[str]:
    """Parts between the first separator that the text has; those larger than size are split by the later ones, the others merged."""
    text = text or ""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    glue, later = separators[k], separators[k + 1 :]
    out, fitting = [], []
    for p in [p for p in (text.split(glue) if glue else text) if p]:
        if len(p) <= size:
            fitting.append(p)
            continue
        out += _merge(fitting, glue, size, overlap)
        fitting = []
        out += split_recursive(p, size, overlap, later) if later else [p]
    return out + _merge(fitting, glue, size, overlap)


def recursive_splitter(size: int = RECURSIVE_SIZE, overlap: int = 0):
    return _splitter(lambda t: split_recursive(t, size, overlap))


def plain_splitter(size: int = PLAIN_SIZE, separator: str = "\n\n"):
    return _splitter(lambda t: split_by(t, size, separator))


def semantic_breakpoints(sentences: DataFrame, key: str = "doc_id", order: str = "ord", vector: str = "vector", percentile: float = BREAK_PERCENTILE) -> DataFrame:
    """sentences with distance (1 - cosine to the one before) and group: a new group starts where the distance exceeds the
    percentile of its document's distances. A document's sentences are one window partition."""
    by_order = W.partitionBy(key).orderBy(order)
    step = sentences.withColumn("_before", F.lag(vector).over(by_order)).withColumn("distance", 1 - cosine(F.col(vector), F.col("_before"))).drop("_before")
    cut = step.withColumn("_cut", F.percentile("distance", F.lit(percentile / 100)).over(W.partitionBy(key)))
    broken = F.coalesce((F.round("distance", 12) > F.round("_cut", 12)).cast("long"), F.lit(0))
    return cut.withColumn("group", F.sum(broken).over(by_order)).drop("_cut")


def semantic_merge(pieces: DataFrame, embed, key: str = "doc_id", order: str = "piece_index", text: str = "piece", similarity: float = MERGE_SIMILARITY, size: int = MERGE_SIZE) -> DataFrame:
    """key, merged_index, text: a piece joins the one before while their vectors are alike and the sum is not too long; what is
    merged is embedded anew, by embed(list of texts). The pieces of a document follow each other in one task."""
    import numpy as np
    import pyarrow as pa

    def merge(texts: list[str]) -> list[str]:
        vectors = [np.asarray(v, float) for v in embed(texts)]
        done, now, v = [], texts[0], vectors[0]
        for t, w in zip(texts[1:], vectors[1:], strict=True):
            if len(now) + len(t) + 2 <= size and (scale := np.linalg.norm(v) * np.linalg.norm(w)) and v @ w / scale >= similarity:
                now = f"{now}\n\n{t}"
                v = np.asarray(embed([now])[0], float)
            else:
                done.append(now)
                now, v = t, w
        return [*done, now]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts, out = None, [], []  # one document's pieces so far, and merged ones that wait for their batch

        def put() -> None:
            out.extend((own, i, t) for i, t in enumerate(merge(texts)))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "merged_index", "text"])

        for b in batches:
            kinds = (b.schema.field(0).type, pa.int32(), pa.string())
            for i in range(0, b.num_rows, SLICE):
                for k, t in zip(*(c.to_pylist() for c in b.slice(i, SLICE).columns), strict=True):
                    if texts and k != own:
                        put()
                        texts = []
                    own = k
                    texts.append(t)
                if out:
                    yield batch()
        if texts:
            put()
            yield batch()

    kind = pieces.schema[key].dataType.simpleString()
    sorted_ = pieces.select(key, text, order).repartition(key).sortWithinPartitions(key, order).select(key, text)
    return sorted_.mapInArrow(run, f"`{key}` {kind}, merged_index int, text string")
