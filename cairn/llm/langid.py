"""Language identification with error-correcting output codes."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import durable, free_names, letter_class, mix64

#: Texts per language that training may read at most, in expectation; chosen by a hash of doc_id, whole texts.
TRAIN_TEXTS = 5_000
#: Hashed n-gram features of each order.
CELLS, ORDERS = 1 << 15, (2, 3, 4)
#: Bytes of a text, and its n-grams, that are weighed at a time.
BLOCK = 1 << 16
#: A text is ambiguous if its two best codewords' losses differ by less than this.
MARGIN = 0.5
_LETTER = re.compile(letter_class())
_GAPS = re.compile(rb" {2,}")
_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str | None) -> Iterator[np.ndarray]:
    """Hashed byte n-grams of the lower-cased letters of a whole text, block by block; words are set off by single spaces."""
    if not text or not _LETTER.search(text):
        return
    data = _GAPS.sub(b" ", b" " + text.lower().encode().translate(_KEEP) + b" ")
    most = max(ORDERS) - 1
    for i in range(0, max(len(data) - 1, 1), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK + most, len(data) - i), i).astype(np.uint32)
        run = b
        for k, n in enumerate(ORDERS):
            if len(b) < n:
                break
            run = run[:-1] * np.uint32(257) + b[n - 1 :]
            h = (run[:BLOCK] + np.uint32(n)) * np.uint32(0x9E3779B1)  # n-grams that start in this block
            yield (h >> np.uint32(17)).astype(np.int64) + k * CELLS


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Up to 7 languages get the exhaustive code (2 ** (k - 1) - 1 bits, every split of the languages once),
    more get the pseudo-random code, of 64, whose closest pair of rows is furthest apart, 15 bits for each doubling of k."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1)][1:]
        return np.array(columns, float).T
    bits, best, code = 15 * (k - 1).bit_length(), -1, None
    for seed in range(64):
        at = np.arange(k * bits, dtype=np.uint64).reshape(k, bits) + np.uint64(seed << 32)
        c = np.where(mix64(at) & np.uint64(1), 1.0, -1.0)
        apart = (bits - (c @ c.T - np.diag(np.full(k, 1e9))).max()) / 2
        split = np.abs(c.sum(0)).max() < k  # a bit that all languages share says nothing
        if split and apart > best:
            best, code = apart, c
    return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits: the log odds that a bit is +1
    scale: np.ndarray  # of each bit's margin
    trust: np.ndarray  # weight of each bit's loss

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous; "und" for null and for texts without letters."""
        n, total = 0, np.zeros(self.weights.shape[1])
        for f in features(text) if self.languages else ():
            n, total = n + len(f), total + self.weights[f].sum(0, dtype=float)
        if not n:
            return "und", 0.0, True
        margin = total / n * self.scale
        loss = (np.exp(np.clip(-self.code * margin, -30, 30)) * self.trust).sum(1)
        p = np.exp(loss.min() - loss)
        k = int(np.argmax(p))
        second = np.partition(loss, 1)[1] - loss[k] if len(loss) > 1 else np.inf
        return self.languages[k], float(p[k] / p.sum()), bool(second < MARGIN)


def _mean(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """languages x bits: what a language adds to the mean of the languages where a bit is +1, and where it is -1."""
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    return up / np.maximum(up.sum(0), 1), down / np.maximum(down.sum(0), 1)


def fit(counts: DataFrame, languages: list[str], totals: np.ndarray) -> Model:
    """A model from counts (lang, a number; feature; n), and each language's sum of them.

    Each bit's classifier is naive Bayes between the languages on either side of it, with half a count added to each feature.
    Features are weighed where their counts are; a row a feature, of a number a bit, comes to the driver: as many as CELLS and
    ORDERS give, by the bits of the code, whatever the number of texts or languages.
    """
    spark, code, size = counts.sparkSession, codewords(len(languages)), len(ORDERS) * CELLS
    up, down = _mean(code)
    least = 0.5 / (totals + 0.5 * size)  # the probability of a feature that a language doesn't have
    none = np.log(least @ up + 1e-12) - np.log(least @ down + 1e-12)
    by_feature = durable(counts.groupBy("feature").agg(F.collect_list(F.struct("lang", "n")).alias("held")))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for held in b["held"]:
                at = np.array([x["lang"] for x in held])
                more = np.array([x["n"] for x in held]) * 2 * least[at]  # n / (total + size / 2)
                rows.append((np.log(least @ up + more @ up[at] + 1e-12) - np.log(least @ down + more @ down[at] + 1e-12)).astype(np.float32))
            yield pd.DataFrame({"feature": b["feature"], "weights": rows})

    got = by_feature.mapInPandas(weigh, "feature int, weights array<float>").toPandas()
    weights = np.tile(none.astype(np.float32), (size, 1))
    if len(got):
        weights[got["feature"].to_numpy()] = np.stack(got["weights"])
    shared = spark.sparkContext.broadcast(weights)

    def typical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for f, held in zip(b["feature"], b["held"], strict=True):
                for x in held:
                    k = x["lang"]
                    own[k] = own.get(k, 0) + x["n"] * 2 * least[k] * shared.value[f].astype(float)
        if own:
            yield pd.DataFrame({"lang": list(own), "margin": list(own.values())})

    # how well a bit tells its languages apart: the least margin that a typical text of any of them has
    margin = least[:, None] * weights.sum(0, dtype=float)
    parts = by_feature.mapInPandas(typical, "lang int, margin array<double>").select("lang", F.posexplode("margin").alias("bit", "m")).groupBy("lang", "bit").agg(F.sum("m").alias("m")).toPandas()
    np.add.at(margin, (parts["lang"].to_numpy(int), parts["bit"].to_numpy(int)), parts["m"].to_numpy(float))
    worst = (margin * code).min(0).clip(1e-6)
    return Model(languages, code, weights, 3 / worst, worst / worst.sum() * len(worst))


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", per_language: int = TRAIN_TEXTS) -> Model:
    """A model from the rows of docs whose lang is given, on about per_language texts of each language at most.

    Which texts take part depends on a hash of key alone. n-grams are counted where the texts are. Repeated rows count as often as
    they are there; texts without letters add nothing; without any row with a lang, every text will be "und".
    """
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    sizes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())  # a row a language
    total = len(ORDERS) * CELLS
    if not sizes:
        return Model([], np.zeros((0, 1)), np.zeros((total, 1), np.float32), np.ones(1), np.ones(1))
    shares = docs.sparkSession.createDataFrame([(x, i, min(1.0, per_language / n)) for i, (x, n) in enumerate(sizes)], "lang string, number int, share double")
    unit = (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(batch["number"], batch["text"], strict=True):
                if k not in own:
                    if len(own) >= 64:  # of many languages, a task holds the counts of some at a time
                        yield from rows(own)
                        own = {}
                    own[k] = np.zeros(total, np.int64)
                for f in features(value):
                    np.add.at(own[k], f, 1)
        yield from rows(own)

    def rows(own: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        for k, c in own.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": k, "feature": at, "n": c[at]})

    chosen = known.join(F.broadcast(shares), "lang").where(unit < F.col("share")).select("number", "text")  # a row a language
    counts = durable(chosen.mapInPandas(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    totals = np.zeros(len(sizes))
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[r["lang"]] = r["n"]
    return fit(counts, [x for x, _ in sizes], totals)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, lang_pred, score and ambiguous for every row of docs.

    Null and letterless texts are "und", with score 0; so is every text where the model knows no language. Of codewords equally
    near, the alphabetically first language wins, and the text is ambiguous. Texts are read whole, in blocks; repeated rows are
    judged alike; an empty table stays empty. Columns in keep that are named like the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by CELLS, ORDERS and the code's length
    added = ("lang_pred", "score", "ambiguous")

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decode(x) for x in texts], columns=added)

    (name,) = free_names(docs, "found")
    rows = docs.select(*[c for c in dict.fromkeys(keep) if c not in added], run(F.col(text)).alias(name))
    return rows.select("*", f"{name}.*").drop(name)
