"""Phrase collocation mining: frequent phrases level by level, scored by the cut that holds them together least."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import _INV, _ODD, _power, durable, maybe_broadcast, mix64

#: Least count and greatest number of words of a candidate, share of a candidate's occurrences in percent that a longer one that
#: holds it may have, and how many phrases of a language are returned.
MIN_COUNT, LONGEST, COVERED, TOP = 30, 4, 80, 2_000
#: Bits of the filter that is broadcast: so many for a phrase, and at most so many in all (32 MB), which bounds it at any size of the corpus.
BITS_A_PHRASE, MOST_BITS = 32, 1 << 28
#: Bytes of text that are looked at together, and different phrases that a task adds up before it hands them on.
BLOCK, HELD = 1 << 20, 300_000
#: Rows of a frame that a task hands on.
ROWS = 50_000
_BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)
_COUNTS = "lang string, phrase binary, n long"


def token_blocks(texts: Iterator[bytes], overlap: int) -> Iterator[list[bytes]]:
    """Lists of words, with _BREAK between pieces, of about BLOCK bytes. Short texts share one; a longer text is cut between words,
    and each of its later lists begins with the last words of the one before, so many that no phrase of one more word is lost or met twice."""
    held, size = [], 0
    for text in texts:
        text, start, carry = text.translate(_FOLD), 0, []
        while len(text) - start > BLOCK:
            end = start + BLOCK
            ends = [x for x in (text.find(c, end) for c in (b" ", b"\t", _BREAK)) if x >= 0]
            end = min(ends, default=len(text))
            words = carry + text[start:end].replace(_BREAK, b" \xff ").split()
            yield words
            carry, start = words[-overlap:] if overlap else [], end
        rest = carry + text[start:].replace(_BREAK, b" \xff ").split()
        held += rest
        held.append(_BREAK)
        size += len(text) - start
        if size > BLOCK:
            yield held
            held, size = [], 0
    yield held


def _slice_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each slice of buffer, from one running sum, so that no loop runs over the slices."""
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _power(_ODD, len(buffer)), out=total[1:])
    own = (total[end] - total[start]) * _power(_INV, len(buffer) + 1)[start]
    return mix64(own + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode()) * 0x9E3779B1


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def phrases_of(words: list[bytes], k: int, lang: str, known: np.ndarray | None) -> list[bytes]:
    """The runs of k words without a break between them; with known, a filter of k - 1 words, only those both of whose parts may be in it."""
    if k == 1:
        return [w for w in words if w != _BREAK]
    if len(words) < k:
        return []
    joined = b" ".join(words)
    buffer = np.frombuffer(joined, np.uint8)
    space = np.flatnonzero(buffer == 32)
    start, end = np.concatenate(([0], space + 1)), np.append(space, len(buffer))
    breaks = np.concatenate(([0], np.cumsum(buffer[start] == 0xFF)))
    good = breaks[k:] == breaks[:-k]
    if known is not None:
        part = _slice_hashes(buffer, start[: len(start) - k + 2], end[k - 2 :], _seed(lang))
        held = np.ones(len(part), bool)
        for at in _probes(part, len(known) * 64):
            held &= (known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        good &= held[:-1] & held[1:]
    at = np.flatnonzero(good)
    return [joined[s:e] for s, e in zip(start[at].tolist(), end[at + k - 1].tolist(), strict=True)]


def count_phrases(texts: DataFrame, k: int, known: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, n of texts (lang, text in bytes) for phrases of k words, and for k = 1 a row with null phrase for all words of a
    language. A task adds up what it has read before anything is shuffled, so that a frequent phrase is a few rows of each task."""
    shared = None if known is None else texts.sparkSession.sparkContext.broadcast(known)  # at most MOST_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pd.DataFrame]:
            for lang, found in counts.items():
                names, n = list(found), list(found.values())
                if k == 1:
                    names, n = [*names, None], [*n, sum(n)]
                for i in range(0, len(names), ROWS):
                    yield pd.DataFrame({"lang": lang, "phrase": names[i : i + ROWS], "n": n[i : i + ROWS]})
            counts.clear()

        for b in batches:
            for lang, own in b.groupby("lang")["text"]:
                for words in token_blocks((t for t in own if t), k - 1):
                    counts[lang].update(phrases_of(words, k, lang, shared and shared.value))
                    if sum(map(len, counts.values())) > HELD:
                        yield from flush()
        yield from flush()

    return texts.mapInPandas(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_filter(level: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bit filter of level's phrases, two bits a phrase, of at most most_bits. It is put together on the executors, a row for each
    64 bits. A phrase that it takes for known by mistake is counted like the others, and its count decides; so a filter that is too
    small for the phrases costs time and never a result."""
    bits = 1 << 16
    n = level.count()
    while bits < min(BITS_A_PHRASE * n, most_bits):
        bits *= 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, own in b.groupby("lang")["phrase"]:
                joined, size = b"".join(own), np.fromiter(map(len, own), np.int64, len(own))
                end = np.cumsum(size)
                at = np.concatenate(_probes(_slice_hashes(np.frombuffer(joined, np.uint8), end - size, end, _seed(lang)), bits))
                yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    rows = level.select("lang", "phrase").mapInPandas(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) for every phrase of up to longest words that occurs min_count times or more, and (lang, n) of all words.

    Apriori (Agrawal and Srikant 1994), a pass over the texts for each number of words: the frequent phrases of k - 1 words are
    broadcast as a filter, a run of k words is counted only where both of its parts pass, and counts of whole phrases decide. Each
    level is written down. A pass without frequent phrases is the last.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    first = durable(count_phrases(texts, 1).where((F.col("n") >= min_count) | F.col("phrase").isNull()))
    found, known = [first.where("phrase IS NOT NULL")], None
    for k in range(2, longest + 1):
        known = phrase_filter(found[-1], most_bits)
        if not known.any():
            break
        found.append(durable(count_phrases(texts, k, known).where(F.col("n") >= min_count)))
    table = reduce(DataFrame.unionAll, [x.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("k"), "n") for k, x in enumerate(found, 1)])
    return table, first.where("phrase IS NULL").select("lang", "n")


def score_cuts(table: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of every candidate in table: its lowest-scoring cut, ties to the shortest first part.

    Both parts of a cut are at least as frequent as the phrase, so they are in table too. Products are decimals of 38 digits, and
    the quotient is that of whole numbers.
    """
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("_w", a, n), " ")
    cuts = (
        table.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("_w")).select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
        .select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    )
    parts = maybe_broadcast(table.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias("_n")))
    for name, to in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts, (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col("_phrase"))).drop("_lang", "_phrase", name).withColumnRenamed("_n", to)
    scored = cuts.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))"))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_best"))
    return best.select("lang", "phrase", "k", "a", "_best.l", "_best.r", "_best.score")


def uncovered(table: DataFrame, scored: DataFrame, covered: int = COVERED) -> DataFrame:
    """scored without the phrases that a longer candidate holds and that occur in it in covered percent of their cases or more."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    most = table.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_most"))
    left = scored.join(most, ["lang", "phrase"], "left")
    return left.where(F.coalesce(100 * F.col("_most") < covered * F.col("a"), F.lit(True))).drop("_most")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases, by score, then count, then phrase in UTF-8 byte order.

    a is the phrase's count, l and r those of the parts of its lowest-scoring cut, n all words of the language. A null lang is
    "und", as is a lang of that name; null and empty texts have no words. Repeated rows count as often as they occur. A text of
    any length is read whole, in blocks that overlap by the words of a phrase. An empty table, or one without a phrase of
    min_count occurrences, gives no rows; other columns, of any name, are not looked at. Ties in score and count cannot remain:
    phrases of a language differ.
    """
    table, totals = levels(docs, text, lang, min_count, longest, most_bits)
    left = uncovered(table, score_cuts(table), covered).join(F.broadcast(totals), "lang")  # a row a language
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)  # a task keeps top rows of a language before they are shuffled
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
