"""Benchmark decontamination with spaced seeds: the seeds of items and of texts are joined, and the places that meet are verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, durable, free_names, maybe_broadcast, mix64, small, word_hashes

#: Positions of a window that are hashed (1) or ignored (0). Windows that differ only where a mask has 0 still meet.
MASKS = ("110100110101", "101101001011", "111001010011", "11111111")
#: An item counts as found where at least this share of its words stands in order in a stretch of a text: on one diagonal, or,
#: around a hit, on neighbouring ones, as words that are put in or left out leave them.
OVERLAP = 0.8
#: A part of an item counts too, if it has at least this share of the item's words, and this many.
PART, PART_WORDS = 0.6, 13
#: Items of fewer words stand in prose by chance. They are found exactly: where a line of a text has their words and no others.
MIN_WORDS = 5
#: Items of at most so many words have too few windows for the masks alone.
SHORT = 30
#: Seeds that are sent to the texts as they are (8 bytes each). Of more, a table of bits is sent, of 2 ** MOST_BITS bits at most
#: (16 MB): it lets some windows through that no item has, which the join sorts out.
MOST_SEEDS, SPARE_BITS, MOST_BITS = 1 << 21, 8, 27
_GAP = np.zeros(256, bool)
_GAP[[c for c in range(128) if not chr(c).isalnum()]] = True


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: runs of ASCII letters and digits and of all other characters beyond ASCII, lower-cased."""
    return word_hashes((text or "").lower().encode(), _GAP)


_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of words under a mask, by position. Word hashes are uniform, so a weighted sum of them is too."""
    n = len(words) - len(mask) + 1
    h = np.full(max(n, 0), int("1" + mask, 2), np.uint64)
    for j, bit in enumerate(mask if n > 0 else ""):
        if bit == "1":
            h += words[j : j + n] * _FACTORS[j]
    return h


def _in_order(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """How many words of an item stand in order among words (their longest common subsequence), and how many of words, from the
    first one on, that takes."""
    row = np.zeros(len(words) + 1, np.int32)
    for w in item:
        row[1:] = np.maximum.accumulate(np.where(words == w, row[:-1] + 1, row[1:]))
    return int(row[-1]), int(np.searchsorted(row, row[-1]))


def masks_of(n: int) -> list[str]:
    """The masks under which an item of n words is looked for: those of MASKS that fit, and, for a short item, ones that some window
    of it is left whole under, whatever words are substituted, as long as OVERLAP of them are left."""
    out = [m for m in MASKS if len(m) <= n]
    if n == 5:
        return ["111", "11011"]  # one word may be other: the middle one, or three in a row are left
    if n <= SHORT:
        other = n - math.ceil(OVERLAP * n)
        out.append("1" * math.ceil((n - other) / (other + 1)))
    return sorted(set(out))


def _line_seeds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The first word's place and the hash of every line of fewer than MIN_WORDS words."""
    at, places, seeds = 0, [], []
    for line in text.split("\n"):
        w = tokens(line)
        if 0 < len(w) < MIN_WORDS:
            places.append(at)
            seeds.append(_whole(w))
        at += len(w)
    return np.array(places, np.int64), np.array(seeds, np.uint64)


def _whole(words: np.ndarray) -> np.uint64:
    """The hash of a short item or line."""
    return mix64((words * _FACTORS[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))[0]


def match(item: np.ndarray, words: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """Words matched and the first and last word of the best place of an item among words, given the diagonals of the hits; null if
    none counts. A diagonal with OVERLAP of the item comes first, of several the fullest, then the first."""
    if len(item) < MIN_WORDS:  # a line's hash met the item's
        at = [s for s in sorted(shifts) if (words[s : s + len(item)] == item).all()]
        return (len(item), at[0], at[0] + len(item) - 1) if at else None
    best = None
    for shift in shifts:
        a, b = max(0, -shift), min(len(item), len(words) - shift)
        same = int((item[a:b] == words[shift + a : shift + b]).sum()) if b > a else 0
        if same >= OVERLAP * len(item) and (best is None or (same, -shift) > best[:2]):
            best = (same, -shift, shift + a, shift + b - 1)
    return best and (best[0], best[2], best[3]) or _around(item, words, sorted(shifts))


def _around(item: np.ndarray, words: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """The best place of an item, or of a part of it, around hits on these diagonals, none of which has the item whole.

    Diagonals that are no further apart than the words an item may lack are judged together, in the words that the item can
    stand in on any of them; so a long text of many hits costs only what its hits do.
    """
    other = len(item) - math.ceil(OVERLAP * len(item))
    need = min(math.ceil(OVERLAP * len(item)), max(PART_WORDS, math.ceil(PART * len(item))))
    best, first = None, None
    for i, shift in enumerate(shifts):
        first = shift if first is None else first
        if i + 1 < len(shifts) and shifts[i + 1] - first <= other:
            continue
        low, high = max(0, first - other), min(len(words), shift + len(item) + other)
        first, there = None, words[low:high]
        if int(np.isin(item, there).sum()) < need:
            continue
        n, end = _in_order(item, there)
        if n >= need and (best is None or n > best[0]):
            _, size = _in_order(item[::-1], there[:end][::-1])
            best = (n, low + end - size, low + end - 1)
    return best


def item_classes(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two durable tables: item_id, node of every item that has words; and node, words (hashes, as bytes), n of each distinct item."""

    @F.pandas_udf("binary")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([tokens(t).tobytes() for t in texts], dtype=object)

    n = benchmark.count()
    rows = durable(benchmark.select(F.col(item).alias("item_id"), words(F.col(text)).alias("words")).where(F.octet_length("words") > 0).withColumn("digest", F.md5("words")), n)
    classes = durable(rows.groupBy("digest").agg(F.first("words").alias("words")).withColumn("node", F.monotonically_increasing_id()).withColumn("n", (F.octet_length("words") / 8).cast("int")), n)
    return durable(rows.select("item_id", "digest").join(classes.select("digest", "node"), "digest").select("item_id", "node"), n), classes.select("node", "words", "n")


def item_seeds(classes: DataFrame) -> DataFrame:
    """seed, node, at: the hash of each window of each item under each of its masks, and the window's place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for node, data in zip(b["node"], b["words"], strict=True):
                w = np.frombuffer(data, np.uint64)
                parts = [_seeds(w, m) for m in masks_of(len(w))] if len(w) >= MIN_WORDS else [np.array([_whole(w)], np.uint64)]
                yield pd.DataFrame({"seed": np.concatenate(parts).view(np.int64), "node": node, "at": np.concatenate([np.arange(len(s)) for s in parts])})

    return durable(classes.mapInPandas(run, "seed long, node long, at int"))


def _seed_table(seeds: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray | None]:
    """The number of top bits of a seed that are looked at, a bit for each of their values that some seed has, and all seeds, sorted,
    if there are at most so many. What comes to the driver is bounded, whatever the size of the benchmark."""
    each = seeds.select("seed").distinct()
    n = each.count()
    bits = min(MOST_BITS, max(16, n.bit_length() + SPARE_BITS))
    if n <= most:
        all_seeds = np.sort(each.toPandas()["seed"].to_numpy(np.int64).view(np.uint64))
        slot = all_seeds >> np.uint64(64 - bits)
        table = np.zeros(1 << (bits - 3), np.uint8)
        np.bitwise_or.at(table, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        return bits, table, all_seeds
    slots = each.select(F.shiftrightunsigned("seed", 64 - bits).alias("slot"))
    got = slots.groupBy(F.expr("int(slot div 8)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, int(slot % 8)))").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 3), np.uint8)
    table[got["byte"].to_numpy(int)] = got["bits"].to_numpy(int)
    return bits, table, None


def _held(seeds: np.ndarray, bits: int, table: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """The places of the seeds that may be an item's; if known is given, of those that are."""
    slot = seeds >> np.uint64(64 - bits)
    at = np.flatnonzero(table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
    if known is not None and len(at):
        at = at[known[np.minimum(np.searchsorted(known, seeds[at]), len(known) - 1)] == seeds[at]]
    return at


def stretches(docs: DataFrame, seeds: DataFrame, sizes: list[int], most_seeds: int = MOST_SEEDS) -> DataFrame:
    """digest, first, words, at, seeds: for each distinct text of docs (text) its parts around windows whose hash may be an item's
    seed: the digest of the text, the place of the part in it, the hashes of the part's words, and the windows' places and hashes.

    sizes: the numbers of words that items have. A part reaches as far on either side of a window as the longest item could.
    """
    masks, short = sorted({m for n in sizes if n >= MIN_WORDS for m in masks_of(n)}), min(sizes) < MIN_WORDS
    reach = max(sizes) + max(sizes) // 5 + 1
    shared = docs.sparkSession.sparkContext.broadcast(_seed_table(seeds, most_seeds))  # MOST_SEEDS and MOST_BITS bound it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                words = tokens(text)
                parts = [_line_seeds(text)] if short and text else []
                for m in masks if len(words) else ():
                    s = _seeds(words, m)
                    parts.append((np.arange(len(s)), s))
                held = [_held(s, *shared.value) for _, s in parts]
                at = np.concatenate([p[k] for (p, _), k in zip(parts, held, strict=True)]) if parts else np.zeros(0, int)
                if not len(at):
                    continue
                s = np.concatenate([x[k] for (_, x), k in zip(parts, held, strict=True)])
                order = np.argsort(at, kind="stable")
                at, s = at[order], s[order]
                for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                    first = max(0, int(at[own[0]]) - reach)
                    out.append((digest, first, words[first : int(at[own[-1]]) + reach].tobytes(), (at[own] - first).astype(np.int32), s[own].view(np.int64)))
            yield pd.DataFrame(out, columns=["digest", "first", "words", "at", "seeds"])

    found = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text").mapInPandas(run, "digest binary, first int, words binary, at array<int>, seeds array<long>")
    return durable(found).dropDuplicates(["digest", "first"])


FOUND = "n_matched long, first_word long, last_word long"


def find(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, most_seeds: int = MOST_SEEDS) -> tuple[DataFrame, DataFrame]:
    """Two durable tables: digest, node, n_matched, n_item, first_word, last_word of each distinct item found in each distinct text,
    a text being known by its MD5; and item_id, node."""
    items, classes = item_classes(benchmark, item, text)
    sizes = [r["n"] for r in classes.select("n").distinct().collect()]  # bounded by the longest item
    schema = f"digest binary, node long, n_item long, {FOUND}"
    if not sizes:
        return docs.sparkSession.createDataFrame([], schema), items
    seeds = item_seeds(classes)
    parts = durable(stretches(docs.select(F.col(text).alias("text")), seeds, sizes, most_seeds))
    wanted = seeds.withColumnRenamed("at", "place")
    wanted = F.broadcast(wanted) if small(wanted, broadcast_rows) else wanted
    windows = parts.select("digest", "first", F.explode(F.arrays_zip("at", "seeds")).alias("w")).select("digest", "first", "w.at", F.col("w.seeds").alias("seed"))
    pairs = windows.join(wanted, "seed").groupBy("digest", "first", "node").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    known = classes.select("node", F.col("words").alias("item"), "n")
    known = F.broadcast(known) if small(known, broadcast_rows // 16) else known
    both = pairs.join(parts.select("digest", "first", "words"), ["digest", "first"]).join(known, "node")

    @F.pandas_udf(FOUND)
    def verify(own: pd.Series, words: pd.Series, shifts: pd.Series, first: pd.Series) -> pd.DataFrame:
        out = []
        for i, w, s, a in zip(own, words, shifts, first, strict=True):
            got = match(np.frombuffer(i, np.uint64), np.frombuffer(w, np.uint64), sorted(map(int, s)))
            out.append((got[0], got[1] + a, got[2] + a) if got else (None, None, None))
        return pd.DataFrame(out, columns=["n_matched", "first_word", "last_word"], dtype="Int64")

    checked = durable(both.select("digest", "node", F.col("n").cast("long").alias("n_item"), verify("item", "words", "shifts", "first").alias("m")))
    best = checked.where("m.n_matched IS NOT NULL").groupBy("digest", "node", "n_item").agg(F.min(F.struct((-F.col("m.n_matched")).alias("k"), F.col("m.first_word"), F.col("m.last_word"))).alias("b"))
    return durable(best.select("digest", "node", "n_item", (-F.col("b.k")).alias("n_matched"), "b.first_word", "b.last_word")), items


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """doc_id, item_id, n_matched, n_item, first_word, last_word for each benchmark item found in each row of docs.

    Every window of every text is hashed under every mask. A table of bits, of bounded size, sorts out most windows that no item
    has; the others are joined with the items' seeds. Each hit fixes a diagonal, on which all words of the item are compared, so
    substituted words cost only themselves. Where no diagonal has OVERLAP of the item, the words around the hits are searched
    for the item's words in order, so that words put in or left out cost only themselves, and a part of PART of the item, and of
    PART_WORDS words, is found too. An item of fewer than MIN_WORDS words is found where a line has its words and no others.

    Null and empty texts and items are found nowhere. Items with equal words are all reported; a text that holds an item twice
    reports its best place once, of equal ones the first; repeated rows of docs report alike. Texts are searched whole, and only
    the surroundings of hits are kept of long ones. Empty tables give no rows; ids may be of any type, and other columns of any
    name. One pass over the texts serves a benchmark of any size. Equal texts are judged once, so that copies are no hot key, and
    what is shuffled is windows that met the table, not texts.
    """
    found, items = find(docs, benchmark, item, text, **options)
    rows = docs.select(F.col(key).alias("doc_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"))
    few = options.get("broadcast_rows", BROADCAST_ROWS)
    out = rows.join(maybe_broadcast(found, few), "digest").join(maybe_broadcast(items, few), "node")
    return out.select("doc_id", "item_id", "n_matched", "n_item", "first_word", "last_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, in which leaks() finds no item of the benchmark.

    Rows without a text stay, repeated rows go or stay alike, an empty benchmark leaves all. The texts to drop are known by their
    digests, which are broadcast while they are few; beyond that docs are joined with them.
    """
    found, _ = find(docs, benchmark, item, text, **options)
    own, other = free_names(docs, "digest", "gone")
    gone = maybe_broadcast(durable(found.select(F.col("digest").alias(other)).distinct()), options.get("broadcast_rows", BROADCAST_ROWS))
    rows = docs.withColumn(own, F.unhex(F.md5(F.col(text).cast("binary"))))
    return rows.join(gone, F.col(own) == F.col(other), "left_anti").select(*docs.columns)
