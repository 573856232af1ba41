"""MinHash near-dedup with SetSketch registers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import durable, free_names, maybe_broadcast, mix64, shingle_hashes, word_hashes

#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Registers, their base and rate. A register is one byte.
REGISTERS, BASE, RATE = 256, 1.08, 20.0
#: A link at the threshold may share no band with at most this probability.
MISS = 3e-5
#: Pairs whose sets are compared in one group.
GROUP_PAIRS = 128
#: Members of a bucket that are compared with each other in one task; a larger bucket is compared block by block.
BLOCK, MEMBERS_A_TASK = 512, 2_000

_XOR = (mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ODD = (mix64(np.arange(1001, REGISTERS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _agree(j: float) -> float:
    """The probability that a register of two sets of equal size and this similarity agrees."""
    return 1 + 2 * math.log1p(-(1 - j) / 2 * (BASE - 1) / BASE) / math.log(BASE)


def plan(percent: int) -> tuple[int, float, int]:
    """Registers a band, and the numbers maybe and equal, for a threshold.

    A band has as many registers, at most eight, as keep a link at the threshold from having no band in common with more than MISS:
    8 at 85, 6 at 80. Candidates are verified if their estimated similarity is at least maybe, four standard errors below the
    threshold; the estimate can reach that where at least equal registers agree, three standard errors below their number there.
    """
    j = percent / 100
    rows = next((r for r in range(8, 0, -1) if (1 - _agree(j) ** r) ** (REGISTERS // r) <= MISS), 1)
    error = lambda x: math.sqrt(REGISTERS * _agree(x) * (1 - _agree(x)))
    slope = REGISTERS * (_agree(j) - _agree(j - 0.01)) / 0.01
    maybe = max(0.0, j - 4 * error(j) / slope)
    return rows, maybe, max(0, math.floor(REGISTERS * _agree(maybe) - 3 * error(maybe)))


def band_values(sketches: np.ndarray, rows: int) -> np.ndarray:
    """The bands of sketches (one a row), of so many registers each, as numbers; registers left over are in no band."""
    n = REGISTERS // rows
    wide = np.zeros((len(sketches), n, 8), np.uint8)
    wide[:, :, :rows] = sketches[:, : n * rows].reshape(len(sketches), n, rows)
    return wide.view(np.int64)[:, :, 0]


def normalised(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between them. bytes.split() splits at the contract's six characters."""
    return b" ".join((text or "").encode().lower().split())


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of normalised words."""
    return shingle_hashes(word_hashes(data))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: floor(1 - log_BASE(h)), h the least of exponential variables of its elements."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):  # bounds the matrix, whatever the length of the text
        low = np.minimum(low, ((short[i : i + 2048, None] ^ _XOR) * _ODD).min(0))
    h = -np.log1p(-(low + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, 255).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest similarity of each pair of sketches (rows of a and b) of sets of known sizes.

    With u, v the sizes' shares and p(x) = -log_BASE(1 - x (BASE - 1) / BASE), a register of the first is larger with probability
    p(u - v J), of the second with p(v - u J); the likelihood of the three counts is maximised over J in steps of 1/128.
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    j = np.arange(129)[None, :] / 128 * np.minimum(u / v, v / u)
    up, down = p(u - v * j).clip(1e-9), p(v - u * j).clip(1e-9)
    like = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log((1 - up - down).clip(1e-9))
    return j[np.arange(len(j)), like.argmax(1)]


def merge(registers: np.ndarray) -> np.ndarray:
    """The registers of the union of sets from theirs (rows): the largest of each. Minima of a union are the least of the minima."""
    return registers.max(0)


def words_digest(text: Column) -> Column:
    """The digest that sketches() gives a text, null without words, computed in the JVM."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "))
    return F.when(words != "", F.unhex(F.md5(words.cast("binary"))))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the normalised words; null without words), n_shingles and bands (all registers, eight to a number)."""

    @F.pandas_udf("digest binary, n_shingles long, bands array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        digest, count, bands = [], [], []
        for x in texts:
            data = normalised(x)
            s = shingles(data)
            digest.append(hashlib.md5(data).digest() if len(s) else None)
            count.append(len(s))
            bands.append(sketch(s).view(np.int64) if len(s) else None)
        return pd.DataFrame({"digest": digest, "n_shingles": count, "bands": bands})

    return docs.select(F.col(key).alias("doc_id"), run(F.col(text)).alias("s")).select("doc_id", "s.*")  # keys of any type stay what they are


def _likely(pairs: DataFrame, classes: DataFrame, maybe: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least maybe."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        view = lambda s: np.stack([np.asarray(v, np.int64) for v in s]).view(np.uint8)
        return pd.Series(estimate(view(x), view(y), n.to_numpy(float), m.to_numpy(float)))

    of = lambda k: classes.select(F.col("node").alias(k), F.col("bands").alias(f"bands_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(similarity("bands_a", "bands_b", "n_a", "n_b") >= maybe).select("a", "b")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are linked.

    Pairs are grouped by a, in groups of about GROUP_PAIRS pairs: a's text goes to each of its groups once, each b's to one, so
    an a with very many partners is spread over as many tasks. Only texts that take part are moved. pairs should be durable.
    """
    n = pairs.count()
    parts = durable(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_PAIRS).cast("int").alias("parts")), n)
    second = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"))
    first = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    wanted = durable(first.unionAll(second).join(classes.select("node", F.col("doc_id").alias("_id"), "digest"), "node"), 2 * n)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    rows = texts.join(maybe_broadcast(wanted), F.col("_key").eqNullSafe(F.col("_id"))).select("a", "part", "node", "digest", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = {}
        for r in group.itertuples(index=False):
            data = normalised(r.text)
            if r.node not in sets and hashlib.md5(data).digest() == r.digest:  # else another row under the same doc_id
                sets[r.node] = shingles(data)
        a = int(group["a"].iloc[0])
        own, out = sets.pop(a, np.zeros(0, np.uint64)), []
        for b, s in sets.items():
            both = len(np.intersect1d(own, s, assume_unique=True))
            if both and 100 * both >= percent * (len(own) + len(s) - both):
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("a", "part").applyInPandas(run, "a long, b long")


def forest_roots(parents: DataFrame, n: int) -> DataFrame:
    """node, root from (node, parent), n rows at most, where each node has one parent, with a smaller number. Paths are halved
    until none is left."""
    now = durable(parents.select("node", F.col("parent").alias("root")), n)
    while True:
        up = maybe_broadcast(now.select(F.col("node").alias("_n"), F.col("root").alias("_r")))
        moved = durable(now.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), n)
        if moved.where("moved").isEmpty():
            return now
        now = moved.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node that it is connected with.

    Alternating large-star and small-star steps; each step is written to the shared folder. A node of any degree is handled by
    its minimum, which is aggregated where the edges are, and a join whose hot side Spark can split. No step adds edges. edges
    should be durable, as they are counted first.
    """
    n = edges.count()
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), n)
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = durable(both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), n)
        key = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if key == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = key


def _unlinked(sketches: np.ndarray, sizes: np.ndarray, roots: np.ndarray, side: np.ndarray, band: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of a block, the members behind it that may be linked with it though their roots differ, with the estimated
    similarities. A pair is left to the first band that it shares, and pairs within a block to that block's own comparison."""
    per_band, maybe, equal = plan(percent)
    bands = band_values(sketches, per_band)
    for i in range(len(sketches) - 1):
        j = np.arange(i + 1, len(sketches))
        j = j[(roots[j] != roots[i]) & (100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i]))]
        if side.any():
            j = j[side[j] != side[i]]
        if band and len(j):
            j = j[~(bands[j, :band] == bands[i, :band]).any(1)]
        j = j[(sketches[j] == sketches[i]).sum(1) >= equal]  # spares most pairs the estimate
        if len(j):
            like = estimate(np.broadcast_to(sketches[i], (len(j), REGISTERS)), sketches[j], np.full(len(j), sizes[i], float), sizes[j].astype(float))
            j, like = j[like >= maybe], like[like >= maybe]
            if len(j):
                yield i, j, like


_CELL = ["band", "value", "x", "y", "i", "j"]


def cells(members: DataFrame, percent: int) -> DataFrame:
    """members (band, value, node, root, n_shingles) once for each cell that they are compared in: x, y, i, j, and their own c, k.

    Sets can only be linked if the smaller has percent of the larger one's shingles. So a bucket of more than BLOCK members is
    dealt by classes c of sizes, of which only neighbours hold links, and each class into blocks k of about BLOCK members. A cell is
    a pair of blocks, i of class x and j of class y; x is y or the class below. A smaller bucket is one cell.
    """
    width = -math.log(percent / 100) * (1 + 1e-9)  # no link reaches over a whole class
    of = ["band", "value"]
    total = members.groupBy(*of).agg(F.count("*").alias("total"))
    classed = members.join(total, of).withColumn("c", F.when(F.col("total") <= BLOCK, 0).otherwise(F.floor(F.log("n_shingles") / width)).cast("int")).drop("total")
    counts = classed.groupBy(*of, "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    # a bucket has few classes: the logarithm of the longest text over that of the shortest, in units of width
    blocks = counts.groupBy(*of).agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("blocks"))
    n = lambda c: F.coalesce(F.try_element_at("blocks", c), F.lit(0))
    each = lambda c, cell: F.when(n(c) > 0, F.transform(F.sequence(F.lit(0), n(c) - 1), cell)).otherwise(F.array().cast("array<struct<x:int,y:int,i:int,j:int>>"))
    pair = lambda x, y, i, j: F.struct(x.alias("x"), y.alias("y"), i.alias("i"), j.alias("j"))
    placed = classed.join(blocks, of).withColumn("k", F.pmod(F.xxhash64("node", F.lit(5)), n(F.col("c"))).cast("int"))
    c, k = F.col("c"), F.col("k")
    own = each(c, lambda o: pair(c, c, F.least(o, k), F.greatest(o, k)))
    above, below = each(c + 1, lambda o: pair(c, c + 1, k, o)), each(c - 1, lambda o: pair(c - 1, c, o, k))
    return placed.select(*of, "c", "k", "node", "root", F.explode(F.concat(own, above, below)).alias("at")).select(*of, "at.*", "c", "k", "node", "root")


def _view(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column]).view(np.uint8)


def link_buckets(members: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """a, b: roots to be joined, from members (band, value, node, root, n_shingles) of buckets that hold several roots.

    Each bucket is compared in blocks. A first comparison, of sketches alone, finds the members that have a likely partner of
    another root; a second one, which only those members' shingle sets are sent to, confirms links, the likeliest first, and
    leaves out pairs that others have joined meanwhile. Both return at most a row a member and block, never the pairs.
    """
    placed = cells(members, percent)
    known = classes.select("node", "bands", "n_shingles")
    # comparing takes longer than reading, so partitions are planned by members, not by bytes
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, members.count() // MEMBERS_A_TASK)

    def order(g: pd.DataFrame) -> tuple:
        g = g.sort_values("node").reset_index(drop=True)
        side = np.where(g["x"] == g["y"], g["k"] != g["i"], g["c"] != g["x"])
        return g, (_view(g["bands"]), g["n_shingles"].to_numpy(), g["root"].to_numpy().copy(), side, int(g["band"].iloc[0]), percent)

    def likely(g: pd.DataFrame) -> pd.DataFrame:
        if g["root"].nunique() < 2:
            return g.iloc[:0][[*_CELL, "c", "k", "node", "root"]]
        g, given = order(g)
        keep = np.zeros(len(g), bool)
        for i, j, _ in _unlinked(*given):
            keep[i] = True
            keep[j] = True
        return g.loc[keep, [*_CELL, "c", "k", "node", "root"]]

    chosen = durable(placed.join(known, "node").repartition(tasks, *_CELL).groupBy(*_CELL).applyInPandas(likely, "band int, value long, x int, y int, i int, j int, c int, k int, node long, root long"))
    wanted = chosen.select("node").distinct().join(classes.select("node", F.col("doc_id").alias("_id"), "digest"), "node")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [normalised(x) for x in b["text"]]
            own = np.array([hashlib.md5(d).digest() == x for d, x in zip(data, b["digest"], strict=True)], bool)  # else another row under the same doc_id
            yield pd.DataFrame({"node": b["node"][own], "shingles": [shingles(d).tobytes() for d, o in zip(data, own, strict=True) if o]})

    sets = texts.join(maybe_broadcast(durable(wanted, classes.count())), F.col("_key").eqNullSafe(F.col("_id"))).select("node", "digest", "text").mapInPandas(to_sets, "node long, shingles binary")
    full = chosen.join(known, "node").join(durable(sets).dropDuplicates(["node"]), "node")

    def confirm(g: pd.DataFrame) -> pd.DataFrame:
        g, given = order(g)
        roots, out = given[2], []
        own = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
        found = [(-p, i, k) for i, j, like in _unlinked(*given) for k, p in zip(j.tolist(), like.tolist(), strict=True)]
        for _, i, k in sorted(found):
            a, b = sorted((int(roots[i]), int(roots[k])))
            if a != b:
                both = len(np.intersect1d(own[i], own[k], assume_unique=True))
                if 100 * both >= percent * (len(own[i]) + len(own[k]) - both):
                    roots[roots == b] = a
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return full.repartition(tasks, *_CELL).groupBy(*_CELL).applyInPandas(confirm, "a long, b long")


def named_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, int]:
    """doc_id, digest, n_shingles, root, component_id for every row of docs; the last two are null for rows without words. Behind
    it the number of rows.

    Classes that agree in a band of registers share a bucket. First each class is compared with the smallest class that any of
    its buckets holds, and the verified links join components. What then still lies in one bucket but in different components
    is compared in blocks. A group of near copies so mostly costs a link a member; pairs are formed one by one only where a
    bucket holds several components, in arrays in a task, and no link that any band shows is lost.
    """
    rows = durable(sketches(docs, key, text))
    n = rows.count()  # classes are at most as many, and each is at most once in a band
    full = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = durable(full.withColumn("node", F.monotonically_increasing_id()), n)
    per_band, maybe, _ = plan(percent)
    members = n * (REGISTERS // per_band)

    @F.pandas_udf("array<long>")
    def values(x: pd.Series) -> pd.Series:
        return pd.Series(list(band_values(_view(x), per_band)) if len(x) else [], dtype=object)

    own_bands = F.col("bands") if per_band == 8 else values("bands")
    bands = classes.select("node", "n_shingles", F.posexplode(own_bands).alias("band", "value"))
    buckets = bands.groupBy("band", "value").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
    shared = durable(bands.join(buckets.select("band", "value", "first"), ["band", "value"]).select("band", "value", "node", "n_shingles", "first"), members)

    nearest = shared.where("node <> first").groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a"))
    links = verify(durable(_likely(nearest.select("a", "b"), classes, maybe), n), classes, docs, key, text, percent)
    roots = forest_roots(links.select(F.col("b").alias("node"), F.col("a").alias("parent")).distinct(), n)

    named = durable(shared.join(roots, "node", "left").select("band", "value", "node", F.coalesce("root", "node").alias("root"), "n_shingles"), members)
    mixed = named.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "value")
    more = durable(link_buckets(durable(named.join(mixed, ["band", "value"]), members), classes, docs, key, text, percent))
    if not more.isEmpty():
        joined = maybe_broadcast(components(more).select(F.col("node").alias("_from"), F.col("root").alias("_to")))
        own = classes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = own.join(joined, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root"))

    of_class = classes.select("digest", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = of_class.join(smallest, "root").select("digest", "root", "component_id")
    return rows.select("doc_id", "digest", "n_shingles").join(named, "digest", "left"), n


def find_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; other columns of docs, whatever their names, don't matter.

    Rows with the same words are one class, found by a digest, and links are sought between classes. Rows without words (null,
    empty or of white space only) have no shingles and are linked with nothing, not even with each other. component_id is the
    smallest doc_id of a component, and kept says whether the row has it; rows repeated under one doc_id are alike. A null doc_id
    is smaller than none: such rows are linked, but never kept beside others, and alone have a null component and aren't kept. Keys may
    be of any type that has an order; the smallest is the smallest in that order.
    Texts are compared whole: a very long one costs time and memory in proportion to its length, in one task. An empty table
    stays empty.
    """
    out, _ = named_rows(docs, key, text, percent)
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near copies, and all rows without words (null, empty or of white space only).

    Of a group the row with the smallest key stays; a null key comes after all others, and of rows with equal keys the one with
    the smallest digest stays. Rows are told apart by key and digest, so a key repeated with another text, or missing, neither
    takes that text away nor saves a copy. Of rows that agree in key and words too, the one that comes first as JSON stays, so
    reruns agree. Clashing columns, long texts and empty tables are as in find_components.
    """
    named, n = named_rows(docs, key, text, percent)
    named = durable(named.where("digest IS NOT NULL"), n)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("d"))
    best = named.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.id").alias("id"), F.col("best.d").alias("d"))
    pairs = named.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    # joined by key and digest: by root, a large group would be one task's
    both = pairs.join(best, pairs["doc_id"].eqNullSafe(best["id"]) & (pairs["digest"] == best["d"]), "left")
    judged = durable(both.select("doc_id", "digest", "n", F.col("d").isNotNull().alias("stays")), n)
    own, other, id_, d_ = free_names(docs, "digest", "row", "id", "of")
    rows = docs.withColumn(own, words_digest(F.col(text)))
    same = lambda t: F.col(key).eqNullSafe(t[id_]) & (F.col(own) == t[d_])
    gone = maybe_broadcast(judged.where("NOT stays").select(F.col("doc_id").alias(id_), F.col("digest").alias(d_)))
    left = rows.join(gone, same(gone), "left_anti")
    again = judged.where("stays AND n > 1").select(F.col("doc_id").alias(id_), F.col("digest").alias(d_))
    if again.isEmpty():
        return left.select(*docs.columns)
    again = maybe_broadcast(again)
    whole = F.struct(*docs.columns)
    one = left.join(again, same(again), "left_semi").groupBy(F.col(key), F.col(own)).agg(F.min_by(whole, F.to_json(whole)).alias(other)).select(f"{other}.*")
    return left.join(again, same(again), "left_anti").select(*docs.columns).unionByName(one)
