"""A stored vector index: an inverted file of centroids with product codes of the residuals (Jégou, Douze and Schmid 2011).

An index is a folder: model (centroids and code books, a row each) and rows (a Parquet folder for each list, with key, vector,
code and the code's error). A search reads the codes of the lists that its queries probe, and vectors only of what it reranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.sizes import durable, maybe_broadcast
from cairn.functions.vectors import cosine
from cairn.operators.dense import SCORES, Nearest, _unit, vector_search
from cairn.operators.lexical import top_k

#: Vectors that centroids and code books are fitted on, at most; they are chosen by a hash of their key. Every row is indexed.
SAMPLE = 50_000
#: Lists at most; without a number given there are as many as the square root of the rows says.
MOST_LISTS = 4_096
#: Bytes of a code, each of which numbers one of so many code words for its part of the dimensions.
PARTS, WORDS = 16, 256
#: Candidates of a query, in multiples of k, that are compared exactly.
RERANK = 8
#: How many lists a query probes is measured when an index is built: as few as find this share of the nearest TRUE_K rows of so many
#: of the rows, chosen by a hash of their key. Where vectors have no structure, that is most lists.
RECALL, TRUE_K, TRIALS = 0.97, 20, 200
#: Queries that are sent to the rows at a time.
SCAN_QUERIES = 20_000


class Model(NamedTuple):
    """Unit centroids (lists x dimensions), and for each part of the dimensions its code words (words x dimensions of the part)."""

    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int = 0

    def edges(self) -> list[int]:
        return [0, *np.cumsum([b.shape[1] for b in self.books])]


def _kmeans(x: np.ndarray, k: int, seed: int, cosine_: bool = False, rounds: int = 15) -> np.ndarray:
    """k means of the rows of x (their directions with cosine_), from seeded rows; an empty mean moves to the row that is worst served."""
    k = min(k, len(x))
    means = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = x @ means.T - (0 if cosine_ else (means * means).sum(1) / 2)
        of = near.argmax(1)
        total, n = np.zeros_like(means), np.bincount(of, minlength=k)
        np.add.at(total, of, x)
        worst = np.argsort(near[np.arange(len(x)), of])
        total[n == 0] = x[worst[: (n == 0).sum()]]
        means = total / np.maximum(n, 1)[:, None]
        if cosine_:
            means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return means


def fit(corpus: DataFrame, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE, parts: int = PARTS, seed: int = 7) -> Model:
    """Centroids and code books from a sample of at most so many rows, chosen by a hash of the key. Rows without a vector don't count."""
    rows = corpus.where(F.col(vector).isNotNull())
    n = rows.count()
    if not n:
        raise ValueError("an index needs a row with a vector")
    h = F.xxhash64(F.col(key))
    some = rows.where(F.pmod(h, F.lit(max(1, n // (2 * sample)))) == 0).orderBy(h, F.col(key)).limit(sample)
    x = _unit(r["v"] for r in some.select(F.col(vector).alias("v")).collect())  # at most sample rows
    centroids = _kmeans(x, min(lists or max(1, int(n**0.5)), MOST_LISTS), seed, True)
    rest = x - centroids[(x @ centroids.T).argmax(1)]
    return Model(centroids, [_kmeans(p, WORDS, seed + 1) for p in np.array_split(rest, min(parts, x.shape[1]), axis=1)])


def encode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The list, the code and the code's error, that is the distance from what the code stands for, of unit vectors."""
    of = (x @ model.centroids.T).argmax(1)
    rest, edges = x - model.centroids[of], model.edges()
    codes = np.zeros((len(x), len(model.books)), np.uint8)
    left = np.zeros(len(x))
    for m, book in enumerate(model.books):
        part = rest[:, edges[m] : edges[m + 1]]
        codes[:, m] = (part @ book.T - (book * book).sum(1) / 2).argmax(1)
        left += ((part - book[codes[:, m]]) ** 2).sum(1)
    return of, codes, np.sqrt(left)


def assign(corpus: DataFrame, model: Model, key: str, vector: str) -> DataFrame:
    """list, key, vector, code, error, near (cosine with the list's centroid) of all rows that have a vector."""
    shared = corpus.sparkSession.sparkContext.broadcast(model)  # MOST_LISTS bounds it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(b["vector"])
                of, codes, error = encode(shared.value, x)
                near = (x * shared.value.centroids[of]).sum(1)
                yield pd.DataFrame({"list": of, "key": b["key"], "vector": b["vector"], "code": [c.tobytes() for c in codes], "error": error, "near": near})

    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, f"list int, key {kinds['key']}, vector {kinds['vector']}, code binary, error double, near double")


def _add(rows: DataFrame, path: str) -> None:
    """Rows of a list are dealt to several tasks, so that a list which holds much of the corpus is not one task's."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    rows.repartition("list", F.pmod(F.xxhash64("key"), F.lit(parts))).write.partitionBy("list").mode("append").parquet(f"{path}/rows")


def build(corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, **fitted) -> None:
    """Writes an index of all rows of corpus that have a vector to an empty path, and measures how many lists to probe; fitted: see fit()."""
    spark, model = corpus.sparkSession, fit(corpus, key, vector, **fitted)
    tables = [(-1, i, c.tolist()) for i, c in enumerate(model.centroids)] + [(m, i, w.tolist()) for m, book in enumerate(model.books) for i, w in enumerate(book)]
    _add(assign(corpus, model, key, vector), path)
    tables.append((-2, 0, [float(calibrate(spark, path, model, recall))]))
    spark.createDataFrame(tables, "part int, number int, value array<double>").coalesce(1).write.parquet(f"{path}/model")


def calibrate(spark: SparkSession, path: str, model: Model, recall: float = RECALL, trials: int = TRIALS) -> int:
    """The fewest lists to probe with which that share of the TRUE_K nearest rows lies in probed lists, for a sample of the rows as queries,
    each of which is compared with all rows."""
    rows = spark.read.parquet(f"{path}/rows")
    h = F.xxhash64(F.lit(1), F.col("key"))
    few = rows.where(F.pmod(h, F.lit(max(1, rows.count() // (20 * trials)))) == 0).orderBy(h, "key").limit(trials).select("key", "vector").collect()
    queries = spark.createDataFrame([(i, [float(x) for x in r["vector"]]) for i, r in enumerate(few)], "query_id long, vector array<double>")
    near = vector_search(rows, queries, TRUE_K + 1, "key", "vector").where("rank > 1")  # the first is the row itself, or equal to it
    found = near.join(rows.select("key", "list"), "key").select("query_id", "list").collect()  # TRUE_K rows a trial
    order = np.argsort(-(_unit(r["vector"] for r in few) @ model.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    ranks = np.sort([place[r["query_id"], r["list"]] for r in found])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else len(model.centroids)


def load(spark: SparkSession, path: str) -> Model:
    """The index's model; it is bounded by MOST_LISTS and WORDS."""
    by = {}
    for r in spark.read.parquet(f"{path}/model").orderBy("part", "number").collect():
        by.setdefault(r["part"], []).append(r["value"])
    return Model(np.array(by[-1]), [np.array(by[m]) for m in sorted(by) if m >= 0], int(by[-2][0][0]))


def add(corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """Adds rows to an index, under the centroids and code books that it has: only their own files are written."""
    _add(assign(corpus, load(corpus.sparkSession, path), key, vector), path)


def pruned(spark: SparkSession, path: str, lists: list[int], *columns: str) -> DataFrame:
    """Those columns of some lists; the other lists' folders are not read."""
    return spark.read.parquet(f"{path}/rows").where(F.col("list").isin(lists)).select(*columns)


def _scan(rows: DataFrame, model: Model, ids: np.ndarray, matrix: np.ndarray, probes: dict[int, np.ndarray], keep: int, floor: np.ndarray | None) -> DataFrame:
    """query_id, key, score, list of each task's keep best rows a query among rows (list, key, code, error, with floor vector too).

    Without floor, scores are what the codes say. With floor, a score for each query, all rows that may reach that are compared
    exactly: a code's score is wrong by its error at most, as queries have length one.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model, ids, matrix, probes, floor))  # SCAN_QUERIES and MOST_LISTS bound it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, ids, matrix, probes, floor = shared.value
        edges, best = model.edges(), Nearest(len(ids), keep)
        for b in batches:
            for number, own in b.sort_values("key").groupby("list"):
                asking = probes.get(number, np.zeros(0, int))
                codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), len(model.books))
                keys, error = own["key"].to_numpy(), own["error"].to_numpy()
                exact = None if floor is None else _unit(own["vector"]).T
                step = max(1, SCORES // len(own))
                for i in range(0, len(asking), step):
                    who = asking[i : i + step]
                    q = matrix[who]
                    scores = np.repeat((q @ model.centroids[number])[:, None], len(own), 1)
                    for m, book in enumerate(model.books):
                        scores += (q[:, edges[m] : edges[m + 1]] @ book.T)[:, codes[:, m]]
                    if floor is None:
                        best.offer(who, scores, keys, number)
                        continue
                    good = scores + error >= floor[who][:, None] - 1e-9
                    some = np.flatnonzero(good.any(0))
                    best.offer(who, q @ exact[:, some], keys[some], number, good[:, some])
            best.settle()
        yield from best.frames(ids, "key", "list")

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"query_id long, key {kind}, score double, list int")


def _rerank(spark: SparkSession, path: str, candidates: DataFrame, asked: DataFrame, lists: list[int], k: int) -> DataFrame:
    """query_id, key, score, rank: the k best of candidates (query_id, list, key) by exact cosine; only their vectors are compared."""
    vectors = pruned(spark, path, lists, "list", "key", "vector")
    pairs = vectors.join(maybe_broadcast(durable(candidates.select("query_id", "list", "key"))), ["list", "key"]).join(maybe_broadcast(asked), "query_id")
    return top_k(pairs.select("query_id", "key", F.coalesce(cosine(F.col("_q"), F.col("vector")), F.lit(0.0)).alias("score")), k, "key")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, key: str = "vec_id", probes: int | None = None, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """query_id, key, score, rank: about the k nearest rows by cosine of every query (query_id, vector), or with exact just those.

    Each query probes the lists of its nearest centroids, as many as build() has found to be needed. The codes of all probed lists are read, not the vectors, and the best
    rerank * k candidates a query are compared exactly. With exact, the k-th score so found is a floor: a list is read too if
    its widest row could reach that (by the angle of the query to the centroid, less that of the row), and in a list a row is
    compared if its code's score and error could. So the result is that of comparing all, whatever the data; how much is skipped
    depends on them. Ties go by key; queries without a vector find nothing; more than SCAN_QUERIES take several passes.
    """
    model = load(spark, path)
    probes = probes or model.probes
    if exact:
        widest = {r["list"]: r["near"] for r in spark.read.parquet(f"{path}/rows").groupBy("list").agg(F.min("near").alias("near")).collect()}  # a row a list
    out, block = None, []

    def search_block(block: list) -> DataFrame:
        ids, matrix = np.array([i for i, _ in block]), _unit([v for _, v in block])
        asked = spark.createDataFrame(block, "query_id long, _q array<double>")
        near = matrix @ model.centroids.T
        first = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        by_list = lambda pairs: {int(n): np.unique(pairs[0][pairs[1] == n]) for n in np.unique(pairs[1])}
        wanted = by_list((np.repeat(np.arange(len(ids)), first.shape[1]), first.ravel()))
        rows = pruned(spark, path, sorted(wanted), "list", "key", "code", "error")
        hits = top_k(_scan(rows, model, ids, matrix, wanted, rerank * k, None), rerank * k, "key").drop("rank")
        found = _rerank(spark, path, hits, asked, sorted(wanted), k)
        if not exact:
            return found
        least = {r["query_id"]: r["s"] for r in found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("s")).collect()}  # a row a query of the block
        floor = np.array([-2.0 if least.get(i) is None else least[i] for i in ids.tolist()])
        angle = np.arccos(np.clip(near, -1, 1)) - np.array([np.arccos(np.clip(widest.get(n, 1.0), -1, 1)) for n in range(len(model.centroids))])
        reach = np.where(angle <= 0, 1.0, np.cos(np.clip(angle, 0, np.pi))) + 1e-9 >= floor[:, None]
        reach[:, [n for n in range(len(model.centroids)) if n not in widest]] = False
        wanted = by_list(np.nonzero(reach))
        rows = pruned(spark, path, sorted(wanted), "list", "key", "code", "error", "vector")
        return top_k(_scan(rows, model, ids, matrix, wanted, k, floor).drop("list"), k, "key")

    for r in queries.select(F.col("query_id").cast("long").alias("i"), F.col("vector").alias("v")).where("v IS NOT NULL").toLocalIterator():
        block.append((r["i"], [float(x) for x in r["v"]]))
        if len(block) == SCAN_QUERIES:
            out, block = (search_block(block) if out is None else out.unionAll(search_block(block))), []
    if block:
        out = search_block(block) if out is None else out.unionAll(search_block(block))
    kind = spark.read.parquet(f"{path}/rows").schema["key"].dataType.simpleString()
    return (spark.createDataFrame([], f"query_id long, key {kind}, score double, rank int") if out is None else out).withColumnRenamed("key", key)
