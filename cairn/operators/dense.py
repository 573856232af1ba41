"""Exact vector search, diversification and redundancy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.vectors import cosine
from cairn.operators.lexical import top_k

# Fixed values of the query semantics.
FETCH_K, MMR_K, LAMBDA = 25, 5, 0.5
#: Query vectors in one pass over the corpus, to which they are sent, and scores of one matrix product.
SCAN_QUERIES, SCORES = 50_000, 2_000_000


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(x, float) for x in rows])
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


class Nearest:
    """The k best rows of each query so far, as one task meets them: by rounded score, then by key. It holds k rows a query."""

    def __init__(self, queries: int, k: int, digits: int = 9):
        self.k, self.digits, self.least = k, digits, np.full(queries, -np.inf)
        self.held, self.waiting = None, []

    def offer(self, who: np.ndarray, scores: np.ndarray, keys: np.ndarray, tag: int = 0, good: np.ndarray | None = None) -> None:
        """scores: who x keys, of which only those in good count, and no NaN; keys ascend. What cannot be among a query's k best is left
        out at once: of scores below its k-th best so far, and of equal ones behind the k-th."""
        rounded, k = scores.round(self.digits), self.k
        rounded[np.isnan(rounded) if good is None else np.isnan(rounded) | ~good] = -np.inf
        least = self.least[who]
        if rounded.shape[1] > 4 * k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(rounded, rounded.shape[1] - k, axis=1)[:, -k])
        above = rounded > least[:, None]
        for found in (above, (rounded == least[:, None]) & (rounded > -np.inf)):
            q, c = np.nonzero(found)
            if found is not above:
                few = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, c = q[few], c[few]
            self.waiting.append((who[q], scores[q, c], keys[c], np.full(len(q), tag)))
        if sum(len(w[0]) for w in self.waiting) > SCORES:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        who, score, key, tag = (np.concatenate(x) for x in zip(*([self.held] if self.held else []), *self.waiting, strict=True))
        rounded = score.round(self.digits)
        order = np.lexsort((pd.Series(key).rank(method="dense").to_numpy(), -rounded, who))
        nth = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order, last = order[nth < self.k], order[nth == self.k - 1]
        self.least[who[last]] = rounded[last]
        self.held, self.waiting = (who[order], score[order], key[order], tag[order]), []

    def frames(self, ids: np.ndarray, key: str, tag: str | None = None) -> Iterator[pd.DataFrame]:
        self.settle()
        for i in range(0, len(self.held[0]) if self.held else 0, SCORES // 10):
            who, score, keys, tags = (x[i : i + SCORES // 10] for x in self.held)
            yield pd.DataFrame({"query_id": ids[who], key: keys, "score": score} | ({tag: tags} if tag else {}))


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """query_id, key, score, rank: the k nearest rows of corpus by cosine for every query (query_id, vector).

    where limits the rows that are searched, before the k are chosen, and reaches the scan. Every batch of rows is compared with
    a block of queries in one matrix product of at most SCORES scores, and a task's k best a query leave it; so a task holds, and the
    shuffle carries from it, k rows a query, whatever the size of the corpus. More than SCAN_QUERIES queries take several passes. Rows without a vector are
    not found; ties go by key, which may be of any type that has an order.
    """
    rows = (corpus if where is None else corpus.where(where)).where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    kind = corpus.schema[key].dataType.simpleString()
    schema = f"query_id long, `{key}` {kind}, score double"
    out, block = None, []

    def search(block: list) -> DataFrame:
        ids, matrix = np.array([i for i, _ in block]), _unit([v for _, v in block])
        shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))  # SCAN_QUERIES bounds it

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            best = Nearest(len(ids), k)
            for b in batches:
                if not len(b):
                    continue
                b = b.sort_values("key")
                own, keys, step = _unit(b["vector"]).T, b["key"].to_numpy(), max(1, SCORES // len(b))
                for i in range(0, len(ids), step):
                    near = matrix[i : i + step] @ own
                    best.offer(np.arange(i, i + len(near)), near, keys)
                best.settle()
            yield from best.frames(ids, key)

        return rows.mapInPandas(run, schema)

    for r in queries.select(F.col("query_id").cast("long").alias("i"), F.col("vector").alias("v")).where("v IS NOT NULL").toLocalIterator():
        block.append((r["i"], r["v"]))
        if len(block) == SCAN_QUERIES:
            out, block = (search(block) if out is None else out.unionAll(search(block))), []
    if block or out is None:
        found = search(block) if block else corpus.sparkSession.createDataFrame([], schema)
        out = found if out is None else out.unionAll(found)
    return top_k(out, k, key)


def mmr_pick(query: np.ndarray, vectors: np.ndarray, k: int = MMR_K, trade: float = LAMBDA) -> list[int]:
    """Indexes of up to k rows of vectors: first the most relevant, then in turn the one whose relevance outweighs its likeness to
    those picked; ties to the lowest index."""
    v = _unit(vectors) if len(vectors) else np.zeros((0, len(query)))
    relevance, alike = (v @ _unit([query])[0]), v @ v.T
    picked: list[int] = []
    most = np.full(len(v), -np.inf)
    for _ in range(min(k, len(v))):
        worth = relevance if not picked else trade * relevance - (1 - trade) * most
        worth = worth.round(9)
        worth[picked] = -np.inf
        picked.append(int(np.argmax(worth)))
        most = np.maximum(most, alike[picked[-1]])
    return picked


def mmr_search(corpus: DataFrame, queries: DataFrame, k: int = MMR_K, fetch_k: int = FETCH_K, trade: float = LAMBDA, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """query_id, key, score, candidate_rank, pick_order: maximal marginal relevance over each query's fetch_k nearest rows
    (Carbonell and Goldstein 1998). A group is one query's candidates."""
    near = vector_search(corpus, queries, fetch_k, key, vector, where)
    kind = corpus.schema[key].dataType.simpleString()
    rows = near.join(corpus.select(key, F.col(vector).alias("_v")), key).join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("_q")), "query_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        picked = mmr_pick(np.asarray(group["_q"].iloc[0], float), np.stack([np.asarray(x, float) for x in group["_v"]]), k, trade)
        out = group.loc[picked, ["query_id", key, "score", "rank"]].rename(columns={"rank": "candidate_rank"})
        return out.assign(pick_order=np.arange(1, len(picked) + 1, dtype=np.int32))

    return rows.groupBy("query_id").applyInPandas(run, f"query_id long, `{key}` {kind}, score double, candidate_rank int, pick_order int")


def redundancy(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """group, redundancy: the mean cosine between different rows of a group, 0 for fewer than two.

    The mean over all ordered pairs is (|sum of unit vectors| ** 2 - n) / (n (n - 1)), so no pairs are formed: a group is added
    up by dimension, where its rows are. Rows with a zero vector count with cosine 0.
    """
    from cairn.functions.vectors import normalise

    unit = rows.select(group, key, F.posexplode(normalise(F.col(vector))).alias("i", "x"))
    squares = unit.groupBy(group, key).agg(F.sum(F.col("x") * F.col("x")).alias("own")).groupBy(group).agg(F.count("*").alias("n"), F.sum("own").alias("own"))
    total = unit.groupBy(group, "i").agg(F.sum("x").alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    mean = (F.col("all") - F.col("own")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)).cast("double")
    return squares.join(total, group).select(group, F.coalesce(mean, F.lit(0.0)).alias("redundancy"))


def similarity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with the cosine of two vector columns in similarity."""
    return rows.withColumn("similarity", cosine(F.col(a), F.col(b)))
