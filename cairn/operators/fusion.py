"""Fusion of ranked lists, reranking and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.dense import vector_search
from cairn.operators.lexical import keyword_search, top_k

# Fixed values of the query semantics (Cormack, Clarke and Büttcher 2009 for RRF).
RRF_K, CANDIDATES, TOP_K = 60, 20, 5
ENSEMBLE = (0.7, 0.3)
RERANK_FROM, RERANK_TO = 20, 4


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = TOP_K, weights: tuple[float, float] = (1.0, 1.0), key: str = "chunk_id", rrf_k: int = RRF_K) -> DataFrame:
    """query_id, key, score, vector_rank, keyword_rank, vector_score, keyword_score, rank: weighted reciprocal rank fusion of two
    lists (query_id, key, score, rank). Ties: hits of the vector list by their rank, then the others by theirs."""
    name = lambda df, p: df.select("query_id", key, F.col("rank").alias(f"{p}_rank"), F.col("score").alias(f"{p}_score"))
    both = name(vector_hits, "vector").join(name(keyword_hits, "keyword"), ["query_id", key], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (rrf_k + F.col(r)), F.lit(0.0))
    scored = both.withColumn("score", part(weights[0], "vector_rank") + part(weights[1], "keyword_rank"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: DataFrame, key: str = "content", rrf_k: int = RRF_K) -> DataFrame:
    """query_id, key, score, rank from any number of lists (query_id, list_id, key, rank), by key; ties by key."""
    scored = lists.groupBy("query_id", key).agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order))


def ensemble(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, key: str = "chunk_id", weights: tuple[float, float] = ENSEMBLE) -> DataFrame:
    return fuse(vector_hits, keyword_hits, k, weights, key)


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, candidates: int = CANDIDATES, where: Column | None = None, key: str = "chunk_id", text: str = "text", vector: str = "embedding", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """fuse(), by weights, of vector and keyword search for a batch of queries (query_id, query, vector). where limits the vector search before
    its candidates are chosen, and what the keyword search scores, but not its statistics of the corpus."""
    near = vector_search(chunks, queries, candidates, key, vector, where)
    found = keyword_search(chunks, queries, candidates, key, text, where)
    return fuse(near, found, k, weights, key)


def hydrate(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with their chunks' columns; a hit without a chunk is left out, after the limit, so fewer than k may come back."""
    return hits.join(chunks, key)


def rerank(pairs: DataFrame, scorer, top_n: int = RERANK_TO, key: str = "chunk_id") -> DataFrame:
    """The top_n candidates of each query (query_id, key, query, text, rank) by a scorer of (query, text), ties by rank.

    Candidates are bounded by the retrieval before; scorer is an expression or a Pandas UDF of two columns.
    """
    scored = pairs.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("rank"))
    return scored.withColumn("rerank", F.row_number().over(order)).where(F.col("rerank") <= top_n)


def search_all(chunks: DataFrame, variations: DataFrame, k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Multi-query search: every variation (query_id, list_id, query) is searched by itself and the lists are fused per query_id.
    The original question is only searched if it is among the variations."""
    own = variations.withColumn("_q", F.concat_ws("/", F.col("query_id").cast("string"), F.col("list_id").cast("string")))
    hits = keyword_search(chunks, own.select(F.col("_q").alias("query_id"), "query"), k, key, text).withColumnRenamed("query_id", "_q")
    return reciprocal_rank_fusion(hits.join(own.select("_q", F.col("query_id"), "list_id"), "_q"), key)


__all__ = ["ensemble", "fuse", "hybrid_search", "hydrate", "reciprocal_rank_fusion", "rerank", "search_all", "top_k"]
