"""Keyword search: postings, document statistics and BM25 over batches of queries."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.sizes import durable, maybe_broadcast, small
from cairn.functions.text import STOPWORDS, TOKEN, tokenize

# Fixed values of the query semantics (Robertson and Zaragoza 2009).
K1, B = 1.5, 0.75
#: Terms of all queries together that are sent to the documents; more are joined.
QUERY_TERMS = 200_000
#: Scores that a task holds at a time, of all queries for some documents.
SCORES = 2_000_000
#: Texts whose counts leave a Python worker together.
SLICE = 500
_TOKEN = re.compile(TOKEN)


def tokens_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens, length of every document; one without tokens has length 0 and still counts."""
    return docs.select(F.col(key), tokenize(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens").cast("long"))


def postings(tokens: DataFrame, key: str = "doc_id", terms: DataFrame | None = None) -> DataFrame:
    """key, length, term, tf. With terms (a table with a column term), only for those: they are looked up before anything is
    shuffled, so the shuffle carries what the queries touch and not the corpus."""
    rows = tokens.select(key, "length", F.explode("tokens").alias("term"))
    if terms is not None:
        rows = rows.join(maybe_broadcast(terms), "term", "left_semi")
    return rows.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n documents and their mean length."""
    return tokens.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(posting: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf."""
    return posting.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # stats is one row


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, term, qtf: a term repeated in a query counts as often."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """query_id, key, score for every document that shares a term with a query, so that every score is positive.

    Counts of documents, their mean length and the terms' frequencies are those of all docs. keep, a condition on docs, limits
    only which documents are scored. A corpus without any token gives no rows.
    """
    tokens = tokens_of(docs, key, text)
    wanted = query_terms(queries)
    posting = postings(tokens, key, wanted.select("term").distinct())
    stats = corpus_stats(tokens)
    frequency = term_stats(posting, stats)
    scored = posting if keep is None else posting.join(docs.where(keep).select(key), key, "left_semi")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.nullif(F.col("mean_length"), F.lit(0.0))))
    matched = scored.join(maybe_broadcast(frequency), "term").crossJoin(F.broadcast(stats)).select(key, "term", part.alias("part"))
    return matched.join(maybe_broadcast(wanted), "term").groupBy("query_id", key).agg(F.sum(F.col("qtf") * F.col("part")).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "doc_id", score: str = "score", digits: int = 9, by: str = "query_id") -> DataFrame:
    """The k rows of each query with the highest scores, and their rank from 1. Scores that agree to so many digits tie and go by
    key: sums of floating point numbers come in no fixed order on a cluster. Each task keeps k rows a query before the shuffle."""
    order = W.partitionBy(by).orderBy(F.round(score, digits).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_counts(docs: DataFrame, terms: dict[str, int], key: str, text: str, keep: Column | None = None) -> DataFrame:
    """key, scored, length, terms, counts: of every document its number of tokens, and which of terms (numbered) it has how often.
    A document is one row from the scan on, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    stop = frozenset(STOPWORDS)

    @F.pandas_udf("length int, terms array<int>, counts array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            for i in range(0, max(len(texts), 1), SLICE):
                out = []
                for t in texts.iloc[i : i + SLICE]:
                    tokens = _TOKEN.findall(t.lower()) if t else []
                    got = Counter(map(known.get, tokens))
                    got.pop(None, None)
                    out.append((len(tokens) - sum(map(stop.__contains__, tokens)), list(got), list(got.values())))
                yield pd.DataFrame(out, columns=["length", "terms", "counts"])

    rows = docs.select(F.col(key).alias("key"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("scored"), run(F.col(text)).alias("c"))
    return rows.select("key", "scored", "c.*")


def best_keys(scores: np.ndarray, order: np.ndarray, k: int, digits: int = 9) -> np.ndarray:
    """For each row of scores the columns of its k best: by rounded score, then by order, which numbers the columns."""
    rounded = scores.round(digits)
    if scores.shape[1] > 4 * k:  # the k-th best score bounds what needs sorting
        least = np.partition(rounded, scores.shape[1] - k, axis=1)[:, -k]
        near = np.flatnonzero((rounded >= least[:, None]).any(0))
        return near[np.lexsort((np.broadcast_to(order[near], (len(scores), len(near))), -rounded[:, near]), axis=1)[:, :k]]
    return np.lexsort((np.broadcast_to(order, scores.shape), -rounded), axis=1)[:, :k]


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", keep: Column | None = None, query_terms_at_most: int = QUERY_TERMS) -> DataFrame:
    """query_id, key, score, rank: BM25's k best documents for every query; see bm25_scores() for what counts.

    The queries' terms are sent to the texts, which are read once: what they have of those terms is written down, a row a document,
    and gives the corpus' statistics too. Scoring reads that narrow table, and a task returns its k best documents a query; so no
    pair of a query and a document that merely share a term is ever a row. Queries of more than query_terms_at_most terms are
    joined instead.
    """
    wanted = durable(query_terms(queries))
    if not small(wanted, query_terms_at_most):
        return top_k(bm25_scores(docs, queries, key, text, keep), k, key)
    rows = wanted.orderBy("query_id", "term").collect()  # query_terms_at_most bounds it
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    ids = sorted({r["query_id"] for r in rows if r["query_id"] is not None}) + ([None] if any(r["query_id"] is None for r in rows) else [])
    place = {q: i for i, q in enumerate(ids)}
    counts = durable(term_counts(docs, terms, key, text, keep))
    total = counts.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    df = np.zeros(len(terms))
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row a term of the queries
        df[r["t"]] = r["n"]
    weight = np.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
    asks = defaultdict(list)
    for r in rows:
        asks[terms[r["term"]]].append((place[r["query_id"]], r["qtf"] * weight[terms[r["term"]]]))
    first = np.cumsum([0, *(len(asks[t]) for t in range(len(terms)))])
    who, worth = (np.array([x[c] for t in range(len(terms)) for x in asks[t]], kind) for c, kind in ((0, np.int64), (1, float)))
    shared = docs.sparkSession.sparkContext.broadcast((first, who, worth))
    mean, step = total["mean"] or 1.0, max(1, SCORES // max(len(ids), 1))

    def cuts(b: pd.DataFrame, first: np.ndarray) -> Iterator[pd.DataFrame]:
        """Of at most step documents, and of no more postings, each counted for every query that asks for its term, than SCORES / 2 and one document's."""
        load = np.cumsum([int((first[np.asarray(t) + 1] - first[np.asarray(t)]).sum()) for t in b["terms"]])
        i = 0
        while i < len(b):
            n = int(np.searchsorted(load, (load[i - 1] if i else 0) + SCORES // 2, "right"))
            yield b.iloc[i : (i := min(max(n, i + 1), i + step))]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, who, worth = shared.value
        for b in batches:
            for part in cuts(b, first):
                size = part["terms"].map(len).to_numpy()
                t, tf = (np.concatenate(part[c].to_numpy()).astype(float) for c in ("terms", "counts"))
                t, doc = t.astype(int), np.repeat(np.arange(len(part)), size)
                length = part["length"].to_numpy(float)[doc]
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                n = first[t + 1] - first[t]  # each posting goes to the queries that ask for its term
                at = np.repeat(first[t] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                flat = who[at] * len(part) + np.repeat(doc, n)
                scores = np.bincount(flat, np.repeat(value, n) * worth[at], len(ids) * len(part)).reshape(len(ids), len(part))
                keys = part["key"]
                order = keys.rank(method="first").to_numpy()
                best = best_keys(scores, order, k)
                got = np.take_along_axis(scores, best, 1)
                q, c = np.nonzero(got > 0)
                yield pd.DataFrame({"q": q, "key": keys.to_numpy()[best[q, c]], "score": got[q, c]})

    kind = docs.schema[key].dataType.simpleString()
    found = counts.where("scored AND size(terms) > 0").select("key", "length", "terms", "counts").mapInPandas(score, f"q int, key {kind}, score double")
    names = docs.sparkSession.createDataFrame([(i, q) for i, q in enumerate(ids)], f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    hits = top_k(found, k, "key", by="q").join(F.broadcast(names), "q")  # fewer than query_terms_at_most queries
    return hits.select("query_id", F.col("key").alias(key), "score", "rank")
