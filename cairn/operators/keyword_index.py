"""A stored inverted index with block maxima, for BM25 without reading the texts.

Documents lie in segments of some dozens, each of one source. A row holds a term's postings in one segment, with the greatest term
frequency and the shortest document there, from which the most that the term can add in the segment follows for any mean length.
A search first reads these two numbers only; postings of segments that cannot reach the k-th best score are never read
(block-max pruning; Mallia, Suel and Tonellotto 2024). Rows are a versioned table, replaced by source.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.sizes import durable, maybe_broadcast
from cairn.functions.text import STOPWORDS, TOKEN
from cairn.operators.lexical import K1, QUERY_TERMS, B, idf, query_terms, top_k
from cairn.sources.versions import VersionedTable

#: Documents of a segment on average, and segments that are scored first, those of the greatest bounds, to get a score to beat.
SEGMENT, FIRST = 64, 8
#: Segments that are scored together, and scores that are added up at a time.
TOGETHER, PARTS = 32, 2_000_000
#: Pairs of a query and a segment up to which all are scored at once, as a second round would cost more than it could skip.
ONE_ROUND = 50_000
#: Folders of an index; rows of a term lie in one of them.
BUCKETS = 32
_TOKEN = re.compile(TOKEN)


def _schema(key: str) -> str:
    return f"source string, segment long, term string, n int, most int, least long, words long, keys array<{key}>, counts array<int>, lengths array<long>"


def open_index(spark: SparkSession, path: str, key: str = "bigint") -> VersionedTable:
    """The table of an index whose documents' keys are of that type."""
    return VersionedTable(spark, path, _schema(key), bucket_by="term", buckets=BUCKETS)


def segments(docs: DataFrame, key: str, source: str, size: int = SEGMENT) -> DataFrame:
    """docs with segment: a source's documents are dealt by a hash of their key to as many segments as its number asks for."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.ceil(F.count("*") / size).alias("_parts"))
    dealt = docs.join(maybe_broadcast(counts), F.col(source).eqNullSafe(F.col("_source")))
    return dealt.withColumn("segment", F.xxhash64(F.col(source), F.pmod(F.xxhash64(F.col(key)), F.col("_parts")))).drop("_source", "_parts")


def invert(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: int = SEGMENT) -> DataFrame:
    """The index's rows: one for each segment and term, and one with null term for a segment's documents and their words.

    A segment's texts meet in one task, some dozens of them whatever the source's size; a document without a token counts.
    Postings leave Python as Arrow lists over flat arrays: a list object for each term would take longer than finding the words.
    """
    stop, kind = frozenset(STOPWORDS), docs.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        names, terms, counts, size, lengths = {}, [], [], [], []
        for t in group["text"].to_pylist():
            found = Counter(_TOKEN.findall(t.lower())) if t else Counter()
            for w in stop.intersection(found):
                del found[w]
            size.append(len(found))
            lengths.append(sum(found.values()))
            terms += [names.setdefault(w, len(names)) for w in found]
            counts += found.values()
        order = np.argsort(np.array(terms, np.int64), kind="stable")
        doc, tf = np.repeat(np.arange(len(size)), size)[order], np.array(counts, np.int32)[order]
        own, n = np.array(lengths, np.int64)[doc], np.bincount(np.array(terms, np.int64), minlength=len(names))
        ends = np.append(0, np.cumsum(n))
        # behind the terms the row of the segment itself, without postings
        offsets, zero = pa.array(np.append(ends, ends[-1]), pa.int32()), np.zeros(1, np.int64)
        most, least = (f.reduceat(x, ends[:-1]) if len(names) else zero[:0] for f, x in ((np.maximum, tf), (np.minimum, own)))
        keys = group["key"].combine_chunks().take(pa.array(doc))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys, pa.array(tf, pa.int32()), pa.array(own, pa.int64()))]
        every = lambda c: group[c].combine_chunks().take(pa.array(np.zeros(len(names) + 1, np.int64)))
        columns = [
            every("source"), every("segment"), pa.array([*names, None], pa.string()), pa.array(np.append(n, len(size)), pa.int32()), pa.array(np.append(most, 0), pa.int32()), pa.array(np.append(least, 0), pa.int64()),
            pa.array(np.append(np.zeros(len(names), np.int64), sum(lengths)), pa.int64()), *lists]
        return pa.table(columns, [f.split(" ")[0] for f in _schema(kind).split(", ")])

    rows = segments(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")), "key", "source", size)
    return rows.groupBy("source", "segment").applyInArrow(run, _schema(kind))


def replace_sources(index: VersionedTable, docs: DataFrame, gone: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", size: int = SEGMENT) -> int:
    """Puts docs in place of what the index has of their sources and of those in gone (source); other sources' rows are not touched."""
    rows = invert(docs, key, text, source, size)  # made once: the keys come from docs, whose every source has rows
    return index.replace(rows.repartition(index.buckets, index.bucket(F.col("term"))), gone, sort=("term", "segment"), keys=docs.select(F.col(source).alias(index.by)))


def _statistics(live: DataFrame) -> tuple[int, float, int]:
    """The number of documents, their mean length, and the number of segments."""
    row = live.where("term IS NULL").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.count("*").alias("segments")).first()
    return row["n"] or 0, (row["words"] or 0) / row["n"] if row["n"] else 0.0, row["segments"]


def _part(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def bounds(live: DataFrame, asked: DataFrame, mean: float) -> DataFrame:
    """query_id, segment, bound: what a document of the segment can score at most. Postings are not read for it."""
    blocks = live.select("term", "segment", _part(F.col("most").cast("double"), F.col("least").cast("double"), mean).alias("most"))
    return blocks.join(asked, "term").groupBy("query_id", "segment").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 and so on, n[i] of them, one i behind the other."""
    return np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _score(blocks: DataFrame, asked: list, pairs: DataFrame, floor: dict | None, mean: float, k: int, kind: str, groups: int) -> DataFrame:
    """q, key, score: of each pair (q, segment) the documents among the k best that score floor[q] or more. Some segments meet in one
    task, whole; what their postings give is added up for so many queries at a time that PARTS, or a query's share, bounds it."""
    by_term = defaultdict(list)
    for q, term, weight in asked:
        by_term[term].append((q, weight))
    names = {t: i for i, t in enumerate(by_term)}
    first = np.cumsum([0, *map(len, by_term.values())])
    who, worth = (np.array([x[c] for own in by_term.values() for x in own], t) for c, t in ((0, np.int64), (1, float)))
    queries = int(who.max()) + 1 if len(who) else 1
    shared = blocks.sparkSession.sparkContext.broadcast((names, first, who, worth, floor))  # QUERY_TERMS bounds it
    schema = f"q long, key {kind}, score double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, first, who, worth, floor = shared.value
        heads, rows = group[group["term"].isna()], group[group["term"].notna()]
        if rows.empty:
            return pd.DataFrame({"q": [], "key": [], "score": []})
        known = np.unique(heads["segment"])
        wanted = np.unique(np.concatenate([i * queries + np.asarray(qs, np.int64) for i, qs in zip(np.searchsorted(known, heads["segment"]), heads["qs"], strict=True)]))
        size = rows["counts"].map(len).to_numpy()
        begin = np.append(0, np.cumsum(size)[:-1])
        tf, length = (np.concatenate(rows[c].to_numpy()).astype(float) for c in ("counts", "lengths"))
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        keys, doc = np.unique(np.concatenate(rows["keys"].to_numpy()), return_inverse=True)
        term = rows["term"].map(names).to_numpy()
        n = first[term + 1] - first[term]
        row, ask = np.repeat(np.arange(len(rows)), n), _spread(first[term], n)
        good = np.isin(np.searchsorted(known, rows["segment"])[row] * queries + who[ask], wanted)
        order = np.argsort(who[ask[good]], kind="stable")
        row, ask = row[good][order], ask[good][order]
        q, out = who[ask], []
        load, at = np.cumsum(size[row]), 0
        while at < len(row):
            upto = int(np.searchsorted(load, (load[at - 1] if at else 0) + PARTS, "right"))
            upto = int(np.searchsorted(q, q[max(upto - 1, at)], "right")) if upto < len(row) else len(row)  # whole queries
            r, a, m = row[at:upto], ask[at:upto], size[row[at:upto]]
            place = _spread(begin[r], m)
            cells, own = np.unique(np.repeat(q[at:upto], m) * len(keys) + doc[place], return_inverse=True)  # only queries and documents that share a term
            score = np.bincount(own, np.repeat(worth[a], m) * value[place])
            of, d = cells // len(keys), cells % len(keys)
            if floor is not None:
                keep = score >= np.array([floor.get(i, 0.0) for i in range(queries)])[of] - 1e-8
                of, d, score = of[keep], d[keep], score[keep]
            order = np.lexsort((d, -score.round(9), of))
            of, d, score = of[order], d[order], score[order]
            best = np.arange(len(of)) - np.searchsorted(of, of) < k
            out.append(pd.DataFrame({"q": of[best], "key": keys[d[best]], "score": score[best]}))
            at = upto
        return pd.concat(out) if out else pd.DataFrame({"q": [], "key": [], "score": []})

    heads = pairs.groupBy("segment").agg(F.collect_set("q").alias("qs"))
    rows = blocks.select("segment", "term", "keys", "counts", "lengths").join(maybe_broadcast(heads.select("segment")), "segment", "left_semi").withColumn("qs", F.lit(None).cast("array<long>"))
    null = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema if f.name not in ("segment", "qs")}
    both = rows.unionByName(heads.withColumns(null))
    return both.groupBy(F.pmod("segment", F.lit(groups)).alias("_g")).applyInPandas(run, schema)


def search(index: VersionedTable, queries: DataFrame, k: int = 20, key: str = "doc_id", version: int | None = None, first: int = FIRST, report: dict | None = None, query_terms_at_most: int = QUERY_TERMS, one_round: int = ONE_ROUND) -> DataFrame:
    """query_id, key, score, rank: BM25's k best documents for every query, those that keyword_search() finds in the same documents.

    Only folders of the queries' terms are read. A query's segments with the greatest bounds are scored first, and its k-th best
    score there is what a document in the other segments has to reach; segments whose bound does not, are skipped. So the result is
    that of scoring all. report, if given, gets how many pairs of a query and a segment there are, and how many are scored.
    Queries of more than query_terms_at_most terms are joined with the postings instead.
    """
    spark = index.spark
    version = index.version() if version is None else version
    kind = index.read(version).schema["keys"].dataType.elementType.simpleString()
    n, mean, segments_ = _statistics(index.read(version, [-1]))
    wanted = query_terms(queries)
    rows = wanted.limit(query_terms_at_most + 1).collect()
    if len(rows) > query_terms_at_most:
        wanted, live = durable(wanted), index.read(version).where("term IS NOT NULL")
        df = live.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        asked = wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(float(n)), F.col("df"))).alias("weight"))
        each = live.join(asked, "term").select("query_id", "weight", F.explode(F.arrays_zip("keys", "counts", "lengths")).alias("x"))
        part = F.col("weight") * _part(F.col("x.counts").cast("double"), F.col("x.lengths").cast("double"), mean)
        return top_k(each.groupBy("query_id", F.col("x.keys").alias(key)).agg(F.sum(part).alias("score")), k, key)
    ids = list({r["query_id"]: None for r in rows})
    place = {q: i for i, q in enumerate(ids)}
    terms = spark.createDataFrame([(t,) for t in sorted({r["term"] for r in rows})], "term string")  # query_terms_at_most bounds it
    buckets = sorted(r["b"] for r in terms.select(index.bucket(F.col("term")).alias("b")).distinct().collect())  # at most BUCKETS
    live = index.read(version, buckets).join(F.broadcast(terms), "term", "left_semi")
    df = {r["term"]: r["df"] for r in live.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term of the queries
    triples = [(place[r["query_id"]], r["term"], r["qtf"] * log(1 + (n - df[r["term"]] + 0.5) / (df[r["term"]] + 0.5))) for r in rows if r["term"] in df]
    names = spark.createDataFrame(list(enumerate(ids)), f"q long, query_id {queries.schema['query_id'].dataType.simpleString()}")
    numbered = spark.createDataFrame(triples, "query_id long, term string, weight double")
    order = W.partitionBy("q").orderBy(F.col("bound").desc(), "segment")
    bound = durable(bounds(live, F.broadcast(numbered), mean).withColumnRenamed("query_id", "q").withColumn("nth", F.row_number().over(order)))  # a row a query and segment
    groups, pairs = max(1, -(-segments_ // TOGETHER)), bound.count()
    if pairs <= one_round:
        if report is not None:
            report |= {"pairs": pairs, "scored": pairs}
        hits = top_k(_score(live, triples, bound, None, mean, k, kind, groups), k, "key", by="q").join(F.broadcast(names), "q")
        return hits.select("query_id", F.col("key").alias(key), "score", "rank")
    found = durable(_score(live, triples, bound.where(F.col("nth") <= first), None, mean, k, kind, groups))
    floor = {r["q"]: r["s"] for r in top_k(found, k, "key", by="q").groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("s")).collect() if r["s"] is not None}  # a row a query
    least = spark.createDataFrame([(i, floor.get(i, 0.0)) for i in range(len(ids))], "q long, floor double")
    rest = bound.where(F.col("nth") > first).join(F.broadcast(least), "q").where(F.col("bound") >= F.col("floor") - 1e-8).select("q", "segment")
    if report is not None:
        report |= {"pairs": pairs, "scored": bound.where(F.col("nth") <= first).count() + rest.count()}
    more = _score(live, triples, rest, floor, mean, k, kind, groups)
    hits = top_k(found.unionAll(more), k, "key", by="q").join(F.broadcast(names), "q")  # fewer than query_terms_at_most queries
    return hits.select("query_id", F.col("key").alias(key), "score", "rank")
