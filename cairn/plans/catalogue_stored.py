"""Queries over stored indexes, versioned tables and long sources, with DuckDB SQL; catalogue adds them to its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import chunking, dense, keyword_index, vector_index
from cairn.operators.context import HISTORY_MESSAGES
from cairn.plans.catalogue import _BM25, _CLEAN, _UNWRAP, _at, _bench_queries, _near, _t, _vector_queries, query
from cairn.sources.versions import VersionedTable
from cairn.streaming import conversations


def _vector_index(spark, sf_dir):
    path = _at(spark)
    vector_index.build(_t(spark, sf_dir, "embeddings"), path)
    return path


@query(f"WITH {_near(20, 'vec_id IS NOT NULL')} SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r")
def vector_ivf_exact(spark, sf_dir):
    """The nearest rows through the index's codes, with bounds that prove that none is missed."""
    hits = vector_index.search(spark, _vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), 20, exact=True)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def vector_ivf_topk(spark, sf_dir):
    """About the nearest rows: the lists nearest to each query, codes first, then exact scores; found says whether the exact search has the row too."""
    asked = _vector_queries(spark, sf_dir)
    hits = vector_index.search(spark, _vector_index(spark, sf_dir), asked, 20)
    exact = dense.vector_search(_t(spark, sf_dir, "embeddings"), asked, 20).select("query_id", "vec_id", F.lit(True).alias("found"))
    return hits.join(exact, ["query_id", "vec_id"], "left").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank", F.coalesce("found", F.lit(False)).alias("found"))


_BEST = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)\nSELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10"


@query(f"WITH {_BM25}, {_BEST}")
def bm25_index_topk(spark, sf_dir):
    stored = keyword_index.open_index(spark, _at(spark))
    keyword_index.replace_sources(stored, _t(spark, sf_dir, "documents"))
    return keyword_index.search(stored, _bench_queries(spark, sf_dir), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH documents AS (
  SELECT doc_id, lang, CASE WHEN source = 'src1' THEN text || ' ' || text ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src2'),
{_BM25}, {_BEST}""")
def bm25_index_replaced(spark, sf_dir):
    """One source is replaced and one taken out after the index was made; the others' postings stay where they are."""
    docs = _t(spark, sf_dir, "documents")
    stored = keyword_index.open_index(spark, _at(spark))
    keyword_index.replace_sources(stored, docs)
    twice = docs.where("source = 'src1'").withColumn("text", F.concat(F.col("text"), F.lit(" "), F.col("text")))
    keyword_index.replace_sources(stored, twice, docs.where("source = 'src2'").select("source").distinct())
    return keyword_index.search(stored, _bench_queries(spark, sf_dir), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT doc_id, source, CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS state FROM documents WHERE source IS DISTINCT FROM 'src2'""")
def versioned_replace(spark, sf_dir):
    """Three commits to a versioned table: all sources, one again, one taken out; and a compaction, which changes no row."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("state"))
    stored = VersionedTable(spark, _at(spark), "doc_id long, source string, state int")
    stored.replace(docs)
    stored.replace(docs.where("source = 'src1'").withColumn("state", F.lit(1)))
    stored.replace(docs.limit(0), docs.where("source = 'src2'").select("source").distinct())
    stored.compact()
    return stored.read()


# items of sources that are as long as their documents are many: headings of up to three levels, some of them a number alone
_HEAD = "doc_id % 9 < 4"
_ITEMS_SQL = f"""it AS (
  SELECT source, doc_id AS i, {_HEAD} AS h, doc_id % 13 % 4 AS d, doc_id % 11 = 0 AND doc_id % 13 % 4 > 0 AS bare, text,
    array_to_string(list_slice([doc_id % 7 + 1, doc_id % 3 + 1, doc_id % 2 + 1], 1, doc_id % 13 % 4), '.') AS num FROM documents),
hd AS (SELECT *, lag(bare) OVER w AS held, lag(num) OVER w AS before, lag(d) OVER w AS levels FROM it WHERE h WINDOW w AS (PARTITION BY source ORDER BY i)),
op AS (
  SELECT source, i, CASE WHEN d > 0 THEN d WHEN held THEN levels ELSE 0 END AS d,
    CASE WHEN d > 0 THEN num || ' Part ' || i WHEN held THEN before || ' Part ' || i ELSE 'Part ' || i END AS t FROM hd WHERE NOT bare),
live AS (
  SELECT *, row_number() OVER w AS n, {", ".join(f"last_value(CASE WHEN d <= {j} THEN {{'d': d, 't': t}} END IGNORE NULLS) OVER w AS l{j}" for j in (1, 2, 3))} FROM op
  WINDOW w AS (PARTITION BY source ORDER BY i)),
sec AS (
  SELECT source, i, n, t, CASE WHEN d = 0 THEN t ELSE array_to_string(list_filter([{", ".join(f"CASE WHEN d >= {j} AND l{j}.d = {j} THEN l{j}.t END" for j in (1, 2, 3))}], lambda x: x IS NOT NULL), ' > ') END AS path FROM live),
pre AS (SELECT it.source, coalesce(min(it.i) FILTER (NOT h) < min(o.i), min(it.i) FILTER (NOT h) IS NOT NULL)::INT AS pre FROM it LEFT JOIN op o ON o.source = it.source GROUP BY it.source),
body AS (SELECT source, i, {_UNWRAP} AS text FROM (SELECT source, i, {_CLEAN} AS text FROM it WHERE NOT h)),
kept AS (SELECT * FROM body WHERE text <> '' AND NOT regexp_full_match(text, '\\d{{1,4}}')),
placed AS (
  SELECT k.source, k.i, coalesce(s.n + pre, 0) AS no, coalesce(s.t, '') AS t, coalesce(s.path, '') AS path FROM kept k ASOF LEFT JOIN sec s ON s.source = k.source AND k.i >= s.i JOIN pre ON pre.source = k.source)"""


def _long_items(spark, sf_dir):
    d = F.col("doc_id") % 13 % 4
    levels = F.slice(F.array(*[(F.col("doc_id") % m + 1).cast("string") for m in (7, 3, 2)]), 1, d.cast("int"))
    number, bare = F.array_join(levels, "."), (F.col("doc_id") % 11 == 0) & (d > 0)
    title = F.when(bare, number).when(d > 0, F.concat(number, F.lit(" Part "), F.col("doc_id"))).otherwise(F.concat(F.lit("Part "), F.col("doc_id")))
    null = F.lit(None).cast("string")
    return _t(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("item_index"), F.when(F.expr(_HEAD), "heading").otherwise("paragraph").alias("type"), F.lit(1).alias("page"),
        F.when(F.expr(_HEAD), title).otherwise(F.col("text")).alias("content"), null.alias("title"), null.alias("table_data"), null.alias("text_fallback"), null.alias("image_path"))


@query(f"WITH {_ITEMS_SQL} SELECT source, i AS item_index, printf('section_%04d', no) AS parent_id, t AS section_title, path AS section_path FROM placed")
def sections_nested(spark, sf_dir):
    """Each source's documents as the items of one layout, with nested headings."""
    return chunking.assign_sections(_long_items(spark, sf_dir)).select("source", "item_index", "parent_id", "section_title", "section_path")


@query(f"WITH {_ITEMS_SQL} SELECT source, no AS section_no, count(*) AS items, min(i) AS first_item FROM placed GROUP BY ALL")
def section_sizes(spark, sf_dir):
    return chunking.assign_sections(_long_items(spark, sf_dir)).groupBy("source", "section_no").agg(F.count("*").alias("items"), F.min("item_index").alias("first_item"))


_HISTORY_SQL = f"""WITH m AS (SELECT conv_id, turn, lower(role) IN ('user', 'human') AS u, text FROM conversations),
h AS (SELECT *, list(CASE WHEN u THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {HISTORY_MESSAGES} PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT conv_id, turn, text AS question, coalesce(array_to_string(before, chr(10)), '') AS history FROM h WHERE u"""


@query(_HISTORY_SQL)
def question_history(spark, sf_dir):
    return conversations.questions_of(_t(spark, sf_dir, "conversations"))


@query(_HISTORY_SQL)
def conversation_replay(spark, sf_dir):
    """The same from a stream, with the messages before a question as state of its conversation."""
    path = _at(spark)
    conversations.replay(spark, f"{sf_dir}/conversations.parque[t]", f"{path}/out", f"{path}/state", f"{path}/mark")
    return conversations.read_questions(spark, f"{path}/out")
