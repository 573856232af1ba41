"""The query catalogue of the library without its subpackage for training text: each operator on the shared test tables, and
DuckDB SQL with the same result where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import layout, providers, text, vectors
from cairn.functions.sizes import shared_dir
from cairn.operators import chunking, context, conversion, dense, fusion, geometry, index, lexical, splitting
from cairn.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


# --- keyword search ---

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = f"""tok AS (
  SELECT doc_id, lang, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{text.TOKEN}'), lambda x: x NOT IN ({_STOP})) AS tokens FROM documents)"""
_BM25 = f"""{_TOKENS},
q AS (
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{text.TOKEN}'), lambda x: x NOT IN ({_STOP}))) AS term FROM benchmark) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS m FROM tok),
tf AS (SELECT doc_id, lang, len, term, count(*) AS tf FROM (SELECT doc_id, lang, len(tokens) AS len, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, n),
sc AS (
  SELECT query_id, doc_id, lang, sum(qtf * (idf * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * len / m)))) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)"""


def _bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_TOKENS} SELECT doc_id, len(tokens)::BIGINT AS n_tokens, len(list_distinct(tokens))::BIGINT AS n_distinct FROM tok")
def tokenize_counts(spark, sf_dir):
    tokens = lexical.tokens_of(_t(spark, sf_dir, "documents"))
    return tokens.select("doc_id", F.col("length").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@query(f"""WITH {_TOKENS}, p AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tok), st AS (SELECT count(*) AS n FROM tok)
SELECT term, count(*)::BIGINT AS df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM p, st GROUP BY term, n""")
def term_df_idf(spark, sf_dir):
    tokens = lexical.tokens_of(_t(spark, sf_dir, "documents"))
    return lexical.term_stats(lexical.postings(tokens), lexical.corpus_stats(tokens)).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def bm25_topk(spark, sf_dir):
    hits = lexical.keyword_search(_t(spark, sf_dir, "documents"), _bench_queries(spark, sf_dir), 10)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE lang = 'fr')
SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def bm25_filtered_topk(spark, sf_dir):
    hits = lexical.keyword_search(_t(spark, sf_dir, "documents"), _bench_queries(spark, sf_dir), 10, keep=F.col("lang") == "fr")
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# --- vector search ---

def _near(k: int, where: str = "TRUE") -> str:
    return f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
near AS (
  SELECT q.vec_id AS query_id, v.vec_id, v.label, v.e, q.e AS qe, list_cosine_similarity(q.e, v.e) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0 AND v.{where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM near QUALIFY rank <= {k})"""


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_near(20, 'vec_id IS NOT NULL')} SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r")
def vector_topk(spark, sf_dir):
    return dense.vector_search(_t(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 20).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_near(10, 'label = 3')} SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r")
def vector_filtered_topk(spark, sf_dir):
    hits = dense.vector_search(_t(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 10, where=F.col("label") == 3)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.label, round(coalesce(avg(list_cosine_similarity(a.e, b.e)) FILTER (a.vec_id <> b.vec_id), 0), 9) AS redundancy FROM v a JOIN v b ON a.label = b.label GROUP BY a.label""")
def redundancy_by_label(spark, sf_dir):
    return dense.redundancy(_t(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", F.round("redundancy", 9).alias("redundancy"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 9) AS own FROM embeddings")
def vector_norms(spark, sf_dir):
    e = F.col("embedding")
    unit = vectors.normalise(e)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(e), 9).alias("norm"), F.round(vectors.cosine(e, unit), 9).alias("own"))


@query(f"""WITH RECURSIVE {_near(dense.FETCH_K, 'vec_id IS NOT NULL')},
s AS (SELECT a.query_id, a.rank AS i, b.rank AS j, list_cosine_similarity(a.e, b.e) AS s FROM r a JOIN r b USING (query_id)),
pick AS (
  SELECT query_id, 1 AS n, [rank] AS got FROM r WHERE rank = 1
  UNION ALL
  SELECT query_id, n + 1, list_append(got, best) FROM (
    SELECT query_id, n, got, arg_max(i, round(worth, 9) - i * 1e-12) AS best FROM (
      SELECT p.query_id, p.n, p.got, c.rank AS i, {dense.LAMBDA} * c.score - (1 - {dense.LAMBDA}) * max(s.s) AS worth
      FROM pick p JOIN r c ON c.query_id = p.query_id JOIN s ON s.query_id = p.query_id AND s.i = c.rank
      WHERE p.n < {dense.MMR_K} AND NOT list_contains(p.got, c.rank) AND list_contains(p.got, s.j) GROUP BY p.query_id, p.n, p.got, c.rank, c.score) GROUP BY query_id, n, got)),
o AS (SELECT query_id, unnest(got) AS rank, generate_subscripts(got, 1) AS pick_order FROM pick WHERE n = {dense.MMR_K})
SELECT query_id, vec_id, rank::INT AS candidate_rank, pick_order::INT AS pick_order FROM o JOIN r USING (query_id, rank)""")
def mmr_select(spark, sf_dir):
    return dense.mmr_search(_t(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)).select("query_id", "vec_id", "candidate_rank", "pick_order")


# --- fusion: documents and embeddings are paired by number, for tests only ---

def _paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = _bench_queries(spark, sf_dir).join(e.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return _t(spark, sf_dir, "documents").join(e, "doc_id", "left"), asked


_HYBRID = f"""{_BM25},
k AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20),
e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT item_id AS query_id, v.doc_id, list_cosine_similarity(a.e, v.e) AS score FROM benchmark JOIN e a ON a.doc_id = item_id, e v WHERE v.doc_id IN (SELECT doc_id FROM documents)),
d AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM n QUALIFY rank <= 20)"""


def _fused(a: float, b: float) -> str:
    return f"""f AS (
  SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.doc_id, k.doc_id) AS doc_id, d.rank AS vector_rank, k.rank AS keyword_rank,
    coalesce({a}::DOUBLE / (60 + d.rank), 0) + coalesce({b}::DOUBLE / (60 + k.rank), 0) AS score
  FROM d FULL JOIN k ON d.query_id = k.query_id AND d.doc_id = k.doc_id),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, keyword_rank) AS rank FROM f)"""


_FUSED_COLUMNS = "query_id, doc_id, round(score, 9) AS score, vector_rank::INT AS vector_rank, keyword_rank::INT AS keyword_rank, rank::INT AS rank"


@query(f"WITH {_HYBRID}, {_fused(1.0, 1.0)} SELECT {_FUSED_COLUMNS} FROM g WHERE rank <= 5")
def hybrid_rrf(spark, sf_dir):
    docs, asked = _paired(spark, sf_dir)
    return fusion.hybrid_search(docs, asked, key="doc_id").select("query_id", "doc_id", F.round("score", 9).alias("score"), "vector_rank", "keyword_rank", "rank")


@query(f"WITH {_HYBRID}, {_fused(*fusion.ENSEMBLE)} SELECT {_FUSED_COLUMNS} FROM g WHERE rank <= 20")
def weighted_ensemble(spark, sf_dir):
    docs, asked = _paired(spark, sf_dir)
    fused = fusion.ensemble(dense.vector_search(docs, asked, 20, "doc_id"), lexical.keyword_search(docs, asked, 20), 20, "doc_id")
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("score"), "vector_rank", "keyword_rank", "rank")


@query(f"""WITH {_BM25}, k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10),
f AS (SELECT query_id // 3 AS query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM k GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, doc_id, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id))::INT AS rank FROM f""")
def multi_query_rrf(spark, sf_dir):
    """Three questions in turn stand for the wordings of one."""
    v = _bench_queries(spark, sf_dir).select(F.expr("query_id div 3").alias("query_id"), F.col("query_id").alias("list_id"), "query")
    return fusion.search_all(_t(spark, sf_dir, "documents"), v, 10, "doc_id").select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {_BM25}, k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20),
b AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{text.TOKEN}'), lambda x: x NOT IN ({_STOP}))) AS qt FROM benchmark),
p AS (SELECT query_id, doc_id, rank, coalesce(len(list_intersect(qt, tokens))::DOUBLE / nullif(len(qt), 0), 0) AS s FROM k JOIN b USING (query_id) JOIN tok USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rerank FROM p)
SELECT query_id, doc_id, round(s, 9) AS rerank_score, rerank::INT AS rerank FROM o WHERE rerank <= 4""")
def rerank_topn(spark, sf_dir):
    docs, asked = _t(spark, sf_dir, "documents"), _bench_queries(spark, sf_dir)
    pairs = lexical.keyword_search(docs, asked, fusion.RERANK_FROM).join(docs.select("doc_id", "text"), "doc_id").join(asked, "query_id")
    return fusion.rerank(pairs, providers.lexical_pair_score, key="doc_id").select("query_id", "doc_id", F.round("rerank_score", 9).alias("rerank_score"), "rerank")


# --- text ---

def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+$', '', 'g')"


_CLEAN = _strip("regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_JOINED = "regexp_replace(coalesce(text, ''), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g')"
for _ in range(2):
    _JOINED = f"regexp_replace({_JOINED}, '(^|[^\\n])\\n([^\\n]|$)', '\\1 \\2', 'g')"
_UNWRAP = _strip(f"regexp_replace({_JOINED}, ' {{2,}}', ' ', 'g')")


@query(f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {_UNWRAP} AS unwrapped FROM documents")
def unwrap_lines(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.unwrap_lines(F.col("text")).alias("unwrapped"))


@query("SELECT doc_id, coalesce(source, 'document') || '_' || left(sha1(coalesce(source, '') || chr(0) || coalesce(lang, '') || chr(0) || coalesce(text, '')), 16) AS chunk_id FROM documents")
def stable_chunk_id(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.stable_id(F.col("source"), F.col("lang"), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, 'Document: ' || source || chr(10) || CASE WHEN doc_id % 3 > 0 THEN 'Section: ' || lang || chr(10) ELSE '' END || chr(10) || text AS embedding_text FROM documents")
def embedding_text(spark, sf_dir):
    path = F.when(F.col("doc_id") % 3 > 0, F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.embedding_text(F.col("source"), path, F.col("text")).alias("embedding_text"))


@query("SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(text, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), 60), ''), 'untitled') AS name FROM documents")
def safe_name(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.safe_name(F.col("text")).alias("name"))


_CAPTIONS = [(1, "Figure 3: The model"), (2, "TABLE 12b. Results"), (3, "fig. 4 - Loss"), (4, "  Fig 7"), (5, "Figures of speech"), (6, ""), (7, "Figure one"), (8, "Table 5 : x")]


@query(f"SELECT id, {_strip(r'''regexp_replace(caption, '^\s*(?:figure|fig\.?|table)\s*\d+[a-z]?\s*[:.\-]?\s*', '', 'i')''')} AS title FROM {_values(_CAPTIONS)} t(id, caption)")
def caption_strip(spark, sf_dir):
    return spark.createDataFrame(_CAPTIONS, "id int, caption string").select("id", text.caption_title(F.col("caption")).alias("title"))


_REPLIES = [
    (1, '{"title": "A", "section": "B", "summary": "C"}'), (2, '```json\n{"title": "A"}\n```'), (3, 'Sure: {"title": "A", "summary": "x"} - done'), (4, "{broken"), (5, "[1, 2]"), (6, ""), (7, '"text"'), (8, None),
]
_REPAIRED = [(1, "A", "B", "C"), (2, "A", "", ""), (3, "A", "", "x"), *((i, "", "", "") for i in range(4, 9))]


@query(f"SELECT * FROM {_values(_REPAIRED)} t(id, title, section, summary)")
def json_repair(spark, sf_dir):
    return providers.chunk_metadata(spark.createDataFrame(_REPLIES, "id int, reply string")).select("id", "title", "section", "summary")


@query("SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


# --- splitting ---

_PIECES = """p AS (
  SELECT doc_id, t, n, 0 AS pos, 0 AS stop, 0 AS k, FALSE AS done FROM (SELECT doc_id, %s AS t, length(%s) AS n FROM documents) WHERE n > 0
  UNION ALL
  SELECT doc_id, t, n, pos, stop, k + 1, stop >= n FROM (
    SELECT doc_id, t, n, k, at2 AS pos, CASE WHEN at2 + 800 >= n THEN n ELSE at2 + coalesce(%s, least(800, n - at2)) END AS stop FROM (
      SELECT doc_id, t, n, k, at2, low, substr(t, at2 + low + 1, 800 - low) AS s FROM (
        SELECT doc_id, t, n, k, at2, ((least(at2 + 800, n) - at2) * 0.4)::DOUBLE AS x, floor((least(at2 + 800, n) - at2) * 0.4)::INT AS low FROM (
          SELECT doc_id, t, n, k, CASE WHEN k = 0 THEN 0 ELSE CASE WHEN nx > pos THEN nx ELSE stop END END AS at2 FROM (
            SELECT *, CASE WHEN back > 0 AND NOT regexp_matches(substr(t, back, 1), '\\s') THEN
                CASE WHEN strpos(substr(t, back + 1, stop - back), ' ') > 0 THEN back + strpos(substr(t, back + 1, stop - back), ' ') ELSE stop END ELSE back END AS nx
            FROM (SELECT *, greatest(0, stop - 100) AS back FROM p WHERE NOT done))))))
)"""
_LAST = lambda sep, n: f"CASE WHEN strpos(s, {sep}) > 0 THEN low + length(s) - strpos(reverse(s), reverse({sep})) + 1 END"
_CUT = "coalesce(" + ", ".join(_LAST(s, n) for s, n in (("chr(10) || chr(10)", 2), ("'. '", 2), ("'? '", 2), ("'! '", 2), ("chr(10)", 1), ("' '", 1))) + ")"


@query(f"WITH RECURSIVE {_PIECES % (_strip('text'), _strip('text'), _CUT)} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS piece_index, piece FROM (SELECT doc_id, k, {_strip('substr(t, pos + 1, stop - pos)')} AS piece FROM p WHERE k > 0) WHERE piece <> ''")
def split_text_chunks(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return splitting.explode_pieces(rows, splitting.split_text()(F.col("text"))).select("doc_id", "piece_index", "piece")


@query()
def split_recursive(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return splitting.explode_pieces(rows, splitting.recursive_splitter()(F.col("text"))).select("doc_id", "piece_index", "piece")


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i0 FROM documents),
n AS (SELECT doc_id, t, length(t) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i0) AS i FROM l WHERE t <> ''),
g AS (
  SELECT doc_id, i, c AS size, 0 AS grp FROM n WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN g.size + 1 + c > 1000 THEN c ELSE g.size + 1 + c END, grp + (g.size + 1 + c > 1000)::INT FROM g JOIN n ON n.doc_id = g.doc_id AND n.i = g.i + 1),
p AS (SELECT doc_id, grp, """ + _strip("string_agg(t, chr(10) ORDER BY i)") + """ AS piece FROM g JOIN n USING (doc_id, i) GROUP BY doc_id, grp)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INT AS piece_index, piece FROM p WHERE piece <> ''""")
def split_plain(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return splitting.explode_pieces(rows, splitting.plain_splitter(separator="\n")(F.col("text"))).select("doc_id", "piece_index", "piece")


def _markdown(spark, sf_dir):
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |"))
    rows = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    return rows.select("o_custkey", F.concat(F.lit("Table: orders\n| key | priority |\n| --- | --- |\n"), "rows").alias("text"))


@query("""WITH RECURSIVE r AS (
  SELECT o_custkey, '| ' || o_orderkey || ' | ' || o_orderpriority || ' |' AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
g AS (
  SELECT o_custkey, i, 47 + length(t) + 1 AS size, 0 AS grp FROM r WHERE i = 1
  UNION ALL
  SELECT r.o_custkey, r.i, CASE WHEN g.size + length(t) + 1 > 200 THEN 47 ELSE g.size END + length(t) + 1, grp + (g.size + length(t) + 1 > 200)::INT FROM g JOIN r ON r.o_custkey = g.o_custkey AND r.i = g.i + 1)
SELECT o_custkey, grp AS piece_index, 'Table: orders' || chr(10) || '| key | priority |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(t, chr(10) ORDER BY i) AS piece FROM g JOIN r USING (o_custkey, i) GROUP BY o_custkey, grp""")
def split_table_rows(spark, sf_dir):
    return splitting.explode_pieces(_markdown(spark, sf_dir), splitting.split_table(F.col("text"), 200)).select("o_custkey", "piece_index", "piece")


_GRID = "SELECT n_regionkey, list([n_nationkey::VARCHAR, n_name] ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey"


def _grid(spark, sf_dir):
    cells = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("r"))
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(cells)), lambda x: x["r"]).alias("rows"))


@query(f"""SELECT n_regionkey, '<table><thead><tr><th>' || array_to_string(rows[1], '</th><th>') || '</th></tr></thead><tbody>' ||
  array_to_string([('<tr><td>' || array_to_string(r, '</td><td>') || '</td></tr>') FOR r IN rows[2:]], '') || '</tbody></table>' AS html FROM ({_GRID})""")
def table_html(spark, sf_dir):
    return _grid(spark, sf_dir).select("n_regionkey", text.table_to_html(F.col("rows")).alias("html"))


@query(f"""SELECT n_regionkey, len(rows) >= 2 AS valid, '| ' || array_to_string(rows[1], ' | ') || ' |' || chr(10) || '|---|---|' || chr(10) ||
  array_to_string([('| ' || array_to_string(r, ' | ') || ' |') FOR r IN rows[2:]], chr(10)) AS markdown FROM ({_GRID})""")
def table_markdown(spark, sf_dir):
    return _grid(spark, sf_dir).select("n_regionkey", text.is_valid_table(F.col("rows")).alias("valid"), text.table_to_markdown(F.col("rows")).alias("markdown"))


# --- sections and chunks ---

def _page_items(spark, sf_dir):
    """A heading and paragraphs from each page's HTML."""
    parts = F.transform(F.split(F.regexp_extract("html", "(?s)<article>(.*)", 1), "<p>"), lambda x: F.regexp_replace(x, "(?s)<[^>]*>", " "))
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source"), F.posexplode(parts).alias("item_index", "content"))
    kind = F.when(F.col("item_index") == 0, "heading").otherwise("paragraph")
    null = F.lit(None).cast("string")
    return pages.select("source", F.col("item_index").cast("long").alias("item_index"), kind.alias("type"), (F.col("item_index") / 5 + 1).cast("int").alias("page"), "content", null.alias("title"), null.alias("table_data"), null.alias("text_fallback"), null.alias("image_path"))


_PAGE_ITEMS = f"""parts AS (SELECT page_id::VARCHAR AS source, string_split(regexp_extract(html, '(?s)<article>(.*)', 1), '<p>') AS x FROM pages),
raw AS (SELECT source, unnest([regexp_replace(y, '(?s)<[^>]*>', ' ', 'g') FOR y IN x]) AS text, generate_subscripts(x, 1) - 1 AS i FROM parts),
clean AS (SELECT source, i, {_CLEAN} AS text FROM raw),
item AS (SELECT source, i, {_UNWRAP} AS text FROM clean),
title AS (SELECT source, text AS title FROM item WHERE i = 0),
body AS (SELECT source, i, text, length(text) AS c, row_number() OVER (PARTITION BY source ORDER BY i) AS k FROM item WHERE i > 0 AND text <> '' AND NOT regexp_full_match(text, '\\d{{1,4}}'))"""


@query(f"WITH {_PAGE_ITEMS} SELECT source, i AS item_index, 'section_0001' AS parent_id, 'heading' AS section_type, title AS section_title, title AS section_path FROM body JOIN title USING (source)")
def sections_breadcrumb(spark, sf_dir):
    return chunking.assign_sections(_page_items(spark, sf_dir)).select("source", "item_index", "parent_id", "section_type", "section_title", "section_path")


_HEADINGS = [
    ("a", "paragraph", "before", "section_0000", "", ""), ("a", "heading", "Abstract", None, None, None), ("a", "paragraph", "free", "section_0002", "Abstract", "Abstract"), ("a", "heading", "1", None, None, None),
    ("a", "heading", "Intro-\nduction", None, None, None), ("a", "paragraph", "p1", "section_0003", "1 Introduction", "1 Introduction"), ("a", "heading", "1.1. Deep\nwater", None, None, None),
    ("a", "paragraph", "p2", "section_0004", "1.1 Deep water", "1 Introduction > 1.1 Deep water"), ("a", "paragraph", "12", None, None, None), ("a", "heading", "1.1.1.1.1.1.1.1.1 Nine", None, None, None),
    ("a", "paragraph", "p3", "section_0005", "1.1.1.1.1.1.1.1.1 Nine", "1 Introduction > 1.1 Deep water > 1.1.1.1.1.1.1.1.1 Nine"), ("a", "heading", "1.1.1.1.1.1.1.1.1.1 Ten", None, None, None),
    ("a", "paragraph", "p4", "section_0006", "1.1.1.1.1.1.1.1.1.1 Ten", "1 Introduction > 1.1 Deep water > 1.1.1.1.1.1.1.1.1 Nine > 1.1.1.1.1.1.1.1.1.1 Ten"), ("a", "heading", "2. Next", None, None, None),
    ("a", "paragraph", "p5", "section_0007", "2 Next", "2 Next"), ("a", "heading", "Free", None, None, None), ("a", "paragraph", "p6", "section_0008", "Free", "Free"), ("a", "heading", "3 Wait", None, None, None),
    ("a", "paragraph", "p7", "section_0009", "3 Wait", "3 Wait"), ("a", "title", "", None, None, None), ("a", "paragraph", "p8", "section_0010", "", ""), ("b", "paragraph", "q1", "section_0000", "", ""),
    ("b", "heading", "3", None, None, None), ("b", "heading", "4 Own", None, None, None), ("b", "paragraph", "q2", "section_0002", "4 Own", "4 Own"),
]


def _heading_items(spark):
    rows = [(s, i, k, 1 + i // 4, t, None, None, None, None) for i, (s, k, t, *_) in enumerate(_HEADINGS)]
    return spark.createDataFrame(rows, chunking.ITEMS)


@query(f"SELECT * FROM {_values([(s, i, p, t, path) for i, (s, _, _, p, t, path) in enumerate(_HEADINGS) if p])} v(source, item_index, parent_id, section_title, section_path)")
def sections_headings(spark, sf_dir):
    """Numbers alone, with dots and of ten levels, wrapped names, unnumbered and empty headings, and text before any."""
    return chunking.assign_sections(_heading_items(spark)).select("source", "item_index", "parent_id", "section_title", "section_path")


@query(f"""SELECT source, 'Document: ' || CASE source WHEN 'a' THEN 'Abstract' ELSE '4 Own' END || chr(10) || CASE WHEN path <> '' THEN 'Section: ' || path || chr(10) ELSE '' END || chr(10) || content AS embedding_text,
  source || '_' || left(sha1(source || chr(0) || path || chr(0) || content), 16) AS chunk_id FROM {_values([(s, t, path) for s, _, t, p, _, path in _HEADINGS if p])} v(source, content, path)""")
def chunk_titles(spark, sf_dir):
    """A document's title is that of the first section that keeps an item and has one."""
    return chunking.create_chunks(_heading_items(spark)).select("source", "embedding_text", "chunk_id")


@query(f"""WITH RECURSIVE {_PAGE_ITEMS},
g AS (
  SELECT source, k, c + 2 AS size, 0 AS grp FROM body WHERE k = 1
  UNION ALL
  SELECT b.source, b.k, CASE WHEN g.size + c > 800 THEN c + 2 ELSE g.size + c + 2 END, grp + (g.size + c > 800)::INT FROM g JOIN body b ON b.source = g.source AND b.k = g.k + 1),
documents AS (
  SELECT source || '/' || grp AS doc_id, source, grp, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text, min(i // 5 + 1) AS a, max(i // 5 + 1) AS b FROM g JOIN body USING (source, k) GROUP BY source, grp),
{_PIECES % (_strip('text'), _strip('text'), _CUT)},
cut AS (SELECT doc_id, k, {_strip('substr(t, pos + 1, stop - pos)')} AS piece FROM p WHERE k > 0),
one AS (SELECT source, grp, k, piece, a, b, row_number() OVER w AS n, count(*) OVER (PARTITION BY source) AS m, lead(piece) OVER w AS next, lead(b) OVER w AS later FROM cut JOIN documents USING (doc_id) WHERE piece <> '' WINDOW w AS (PARTITION BY source ORDER BY grp, k)),
mended AS (
  SELECT source, n, a, CASE WHEN n = m - 1 AND length(next) < 50 THEN coalesce(nullif(later, 0), b) ELSE b END AS b, CASE WHEN n = m - 1 AND length(next) < 50 THEN piece || chr(10) || chr(10) || next ELSE piece END AS content
  FROM one WHERE NOT (n = m AND m > 1 AND length(piece) < 50)),
ids AS (SELECT *, source || '_' || left(sha1(source || chr(0) || title || chr(0) || content), 16) AS chunk_id FROM mended JOIN title USING (source)),
kept AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY source, n) = 1)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY n) - 1)::INT AS chunk_index, chunk_id, 'section_0001' AS parent_id, 'text' AS type, title AS section_path, a::INT AS page_start, b::INT AS page_end, length(content)::INT AS char_count, content FROM kept""")
def chunk_pipeline(spark, sf_dir):
    return chunking.create_chunks(_page_items(spark, sf_dir)).select("source", "chunk_index", "chunk_id", "parent_id", "type", "section_path", "page_start", "page_end", "char_count", "content")


def _line_items(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where("text <> ''")


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i0 FROM documents),
n AS (SELECT doc_id, length(t) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i0) AS i FROM l WHERE t <> ''),
g AS (
  SELECT doc_id, i, c + 2 AS size, 0 AS grp FROM n WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN g.size + c > {splitting.CHUNK_SIZE} THEN c + 2 ELSE g.size + c + 2 END, grp + (g.size + c > {splitting.CHUNK_SIZE})::INT FROM g JOIN n ON n.doc_id = g.doc_id AND n.i = g.i + 1)
SELECT doc_id, grp AS pack, count(*)::INT AS items FROM g GROUP BY doc_id, grp""")
def chunk_packing(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    packed = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.pack(lines)).alias("pack", "at"))
    return packed.select("doc_id", "pack", F.size("at").alias("items"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup_first(spark, sf_dir):
    keyed = _t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return chunking.first_of(keyed, "key", "doc_id").select("doc_id", "source")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, count(*)::BIGINT AS lines FROM (SELECT doc_id, CASE WHEN i % 3 = 0 THEN (i * 7)::VARCHAR ELSE t END AS t FROM l) WHERE t <> '' AND NOT regexp_full_match(t, '\\d{1,4}') GROUP BY doc_id""")
def page_number_filter(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    lines = lines.withColumn("t", F.when((F.col("i") + 1) % 3 == 0, ((F.col("i") + 1) * 7).cast("string")).otherwise(F.col("t")))
    return lines.where((F.col("t") != "") & ~chunking.is_page_number(F.lit("paragraph"), F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT doc_id, source, lang, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1)::INT AS type_number FROM documents")
def running_numbers(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_index"), "source", F.col("lang").alias("type"))
    return chunking.running_number(rows).select(F.col("item_index").alias("doc_id"), "source", F.col("type").alias("lang"), "type_number")


# --- context ---

@query("SELECT conv_id, turn, string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM conversations")
def neighbour_expand(spark, sf_dir):
    return context.expand_neighbours(_t(spark, sf_dir, "conversations"), 1, ("conv_id",), "turn", "text").select("conv_id", "turn", "context")


_CITED = """SELECT doc_id, source || ', p.' || CASE WHEN a IS NOT DISTINCT FROM b THEN coalesce(a::VARCHAR, 'None') ELSE coalesce(a::VARCHAR, 'None') || '-' || coalesce(b::VARCHAR, 'None') END
  || ', ' || CASE WHEN doc_id % 4 = 0 THEN 'front matter' ELSE lang END AS citation, source, text
FROM (SELECT *, CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 END AS a, CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 + doc_id % 2 END AS b FROM documents)"""


def _cited(spark, sf_dir):
    some = F.col("doc_id") % 5 > 0
    rows = _t(spark, sf_dir, "documents").withColumn("page_start", F.when(some, F.col("doc_id") % 7)).withColumn("page_end", F.when(some, F.col("doc_id") % 7 + F.col("doc_id") % 2))
    return context.with_citations(rows.withColumn("section_path", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).otherwise("")))


@query(f"SELECT doc_id, citation FROM ({_CITED})")
def citations(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", "citation")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM ({_CITED}) QUALIFY n <= 5)
SELECT source, string_agg('[' || n || '] (' || citation || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM r GROUP BY source""")
def numbered_context(spark, sf_dir):
    """The five first documents of a source stand for its results; their whole texts are the context."""
    rows = _cited(spark, sf_dir).withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("rank <= 5")
    return context.prompt_context(rows.withColumn("context", F.col("text")), "source")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def history_tail(spark, sf_dir):
    return context.history_tail(_t(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role")


@query("""WITH t AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8)
SELECT conv_id, string_agg(CASE WHEN lower(role) IN ('user', 'human') THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM t GROUP BY conv_id""")
def history_prompt(spark, sf_dir):
    return context.format_history(_t(spark, sf_dir, "conversations"))


@query("""SELECT doc_id, list_aggregate([x::VARCHAR FOR x IN CASE WHEN doc_id % 9 = doc_id % 4 + 3 THEN [doc_id % 9] ELSE [doc_id % 9, doc_id % 4 + 3] END IF x IN (1, 2, 3, 4, 5)], 'string_agg', ',') AS cited
FROM documents""")
def answer_marker_extract(spark, sf_dir):
    """A marker that is repeated counts once."""
    reply = F.format_string("It is so [%d], and not [x] or [123], as in [%d].", F.col("doc_id") % 9, F.col("doc_id") % 4 + 3)
    found = F.array_join(text.answer_markers(reply, F.array(*[F.lit(i) for i in range(1, 6)])), ",")
    return _t(spark, sf_dir, "documents").select("doc_id", F.nullif(found, F.lit("")).alias("cited"))


@query("""WITH p AS (SELECT source, doc_id, 'img' || doc_id % 4 || '.png' AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT source, path, min(n) AS n FROM p GROUP BY ALL)
SELECT source, n::INT AS n, path FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY n) <= 3""")
def image_pick(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").withColumn("image_paths", F.array(F.format_string("img%d.png", F.col("doc_id") % 4))).withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("doc_id")))
    return context.pick_images(rows, by="source").select("source", "n", "path")


# --- index ---

@query("""SELECT doc_id AS chunk_id, 'delete' AS action FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 > 0 UNION ALL
SELECT doc_id, 'add' FROM documents WHERE doc_id % 5 > 0 AND doc_id % 3 = 0""")
def index_sync_diff(spark, sf_dir):
    ids = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return index.sync_plan(ids.where("chunk_id % 5 = 0"), ids.where("chunk_id % 3 = 0"))


@query("SELECT doc_id, source, CASE WHEN source = 'src3' THEN 'new' ELSE lang END AS lang FROM documents WHERE source <> 'src3' OR doc_id % 2 = 0")
def replace_source(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return index.replace_source(rows, "src3", rows.where("source = 'src3' AND doc_id % 2 = 0").withColumn("lang", F.lit("new")))


@query("SELECT doc_id, (row_number() OVER (ORDER BY (source = 'src3')::INT, doc_id) - 1)::BIGINT AS chunk_index FROM documents")
def reindex_numbers(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").alias("chunk_index"))
    return index.renumber(rows, "src3", rows.where("source = 'src3'")).select("doc_id", "chunk_index")


@query("""WITH c AS (SELECT source, lang, count(*) AS n, max(doc_id % 7) AS p FROM documents GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS chunks, max(p)::BIGINT AS pages, sum(n)::BIGINT AS items, string_agg(lang || '=' || n, ',' ORDER BY lang) AS types FROM c GROUP BY source""")
def document_summary(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    rows = index.document_listing(docs.select("source", (F.col("doc_id") % 7).alias("page_end")), docs.select("source", F.col("lang").alias("type")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("source", "chunks", "pages", "items", shown.alias("types"))


@query("SELECT count(*)::BIGINT AS chunks, min(length(text))::BIGINT AS shortest, floor(sum(length(text)) / count(*))::BIGINT AS mean, max(length(text))::BIGINT AS longest FROM documents")
def length_stats(spark, sf_dir):
    return index.length_stats(_t(spark, sf_dir, "documents"), F.length("text"))


@query("SELECT lang AS type, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def count_by_type(spark, sf_dir):
    return index.count_by_type(_t(spark, sf_dir, "documents").select(F.col("lang").alias("type")))


# --- layout: every line of a document is a block, with a place and a font that follow from its length ---

_BLOCKS = """SELECT source, doc_id AS page, i AS block, t AS text, 9 + length(t) % 6 AS font_size, length(t) % 5 = 0 AS is_bold, 50.0::DOUBLE AS x0, 20.0::DOUBLE * i AS y0,
  50.0::DOUBLE + length(t) % 400 AS x1, 20.0::DOUBLE * i + 12 AS y1 FROM (
  SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE t <> ''"""


def _blocks(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "text")).where("text <> ''")
    n, at = F.length("text"), F.col("i") + 1
    return lines.select(
        "source", "page", at.alias("block"), "text", (9 + n % 6).cast("double").alias("font_size"), (n % 5 == 0).alias("is_bold"), F.lit(50.0).alias("x0"), (20.0 * at).alias("y0"),
        (50.0 + n % 400).alias("x1"), (20.0 * at + 12).alias("y1"), F.lit(800.0).alias("page_height"))


def _score(x: str) -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    points = [f"2 * regexp_matches({x}, {quote('(?i)' + p)})::INT" for p in layout.STRONG] + [f"regexp_matches({x}, {quote(p)})::INT" for p in layout.MEDIUM]
    share = f"(length({x}) - length(translate({x}, {quote(layout.MATH_CHARACTERS)}, ''))) / greatest(length({x}), 1)"
    return f"({' + '.join(points)} + CASE WHEN {share} > 0.22 THEN 2 WHEN {share} > 0.15 THEN 1 ELSE 0 END)"


_FORMULAS = [
    (1, "Attention(Q, K, V) = softmax(QK^T / \\sqrt{d_k}) V"), (2, "plain text about nothing at all"), (3, "x_i = y_j + z^{2}"), (4, "PE(pos, 2i) = sin(pos)"), (5, "type (a)"), (6, "The model = x_1 + head_1"),
    (7, "∑ x ∈ R"), (8, "a. b. c = d_model"), (9, ""), (10, "W^Q = [1, 2]"), (11, "short="), (12, "=" * 301),
]
_STARTS = " OR ".join(f"starts_with(lower(t), '{x}')" for x in layout.NOT_EQUATION_STARTS)
_EQUATION = f"(length(t) BETWEEN 12 AND 300 AND (length(t) - length(replace(t, '. ', ''))) / 2 < 2 AND NOT ({_STARTS}) AND {_score('t')} >= 3)"


@query(f"SELECT id, {_score('t')}::INT AS score, {_EQUATION} AS equation FROM {_values(_FORMULAS)} f(id, t)")
def math_scores(spark, sf_dir):
    rows = spark.createDataFrame(_FORMULAS, "id int, t string")
    return rows.select("id", layout.math_score(F.col("t")).alias("score"), layout.is_likely_equation(F.col("t")).alias("equation"))


@query(f"""WITH b AS ({_BLOCKS}), m AS (SELECT source, page, list_sort(list(font_size))[count(*) // 2 + 1] AS med FROM b GROUP BY ALL),
c AS (SELECT *, {_strip('text')} AS t FROM b JOIN m USING (source, page))
SELECT source, page, block::INT AS block, CASE WHEN y0 < 800 * 0.15 AND font_size > med * 1.4 THEN 'title'
  WHEN (regexp_matches(t, '^\\d+(\\.\\d+)*\\s+[A-Z]') OR regexp_full_match(t, '[A-Z][A-Za-z\\s]{{3,40}}')) AND (font_size >= med * 1.1 OR is_bold) THEN 'heading'
  WHEN regexp_matches(t, '(?i)^(Figure|Fig\\.|Table)\\s+\\d+') THEN 'caption' WHEN {_EQUATION} THEN 'equation' ELSE 'paragraph' END AS label FROM c""")
def classify_blocks(spark, sf_dir):
    return geometry.classify(_blocks(spark, sf_dir)).select("source", "page", "block", "label")


@query(f"""WITH b AS ({_BLOCKS}), r AS (SELECT source, page, x0 + 30 AS x0, y0 + 5 AS y0, x1 + 30 AS x1, y1 + 30 AS y1 FROM b WHERE block % 4 = 0)
SELECT source, page, block::INT AS block FROM b WHERE NOT EXISTS (
  SELECT 1 FROM r WHERE r.source = b.source AND r.page = b.page AND least(b.x1, r.x1) > greatest(b.x0, r.x0) AND least(b.y1, r.y1) > greatest(b.y0, r.y0) AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0
    AND (least(b.x1, r.x1) - greatest(b.x0, r.x0)) * (least(b.y1, r.y1) - greatest(b.y0, r.y0)) >= 0.45 * ((b.x1 - b.x0) * (b.y1 - b.y0)))""")
def overlap_exclusion(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    moved = [(F.col("x0") + 30).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x1") + 30).alias("x1"), (F.col("y1") + 30).alias("y1")]
    return geometry.exclude_covered(b, b.where("block % 4 = 0").select("source", "page", *moved)).select("source", "page", "block")


@query(f"""WITH b AS ({_BLOCKS}), t AS (SELECT * FROM b WHERE block % 6 = 0),
c AS (SELECT source, page, y1, 'T' || block AS title FROM b WHERE block % 4 = 1)
SELECT t.source, t.page, t.block::INT AS table_id, arg_min(c.title, t.y0 - c.y1) AS title FROM t LEFT JOIN c ON c.source = t.source AND c.page = t.page AND t.y0 - c.y1 BETWEEN 0 AND 100 GROUP BY ALL""")
def nearest_caption(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    marked = b.where("block % 4 = 1").withColumn("text", F.concat(F.lit("Table 1: T"), F.col("block").cast("string")))
    tables = b.where("block % 6 = 0").select("source", "page", F.col("block").alias("table_id"), "x0", "y0", "x1", "y1")
    return geometry.table_captions(tables, marked).select("source", "page", "table_id", "title")


@query(f"""WITH b AS ({_BLOCKS}), p AS (SELECT * FROM b WHERE block % 9 = 0)
SELECT source, page, block::INT AS block FROM b WHERE NOT (length(text) <= 40 AND NOT regexp_matches(text, '^\\d+(?:\\.\\d+)*\\.?\\s+\\S') AND EXISTS (
  SELECT 1 FROM p WHERE p.source = b.source AND p.page = b.page AND least(b.x1, p.x1) - greatest(b.x0, p.x0) > 0 AND b.y0 < p.y1 + 80 AND b.y1 > p.y0 - 80))""")
def figure_label_filter(spark, sf_dir):
    b = _blocks(spark, sf_dir).select("source", "page", "block", "text", F.col("x0").alias("l"), F.col("y0").alias("t"), F.col("x1").alias("r"), F.col("y1").alias("b"))
    return geometry.drop_figure_labels(b, b.where("block % 9 = 0")).select("source", "page", "block")


@query(f"""WITH RECURSIVE b AS ({_BLOCKS}), c AS (SELECT source, page, block AS caption_id, x0, y0, x1, y1 FROM b WHERE block % 7 = 0),
r AS (SELECT source, page, x0 AS rx0, y0 AS ry0, x1 AS rx1, y0 + 45 AS ry1 FROM b WHERE block % 3 = 1 AND x1 - x0 >= 80),
near AS (
  SELECT c.source, c.page, caption_id, rx0, ry0, rx1, ry1, row_number() OVER (PARTITION BY c.source, c.page, caption_id ORDER BY greatest(y0 - ry1, ry0 - y1, 0), abs((ry0 + ry1) / 2 - (y0 + y1) / 2), rx0, ry0, rx1, ry1) AS n
  FROM c JOIN r ON r.source = c.source AND r.page = c.page WHERE greatest(y0 - ry1, ry0 - y1, 0) <= 0.4 * 800),
f AS (
  SELECT source, page, caption_id, n, rx0 AS x0, ry0 AS y0, rx1 AS x1, ry1 AS y1 FROM near WHERE n = 1
  UNION ALL
  SELECT source, page, caption_id, n, CASE WHEN meets THEN least(x0, rx0) ELSE x0 END, CASE WHEN meets THEN least(y0, ry0) ELSE y0 END, CASE WHEN meets THEN greatest(x1, rx1) ELSE x1 END, CASE WHEN meets THEN greatest(y1, ry1) ELSE y1 END
  FROM (SELECT q.*, f.x0, f.y0, f.x1, f.y1, (least(rx1, x1 + 20) > greatest(rx0, x0 - 20) AND least(ry1, y1 + 20) > greatest(ry0, y0 - 20)) OR abs(ry0 - y1) < 20 OR abs(y0 - ry1) < 20 AS meets
    FROM f JOIN near q ON q.source = f.source AND q.page = f.page AND q.caption_id = f.caption_id AND q.n = f.n + 1)),
l AS (SELECT source, page, caption_id, greatest(x0 - 8, 0) AS f_x0, greatest(y0 - 8, 0) AS f_y0, least(x1 + 8, 600) AS f_x1, least(y1 + 8, 800) AS f_y1 FROM f QUALIFY row_number() OVER (PARTITION BY source, page, caption_id ORDER BY n DESC) = 1)
SELECT c.source, c.page, c.caption_id::INT AS caption_id, c.x0, c.y0, c.x1, c.y1, f_x0, f_y0, f_x1, f_y1 FROM c LEFT JOIN (SELECT * FROM l WHERE f_x1 - f_x0 <= 0.95 * 600) l ON l.source = c.source AND l.page = c.page AND l.caption_id = c.caption_id""")
def figure_region(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    captions = b.where("block % 7 = 0").select("source", "page", F.col("block").alias("caption_id"), "x0", "y0", "x1", "y1")
    rects = b.where("block % 3 = 1").withColumn("y1", F.col("y0") + 45)
    pages = b.select("source", "page").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    return geometry.figure_regions(captions, rects, pages)


# --- models: the stand-ins take the place of real ones ---

@query("""WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT label, vec_id, 1 - list_cosine_similarity(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)) AS d FROM v),
c AS (SELECT *, quantile_cont(d, 0.7) OVER (PARTITION BY label) AS c FROM d)
SELECT label, vec_id, (sum(coalesce((round(d, 12) > round(c, 12))::INT, 0)) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS "group" FROM c""")
def semantic_breakpoints(spark, sf_dir):
    return splitting.semantic_breakpoints(_t(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", "group")


@query()
def semantic_merge(spark, sf_dir):
    rows = splitting.explode_pieces(_t(spark, sf_dir, "documents").select("doc_id", "text"), splitting.recursive_splitter()(F.col("text")))
    return splitting.semantic_merge(rows.select("doc_id", "piece_index", "piece"), lambda texts: providers.HashingEmbedder().embed(texts))


# --- smaller pieces of the pipeline ---

@query(f"""WITH c AS (SELECT doc_id, source, doc_id % 4 AS k, CASE WHEN doc_id % 3 > 0 THEN lang END AS title, {_CLEAN} AS text FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN concat_ws(chr(10), 'Table: ' || title, source) WHEN 1 THEN coalesce('Figure: ' || title, '') WHEN 2 THEN text ELSE {_UNWRAP} END AS item_text FROM c""")
def item_texts(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("table", "figure", "equation", "paragraph")]), (F.col("doc_id") % 4 + 1).cast("int"))
    title = F.when(F.col("doc_id") % 3 > 0, F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.item_text(kind, F.col("text"), title, F.col("source"), F.col("text")).alias("item_text"))


@query(f"WITH {_near(20, 'vec_id IS NOT NULL')} SELECT query_id, round(avg(score), 6) AS mean_score, count(DISTINCT coalesce(label, -1))::BIGINT AS sections FROM r GROUP BY query_id")
def relevance_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    hits = dense.vector_search(e, _vector_queries(spark, sf_dir), 20).join(e.select("vec_id", F.col("label").cast("string").alias("section_path")), "vec_id")
    return index.relevance_summary(hits).select("query_id", F.round("mean_score", 6).alias("mean_score"), "sections")


@query(f"""WITH {_near(5, 'vec_id IS NOT NULL')}, s AS (SELECT query_id, vec_id, rank FROM r) SELECT query_id, vec_id, 'similarity' AS method, rank::INT AS place FROM s""")
def similarity_listing(spark, sf_dir):
    from cairn.plans.answering import compare_retrieval

    return compare_retrieval(_t(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)).where("method = 'similarity'").select("query_id", "vec_id", "method", "place")


@query(f"""WITH d AS (SELECT source, doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) WHEN 1 THEN '  ' ELSE '' END AS content FROM documents)
SELECT source AS query_id, doc_id, content FROM d QUALIFY row_number() OVER (PARTITION BY source, {_strip('content')} ORDER BY doc_id) = 1""")
def distinct_contents(spark, sf_dir):
    from cairn.plans import answering

    end = F.when(F.col("doc_id") % 3 == 0, "\n").when(F.col("doc_id") % 3 == 1, "  ").otherwise("")
    rows = _t(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.concat("text", end).alias("content"), F.col("doc_id").alias("rank"))
    return answering.distinct_contents(rows).select("query_id", "doc_id", "content")


@query("""SELECT doc_id AS chunk_id, 'chunk_id=' || doc_id || ';content=' || text || CASE WHEN doc_id % 3 = 0 THEN ';image_paths=["img/' || doc_id || '.png"]' ELSE '' END || ';source=' || source
  || CASE WHEN doc_id % 2 = 0 THEN ';type=' || lang ELSE '' END AS metadata FROM documents""")
def store_metadata(spark, sf_dir):
    from cairn.sources.writers import to_metadata

    null = F.lit(None).cast("string")
    images = F.when(F.col("doc_id") % 3 == 0, F.array(F.format_string("img/%d.png", F.col("doc_id"))))
    rows = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), null.alias("chunk_index"), null.alias("parent_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("type"), "source", null.alias("section_path"),
        null.alias("page_start"), null.alias("page_end"), F.col("text").alias("content"), images.alias("image_paths"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return to_metadata(rows).select("chunk_id", shown.alias("metadata"))


@query("""SELECT conv_id, 'User: ' || string_agg(text, chr(10) || 'User: ' ORDER BY turn) AS history FROM (
  SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY conv_id""")
def user_history(spark, sf_dir):
    return context.format_history(_t(spark, sf_dir, "conversations").where("role = 'user'"), 2)


# --- sources and sinks: written to the shared folder, and read back ---

def _at(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS text FROM nation")
def text_folder(spark, sf_dir):
    path = _at(spark)
    _t(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return readers.read_text_folder(spark, path).select("text")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS item_index, n_nationkey::BIGINT AS key, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS name FROM nation")
def json_array_round_trip(spark, sf_dir):
    path = _at(spark)
    writers.write_json_array(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("name")), path, "key")
    return readers.read_json_array(spark, path, "key bigint, name string")


@query("SELECT n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'unknown' END AS topic, 'chunk_' || (row_number() OVER (ORDER BY n_nationkey) - 1) AS source FROM nation")
def json_topics(spark, sf_dir):
    path = _at(spark)
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("text"), F.when(F.col("n_nationkey") % 2 == 0, "even").alias("topic")).orderBy("n_nationkey")
    writers.write_json_array(rows.drop("n_nationkey"), path)
    return readers.read_topics(spark, path)


@query(f"SELECT t AS page_content, 'chunk_' || (i - 1) AS source FROM {_values([(i + 1, c[1]) for i, c in enumerate(_CAPTIONS)])} v(i, t)")
def list_source(spark, sf_dir):
    return readers.from_list(spark, [c[1] for c in _CAPTIONS])


@query("SELECT page_id::VARCHAR AS source, count(*)::BIGINT AS items FROM (SELECT page_id, unnest(string_split(regexp_extract(html, '(?s)<article>(.*)', 1), '<p>')) FROM pages) GROUP BY page_id")
def layout_items_json(spark, sf_dir):
    path = _at(spark)
    writers.write_json_array(_page_items(spark, sf_dir).drop("item_index"), path)
    return readers.read_items(spark, path).groupBy("source").agg(F.count("*").alias("items"))


@query("SELECT 0::BIGINT AS before, count(*)::BIGINT AS after FROM nation WHERE n_regionkey <> 2 OR n_nationkey % 2 = 0")
def stored_table_replace(spark, sf_dir):
    """A table that is not there yet is empty; writing it anew replaces it, also from rows that were read from it."""
    path, schema = _at(spark), "source string, n long"
    before = readers.read_or_empty(spark, path, schema).count()
    rows = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("source"), F.col("n_nationkey").cast("long").alias("n"))
    writers.write_table(rows, path)
    writers.replace_stored_source(spark, path, schema, "2", rows.where("source = '2' AND n % 2 = 0"))
    return readers.open_index(spark, path).agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("after"))


@query("SELECT doc_id, 64 AS dimensions, 2 AS copies FROM documents")
def embedded_store(spark, sf_dir):
    """Appended twice, as a store that is only added to."""
    path, rows = _at(spark), _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("embedding_text"))
    for _ in range(2):
        writers.store_embedded(rows, lambda r: providers.embed_column(r, providers.HashingEmbedder), path)
    return readers.open_index(spark, path).groupBy("doc_id").agg(F.max(F.size("embedding")).alias("dimensions"), F.count("*").cast("int").alias("copies"))


# --- joins and listings ---

@query("SELECT d.doc_id, d.source, b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 100")
def hydrate_hits(spark, sf_dir):
    """A hit without a chunk is left out."""
    hits = _t(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 100).alias("chunk_id"))
    return fusion.hydrate(hits, _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")).select("doc_id", "source", "text")


@query("SELECT d.doc_id, coalesce(b.text, '') AS content, CASE WHEN b.text IS NULL THEN '' ELSE 'p' || b.item_id END AS section_path FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 100")
def source_contents(spark, sf_dir):
    from cairn.plans import answering

    hits = _t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100).alias("chunk_id"))
    chunks = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("section_path"))
    return answering.attach_contents(hits, chunks).select("doc_id", "content", "section_path")


@query("""SELECT c.n, c.text, b.text AS title FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, text FROM documents) c JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS n, text FROM benchmark) b USING (n)""")
def positional_zip(spark, sf_dir):
    numbered = lambda t, key: _t(spark, sf_dir, t).withColumn("k", F.col(key)).transform(lambda d: index.dense_rank_of(d.withColumn("_z", F.lit(0)), ["_z", "k"], "n"))
    return index.zip_rows(numbered("documents", "doc_id").select("n", "text"), numbered("benchmark", "item_id").select("n", F.col("text").alias("title")), "n")


@query("SELECT source, doc_id, (doc_id % 7 IS DISTINCT FROM lag(doc_id % 7) OVER (PARTITION BY source ORDER BY doc_id)) AS page_break FROM documents")
def page_breaks(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("item_index"), (F.col("doc_id") % 7).alias("page"))
    return conversion.page_breaks(rows).select("source", F.col("item_index").alias("doc_id"), "page_break")


@query("SELECT DISTINCT ON (source) source, doc_id, lang FROM documents ORDER BY source, doc_id DESC")
def last_wins(spark, sf_dir):
    return chunking.last_of(_t(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id")


@query(f"SELECT doc_id, {_strip("string_split(regexp_replace(" + _strip('text') + ", '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}]', chr(10), 'g'), chr(10))[1]")} AS line, left(text, 100) AS beginning, array_to_string(string_split(text, chr(10))[:10], chr(10)) AS lines, TRY_CAST(left(text, 1) AS INT) AS number FROM documents")
def first_lines(spark, sf_dir):
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", text.first_line(t).alias("line"), text.preview(t, 100).alias("beginning"), text.first_lines(t).alias("lines"), text.to_int(F.left(t, F.lit(1))).alias("number"))


@query("SELECT doc_id, source, 'demo_' || lpad((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::VARCHAR, greatest(3, length((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::VARCHAR))::INT, '0') AS chunk_id, 1 AS version FROM documents")
def demo_chunk_ids(spark, sf_dir):
    from cairn.plans import answering

    return answering.demo_ids(_t(spark, sf_dir, "documents").select("doc_id", "source"), "demo_", "doc_id")


# --- more of layouts ---

@query(f"""WITH b AS ({_BLOCKS}) SELECT source, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE NOT (x1 - x0 < 3 AND y1 - y0 < 3) AND x1 > x0 AND y1 > y0 GROUP BY source, page""")
def rect_unions(spark, sf_dir):
    return geometry.union_rects(geometry.usable_rects(_blocks(spark, sf_dir), geometry.MIN_DRAWING), geometry.PAGE)


@query(f"""WITH b AS ({_BLOCKS}) SELECT source, page, block::INT AS block, CASE WHEN greatest(x0 - 4, 0) < least(x1 + 4, 300) AND greatest(y0 - 4, 0) < least(y1 + 4, 400) THEN greatest(x0 - 4, 0) END AS l,
  CASE WHEN greatest(x0 - 4, 0) < least(x1 + 4, 300) AND greatest(y0 - 4, 0) < least(y1 + 4, 400) THEN least(y1 + 4, 400) END AS b FROM b""")
def crop_boxes(spark, sf_dir):
    box = geometry.crop_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(300.0), F.lit(400.0))
    return _blocks(spark, sf_dir).withColumn("box", box).select("source", "page", "block", F.col("box.l").alias("l"), F.col("box.b").alias("b"))


_NODES = """SELECT source, doc_id * 1000 + i AS node_index, CASE i % 5 WHEN 0 THEN 'section_header' WHEN 1 THEN 'page_header' WHEN 2 THEN 'formula' WHEN 3 THEN 'caption' ELSE 'list_item' END AS label, (doc_id % 9)::INT AS page, t AS text
FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""


@query(f"""WITH n AS ({_NODES}), k AS (SELECT *, {_strip('text')} AS t FROM n WHERE label <> 'page_header' AND NOT (label = 'caption' AND node_index % 2 = 0)),
t AS (SELECT *, CASE label WHEN 'section_header' THEN 'heading' WHEN 'formula' THEN 'equation' WHEN 'caption' THEN 'caption' ELSE 'paragraph' END AS type FROM k WHERE t <> '')
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY node_index) - 1)::BIGINT AS item_index, type, page, CASE WHEN type <> 'equation' THEN t END AS content, CASE WHEN type = 'equation' THEN t END AS text_fallback,
  CASE WHEN type = 'equation' THEN 'images/equations/' || source || '_p' || page || '_equation_' || (row_number() OVER (PARTITION BY source, type ORDER BY node_index) - 1) || '.png' END AS image_path FROM t""")
def convert_document(spark, sf_dir):
    """Every line of a document is a node; a table holds every second caption, and has no word itself."""
    lines = _t(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("section_header", "page_header", "formula", "caption", "list_item")]), (F.col("i") + 1) % 5 + 1)
    null = lambda kind: F.lit(None).cast(kind)
    nodes = lines.select(
        "source", (F.col("doc_id") * 1000 + F.col("i") + 1).alias("node_index"), F.lit("text").alias("kind"), label.alias("label"), (F.col("doc_id") % 9).cast("int").alias("page"), "text", null("string").alias("ref"),
        null("array<string>").alias("captions"), null("string").alias("caption"), null("array<array<string>>").alias("cells"), *[null("double").alias(c) for c in "ltrb"])
    nodes = nodes.withColumn("ref", F.concat(F.lit("#"), F.col("node_index").cast("string")))
    tables = nodes.where("label = 'caption' AND node_index % 2 = 0").withColumns({"kind": F.lit("table"), "captions": F.array("ref"), "cells": F.array(F.array(F.lit("-"), F.lit(" "))), "label": F.lit("table"), "ref": F.lit("t"), "node_index": -F.col("node_index")})
    return conversion.convert_nodes(nodes.unionByName(tables)).select("source", "item_index", "type", "page", "content", "text_fallback", "image_path")


_SPANS = """SELECT source, doc_id AS page, block, (span - 1) // 8 AS line, span, w || ' ' AS text, 8.0 + length(w) % 5 AS size, length(w) % 7 = 6 AS bold FROM (
  SELECT source, doc_id, block, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS span FROM (
    SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS block FROM documents))"""


@query(f"""WITH s AS ({_SPANS}), l AS (SELECT source, page, block, line, string_agg(text, '' ORDER BY span) AS text FROM s GROUP BY ALL),
t AS (SELECT source, page, block, {_strip('text')} AS text FROM (SELECT source, page, block, string_agg(text, chr(10) ORDER BY line) AS text FROM l GROUP BY ALL))
SELECT source, page, (row_number() OVER (PARTITION BY source, page ORDER BY block))::INT AS block_order, text, font_size, is_bold, 20.0::DOUBLE * block + last AS y1
FROM t JOIN (SELECT source, page, block, round(avg(size), 6)::DOUBLE AS font_size, bool_or(bold) AS is_bold, max(line) + 10 AS last FROM s GROUP BY ALL) USING (source, page, block) WHERE text <> ''""")
def rich_blocks(spark, sf_dir):
    """Every line of a document is a block, and every eight words are a line of it."""
    lines = _t(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("b", "t"))
    words = lines.select("source", "page", (F.col("b") + 1).alias("block"), F.posexplode(F.split("t", " ")).alias("span", "w")).withColumn("line", F.floor(F.col("span") / 8).cast("int"))
    n, x, y = F.length("w"), 50.0 + F.col("span") % 8, 20.0 * F.col("block") + F.col("line")
    spans = words.select("source", "page", "block", "line", "span", F.concat("w", F.lit(" ")).alias("text"), (8.0 + n % 5).alias("size"), (n % 7 == 6).alias("bold"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 10).alias("y1"))
    return geometry.rich_blocks(spans).select("source", "page", "block_order", "text", F.round("font_size", 6).alias("font_size"), "is_bold", "y1")


@query("SELECT doc_id::VARCHAR AS chunk_id, source, text AS content, [doc_id, doc_id + 1] AS item_indices, CASE WHEN doc_id % 2 = 0 THEN ['a', 'b'] END AS image_paths FROM documents")
def chunks_json(spark, sf_dir):
    path, number = _at(spark), F.col("doc_id").cast("long")
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "source", F.col("text").alias("content"), F.array(number, number + 1).alias("item_indices"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("image_paths"))
    writers.write_json_array(rows, path, "chunk_id")
    return readers.read_chunks(spark, path).select("chunk_id", "source", "content", "item_indices", "image_paths")


_FILES = [("b.PDF", b"%PDF-1.7 x"), ("a.pdf", b"%PDF-1.4 longer"), ("c.pdf", b"<html>"), ("d.txt", b"%PDF-1.4")]


@query(f"SELECT * FROM {_values([(n, sorted(x for x, _ in _FILES if x.lower().endswith('.pdf')).index(n), len(b)) for n, b in _FILES[:2]])} v(source, file_index, length)")
def pdf_files(spark, sf_dir):
    """By name, in either case, and first bytes; numbered in the order of all names, of which capitals come first."""
    path, jvm = _at(spark), spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, content in _FILES:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(where, name))
        out.write(bytearray(content))
        out.close()
    return readers.pdf_files(spark, path).select("source", "file_index", F.length("content").alias("length"))


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'stored' ELSE 'new' END AS state FROM documents WHERE doc_id % 3 = 0""")
def index_sync_apply(spark, sf_dir):
    """What is wanted and stored stays as it was stored; of the rest, only what is new goes through the embedding."""
    ids = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return index.apply_sync(ids.where("chunk_id % 5 = 0").withColumn("state", F.lit("stored")), ids.where("chunk_id % 3 = 0"), lambda rows: rows.withColumn("state", F.lit("new")))


from cairn.plans import catalogue_stored  # noqa: E402, F401  it uses what is above
