"""The queries over whole tables that apply the operators of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, divergence, langid, line_dedup, mixing, near_dedup, order_minhash, phrases, pii, quality, toxicity, url_filter, warc
from cairn.llm.common import table

URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


URL_FILTERS_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
pages_ AS (
  SELECT page_id, row_number() OVER () AS r,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
best AS (
  SELECT r, h || p AS rule, v FROM pages_ JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, h || p) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM pages_ LEFT JOIN best USING (r)
"""


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
last AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN last USING (d)
"""


def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.measure(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM docs GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM s),
f AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM r),
o AS (SELECT *, 3.0::DOUBLE * source_size * share > free::DOUBLE * w AS open FROM f),
t AS (
  SELECT source, source_size, CASE WHEN open THEN (max(CASE WHEN open THEN free END) OVER ())::DOUBLE * w / (max(CASE WHEN open THEN share END) OVER ())
    ELSE 3.0::DOUBLE * source_size END AS target FROM o),
d AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1 END AS rate,
    ('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM docs JOIN t ON docs.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM d
"""

def remainder(modulus: int):
    """crc32 of doc_id as text modulo a number; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder(4) != 2))
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.render(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (
  SELECT r, source, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare, i
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
h AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (
  SELECT l.source, bare FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source WHERE bare <> '' GROUP BY l.source, bare, pages
  HAVING count(DISTINCT r) >= {line_dedup.MIN_PAGES} AND count(DISTINCT r) > {line_dedup.MAX_RATIO} * pages),
m AS (SELECT l.*, b.bare IS NOT NULL AS gone FROM l LEFT JOIN b ON l.bare = b.bare AND l.source IS NOT DISTINCT FROM b.source),
g AS (
  SELECT r, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_dropped, CASE WHEN k > 0 THEN coalesce(kept, '') ELSE text END AS text
FROM d LEFT JOIN g USING (r)
"""


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(remainder(5) != 0), table(spark, sf_dir, "labels").where(remainder(5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


PHRASES_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([{", ".join(map(str, range(1, phrases.LONGEST + 1)))}]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*)::BIGINT AS a FROM runs GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
cuts AS (SELECT lang, k, phrase, w, a, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score, cut
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : ], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, a, unnest(flatten(list_transform(generate_series(2, k - 1), lambda m: list_transform(generate_series(1, k - m + 1), lambda i: array_to_string(w[i : i + m - 1], ' '))))) AS phrase
  FROM f WHERE k > 2),
most AS (SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY lang, phrase)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank, s.phrase, s.a, l, r, n, score
FROM scored s JOIN total USING (lang) LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase
WHERE m.a IS NULL OR 100 * m.a < {phrases.COVERED} * s.a QUALIFY rank <= {phrases.TOP}
"""


def edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
each AS (SELECT r, lang, source, unnest(t) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS n FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, v.term, v.n AS in_lang, coalesce(c.n, 0) AS n
  FROM groups g JOIN vocabulary v USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM each GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (
  SELECT *, 1 + ({divergence.SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS p,
    1 + ({divergence.SCALE}::HUGEINT * (in_lang + 1)) // (sum(in_lang) OVER g + count(*) OVER g) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, encode(item)))::INT AS rank
  FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filters,
    "op2_minhash_near_dedup": near_copies,
    "op3_language_id": languages,
    "op4_pii": personal_data,
    "op5_warc": warc_archive,
    "op6_line_dedup": line_frequency,
    "op7_mixing": mixing_weights,
    "op8_decontamination": benchmark_leaks,
    "op9_quality_rules": quality_rules,
    "op10_toxicity": toxic_texts,
    "op11_phrases": collocations,
    "op12_order_minhash": edit_fingerprints,
    "op13_source_divergence": source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": URL_FILTERS_SQL,
    "op5_warc": WARC_SQL,
    "op6_line_dedup": LINES_SQL,
    "op7_mixing": MIX_SQL,
    "op11_phrases": PHRASES_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
