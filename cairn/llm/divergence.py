"""Source divergence audit: how far each source's use of words lies from that of its language's other sources, and in which terms.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import durable, maybe_broadcast

#: A term: a run of ASCII letters and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A language keeps the terms of so many of its documents; terms of a source are returned up to this rank; shares are in parts of a billion.
MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """text with A-Z in lower case and nothing else; where all of it is ASCII, lower() says the same in much less time."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def number_groups(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, group of every (lang, source) of docs; nulls are ''. The upper half of group numbers the language. A row a source is
    sorted here, in one task."""
    named = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    of = F.shiftleft(F.dense_rank().over(W.orderBy("lang")).cast("long"), 32).bitwiseOR(F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long"))
    return named.withColumn("group", of)


def term_counts(docs: DataFrame, groups: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """group, term, n occurrences, held by how many documents.

    All terms of a document and its distinct ones are exploded in one pass, and tasks add up what they read before the shuffle.
    """
    terms = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), terms.alias("terms"))
    numbered = rows.join(maybe_broadcast(groups), ["lang", "source"]).select("group", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    each = numbered.select("group", "once", F.explode("terms").alias("term"))
    return each.groupBy("group", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("held"))


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """of (a language's number), term, n, by_group of the terms that min_docs of a language's documents hold: a row a term, with an entry
    for each group that has it."""
    by_term = counts.groupBy(F.shiftright("group", 32).alias("of"), "term").agg(F.sum("held").alias("held"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("group", "n"))).alias("by_group"))
    return by_term.where(F.col("held") >= min_docs).select("of", "term", "n", "by_group")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for counts of any size."""
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) of docs its divergence from each other source of the language
    (part "pair", all ranks), and the terms that it uses more than the language does (part "term", ranks to top).

    Null text, lang and source count as ''. Every group has rows of part "pair" if its language has another source, also without
    any term (value 0 where the language keeps none). Repeated rows count as documents of their own; ties go by item in UTF-8 byte
    order. An empty table gives no rows; texts of any length are exploded term by term; other columns, of any name, are not read.

    A kept term is one row with its counts by source, which crossing it with the language's sources fills up with zeros. Terms with
    the same counts everywhere diverge alike, so they are added up first; then the rows of two sources of a language meet term by
    term, both sides being exploded from the row that holds them. What is kept of a term has an entry a source, and the result has
    a row for each two sources of a language: sources may be thousands, not as many as documents.
    """
    named = durable(number_groups(docs, lang, source))
    terms = durable(vocabulary(term_counts(docs, named, text, lang, source), min_docs))
    sparse = terms.select("term", F.col("n").alias("in_lang"), F.explode("by_group").alias("group", "n"))
    kept = terms.groupBy("of").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = sparse.groupBy("group").agg(F.sum("n").alias("total"))
    groups = durable(
        named.withColumn("of", F.shiftright("group", 32)).join(totals, "group", "left").join(kept, "of", "left")
        .select("of", "group", "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")])
    )
    by_lang = maybe_broadcast(groups.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("group", "total"))).alias("groups"), F.first("terms").alias("terms")))
    dense = terms.join(by_lang, "of").select("of", F.transform("groups", lambda g: F.coalesce(F.try_element_at("by_group", g["group"]), F.lit(0))).alias("counts"))
    alike = dense.groupBy("of", "counts").agg(F.count("*").alias("times")).join(by_lang, "of")
    shares = alike.select("times", F.zip_with("counts", "groups", lambda n, g: F.struct(g["group"].alias("group"), share(n, g["total"], F.col("terms")).alias("p"))).alias("all"))
    pairs = shares.select("times", "all", F.explode("all").alias("a")).select("times", "a", F.explode("all").alias("b")).where("a.group <> b.group")
    value = F.sum(F.col("times") * divergence(F.col("a.p"), F.col("b.p"))).alias("value")
    sums = pairs.groupBy(F.col("a.group").alias("group"), F.col("b.group").alias("other")).agg(value)
    other = groups.select("of", F.col("group").alias("other"), F.col("source").alias("item"))
    every = groups.select("of", "group", "lang", "source").join(other, "of").where(F.col("group") != F.col("other"))
    pair = every.join(sums, ["group", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    above = sparse.where("n > 0").join(maybe_broadcast(groups), "group")
    above = above.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    term = above.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(pair, "pair").unionAll(_ranked(term, "term").where(F.col("rank") <= top))
