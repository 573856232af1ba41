"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import WORD, durable, free_names, maybe_broadcast

#: No source is repeated more often than this.
MAX_RATE = 3


def source_targets(sizes: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """source, source_size, target from (source, size), for sources that weigh 1, 2, 3 and so on in turn, by code point, null last.

    Targets share the sum of all sizes by weight. One above max_rate times its source's size stops there, and the excess is
    shared out again. The fixed point has a closed form: in the order of max_rate * size / weight, a source is at its limit as
    long as that ratio is not above the level that the sources from it on would get. Only one row a source is sorted here, in one
    task: that is meant for sources, of which there are thousands, not for keys that grow with the documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = total.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("most", max_rate * F.col("source_size"))
    by_ratio = W.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        weighed.withColumn("free", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("share", F.sum("weight").over(rest))
        .withColumn("open", F.col("most").cast("double") * F.col("share") > F.col("free").cast("double") * F.col("weight"))
    )
    # all sources from the first open one on share what the others leave
    free = F.max(F.when(F.col("open"), F.col("free"))).over(everything)
    share = F.max(F.when(F.col("open"), F.col("share"))).over(everything)
    return (
        level.withColumn("target", F.when(F.col("open"), free.cast("double") * F.col("weight") / share).otherwise(F.col("most").cast("double")))
        .select("source", "source_size", "target")
    )


def draw(key: Column) -> Column:
    """A number in [0, 1) that only depends on key, as text; null counts as the text "null"."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, max_rate: int = MAX_RATE, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Adds size, source_size, target, copies and taken to every row of docs (columns of those names are replaced).

    size is the number of words of the text, 0 for null. A document is taken floor(rate) times, rate being its source's target
    over its size, and once more with the rate's fraction as probability, by a number drawn from its key alone: reruns agree,
    and rows repeated under one key are all drawn alike. Sources without words have target 0 and their documents 1 copy of
    nothing (taken 0, copies 1), so that no row is lost to a division by zero. An empty table stays empty. Whole texts are counted,
    whatever their length. How near a source comes to its target depends on its number of documents: with n alike, of rate r and
    fraction f, the relative deviation is sqrt(f (1 - f) / n) / r.

    Words are counted in the pass that adds up the sources, a row a source, and again where the rows are returned; a caller that
    only needs the numbers gives measure() instead of texts, which counts once.
    """
    docs = docs.drop("source_size", "target", "copies", "taken").withColumn("size", word_count(F.col(text)))
    totals = durable(source_targets(docs.select(F.col(source).alias("source"), "size"), max_rate))
    return attach(docs, totals, source, key)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, target and the rest of mix(), without texts: a durable narrow table is all that is kept of them."""
    narrow = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return attach(narrow, durable(source_targets(narrow)))


def attach(docs: DataFrame, totals: DataFrame, source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs, which have size, with source_size, target, copies and taken from the sources' totals."""
    (own,) = free_names(docs, "source")
    totals = maybe_broadcast(totals.withColumnRenamed("source", own))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    copies = (F.floor(rate) + (draw(F.col(key)) < rate - F.floor(rate)).cast("int")).cast("long")
    return (
        docs.join(totals, docs[source].eqNullSafe(totals[own]), "left").drop(own)
        .withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    )


def emit(mixed: DataFrame, copies: str = "copies", copy: str = "copy") -> DataFrame:
    """Each row of mixed as often as its column copies says, without that column, and with the copy's number from 0 in column copy, in place
    of one of that name. Rows whose copies are 0 or null are not emitted."""
    counted = mixed.drop(copy) if copy != copies else mixed
    (n,) = free_names(mixed, "n")
    return counted.withColumnRenamed(copies, n).where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))).drop(n)


def repeat(docs: DataFrame, copy: str = "copy", **options) -> DataFrame:
    """The mixture itself: docs' rows as often as mix() takes them, all their columns as they are, whatever their names, and the copy's
    number from 0 in column copy, which docs must not have."""
    added = ("size", "source_size", "target", "copies", "taken")
    clash = dict(zip([c for c in docs.columns if c.lower() in added], free_names(docs, *[c for c in docs.columns if c.lower() in added]), strict=True))
    mixed = mix(docs.withColumnsRenamed(clash), **{k: clash.get(v, v) for k, v in options.items()})
    out = emit(mixed, copy=copy).drop("size", "source_size", "target", "taken").withColumnsRenamed({v: k for k, v in clash.items()})
    return out.select(*docs.columns, copy)
