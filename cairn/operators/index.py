"""Keeping an index in step with its chunks, and summaries of what is in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.chunking import last_of


def sync_plan(existing: DataFrame, wanted: DataFrame, key: str = "chunk_id", order: str | None = None, reindex: bool = False) -> DataFrame:
    """key, action: "delete" for what only the index has, "add" for what only wanted has, each id once; with reindex, delete all and
    add all. With order, the last of wanted rows with one id stands for it."""
    new = (last_of(wanted, key, order) if order else wanted).select(key).distinct()
    old = existing.select(key).distinct()
    gone, more = (old, new) if reindex else (old.join(new, key, "left_anti"), new.join(old, key, "left_anti"))
    return gone.withColumn("action", F.lit("delete")).unionAll(more.withColumn("action", F.lit("add")))


def apply_sync(index: DataFrame, wanted: DataFrame, embed, key: str = "chunk_id", order: str | None = None, reindex: bool = False) -> DataFrame:
    """The index after a sync: rows that stay as they are, and the added rows of wanted, which alone go through embed(rows)."""
    new = last_of(wanted, key, order) if order else wanted.dropDuplicates([key])
    if reindex:
        return embed(new)
    stay = index.join(new.select(key), key, "left_semi")
    return stay.unionByName(embed(new.join(index.select(key), key, "left_anti")))


def replace_source(rows: DataFrame, source: str, new: DataFrame) -> DataFrame:
    """rows with all of a source's rows replaced by new ones."""
    return rows.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new)


def renumber(rows: DataFrame, source: str, new: DataFrame, order: str = "chunk_index") -> DataFrame:
    """replace_source() with order counted anew from 0: the kept rows in their order, then the new ones.

    One sequence over all rows would sort them in one task. So rows are counted by source and position instead, and numbered
    within blocks of the kept order, to which the totals of the blocks before are added.
    """
    kept = rows.where(~F.col("source").eqNullSafe(F.lit(source))).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return dense_rank_of(kept, ["_new", order], order).drop("_new")


def dense_rank_of(rows: DataFrame, by: list[str], name: str, block: int = 100_000) -> DataFrame:
    """rows with their number from 0 in the order of by, the last column of which is a whole number. Rows are numbered in blocks
    of that number, in parallel; only one row a block is added up in order."""
    blocked = rows.withColumn("_b", F.floor(F.col(by[-1]) / block))
    head = [*by[:-1], "_b"]
    own = blocked.withColumn("_k", F.row_number().over(W.partitionBy(*head).orderBy(by[-1])) - 1)
    counts = blocked.groupBy(*head).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy(*head).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return own.join(before, head).withColumn(name, (F.col("_s") + F.col("_k")).cast("long")).drop("_b", "_k", "_s")


def count_by_type(rows: DataFrame, kind: str = "type") -> DataFrame:
    """kind, n, the most frequent first, equally frequent ones by name."""
    return rows.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind)


def length_stats(chunks: DataFrame, length: Column) -> DataFrame:
    """One row: chunks, shortest, mean (without its fraction) and longest; zeros for none."""
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return chunks.agg(F.count("*").alias("chunks"), zero(F.min(length)).alias("shortest"), zero(F.floor(F.sum(length) / F.nullif(F.count("*"), F.lit(0)))).alias("mean"), zero(F.max(length)).alias("longest"))


def document_summary(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """source, chunks, pages, items, types (items of each type) for every source that has chunks; items of others don't count."""
    by = chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.coalesce(F.max("page_end"), F.lit(0)).alias("pages"))
    kinds = items.groupBy("source", "type").agg(F.count("*").alias("n"))
    held = kinds.groupBy("source").agg(F.sum("n").alias("items"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return by.join(held, "source", "left").withColumn("items", F.coalesce("items", F.lit(0))).withColumn("types", F.coalesce("types", none)).select("source", "chunks", "pages", "items", "types")


def document_listing(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """document_summary() in the order of sources."""
    return document_summary(chunks, items).orderBy("source")


def document_detail(items: DataFrame, chunks: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """A source's items and chunks, each in their order; a LookupError where it has neither."""
    own = items.where(F.col("source") == source).orderBy("item_index"), chunks.where(F.col("source") == source).orderBy("chunk_index")
    if own[0].isEmpty() and own[1].isEmpty():
        raise LookupError(f"document not found: {source}")
    return own


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same set of rows."""
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def zip_rows(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """The rows of a and b (both with order, a number from 0) side by side by their place; the shorter one ends it."""
    return a.join(b, order)


def relevance_summary(results: DataFrame, by: str = "query_id") -> DataFrame:
    """by, mean_score, sections: the mean score of a query's results, and how many sections they are from (null is one)."""
    return results.groupBy(by).agg(F.avg("score").alias("mean_score"), F.count_distinct(F.struct(F.coalesce(F.to_json(F.struct("section_path")), F.lit("")))).alias("sections"))
