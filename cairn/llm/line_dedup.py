"""Line dedup: lines that too large a share of a host's pages contain are boilerplate. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, durable, free_names, small

#: A line is boilerplate on more than this share of its host's pages, and on this many pages at least: by the share alone every
#: line of a host of twelve pages or fewer would be boilerplate, as its one page is more than the share.
MAX_RATIO, MIN_PAGES = 0.08, 5
_EDGE = " \t\r\x0b\x0c"


def line_keys(text: Column) -> Column:
    """A 128-bit key of each \\n-split line, without white space at its ends; null for a line of white space only."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_EDGE)))
    return F.transform(bare, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, a, b: the lines to drop of each host.

    A page counts once for a line however often it repeats it; a null host is a host of its own; a null text is a page without
    lines. Counts are added up where the pages are read, and only the keys of lines are shuffled.
    """
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    lines = (
        docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(line_keys(F.col(text)))).alias("line")).where("line IS NOT NULL")
        .groupBy("host", "line.a", "line.b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    )
    pages = pages.withColumnRenamed("host", "h")
    return lines.join(pages, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > max_ratio * F.col("pages")).select("host", "a", "b")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with their boilerplate lines removed, and n_lines, n_dropped added (columns of those names are replaced).

    No row is dropped: a page of boilerplate only keeps an empty text, a null text stays null with 0 lines, and an empty text is
    one line without a word, which is never dropped. Other lines stay as they are, in order. n_chars follows the text where
    docs have that column. A text of any length is judged line by line in its row; an empty table stays empty; other columns may
    have any names.

    A host has at most (mean lines a page) / max_ratio lines to drop, so they fit one row a host. Those rows are broadcast while
    their lines are few in all; beyond that docs are joined by host, and Spark splits a hot host, which is one row to look up.
    """
    drop = durable(boilerplate(docs, host, text, max_ratio, min_pages))
    host_, drop_, kept_ = free_names(docs.withColumns({"n_lines": F.lit(0), "n_dropped": F.lit(0)}), "host", "drop", "kept")
    by_host = drop.groupBy(F.col("host").alias(host_)).agg(F.collect_set(F.struct("a", "b")).alias(drop_))
    if small(drop, broadcast_rows):
        by_host = F.broadcast(by_host)
    out = docs.drop("n_lines", "n_dropped").join(by_host, F.col(host).eqNullSafe(F.col(host_)), "left")
    lines, keys = F.split(F.col(text), "\n"), line_keys(F.col(text))
    kept = F.filter(F.arrays_zip(lines.alias("t"), keys.alias("k")), lambda x: ~F.coalesce(F.array_contains(F.col(drop_), x["k"]), F.lit(False)))
    out = out.withColumn(kept_, F.when(F.col(drop_).isNotNull(), F.transform(kept, lambda x: x["t"])).otherwise(lines))
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size(lines) - F.size(kept_), F.lit(0)).cast("long"))
    out = out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join(kept_, "\n")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(host_, drop_, kept_)
