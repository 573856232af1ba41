"""Sections of layouts: heading stacks over ranges of items, so that a source of any length is read by as many tasks as it has ranges.

What a range does to the headings above it is a pair: how far down it cuts the stack that it finds (its least depth), and the stack
that it leaves on top. Such pairs compose, so ranges are summed up in parallel, the sums are carried over a source's ranges, a row
a range, and each range is then read with what it starts from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.sizes import durable
from cairn.functions.text import BARE_NUMBER, NUMBERED, clean_text, unwrap_lines

#: Items of a range, by their numbers.
RANGE = 10_000
_STACK = "array<struct<depth: int, title: string>>"
#: Rows that are read and leave a worker together.
SLICE = 1_000
_HEADINGS = ("source", "_range", "item_index", "type", "title", "depth")
_ARROW_STACK = pa.list_(pa.struct([("depth", pa.int32()), ("title", pa.string())]))
_CARRIED = {
    "source": pa.string(), "_range": pa.int64(), "_stack": _ARROW_STACK, "_opened": pa.int64(), "_type": pa.string(), "_title": pa.string(), "_depth": pa.int32(), "_pre": pa.int32(),
}


def read_headings(items: DataFrame) -> DataFrame:
    """source, _range, item_index, type, title, depth of every heading that opens a section; items have _range and _head.

    A heading that is only a number is held, and goes in front of the next heading, unless that has a number of its own. Depth is
    the number's levels, 0 without one. The heading before the first one of a range is the last one of the ranges before.
    """
    heads = durable(items.where("_head IS NOT NULL").select("source", "_range", "item_index", "type", "_head", F.coalesce(F.col("_head").rlike(BARE_NUMBER), F.lit(False)).alias("_bare")))
    held = F.struct("_bare", "_head")
    last = heads.groupBy("source", "_range").agg(F.max_by(held, "item_index").alias("_last"))
    carried = last.select("source", "_range", F.lag("_last").over(W.partitionBy("source").orderBy("_range")).alias("_carried"))  # a row a range
    before = F.coalesce(F.lag(held).over(W.partitionBy("source", "_range").orderBy("item_index")), F.col("_carried"))
    rows = heads.join(carried, (heads["source"].eqNullSafe(carried["source"])) & (heads["_range"] == carried["_range"])).drop(carried["source"], carried["_range"]).withColumn("_before", before).where("NOT _bare")
    own = F.nullif(F.regexp_extract("_head", NUMBERED, 1), F.lit(""))
    number = F.coalesce(own, F.when(F.col("_before._bare"), F.col("_before._head")))
    name = unwrap_lines(F.when(own.isNotNull(), F.regexp_extract("_head", NUMBERED, 2)).otherwise(F.col("_head")))
    title = F.when(number.isNotNull(), F.concat(number, F.lit(" "), name)).otherwise(name)
    return rows.select("source", "_range", "item_index", "type", title.alias("title"), F.when(number.isNotNull(), F.size(F.split(number, r"\."))).otherwise(0).cast("int").alias("depth"))


def push(stack: list, depth: int, title: str) -> list:
    """The stack behind a heading: a numbered one stands on those of fewer levels, another one clears it."""
    return [*(x for x in stack if x[0] < depth), (depth, title)] if depth else []


def _stack_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each range, which starts from nothing: the least depth so far, and the stack behind each heading. Headings come sorted,
    many ranges in one batch, as a call for each range of a short source would cost more than its headings."""
    own, low, stack, nth = None, 1 << 30, [], 0
    for whole in batches:
        for i in range(0, whole.num_rows, SLICE):
            b = whole.slice(i, SLICE)
            column, lows, stacks, nths = {n: b.column(n) for n in _HEADINGS}, [], [], []
            for *key, depth, title in zip(*(column[n].to_pylist() for n in ("source", "_range", "depth", "title")), strict=True):
                if key != own:
                    own, low, stack, nth = key, 1 << 30, [], 0
                stack, low, nth = push(stack, depth, title), min(low, depth), nth + 1
                lows.append(low)
                stacks.append([{"depth": d, "title": t} for d, t in stack])
                nths.append(nth)
            arrays = [*(column[n].cast(pa.int32()) if n == "depth" else column[n] for n in _HEADINGS), pa.array(lows, pa.int32()), pa.array(stacks, _ARROW_STACK), pa.array(nths, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*_HEADINGS, "low", "stack", "nth"])


def _carry_source(rows: list[dict]) -> list[tuple]:
    """Along one source's ranges, a row each: what was there before it. The last, _pre: whether an item stands before the first heading."""
    items, opens = ([r[c] for r in rows if r[c] is not None] for c in ("first_item", "first_open"))
    pre = bool(items) and not (opens and min(opens) <= min(items))  # also without any heading
    stack, opened, last, out = [], 0, (None, None, None), []
    for r in rows:
        out.append((r["source"], r["_range"], [{"depth": d, "title": t} for d, t in stack], opened, *last, int(pre)))
        if r["low"] is not None:
            stack = [*(x for x in stack if x[0] < r["low"]), *((x["depth"], x["title"]) for x in r["stack"])]
            opened += r["opened"]
            last = (r["type"], r["title"], r["depth"])
    return out


def _carry_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_carry_source() for each source; ranges come sorted."""
    rows, out = [], []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CARRIED.values(), strict=True)], names=list(_CARRIED))

    for whole in batches:
        for i in range(0, whole.num_rows, SLICE):
            for r in whole.slice(i, SLICE).to_pylist():
                if rows and r["source"] != rows[0]["source"]:
                    out += _carry_source(rows)
                    rows = []
                rows.append(r)
            if out:
                yield batch()
    if rows:
        out += _carry_source(rows)
        yield batch()


def _path(stack, title, depth):
    return F.when(depth == 0, title).otherwise(F.array_join(F.transform(stack, lambda x: x["title"]), " > "))


def place_items(items: DataFrame, span: int = RANGE) -> DataFrame:
    """items (source, item_index, type, content) with section_no, section_type, section_title and section_path.

    Every heading but a bare number opens a section, also an empty one; items before the first one are in a preamble, number 0, which counts as
    a section where it has an item. A numbered heading's path goes through the numbered headings of fewer levels before it, back to
    the last unnumbered one, which is in no path but its own. Sources are kept apart, a null one too. Levels may be as many as they like.
    """
    heading = F.col("type").isin("title", "heading")
    rows = items.withColumn("_range", F.floor(F.col("item_index") / span)).withColumn("_head", F.when(heading, clean_text(F.col("content"))))
    opens = durable(read_headings(rows))
    kind = opens.schema
    by_range = opens.select(*_HEADINGS).repartition("source", "_range").sortWithinPartitions("source", "_range", "item_index")
    stacked = durable(by_range.mapInArrow(_stack_ranges, f"source string, _range long, item_index {kind['item_index'].dataType.simpleString()}, type string, title string, depth int, low int, stack {_STACK}, nth int"))
    sums = stacked.groupBy("source", "_range").agg(F.max_by(F.struct("low", "stack", "type", "title", "depth"), "item_index").alias("_s"), F.count("*").alias("opened"), F.min("item_index").alias("first_open"))
    ranges = rows.groupBy("source", "_range").agg(F.min(F.when(~heading, F.col("item_index"))).alias("first_item"))
    both = ranges.join(sums.withColumnsRenamed({"source": "_source", "_range": "_r"}), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")), "left")
    both = both.select("source", "_range", "first_item", "first_open", "opened", "_s.*")
    carry = durable(both.repartition("source").sortWithinPartitions("source", "_range").mapInArrow(_carry_ranges, f"source string, _range long, _stack {_STACK}, _opened long, _type string, _title string, _depth int, _pre int"))
    start = carry.withColumnsRenamed({"source": "_source", "_range": "_r"})
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r"))
    above = F.filter("_stack", lambda x: x["depth"] < F.col("low"))
    section = F.struct((F.col("_opened") + F.col("nth")).alias("n"), F.col("type").alias("type"), F.col("title").alias("title"), _path(F.concat(above, F.col("stack")), F.col("title"), F.col("depth")).alias("path"))
    known = stacked.join(start, same).select(F.col("source").alias("_source"), F.col("_range").alias("_r"), F.col("item_index").alias("_i"), section.alias("_section"))
    placed = rows.join(known, same & (F.col("item_index") == F.col("_i")), "left").drop("_source", "_r", "_i")
    inside = F.last("_section", ignorenulls=True).over(W.partitionBy("source", "_range").orderBy("item_index"))
    before = F.when(F.col("_opened") > 0, F.struct(F.col("_opened").alias("n"), F.col("_type").alias("type"), F.col("_title").alias("title"), _path(F.col("_stack"), F.col("_title"), F.col("_depth")).alias("path")))
    out = placed.withColumn("_section", inside).join(start, same).withColumn("_section", F.coalesce("_section", before))
    named = {"section_no": F.when(F.col("_section").isNull(), 0).otherwise(F.col("_section.n") + F.col("_pre")).cast("long"), "section_type": F.coalesce("_section.type", F.lit("preamble")), "section_title": F.coalesce("_section.title", F.lit("")), "section_path": F.coalesce("_section.path", F.lit(""))}
    return out.withColumns(named).drop("_range", "_head", "_section", "_source", "_r", "_stack", "_opened", "_type", "_title", "_depth", "_pre")


def number_in_ranges(rows: DataFrame, by: list[str], order: str, name: str, span: int = RANGE) -> DataFrame:
    """rows with their number from 0 in name, by order (a whole number), among those that agree in by. Ranges are counted in parallel, and
    only their counts, a row a range, are added up in order; so a group may hold most of the rows."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / span))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), before.alias("_start"))
    own = ranged.withColumn("_k", F.row_number().over(W.partitionBy(*by, "_range").orderBy(order)) - 1)
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return own.join(starts, same).withColumn(name, (F.col("_start") + F.col("_k")).cast("int")).drop("_range", "_r", "_n", "_k", "_start", *[f"_by{i}" for i in range(len(by))])
