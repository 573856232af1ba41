"""Sections and chunks from the items of a layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.text import PAGE_NUMBER, embedding_text, item_text, stable_id, stem_of
from cairn.operators.sections import number_in_ranges, place_items
from cairn.operators.splitting import CHUNK_OVERLAP, CHUNK_SIZE, split_table, split_text

# Fixed value of the query semantics.
MIN_CHUNK_CHARS = 50

ITEMS = "source string, item_index long, type string, page int, content string, title string, table_data string, text_fallback string, image_path string"


def prepare_items(items: DataFrame) -> DataFrame:
    """items with their text. Which items are dropped is decided after sections are numbered, as any item opens a preamble."""
    return items.withColumn("text", item_text(F.col("type"), F.col("content"), F.col("title"), F.col("table_data"), F.col("text_fallback")))


def is_page_number(kind: Column, text: Column) -> Column:
    return (kind == "paragraph") & text.rlike(PAGE_NUMBER)


def assign_sections(items: DataFrame) -> DataFrame:
    """Items with section_no, parent_id, section_type, section_title and section_path (see sections.place_items()); headings, empty
    items and page numbers are gone. parent_id is section_no behind section_, of four digits at least: order by section_no."""
    rows = place_items(prepare_items(items)).withColumn("parent_id", F.format_string("section_%04d", F.col("section_no")))
    kept = ~F.col("type").isin("title", "heading") & (F.coalesce("text", F.lit("")) != "") & ~is_page_number(F.col("type"), F.col("text"))
    return rows.where(kept)


def pack(texts: Column, size: int = CHUNK_SIZE) -> Column:
    """Groups, as arrays of positions from 0, of neighbouring texts: a text starts a new group if it would not fit the one before
    with a blank line behind every text in it."""

    def step(state, x):
        full = (F.size(state["now"]) > 0) & (state["size"] + F.length(x["text"]) > size)
        done = F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"])
        now = F.when(full, F.array(x["i"])).otherwise(F.concat(state["now"], F.array(x["i"])))
        length = F.when(full, F.lit(0)).otherwise(state["size"]) + F.length(x["text"]) + 2
        return F.struct(done.alias("done"), now.alias("now"), length.alias("size"))

    numbered = F.transform(texts, lambda t, i: F.struct(i.alias("i"), t.alias("text")))
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("now"), F.lit(0).alias("size"))
    return F.aggregate(numbered, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def pack_sections(rows: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Groups of a section's items that become chunks together: source and the section's columns, group, type, items.

    Tables and figures stand alone. Runs of other items between them are packed up to size. A run of one section is one array.
    """
    alone = F.col("type").isin("table", "figure")
    by = W.partitionBy("source", "parent_id").orderBy("item_index")
    runs = rows.withColumn("_alone", alone).withColumn("_run", F.sum((alone | F.coalesce(F.lag(alone).over(by), F.lit(False))).cast("int")).over(by))
    item = F.struct("item_index", "text", "page", "image_path", "type")
    one = ["source", "section_no", "parent_id", "section_type", "section_title", "section_path", "_run", "_alone"]
    grouped = runs.groupBy(*one).agg(F.array_sort(F.collect_list(item)).alias("items"))
    packed = grouped.withColumn("_groups", pack(F.transform("items", lambda x: x["text"]), size)).select("*", F.posexplode("_groups").alias("_k", "_at"))
    picked = packed.withColumn("items", F.transform("_at", lambda i: F.get(F.col("items"), i)))
    kind = F.when(F.col("_alone"), F.col("items")[0]["type"]).otherwise(F.lit("text"))
    return picked.select("source", "section_no", "parent_id", "section_type", "section_title", "section_path", F.struct("_run", "_k").alias("group"), kind.alias("type"), "items")


def create_chunks(items: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of every source's items, numbered per source set in reading order.

    A chunk keeps all pages, items and images of the group that its piece comes from. A last text chunk of a section that is
    shorter than MIN_CHUNK_CHARS joins the text chunk before it, which takes its items, and its last page if it has one. Chunks
    that get the same id are one chunk, the first. A source's title is that of its first section that keeps items and has one.
    """
    sectioned = assign_sections(items)
    groups = pack_sections(sectioned, size)
    joined = F.array_join(F.transform("items", lambda x: x["text"]), "\n\n")
    whole = groups.withColumn("_text", joined).withColumn("_split", split_text(size, overlap)(F.col("_text")))
    table = F.when(F.col("type") == "table", split_table(F.col("_text"), size))
    pieces = whole.withColumn("_pieces", F.coalesce(table, F.col("_split"))).select("*", F.posexplode("_pieces").alias("piece_index", "content")).drop("_text", "_split", "_pieces")
    by = W.partitionBy("source", "parent_id").orderBy("group", "piece_index")
    after = W.partitionBy("source", "parent_id")
    ranked = pieces.withColumn("_i", F.row_number().over(by)).withColumn("_n", F.count("*").over(after))
    last = F.lead(F.struct("type", "content", "items")).over(by)
    ranked = ranked.withColumn("_next", last).withColumn("_before", F.lag("type").over(by))
    short = (F.col("type") == "text") & (F.length("content") < MIN_CHUNK_CHARS)
    ranked = ranked.where(~((F.col("_i") == F.col("_n")) & short & F.coalesce(F.col("_before") == "text", F.lit(False))))
    takes = (F.col("_i") == F.col("_n") - 1) & (F.col("type") == "text") & F.coalesce((F.col("_next.type") == "text") & (F.length("_next.content") < MIN_CHUNK_CHARS), F.lit(False))
    merged = ranked.withColumn("content", F.when(takes, F.concat("content", F.lit("\n\n"), F.col("_next.content"))).otherwise(F.col("content")))
    merged = merged.withColumn("_more", F.when(takes, F.col("_next.items")).otherwise(F.slice("items", 1, 0)))
    titles = sectioned.where("section_title <> ''").groupBy("source").agg(F.min_by("section_title", "item_index").alias("_document"))
    named = merged.join(titles, "source", "left").withColumn("_document", F.coalesce("_document", stem_of(F.col("source"))))
    pages = lambda of: F.filter(F.transform(of, lambda x: x["page"]), lambda p: p.isNotNull())
    images = F.filter(F.transform("items", lambda x: x["image_path"]), lambda p: F.coalesce(p != "", F.lit(False)))
    chunks = named.select(
        stable_id(F.col("source"), F.col("section_path"), F.col("content")).alias("chunk_id"), "parent_id",
        F.transform(F.concat("items", "_more"), lambda x: x["item_index"]).alias("item_indices"), "type", "source", "section_title", "section_path",
        F.array_min(pages("items")).alias("page_start"), F.coalesce(F.nullif(F.array_max(pages("_more")), F.lit(0)), F.array_max(pages("items"))).alias("page_end"), "content",
        F.nullif(images, F.array().cast("array<string>")).alias("image_paths"),
        embedding_text(F.col("_document"), F.col("section_path"), F.col("content")).alias("embedding_text"), F.length("content").alias("char_count"),
        F.struct("section_no", "group", "piece_index").alias("_order"),
    )
    return number_chunks(first_of(chunks, "chunk_id", "source", "_order"), "_order").drop("_order")


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the first by order. dropDuplicates() would keep any."""
    return rows.withColumn("_first", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_first = 1").drop("_first")


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_last", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where("_last = 1").drop("_last")


def number_chunks(chunks: DataFrame, order: str) -> DataFrame:
    """chunk_index from 0 within each source, by a struct that begins with section_no. Chunks are counted by section, in parallel, and
    only sections, a row each, are added up within a source. (source, chunk_index) orders chunks; index.renumber() makes one
    sequence over all sources where a caller needs it."""
    at = F.col(f"{order}.section_no")
    counts = chunks.groupBy("source", at.alias("_no")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("source").alias("_source"), "_no", before.alias("_start"))
    own = chunks.withColumn("_k", F.row_number().over(W.partitionBy("source", at).orderBy(order)) - 1)
    joined = own.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (at == F.col("_no")))
    return joined.withColumn("chunk_index", (F.col("_start") + F.col("_k")).cast("int")).drop("_source", "_no", "_start", "_k")


def running_number(items: DataFrame) -> DataFrame:
    """items with type_number: the number from 0 of each item among those of its type and source, counted by ranges of items."""
    return number_in_ranges(items, ["source", "type"], "item_index", "type_number")
