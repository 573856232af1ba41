"""Joins of blocks, tables, figures and captions on a page."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.layout import DEFAULT_FONT, class_of, upper_median
from cairn.functions.text import NUMBERED, strip

# Fixed values of the query semantics, in points and shares of a page.
OVERLAP_SHARE, CAPTION_GAP, LABEL_MARGIN, LABEL_CHARACTERS = 0.45, 100.0, 80.0, 40
#: Drawings smaller than this both ways are no figures.
MIN_DRAWING = 3.0
MIN_WIDTH, MIN_HEIGHT, MIN_SHARE, MAX_GAP_SHARE, MAX_WIDTH_SHARE, JOIN_GAP, PAD = 80.0, 40.0, 0.05, 0.40, 0.95, 20.0, 8.0
TABLE_CAPTION = r"(?i)\A\s*table\s*\d+[a-z]?\s*[:.\-]?\s*(.*)\z"
FIGURE_CAPTION = r"(?i)\A\s*(?:figure|fig\.?)\s*\d+[a-z]?\s*[:.\-]?\s*(.*)\z"
PAGE = ["source", "page"]


def _fragments(spans: DataFrame) -> DataFrame:
    """spans with those of a block that meet in an Arrow batch put together in one row: lines, spans and texts as arrays, the sizes' sum and number n, bold, and
    the rectangle. Parsers give a block's spans one behind the other, so nearly every block is one row before anything is shuffled."""
    key = [*PAGE, "block"]
    names = {c: spans.schema[c].dataType.simpleString() for c in (*key, "line", "span", "text")}
    boxes = {"x0": "min", "y0": "min", "x1": "max", "y1": "max"}
    schema = ", ".join([*(f"{c} {names[c]}" for c in key), *(f"{c}s array<{names[c]}>" for c in ("line", "span", "text")), "size double, n long, bold boolean", *(f"{c} double" for c in boxes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for c in boxes:
                t = t.append_column(f"nan_{c}", pc.is_nan(t[c]))
            # Spark takes NaN for the largest number, Arrow leaves it out
            nan = {c: "all" if how == "min" else "any" for c, how in boxes.items()}
            g = t.group_by(key, use_threads=False).aggregate([
                ("line", "list"), ("span", "list"), ("text", "list"), ("size", "sum"), ("size", "count"), ("bold", "any"), *boxes.items(), *((f"nan_{c}", how) for c, how in nan.items())])
            box = [pc.if_else(pc.fill_null(g[f"nan_{c}_{nan[c]}"], False), pa.scalar(math.nan), g[f"{c}_{how}"]) for c, how in boxes.items()]
            out = [*(g[c] for c in key), *(g[f"{c}_list"] for c in ("line", "span", "text")), g["size_sum"], g["size_count"], g["bold_any"], *box]
            yield from pa.table(out, [*key, "lines", "spans", "texts", "size", "n", "bold", *boxes]).combine_chunks().to_batches()

    doubles = {c: F.col(c).cast("double") for c in ("size", *boxes)}
    return spans.select(*key, "line", "span", "text", "size", "bold", *boxes).withColumns(doubles).mapInArrow(run, schema)


def rich_blocks(spans: DataFrame) -> DataFrame:
    """Blocks from their spans (source, page, block, line, span, text, size, bold, x0, y0, x1, y1): lines joined, mean font size
    (10 without spans of a size), bold if any span is; in reading order of rounded top and left edge, in block_order.

    Spans of a block are put together where they are read, and what is shuffled, once and by page, is those pieces. Spans in any
    order give the same blocks, though then more is shuffled.
    """
    pieces = _fragments(spans).repartition(*PAGE)
    own = F.flatten(F.transform(F.collect_list(F.struct("lines", "spans", "texts")), lambda f: F.arrays_zip(f["lines"].alias("lines"), f["spans"].alias("spans"), f["texts"].alias("texts"))))

    def joined(all_: Column) -> Column:
        """The sorted spans' texts, a line feed where a line begins that is not the block's first."""
        begins = lambda s, i: (i > 0) & ~F.get(all_, i - 1)["lines"].eqNullSafe(s["lines"])
        return F.array_join(F.transform(all_, lambda s, i: F.concat(F.when(begins(s, i), "\n").otherwise(""), F.coalesce(s["texts"], F.lit("")))), "")

    text = strip(F.get(F.transform(F.array(F.sort_array(own)), joined), F.lit(0)))  # bound to a variable, a block's spans are sorted once and not for each of them
    blocks = pieces.groupBy(*PAGE, "block").agg(
        text.alias("text"), F.coalesce(F.sum("size") / F.nullif(F.sum("n"), F.lit(0)), F.lit(10.0)).alias("font_size"), F.bool_or("bold").alias("is_bold"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where("text <> ''")
    return blocks.withColumn("block_order", F.row_number().over(W.partitionBy(*PAGE).orderBy(F.round("y0", 1), "x0")))


def page_fonts(blocks: DataFrame) -> DataFrame:
    """source, page, median_font."""
    return blocks.groupBy(*PAGE).agg(upper_median(F.collect_list("font_size")).alias("median_font"))


def classify(blocks: DataFrame) -> DataFrame:
    """blocks (with page_height) with their label, by the fonts of their page: the upper median of its blocks' sizes. Blocks are
    shuffled once, by page."""
    page, size = W.partitionBy(*PAGE), F.when(F.col("font_size") > 0, F.col("font_size"))
    numbered = blocks.withColumn("_i", F.row_number().over(page.orderBy(size.asc_nulls_last()))).withColumn("_n", F.count(size).over(page))
    middle = F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, size)).over(page)
    fonts = numbered.withColumn("_median", F.coalesce(middle, F.lit(DEFAULT_FONT))).withColumn("_bare", strip(F.col("text")))
    rows = fonts.withColumn("_low", F.lower("_bare"))
    label = class_of(F.col("_bare"), F.col("_low"), F.col("font_size"), F.col("is_bold"), F.col("y0"), F.col("page_height"), F.col("_median"))
    return rows.withColumn("label", label).drop("_i", "_n", "_median", "_bare", "_low")


def equation_rects(blocks: DataFrame, pad: float = 6.0) -> DataFrame:
    """Padded rectangles of the blocks that look like equations, as equations() finds them."""
    return equations(blocks).select(*PAGE, (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"))


def equations(blocks: DataFrame) -> DataFrame:
    """The blocks (with page_height) that are equations where text is of the default font, whatever their page's fonts."""
    rows = blocks.withColumn("_bare", strip(F.col("text"))).withColumn("_low", F.lower("_bare"))
    label = class_of(F.col("_bare"), F.col("_low"), F.col("font_size"), F.col("is_bold"), F.col("y0"), F.col("page_height"), F.lit(DEFAULT_FONT))
    return rows.withColumn("_label", label).where("_label = 'equation'").drop("_bare", "_low", "_label")


def _named(rects: DataFrame, p: str) -> DataFrame:
    return rects.select(*PAGE, *[F.col(c).alias(f"{p}{c}") for c in rects.columns if c not in PAGE])


def exclude_covered(blocks: DataFrame, rects: DataFrame, share: float = OVERLAP_SHARE) -> DataFrame:
    """blocks of which no rectangle on their page covers so large a share. Equal pages are joined, not all pairs."""
    r = _named(rects.select(*PAGE, "x0", "y0", "x1", "y1"), "r_")
    width = F.least("x1", "r_x1") - F.greatest("x0", "r_x0")
    height = F.least("y1", "r_y1") - F.greatest("y0", "r_y0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    same = (blocks["source"] == r["source"]) & (blocks["page"] == r["page"])
    return blocks.join(r, same & (width > 0) & (height > 0) & (area > 0) & (width * height >= share * area), "left_anti")


def usable_rects(rects: DataFrame, least: float = 0.0) -> DataFrame:
    """rects that are not empty; with least, as for drawings, also not smaller than that both ways."""
    wide, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return rects.where((wide > 0) & (tall > 0) & ~((wide < least) & (tall < least)))


def union_rects(rects: DataFrame, by: list[str]) -> DataFrame:
    """The smallest rectangle around all of each group."""
    return rects.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def caption_lines(blocks: DataFrame, pattern: str) -> DataFrame:
    """source, page, title, caption, line (its number in the block) and the block's rectangle, and order if it has one, for each line
    that is a caption."""
    order = [c for c in ("block_order",) if c in blocks.columns]
    rows = blocks.select(*PAGE, *order, "x0", "y0", "x1", "y1", F.posexplode(F.split("text", "\n")).alias("line", "_line")).withColumn("caption", strip(F.col("_line")))
    return rows.where(F.col("caption").rlike(pattern)).withColumn("title", strip(F.regexp_extract("caption", pattern, 1))).drop("_line")


def table_captions(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """tables (with table_id) with the title of the nearest caption that ends above them, within CAPTION_GAP; of equally near
    ones the smallest title; null without one."""
    c = caption_lines(blocks, TABLE_CAPTION).select(*[F.col(p).alias(f"c_{p}") for p in PAGE], "title", F.col("y1").alias("c_y1"))
    gap = F.col("y0") - F.col("c_y1")
    near = tables.join(c, (F.col("source") == F.col("c_source")) & (F.col("page") == F.col("c_page")) & (gap >= 0) & (gap <= CAPTION_GAP))
    best = near.groupBy(*PAGE, "table_id").agg(F.min(F.struct(gap.alias("gap"), "title"))["title"].alias("title"))
    return tables.join(best, [*PAGE, "table_id"], "left")


def figure_captions(blocks: DataFrame) -> DataFrame:
    return caption_lines(blocks, FIGURE_CAPTION).where("title <> ''")


def _union(a: Column, b: Column) -> Column:
    low, high = (lambda k: F.least(a[k], b[k]).alias(k)), (lambda k: F.greatest(a[k], b[k]).alias(k))
    return F.struct(low("x0"), low("y0"), high("x1"), high("y1"))


def figure_regions(captions: DataFrame, rects: DataFrame, pages: DataFrame) -> DataFrame:
    """captions (with caption_id, x0 to y1) with the figure's rectangle f_x0 to f_y1, null without one.

    Of the pictures and drawings on the page that are large and near enough, ordered by vertical gap, then by the distance of
    centers, the first grows by each next one that lies within JOIN_GAP of what it has grown to. It is padded and cut to the
    page, and dropped if it is almost as wide as that. pages has (source, page, width, height).
    """
    r = _named(rects.select(*PAGE, "x0", "y0", "x1", "y1"), "r_").join(pages.withColumnsRenamed({"width": "_w", "height": "_h"}), PAGE)
    tall, wide = F.col("r_y1") - F.col("r_y0"), F.col("r_x1") - F.col("r_x0")
    r = r.where((wide >= MIN_WIDTH) & (tall >= MIN_HEIGHT) & (wide >= MIN_SHARE * F.col("_w")))
    gap = F.greatest(F.col("y0") - F.col("r_y1"), F.col("r_y0") - F.col("y1"), F.lit(0.0))
    center = F.abs((F.col("r_y0") + F.col("r_y1")) / 2 - (F.col("y0") + F.col("y1")) / 2)
    box = F.struct(F.col("r_x0").alias("x0"), F.col("r_y0").alias("y0"), F.col("r_x1").alias("x1"), F.col("r_y1").alias("y1"))
    near = captions.join(r, PAGE).where(gap <= MAX_GAP_SHARE * F.col("_h"))
    listed = near.groupBy(*PAGE, "caption_id", "_w", "_h").agg(F.array_sort(F.collect_list(F.struct(gap.alias("gap"), center.alias("center"), box.alias("box")))).alias("_c"))

    def grow(best: Column, c: Column) -> Column:
        b = c["box"]
        meets = (F.least(b["x1"], best["x1"] + JOIN_GAP) > F.greatest(b["x0"], best["x0"] - JOIN_GAP)) & (F.least(b["y1"], best["y1"] + JOIN_GAP) > F.greatest(b["y0"], best["y0"] - JOIN_GAP))
        level = (F.abs(b["y0"] - best["y1"]) < JOIN_GAP) | (F.abs(best["y0"] - b["y1"]) < JOIN_GAP)
        return F.when(meets | level, _union(best, b)).otherwise(best)

    found = listed.withColumn("_f", F.aggregate("_c", F.col("_c")[0]["box"], grow))
    cut = {
        "f_x0": F.greatest(F.col("_f.x0") - PAD, F.lit(0.0)), "f_y0": F.greatest(F.col("_f.y0") - PAD, F.lit(0.0)),
        "f_x1": F.least(F.col("_f.x1") + PAD, F.col("_w")), "f_y1": F.least(F.col("_f.y1") + PAD, F.col("_h")),
    }
    found = found.withColumns(cut).where(F.col("f_x1") - F.col("f_x0") <= MAX_WIDTH_SHARE * F.col("_w"))
    return captions.join(found.select(*PAGE, "caption_id", *cut), [*PAGE, "caption_id"], "left")


def drop_figure_labels(headings: DataFrame, pictures: DataFrame) -> DataFrame:
    """headings (text, l, t, r, b on a page) without the short, unnumbered ones in or close to a picture, which are its labels."""
    p = _named(pictures.select(*PAGE, "l", "t", "r", "b"), "p_")
    short = (F.length("text") <= LABEL_CHARACTERS) & ~F.col("text").rlike(NUMBERED)
    across = F.least("r", "p_r") - F.greatest("l", "p_l") > 0
    beside = (F.col("t") < F.col("p_b") + LABEL_MARGIN) & (F.col("b") > F.col("p_t") - LABEL_MARGIN)
    same = (headings["source"] == p["source"]) & (headings["page"] == p["page"])
    return headings.join(p, same & short & across & beside, "left_anti")


def crop_box(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column, pad: float = 4.0) -> Column:
    """A box with its padding, cut to the page; null if nothing is left."""
    box = F.struct(F.greatest(l - pad, F.lit(0.0)).alias("l"), F.greatest(t - pad, F.lit(0.0)).alias("t"), F.least(r + pad, width).alias("r"), F.least(b + pad, height).alias("b"))
    return F.when((box["r"] > box["l"]) & (box["b"] > box["t"]), box)
