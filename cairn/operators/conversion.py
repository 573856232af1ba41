"""From the nodes that a layout parser gives for a document to its items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.text import caption_title, first_line, is_valid_table, safe_name, stem_of, strip, table_to_html, table_to_markdown
from cairn.operators.geometry import PAGE, classify, drop_figure_labels, equation_rects, equations, exclude_covered, figure_captions, figure_regions, table_captions

#: A node: kind is table, picture or text; label is the parser's; captions are the refs of the captions of a table or picture,
#: whose text is caption; the box is in points from the top left of the page, null where the parser has none.
NODES = "source string, node_index long, kind string, label string, page int, text string, ref string, captions array<string>, caption string, cells array<array<string>>, l double, t double, r double, b double"
# Fixed values of the query semantics: page furniture, and labels whose text may be drawn in a figure.
SKIP_LABELS, FIGURE_TEXT = ("page_header", "page_footer"), ("title", "section_header", "text")
FOLDERS = {"table": "tables/", "figure": "", "equation": "equations/"}


def drop_furniture(nodes: DataFrame) -> DataFrame:
    """nodes without page headers and footers, tables without a word, and texts without anything."""
    words = table_to_markdown(F.coalesce("cells", F.array().cast("array<array<string>>"))).rlike(r"(?U)\w")
    text = (F.col("kind") == "text") & (F.coalesce(strip(F.col("text")), F.lit("")) != "") & ~F.coalesce(F.col("label").isin(*SKIP_LABELS), F.lit(False))
    return nodes.where(((F.col("kind") == "table") & words) | (F.col("kind") == "picture") | text)


def drop_attached_captions(kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """kept without the captions that a table or picture among nodes of their source holds, even one that is dropped itself."""
    held = nodes.where(F.col("kind").isin("table", "picture")).select(F.col("source").alias("_s"), F.explode("captions").alias("_ref")).distinct()
    return kept.join(held, (F.col("label") == "caption") & (F.col("source") == F.col("_s")) & (F.col("ref") == F.col("_ref")), "left_anti")


def convert_nodes(nodes: DataFrame, image_dir: str = "images") -> DataFrame:
    """The items of every source, numbered from 0 in the order of its nodes.

    Tables become Markdown under their caption's title, pictures figures, formulas equations, headings their first line; short
    texts drawn in or beside a picture are dropped, as are furniture and captions that a table or picture has. Pictures of
    tables, figures and equations are named by source, page, number from 0 and title. A null box is beside no picture.
    """
    texts = nodes.withColumn("text", strip(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n"))))
    kept = drop_attached_captions(drop_furniture(texts), nodes)
    pictures = nodes.where("kind = 'picture' AND l IS NOT NULL").select("source", "page", "l", "t", "r", "b")
    drawn = (F.col("kind") == "text") & F.col("label").isin(*FIGURE_TEXT)
    rows = drop_figure_labels(kept.where(drawn), pictures).unionByName(kept.where(~F.coalesce(drawn, F.lit(False))))
    of = F.col("label")
    kind = (
        F.when(F.col("kind") == "table", "table").when(F.col("kind") == "picture", "figure").when(of == "title", "title").when(of == "section_header", "heading")
        .when(of == "formula", "equation").when(of == "caption", "caption").otherwise("paragraph"))
    rows = rows.withColumn("type", kind).withColumn("_title", caption_title(F.col("caption")))
    by = W.partitionBy("source")
    number = F.row_number().over(W.partitionBy("source", "type").orderBy("node_index")) - 1
    folder = F.element_at(F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair]), F.col("type"))
    name = F.concat(F.lit(f"{image_dir}/"), folder, stem_of(F.col("source")), F.lit("_p"), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit("_"), F.col("type"), F.lit("_"), number.cast("string"))
    titled = F.when(F.col("type") == "equation", name).otherwise(F.concat(name, F.lit("_"), safe_name(F.col("_title"))))
    content = F.when(F.col("type").isin("title", "heading"), first_line(F.col("text"))).when(F.col("type").isin("paragraph", "caption"), F.col("text"))
    title = F.when(F.col("type") == "table", F.nullif("_title", F.lit(""))).when(F.col("type") == "figure", F.col("_title"))
    return rows.withColumn("item_index", (F.row_number().over(by.orderBy("node_index")) - 1).cast("long")).select(
        "source", "item_index", "type", "page", content.alias("content"), title.alias("title"), F.when(F.col("type") == "table", table_to_markdown(F.col("cells"))).alias("table_data"),
        F.when(F.col("type") == "equation", F.col("text")).alias("text_fallback"), F.when(F.col("type").isin(*FOLDERS), F.concat(titled, F.lit(".png"))).alias("image_path"))


#: Labels of blocks that become items of their own; equations become items another way.
KEPT_LABELS = ("title", "heading", "paragraph", "caption")


def extract_items(blocks: DataFrame, tables: DataFrame, rects: DataFrame, pages: DataFrame, image_dir: str = "images") -> DataFrame:
    """The items of pages that were read as blocks (geometry.rich_blocks), tables (source, page, table_id, cells, x0 to y1), usable
    rectangles of pictures and drawings, and pages (source, page, width, height); numbered from 0 in each source.

    On a page come the blocks that no valid table or equation covers, by their label, then tables as HTML, figures that have a
    caption, and equations. Tables and figures are named by source, page, number from 0 on the page, and title.
    """
    sized = blocks.join(pages.select(*PAGE, F.col("height").alias("page_height")), PAGE)
    valid = tables.where(is_valid_table(F.col("cells")))
    covers = valid.select(*PAGE, "x0", "y0", "x1", "y1").unionByName(equation_rects(sized))
    stem, page = F.concat(stem_of(F.col("source")), F.lit("_page_"), F.col("page").cast("string")), W.partitionBy(*PAGE)
    null = F.lit(None).cast("string")
    columns = lambda part, order, kind, **c: [*PAGE, F.lit(part).alias("_part"), order.alias("_order"), kind.alias("type"), *[c.get(n, null).alias(n) for n in ("content", "title", "table_data", "text_fallback", "image_id", "image_path")], c.get("font_size", F.lit(None).cast("double")).alias("font_size")]
    # labels come from the fonts of whole pages, so blocks are labelled before any is left out
    texts = exclude_covered(classify(sized), covers).where(F.col("label").isin(*KEPT_LABELS))
    out = texts.select(*columns(0, F.struct("block_order", F.lit(0).alias("line")), F.col("label"), content=F.col("text"), font_size=F.round("font_size", 1)))
    named = table_captions(valid.withColumn("_n", F.row_number().over(page.orderBy("table_id")) - 1), blocks)
    table_id = F.concat(stem, F.lit("_table_"), F.col("_n").cast("string"))
    safe = F.coalesce(F.regexp_replace(F.nullif("title", F.lit("")), r"[^\p{L}\p{N}_-]", "_"), F.concat(F.lit("table_"), F.col("_n").cast("string")))
    out = out.unionByName(named.select(*columns(1, F.struct(F.col("_n").alias("block_order"), F.lit(0).alias("line")), F.lit("table"), title=F.nullif("title", F.lit("")), table_data=table_to_html(F.col("cells")), image_id=table_id, image_path=F.concat(F.lit(f"{image_dir}/tables/"), table_id, F.lit("_"), safe, F.lit(".png")))))
    captions = figure_captions(blocks).withColumn("caption_id", F.row_number().over(page.orderBy("block_order", "line")) - 1)
    figures = figure_regions(captions, rects, pages).where("f_x0 IS NOT NULL")
    path = F.concat(F.lit(f"{image_dir}/"), stem, F.lit("_figure_"), F.col("caption_id").cast("string"), F.lit("_"), F.regexp_replace("title", r"[^a-zA-Z0-9_-]", "_"), F.lit(".png"))
    out = out.unionByName(figures.select(*columns(2, F.struct(F.col("caption_id").alias("block_order"), F.lit(0).alias("line")), F.lit("figure"), title=F.col("title"), image_path=path)))
    out = out.unionByName(equations(sized).select(*columns(3, F.struct("block_order", F.lit(0).alias("line")), F.lit("equation"), text_fallback=F.col("text"))))
    number = F.row_number().over(W.partitionBy("source").orderBy("page", "_part", "_order")) - 1
    return out.withColumn("item_index", number.cast("long")).drop("_part", "_order")


def page_breaks(items: DataFrame) -> DataFrame:
    """items with page_break: whether an item's page differs from the one before it in its source. The first one's always does,
    unless it has none."""
    before = F.lag("page").over(W.partitionBy("source").orderBy("item_index"))
    return items.withColumn("page_break", ~F.col("page").eqNullSafe(before))
