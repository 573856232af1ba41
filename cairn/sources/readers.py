"""Sources: text folders, JSON arrays, lists in memory, layouts of PDF files, and stored indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.sizes import durable, maybe_broadcast
from cairn.operators.chunking import ITEMS

CHUNKS = (
    "chunk_id string, chunk_index int, parent_id string, item_indices array<bigint>, type string, source string, section_title string, section_path string, "
    "page_start int, page_end int, content string, image_paths array<string>, embedding_text string, char_count int"
)
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
SPANS = "source string, page int, block int, line int, span int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every *.txt file of a folder; an error if the folder is missing or has none."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no .txt files in {path}")
    return rows


def read_json_array(spark: SparkSession, path: str, schema: str, number: bool = True) -> DataFrame:
    """A row for each object of a JSON array, numbered from 0 in item_index unless number is False; an error if the file is missing or
    not an array. What write_json_array() wrote is read by as many tasks as Spark makes of its lines; another array is one task's."""
    from cairn.sources.writers import ARRAY_OPEN, _files

    fs, where = _files(spark, path)
    if fs.exists(where(f"{path}/{ARRAY_OPEN}")):
        return _read_lines(spark, path, schema, number)
    whole = spark.read.text(path, wholetext=True)
    if whole.where(~F.ltrim("value").startswith("[")).limit(1).count():
        raise ValueError(f"{path} is not a JSON array")
    parsed = F.from_json("value", f"array<struct<{', '.join(_field(f) for f in _split(schema))}>>")
    rows = whole.select(F.posexplode(parsed).alias("item_index", "_x")).select(F.col("item_index").cast("long"), "_x.*")
    return rows if number else rows.drop("item_index")


def _read_lines(spark: SparkSession, path: str, schema: str, number: bool) -> DataFrame:
    """An array of a line an object. To number them, lines are written with their block of a file and their place among a task's
    lines; blocks, a row each, are added up in the order of files."""
    block = ["_file", "_block"]
    lines = spark.read.text(path).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    objects = lines.where(~F.col("value").isin("[", "]", ",")).withColumn("_x", F.from_json(F.regexp_replace("value", "^,", ""), f"struct<{', '.join(_field(f) for f in _split(schema))}>"))
    if not number:
        return objects.select("_x.*")
    kept = durable(objects.select("_x", *block, "_line"))
    counts = kept.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a block
    starts = counts.select(*block, (before - F.col("_first")).alias("_start"))
    return kept.join(maybe_broadcast(starts), block).select((F.col("_line") + F.col("_start")).alias("item_index"), "_x.*")


def _split(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def _field(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"{name}: {kind}"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, ", ".join(f for f in _split(ITEMS) if not f.startswith("item_index ")))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, CHUNKS, number=False)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where nothing is stored yet. A table that a writer left moved away is put back first."""
    from cairn.sources.writers import recover_table

    recover_table(spark, path)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """text, topic, source of a JSON array of texts; a missing topic is "unknown", the source is the place in the array."""
    rows = read_json_array(spark, path, "text string, topic string")
    return rows.select("text", F.coalesce("topic", F.lit("unknown")).alias("topic"), F.concat(F.lit("chunk_"), F.col("item_index").cast("string")).alias("source"))


def from_list(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(t, f"chunk_{i}") for i, t in enumerate(texts)], "page_content string, source string")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """source, file_index, content of the PDF files of a folder that may be ingested: by name, size and first bytes. file_index
    numbers the folder's PDF files by name, in which order they are to be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("source")
    order = files.select(name).distinct().select("source", (F.row_number().over(W.orderBy("source")) - 1).alias("file_index"))  # names only
    right = files.where((F.col("length") <= MAX_UPLOAD_BYTES) & (F.substring("content", 1, 4) == F.lit(b"%PDF")))
    return right.select(name, "content").join(maybe_broadcast(order), "source").select("source", "file_index", "content")


def parse_pdfs(files: DataFrame, parser: Callable[[], Callable[[str, bytes], Iterable[dict]]], schema: str = SPANS) -> DataFrame:
    """Rows of a parser's output for every file. parser() is called once in each worker, as loading models is slow; it returns a
    function of name and bytes. A file that it cannot read gives no rows. No parser of PDF files comes with this library."""
    names = [f.split(" ")[0] for f in _split(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = parser()
        for b in batches:
            for name, content in zip(b["source"], b["content"], strict=True):
                try:
                    rows = list(parse(name, bytes(content)))
                except ValueError:
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.select("source", "content").mapInPandas(run, schema)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
