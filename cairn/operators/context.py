"""What surrounds hits and questions: neighbouring chunks, citations, sources of an answer, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.text import citation, numbered_context

# Fixed values of the query semantics.
HISTORY_MESSAGES, MAX_IMAGES = 8, 3


def expand_neighbours(chunks: DataFrame, neighbours: int, key: tuple[str, ...] = ("source", "parent_id"), order: str = "chunk_index", text: str = "content") -> DataFrame:
    """chunks with context: their text with that of so many chunks before and behind in their section, which is a source's."""
    if neighbours <= 0:
        return chunks.withColumn("context", F.col(text))
    around = W.partitionBy(*key).orderBy(order).rowsBetween(-neighbours, neighbours)
    return chunks.withColumn("context", F.array_join(F.collect_list(text).over(around), "\n\n"))


def with_citations(results: DataFrame) -> DataFrame:
    return results.withColumn("citation", citation(F.col("source"), F.col("page_start"), F.col("page_end"), F.col("section_path")))


def prompt_context(results: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """by, context: each query's results (rank, citation, context), numbered, as one text. Results are bounded by the search."""
    entry = F.struct(F.col(rank).alias("n"), "citation", "context")
    return results.groupBy(by).agg(numbered_context(F.collect_list(entry)).alias("context"))


def history_tail(messages: DataFrame, n: int = HISTORY_MESSAGES, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each conversation's last n messages."""
    order = W.partitionBy(by).orderBy(F.col(turn).desc())
    return messages.withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= n).drop("_back")


def format_history(messages: DataFrame, n: int = HISTORY_MESSAGES, by: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """by, history: the last n messages as lines that begin with User: or Assistant:."""
    line = F.concat(F.when(F.lower(F.col(role)).isin("user", "human"), "User").otherwise("Assistant"), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("line")))), lambda x: x["line"])
    return history_tail(messages, n, by, turn).groupBy(by).agg(F.array_join(lines, "\n").alias("history"))


def pick_images(results: DataFrame, limit: int = MAX_IMAGES, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """by, n, path: the first images, each once, of each query's results (rank, image_paths), in the order of sources."""
    each = results.select(by, F.col(rank).alias("n"), F.posexplode("image_paths").alias("i", "path")).groupBy(by, "path").agg(F.min(F.struct("n", "i")).alias("at"))
    order = W.partitionBy(by).orderBy("at")
    return each.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select(by, F.col("at.n").alias("n"), "path")


def answer_sources(results: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """by, sources: an array of {n, citation, type, chunk_id, image_paths} in the order of n."""
    entry = F.struct(F.col(rank).alias("n"), "citation", "type", "chunk_id", "image_paths")
    return results.groupBy(by).agg(F.array_sort(F.collect_list(entry), lambda a, b: a["n"] - b["n"]).alias("sources"))
