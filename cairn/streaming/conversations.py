"""Conversations as keyed state: each question with the messages before it, from a stream or a table, and batches of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.providers import TextGenerator, standalone_question
from cairn.functions.sizes import durable
from cairn.functions.text import numbered_context
from cairn.operators.context import HISTORY_MESSAGES, answer_sources, history_tail
from cairn.plans.answering import ANSWER, NO_ANSWER, REWRITE, retrieve
from cairn.sources.versions import VersionedTable

MESSAGES = "conv_id long, turn long, role string, text string"
QUESTIONS = "conv_id long, turn long, question string, history string"
_USER = ("user", "human")


def questions_of(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """conv_id, turn, question, history: every message of a user, with up to n messages before it as lines. Turns number a conversation."""
    user = F.lower("role").isin(*_USER)
    line = F.concat(F.when(user, "User").otherwise("Assistant"), F.lit(": "), F.coalesce("text", F.lit("")))
    before = F.collect_list(line).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1))
    return messages.withColumn("history", F.array_join(before, "\n")).where(user).select("conv_id", "turn", F.col("text").alias("question"), "history")


def state_table(spark: SparkSession, path: str) -> VersionedTable:
    """The last messages of every conversation, in versions."""
    return VersionedTable(spark, path, MESSAGES, by="conv_id")


def advance(state: VersionedTable, messages: DataFrame, number: int, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The questions among a micro-batch's messages with what came before them, which is state of their conversations and goes on with them.

    Micro-batch number makes version number of the state from the one before. A batch that comes again after a failure starts from
    the same version as before, so it gives the same rows. Only folders of the batch's conversations are read.
    """
    new = durable(messages.dropDuplicates(["conv_id", "turn"]))
    keys = new.select("conv_id").distinct()
    buckets = sorted(r["b"] for r in keys.select(state.bucket(F.col("conv_id")).alias("b")).distinct().collect())  # at most the table's
    old = state.read(number - 1, buckets).join(keys, "conv_id", "left_semi").join(new.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    every = durable(old.unionByName(new))
    if state.version() < number:
        state.replace(history_tail(every, n), expect=number - 1)
    return questions_of(every, n).join(new.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")


def replay(spark: SparkSession, source: str, sink: str, state: str, checkpoint: str, files_per_trigger: int = 1000, n: int = HISTORY_MESSAGES) -> None:
    """Reads the files of messages in source that have not been read yet, in which a conversation's turns come in order, and writes their
    questions to sink, a folder a micro-batch. One stream a state."""
    table = state_table(spark, state)

    def step(batch: DataFrame, number: int) -> None:
        advance(table, batch, number, n).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_questions(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).parquet(sink).drop("batch")


def rewrite(questions: DataFrame, make: Callable[[], TextGenerator]) -> DataFrame:
    """questions (question, history) with query: the question put so that it stands alone; make() runs once in each worker."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema] + ["query string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(query=[standalone_question(q, h, model, REWRITE) for q, h in zip(b["question"].fillna(""), b["history"], strict=True)])

    return questions.mapInPandas(run, schema)


def answer_batch(chunks: DataFrame, questions: DataFrame, embedder, make: Callable[[], TextGenerator], k: int = 5, chunk_type: str | None = None) -> DataFrame:
    """query_id, question, search_query, answer, sources for questions (query_id, question, history) of any number of conversations.

    All are rewritten, retrieved in one plan, and answered by a model of which each worker has one. A question without a hit is
    answered by NO_ANSWER and asks no model; a blank one too, as its search finds nothing.
    """
    asked = rewrite(questions.select("query_id", "question", "history"), make)
    found = retrieve(chunks, asked.select("query_id", "query"), embedder, k, chunk_type, neighbours=1)
    sources = answer_sources(found)
    contexts = found.groupBy("query_id").agg(numbered_context(F.collect_list(F.struct(F.col("rank").alias("n"), "citation", "context"))).alias("context"))
    rows = asked.join(contexts, "query_id", "left").join(sources, "query_id", "left")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["answer string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(answer=[model.generate(ANSWER.format(context=c, question=q)) if isinstance(c, str) else NO_ANSWER for c, q in zip(b["context"], b["question"], strict=True)])

    none = F.array().cast(sources.schema["sources"].dataType)
    return rows.mapInPandas(run, schema).select("query_id", "question", F.col("query").alias("search_query"), "answer", F.coalesce("sources", none).alias("sources"))
