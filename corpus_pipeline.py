"""From raw documents to a training mixture, in five stages over whole tables.

Every stage takes null and empty texts and null columns, texts of any length, repeated rows and ids, empty tables, and columns of
any name beside those of documents, which go through unchanged. What it does with rows that tie is said with its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from cairn.llm.common import durable, free_names, table

#: Documents are near copies from this similarity of their five-word shingles on.
PERCENT = 80
#: SQL cannot express the first stage's model, so there is no SQL for the rows of run().
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents and drops those that score 0.5 or more; texts that are null or empty stay. Equal texts
    score alike, so repeated rows stay or go together; without labels of both classes nothing goes."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (name,) = free_names(docs, "score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the lines that too many documents of a source share; every document stays, though its text may become empty."""
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]
    aside = dict(zip(own, free_names(docs, *own), strict=True))  # the operator has columns of these names
    cleaned = line_dedup.drop_boilerplate(docs.withColumnsRenamed(aside)).drop("n_lines", "n_dropped")
    return cleaned.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group that PERCENT and more of shared shingles link, and all
    documents without words. Rows are told apart by doc_id and words, so repeated and null ids lose no text."""
    return near_dedup.drop_near_copies(docs, percent=PERCENT)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark; without one all stay, and so do null and empty texts."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources come near their targets; copy numbers the repetitions of a document from 0. It is called _copy
    where the documents have a column copy."""
    name = "copy" if "copy" not in {c.lower() for c in docs.columns} else free_names(docs, "copy")[0]
    return mixing.repeat(docs, name)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near dedup", near_copies), ("decontamination", leaks), ("mixing", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each but the last is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
