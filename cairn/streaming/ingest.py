"""Incremental ingestion: every micro-batch of files replaces its sources in the stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.providers import embed_column
from cairn.functions.sizes import durable
from cairn.operators.chunking import ITEMS, create_chunks, last_of
from cairn.operators.index import apply_sync
from cairn.sources.readers import CHUNKS, read_or_empty
from cairn.sources.versions import VersionedTable

INDEX = f"{CHUNKS}, embedding array<double>"
#: A job's states are appended; the last one counts.
JOBS = "job_id string, source string, status string, stage string, progress double, items long, chunks long, sections long, error string, at timestamp"


def chunk_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, CHUNKS)


def item_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ITEMS)


def index_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, INDEX)


def sync_index(index: VersionedTable, chunks: DataFrame, sources: DataFrame, embedder) -> int:
    """Brings the sources' rows of an index in step with their chunks: only the folders that may hold them are read, only chunks with
    new ids are embedded, and only these sources' rows are written. Another writer who changes them meanwhile is a Conflict."""
    base = index.version()
    buckets = sorted(r["b"] for r in sources.select(index.bucket(F.col("source")).alias("b")).distinct().collect())  # at most the table's
    stored = index.read(base, buckets).join(sources, "source", "left_semi")
    return index.replace(apply_sync(stored.select(*chunks.columns, "embedding"), chunks, lambda rows: embed_column(rows, embedder)), sources, expect=base)


def stream_items(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def record_job(spark: SparkSession, path: str, job_id: str, source: str, status: str, stage: str = "", progress: float = 0.0, items: int | None = None, chunks: int | None = None, sections: int | None = None, error: str | None = None) -> None:
    """Appends a job's state: status is running, done or error."""
    row = spark.createDataFrame([(job_id, source, status, stage, progress, items, chunks, sections, error)], JOBS.removesuffix(", at timestamp"))
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def jobs(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """The last state of every job; with status, of those in it."""
    last = read_or_empty(spark, path, JOBS).groupBy("job_id").agg(F.max_by(F.struct("source", "status", "stage", "progress", "items", "chunks", "sections", "error", "at"), "at").alias("s"))
    rows = last.select("job_id", "s.*")
    return rows if status is None else rows.where(F.col("status") == status)


def job_status(spark: SparkSession, path: str, job_id: str) -> dict:
    """The last state of one job; a LookupError if there is none."""
    row = jobs(spark, path).where(F.col("job_id") == job_id).first()
    if row is None:
        raise LookupError(f"unknown job: {job_id}")
    return row.asDict()


def run_ingest(spark: SparkSession, folder: str, chunks_path: str, checkpoint: str, files_per_trigger: int = 16, embedder: Callable | None = None, index_path: str | None = None, items_path: str | None = None, jobs_path: str | None = None) -> StreamingQuery:
    """Starts a query that ingests what is there and ends. The stored tables are versioned: a batch writes its own sources' rows, whatever
    else is stored, and readers see each table before or after it. A batch that is repeated after a failure replaces the same sources by
    the same rows, so the tables are right whenever it ends.

    With items_path the batch's items replace their sources' too. With embedder and index_path the index is brought in step. With
    jobs_path each batch is a job, whose states are recorded for every source of it.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        items = durable(last_of(batch.withColumn("_key", F.struct("source", "item_index")).withColumn("_seen", F.monotonically_increasing_id()), "_key", "_seen").drop("_key", "_seen"))
        job, source = uuid.uuid4().hex, f"batch {number}"
        tell = (lambda *a, **k: record_job(spark, jobs_path, job, source, *a, **k)) if jobs_path else (lambda *a, **k: None)
        tell("running", "chunks", 0.3)
        try:
            chunks, sources = durable(create_chunks(items)), items.select("source").distinct()
            chunk_table(spark, chunks_path).replace(chunks, sources)
            if items_path:
                item_table(spark, items_path).replace(items.select(*[f.split()[0] for f in ITEMS.split(", ")]), sources)
            if embedder is not None and index_path:
                tell("running", "index", 0.7)
                sync_index(index_table(spark, index_path), chunks, sources, embedder)
        except Exception as e:
            tell("error", error=str(e)[:500])
            raise
        if jobs_path:
            n = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("source", "parent_id").alias("sections")).first()
            tell("done", "done", 1.0, items=items.count(), chunks=n["chunks"], sections=n["sections"])

    return stream_items(spark, folder, files_per_trigger).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
