"""Command line: python -m cairn COMMAND ...; python -m cairn COMMAND -h tells its arguments."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import providers
from cairn.operators import chunking, index, splitting
from cairn.plans import answering
from cairn.sources import readers, writers


def _spark() -> SparkSession:
    return SparkSession.builder.appName("cairn").getOrCreate()


def _print(rows: DataFrame) -> None:
    for r in rows.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """Items as a JSON array to chunks as a JSON array, and statistics of them."""
    chunks = chunking.create_chunks(readers.read_items(spark, a.items)).cache()
    writers.write_json_array(chunks, a.out, "source", "chunk_index")
    _print(index.length_stats(chunks, F.col("char_count")))
    _print(index.count_by_type(chunks))


def sync(spark: SparkSession, a: argparse.Namespace) -> None:
    """Items as a JSON array into a stored index: only new chunks are embedded."""
    from cairn.streaming.ingest import INDEX

    writers.write_table(answering.ingest(readers.read_items(spark, a.items), readers.read_or_empty(spark, a.index, INDEX), providers.HashingEmbedder), a.index)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best chunks for a question; with --rerank, reranked."""
    asked, chunks = spark.createDataFrame([(0, a.question)], "query_id long, query string"), readers.open_index(spark, a.index)
    found = answering.retrieve_reranked(chunks, asked, providers.HashingEmbedder) if a.rerank else answering.retrieve(chunks, asked, providers.HashingEmbedder, a.k, a.type)
    _print(answering.listing(found).select("rank", "score", "citation", "content"))


def ask(spark: SparkSession, a: argparse.Namespace) -> None:
    """An answer with its sources."""
    bot = answering.Answerer(readers.open_index(spark, a.index), providers.HashingEmbedder, providers.generator(a.model), a.k)
    print(json.dumps(bot.answer(a.question, a.type), ensure_ascii=False))


def documents(spark: SparkSession, a: argparse.Namespace) -> None:
    """What is stored of every source."""
    _print(index.document_listing(readers.open_index(spark, a.index), readers.read_items(spark, a.items)))


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    """The pieces of a folder's texts."""
    how = {"text": splitting.split_text(), "plain": splitting.plain_splitter(), "recursive": splitting.recursive_splitter()}[a.how]
    _print(splitting.explode_pieces(readers.read_text_folder(spark, a.folder), how(F.col("text"))).select("path", "piece_index", "piece"))


COMMANDS = {
    "chunk": (chunk, ["items", "out"]), "sync": (sync, ["items", "index"]), "search": (search, ["index", "question"]), "ask": (ask, ["index", "question"]), "documents": (documents, ["index", "items"]), "split": (split, ["folder"]),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cairn", description=__doc__)
    every = parser.add_subparsers(dest="command", required=True)
    for name, (run, places) in COMMANDS.items():
        own = every.add_parser(name, help=run.__doc__)
        for p in places:
            own.add_argument(p)
        if name in ("search", "ask"):
            own.add_argument("-k", type=int, default=5)
            own.add_argument("--type", choices=("text", "table", "figure"))
        if name == "search":
            own.add_argument("--rerank", action="store_true")
        if name == "ask":
            own.add_argument("--model", default="echo")
        if name == "split":
            own.add_argument("--how", choices=("text", "plain", "recursive"), default="text")
    a = parser.parse_args(argv)
    COMMANDS[a.command][0](_spark(), a)


if __name__ == "__main__":
    main()
