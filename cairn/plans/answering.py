"""From files to an index, and from questions to cited answers."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.providers import TextEmbedder, TextGenerator, embed_column, lexical_pair_score, standalone_question
from cairn.functions.sizes import durable, maybe_broadcast
from cairn.functions.text import preview, strip
from cairn.operators import context, fusion, index
from cairn.operators.chunking import create_chunks, first_of
from cairn.operators.dense import mmr_search, vector_search
from cairn.operators.lexical import keyword_search

# The reply without a source, how a prompt shows its sources, and what stands above an image.
NO_ANSWER = "I don't know based on the provided documents."
REWRITE = "Conversation so far:\n{history}\n\nPut the last question so that it can be understood without the conversation. Only write the question.\n{question}"
ANSWER = "Answer from these numbered sources alone, and cite each as [n].\n\nSources:\n\n{context}\n\nQuestion: {question}"
PLAIN_ANSWER = "Answer the question from these documents alone.\n\nDocuments:\n\n{context}\n\nQuestion: {question}"
SOURCE, SOURCES_BETWEEN, IMAGE_OF = "[{n}] ({citation})\n{context}", "\n\n---\n\n", "Image for source [{n}] ({type}):"
# Fixed values of the query semantics: documents of the older chat and of the one-shot answer.
CHAT_K, ONE_SHOT_K = 3, 10


def ingest(items: DataFrame, stored: DataFrame, embedder) -> DataFrame:
    """The index after a batch of layout items: their sources' chunks are made anew, and only chunks with new ids are embedded."""
    chunks = create_chunks(items)
    other = stored.join(items.select("source").distinct(), "source", "left_anti")
    own = stored.join(items.select("source").distinct(), "source", "left_semi")
    return other.unionByName(index.apply_sync(own, chunks, lambda rows: embed_column(rows, embedder)))


def retrieve(chunks: DataFrame, questions: DataFrame, embedder, k: int = fusion.TOP_K, chunk_type: str | None = None, neighbours: int = 0, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Ranked chunks with context and citation for a batch of questions (query_id, query). Ties go by chunk_id. Neighbours are looked for in
    the hits' sections only, which a semi-join picks where the chunks are."""
    asked = embed_column(questions, embedder, "query", "vector")
    where = None if chunk_type is None else F.col("type") == chunk_type
    searched = chunks if "_search" in chunks.columns else chunks.withColumn("_search", F.concat_ws(" ", "section_path", "content"))
    hits = fusion.hybrid_search(searched, asked, k, where=where, key="chunk_id", text="_search", vector="embedding", weights=weights)
    hits = durable(hits)
    found = chunks.join(maybe_broadcast(hits.select("chunk_id").distinct()), "chunk_id", "left_semi").select("source", "parent_id").distinct()
    same = maybe_broadcast(found.select(F.col("source").alias("_source"), F.col("parent_id").alias("_parent")))
    near = chunks.join(same, F.col("source").eqNullSafe(F.col("_source")) & F.col("parent_id").eqNullSafe(F.col("_parent")), "left_semi")
    return context.with_citations(fusion.hydrate(hits, context.expand_neighbours(near, neighbours), "chunk_id"))


def retrieve_reranked(chunks: DataFrame, questions: DataFrame, embedder, candidates: int = fusion.RERANK_FROM, top_n: int = fusion.RERANK_TO, scorer=lexical_pair_score, weights: tuple[float, float] = fusion.ENSEMBLE) -> DataFrame:
    """Hybrid candidates, fused by weights, and of those the best by a pair scorer."""
    wide = retrieve(chunks, questions, embedder, candidates, weights=weights)
    return fusion.rerank(wide.withColumn("text", F.col("content")).join(questions.select("query_id", "query"), "query_id"), scorer, top_n)


def compare_retrieval(chunks: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Plain top k and maximal marginal relevance side by side: query_id, method, key, place."""
    plain = vector_search(chunks, queries, 5, **options).select("query_id", F.lit("similarity").alias("method"), "vec_id", F.col("rank").alias("place"))
    return plain.unionAll(mmr_search(chunks, queries, **options).select("query_id", F.lit("mmr").alias("method"), "vec_id", F.col("pick_order").alias("place")))


def distinct_contents(hits: DataFrame) -> DataFrame:
    """Each query's hits, of equal contents only the first, up to white space at the ends."""
    key = F.struct("query_id", strip(F.col("content")))
    return first_of(hits.withColumn("_key", key), "_key", "rank").drop("_key")


def attach_contents(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """sources (with chunk_id) with the content and section_path of their chunks, both "" where a chunk is gone."""
    known = chunks.select("chunk_id", "content", "section_path")
    return sources.drop("content", "section_path").join(known, "chunk_id", "left").fillna("", ["content", "section_path"])


def first_images(rows: list) -> dict[str, object]:
    """Each image's path with the first of rows that has it, in the order of rows."""
    out: dict[str, object] = {}
    for r in rows:
        for path in r["image_paths"] or ():
            out.setdefault(path, r)
    return out


def user_message(question: str, rows: list, read: Callable[[str], bytes | None] | None = None, most: int = context.MAX_IMAGES) -> str | list[dict]:
    """The prompt for rows (n, citation, context, type, image_paths, in order of n). With read, which gives a file's bytes or None, a list
    of blocks: the prompt, and then the first few images that can be read, each named by its source."""
    prompt = ANSWER.format(context=SOURCES_BETWEEN.join(SOURCE.format(**{c: r[c] for c in ("n", "citation", "context")}) for r in rows), question=question)
    if read is None:
        return prompt
    readable = ((r, data) for r, data in ((r, read(p)) for p, r in first_images(rows).items()) if data is not None)
    images = [(IMAGE_OF.format(n=r["n"], type=r["type"]), base64.b64encode(data).decode()) for r, data in islice(readable, most)]
    return [_block("text", prompt), *(b for name, data in images for b in (_block("text", name), _block("image_url", {"url": f"data:image/png;base64,{data}"})))]


def _block(kind: str, value) -> dict:
    return {"type": kind, kind: value}


@dataclass
class Answerer:
    """A conversation about an index. State is the history; retrieval is one plan, models run where their providers say."""

    chunks: DataFrame
    embedder: type[TextEmbedder]
    model: TextGenerator
    k: int = fusion.TOP_K
    history: list[tuple[str, str]] = field(default_factory=list)

    def answer(self, question: str, chunk_type: str | None = None) -> dict:
        if not question.strip():
            raise ValueError("the question is blank")
        spark = self.chunks.sparkSession
        tail = "\n".join(f"{role}: {text}" for role, text in self.history[-context.HISTORY_MESSAGES :])
        query = standalone_question(question, tail, self.model, REWRITE)
        asked = spark.createDataFrame([(0, query)], "query_id long, query string")
        found = retrieve(self.chunks, asked, self.embedder, self.k, chunk_type, neighbours=1)
        rows = found.select(F.col("rank").alias("n"), "citation", "context", "type", "chunk_id", "image_paths", "content", "section_path").orderBy("n").collect()  # k rows
        if not rows:
            return {"question": question, "search_query": query, "answer": NO_ANSWER, "sources": []}
        reply = self.model.generate(user_message(question, rows))
        self.history += [("User", question), ("Assistant", reply)]
        return {"question": question, "search_query": query, "answer": reply, "sources": [{c: r[c] for c in ("n", "citation", "type", "chunk_id", "image_paths", "content", "section_path")} for r in rows]}

    def reset(self) -> None:
        self.history.clear()


@dataclass
class OlderChat:
    """The older chat about plain texts (text, embedding): nearest texts only, and the whole history, which serves to rewrite the
    question and is no evidence for the answer."""

    texts: DataFrame
    embedder: type[TextEmbedder]
    model: TextGenerator
    k: int = CHAT_K
    history: list[tuple[str, str]] = field(default_factory=list)

    def ask(self, question: str) -> str:
        query = standalone_question(question, "\n".join(f"{role}: {text}" for role, text in self.history), self.model, REWRITE)
        reply = answer_once(self.texts, query, self.embedder, self.model, self.k, distinct=False)
        self.history += [("User", question), ("Assistant", reply)]
        return reply


def answer_once(texts: DataFrame, question: str, embedder, model: TextGenerator, k: int = ONE_SHOT_K, key: str = "chunk_id", text: str = "text", distinct: bool = True) -> str:
    """An answer from the k nearest texts, of equal ones the first, without a conversation."""
    asked = embed_column(texts.sparkSession.createDataFrame([(0, question)], "query_id long, query string"), embedder, "query", "vector")
    hits = vector_search(texts, asked, k, key).join(texts.select(key, F.col(text).alias("content")), key)
    rows = (distinct_contents(hits) if distinct else hits).orderBy("rank").select("content").collect()  # k rows
    return model.generate(PLAIN_ANSWER.format(context="\n\n".join(r["content"] for r in rows), question=question)) if rows else NO_ANSWER


def listing(hits: DataFrame, characters: int = 400) -> DataFrame:
    """Hits for reading, in order, with the beginnings of their texts."""
    return hits.withColumn("content", preview(F.col("content"), characters)).orderBy("query_id", "rank")


def demo_ids(pieces: DataFrame, prefix: str, order: str) -> DataFrame:
    """pieces with ids of a prefix and a number of three digits at least, by source."""
    n = F.row_number().over(W.partitionBy("source").orderBy(order)) - 1
    return pieces.withColumn("chunk_id", F.concat(F.lit(prefix), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))).withColumn("version", F.lit(1))


__all__ = ["Answerer", "OlderChat", "answer_once", "attach_contents", "compare_retrieval", "demo_ids", "distinct_contents", "ingest", "keyword_search", "listing", "retrieve", "retrieve_reranked", "user_message"]
