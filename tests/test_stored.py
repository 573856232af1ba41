"""Stored indexes, versioned tables and sections of long sources."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import providers
from cairn.operators import chunking, dense, keyword_index, lexical, sections, vector_index
from cairn.plans import answering
from cairn.sources.versions import Conflict, VersionedTable
from cairn.streaming import conversations
from tests.test_operators import ITEM, plain_sections

SF = "/root/testdata/sf0.001"


# versioned tables


def table_of(spark, tmp_path, **options):
    return VersionedTable(spark, str(tmp_path / "t"), "source string, v int", **options)


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, v int")


def read(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def test_versions(spark, tmp_path):
    t = table_of(spark, tmp_path)
    assert t.version() == -1 and read(t) == []
    assert t.replace(rows_of(spark, ("a", 1), ("a", 2), ("b", 3), (None, 4))) == 0
    files = set((tmp_path / "t/data").rglob("*.parquet"))
    assert t.replace(rows_of(spark, ("a", 5))) == 1
    assert {str(f) for f in files} <= {str(f) for f in (tmp_path / "t/data").rglob("*.parquet")}, "a commit leaves the other rows' files"
    assert t.replace(rows_of(spark, (None, 6)), rows_of(spark, ("b", 0))) == 2
    assert read(t) == [("a", 5), (None, 6)] and read(t, 0) == [("a", 1), ("a", 2), ("b", 3), (None, 4)] and read(t, 1) == [("a", 5), ("b", 3), (None, 4)]
    assert t.replace(rows_of(spark, ("b", 7))) == 3 and t.compact() == 4
    assert read(t) == [("a", 5), ("b", 7), (None, 6)] and len(t.state(4)["parts"]) == 1 and not t.state(4)["gone"]
    t.replace(rows_of(spark, ("a", 8)))
    assert read(t) == [("a", 8), ("b", 7), (None, 6)]
    t.vacuum()
    assert read(t) == [("a", 8), ("b", 7), (None, 6)] and len(list((tmp_path / "t/data").iterdir())) == 2
    t.replace(rows_of(spark).limit(0), rows_of(spark, ("a", 0), ("b", 0), (None, 0)))
    assert read(t) == [] and t.compact() == 7 and read(t) == []


def test_two_writers_both_survive(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.replace(rows_of(spark, ("keep", 0)))
    writers = [threading.Thread(target=lambda i=i: table_of(spark, tmp_path).replace(rows_of(spark, (f"w{i}", i)))) for i in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert t.version() == 6 and read(t) == [("keep", 0)] + [(f"w{i}", i) for i in range(6)]


def test_conflicts(spark, tmp_path):
    t = table_of(spark, tmp_path, buckets=1000)
    base = t.replace(rows_of(spark, ("a", 1), ("b", 1)))
    t.replace(rows_of(spark, ("a", 2)))
    with pytest.raises(Conflict):
        t.replace(rows_of(spark, ("a", 3)), expect=base)
    assert t.replace(rows_of(spark, ("b", 3)), expect=base) == 2 and read(t) == [("a", 2), ("b", 3)]
    other = table_of(spark, tmp_path, buckets=1000)
    write, other._write = other._write, lambda *a: (t.replace(rows_of(spark, ("c", 9))), write(*a))[1]
    other.compact()  # a commit that comes between its reading and its own commit stays
    assert read(t) == [("a", 2), ("b", 3), ("c", 9)]
    other._write = lambda *a: (t.compact(), write(*a))[1]
    with pytest.raises(Conflict):
        other.compact()
    assert read(t) == [("a", 2), ("b", 3), ("c", 9)]


def test_a_publisher_never_overwrites(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.replace(rows_of(spark, ("a", 1)))
    assert not t._publish(0, {"parts": [], "gone": []}) and read(t) == [("a", 1)]
    assert [p.name for p in (tmp_path / "t/log").iterdir() if not p.name.endswith(".crc")] == [f"{0:020d}.json"]


def test_unfinished_writer(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.replace(rows_of(spark, ("a", 1)))
    t._commit, commit = (lambda change: 1 / 0), t._commit
    with pytest.raises(ZeroDivisionError):
        t.replace(rows_of(spark, ("a", 2)))
    t._commit = commit
    assert read(t) == [("a", 1)] and t.replace(rows_of(spark, ("a", 3))) == 1 and read(t) == [("a", 3)]


def test_bucket_by_another_column(spark, tmp_path):
    t = table_of(spark, tmp_path, bucket_by="v", buckets=4)
    t.replace(rows_of(spark, *[("a", i) for i in range(40)], ("b", 1)))
    t.replace(rows_of(spark, ("a", 3)))
    bucket = spark.range(1).select(t.bucket(F.lit(3))).first()[0]
    assert [tuple(r) for r in t.read(buckets=[bucket]).where("v = 3").collect()] == [("a", 3)] and read(t) == [("a", 3), ("b", 1)]


# vectors


def clustered(spark, n=3000, groups=30, dims=24):
    r = np.random.default_rng(3)
    middle = r.normal(size=(groups, dims))
    x = middle[r.integers(groups, size=n)] + 0.15 * r.normal(size=(n, dims))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (n, rows[0][1]), (n + 1, None), (n + 2, [0.0] * dims)], "vec_id long, embedding array<double>")


def ask(corpus, step=97):
    return corpus.where(f"vec_id % {step} = 0").selectExpr("vec_id AS query_id", "embedding AS vector")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    corpus, path = clustered(spark).cache(), str(tmp_path_factory.mktemp("ivf") / "index")
    vector_index.build(corpus, path)
    return corpus, path


def test_vector_index_reads_few_lists(spark, stored):
    corpus, path = stored
    model = vector_index.load(spark, path)
    assert len(model.centroids) == 54 and model.probes < 12
    exact = {(r.query_id, r.vec_id) for r in dense.vector_search(corpus, ask(corpus), 20).collect()}
    got = {(r.query_id, r.vec_id) for r in vector_index.search(spark, path, ask(corpus)).collect()}
    assert len(got & exact) / len(exact) >= 0.95
    few = vector_index.pruned(spark, path, [1, 2, 3], "list", "key", "code")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ReadSchema: struct<key:bigint,code:binary>" in plan
    read = {r.f.split("/")[-2] for r in few.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read and read <= {"list=1", "list=2", "list=3"}


def test_vector_index_exact(spark, stored):
    corpus, path = stored
    for k in (1, 20):
        want = sorted((r.query_id, r.vec_id, r["rank"], round(r.score, 9)) for r in dense.vector_search(corpus, ask(corpus, 211), k).collect())
        got = vector_index.search(spark, path, ask(corpus, 211), k, probes=1, exact=True)
        assert sorted((r.query_id, r.vec_id, r["rank"], round(r.score, 9)) for r in got.collect()) == want
    assert vector_index.search(spark, path, ask(corpus.where("embedding IS NULL"), 1)).count() == 0


def test_vector_index_exact_without_structure(spark, tmp_path):
    """Random vectors, where bounds skip little, and text keys."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id")))
    queries = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    vector_index.build(e, str(tmp_path / "i"), lists=9)
    want = sorted((r.query_id, r.vec_id, r["rank"]) for r in dense.vector_search(e, queries, 20).collect())
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in vector_index.search(spark, str(tmp_path / "i"), queries, probes=2, exact=True).collect()) == want


def test_vector_index_grows(spark, tmp_path):
    corpus, path = clustered(spark, 400, 6), str(tmp_path / "i")
    vector_index.build(corpus.where("vec_id < 300"), path)
    vector_index.add(corpus.where("vec_id >= 300"), path)
    want = {(r.query_id, r.vec_id) for r in dense.vector_search(corpus, ask(corpus, 50), 5).collect()}
    assert {(r.query_id, r.vec_id) for r in vector_index.search(spark, path, ask(corpus, 50), 5, exact=True).collect()} == want
    with pytest.raises(ValueError):
        vector_index.build(corpus.where("embedding IS NULL"), str(tmp_path / "none"))


def test_codes_err_by_no_more_than_they_say():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = vector_index._kmeans(x, 7, 1, True)
    rest = x - centroids[(x @ centroids.T).argmax(1)]
    model = vector_index.Model(centroids, [vector_index._kmeans(p, 16, 2) for p in np.array_split(rest, 3, axis=1)])
    of, codes, error = vector_index.encode(model, x)
    back = centroids[of] + np.hstack([b[codes[:, m]] for m, b in enumerate(model.books)])
    assert np.allclose(np.linalg.norm(x - back, axis=1), error) and error.max() < 1


# keywords


def corpus_of(spark, n=600, seed=5):
    r = random.Random(seed)
    common, rare = ["alpha", "beta", "gamma", "the"], [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choices(common, k=r.randint(0, 6)) + r.choices(rare, k=r.randint(0, 12))), f"s{min(i % 7, 3)}") for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "s1"), (n + 1, "", None), (n + 2, "alpha w1 w1", None)], "doc_id long, text string, source string")


QUESTIONS = [(1, "alpha w1"), (2, "w2 w3 w4 w2"), (3, "the"), (4, "nothing here"), (None, "beta"), (5, None), (6, "gamma w7 w9 alpha")]


def results(df):
    return sorted(map(repr, ((r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in df.collect())))


@pytest.mark.parametrize("options", [{}, {"one_round": 0}, {"one_round": 0, "first": 1}, {"query_terms_at_most": 1}])
def test_keyword_index_equals_search(spark, tmp_path, options):
    docs, asked = corpus_of(spark), spark.createDataFrame(QUESTIONS, "query_id long, query string")
    stored = keyword_index.open_index(spark, str(tmp_path / "k"))
    keyword_index.replace_sources(stored, docs, size=16)
    assert results(keyword_index.search(stored, asked, 5, **options)) == results(lexical.keyword_search(docs, asked, 5))


def test_keyword_index_skips_segments(spark, tmp_path, monkeypatch):
    docs, asked = corpus_of(spark), spark.createDataFrame([(1, "w1"), (2, "alpha w5")], "query_id long, query string")
    stored, report = keyword_index.open_index(spark, str(tmp_path / "k")), {}
    keyword_index.replace_sources(stored, docs, size=8)
    monkeypatch.setattr(keyword_index, "PARTS", 3)
    got = keyword_index.search(stored, asked, 3, one_round=0, first=2, report=report)
    assert results(got) == results(lexical.keyword_search(docs, asked, 3)) and report["scored"] < 0.8 * report["pairs"]
    bucket = spark.range(1).select(stored.bucket(F.lit("w1"))).first()[0]
    blocks = stored.read(buckets=[bucket]).select("term", "segment", "most", "least")
    assert all(f"/bucket={bucket}/" in f for f in blocks.inputFiles()) and "keys" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_keyword_index_is_inverted_once_and_as_arrow_lists(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "A b b", "s"), (None, "b the", "s"), (3, None, "s"), (4, "", None), (5, "the", None)], "doc_id int, text string, source string")
    rows = keyword_index.invert(docs, size=64)
    assert "FlatMapGroupsInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.source, r.term): (r.n, r.most, r.least, r.words, sorted(zip(r["keys"], r.counts, r.lengths, strict=True), key=str)) for r in rows.collect()}
    assert got == {("s", None): (3, 0, 0, 3, []), (None, None): (2, 0, 0, 0, []), ("s", "b"): (2, 2, 1, 0, [(1, 2, 2), (None, 1, 1)])}  # a and the are stopwords
    stored = keyword_index.open_index(spark, str(tmp_path / "k"), "int")
    written = []
    monkeypatch.setattr(keyword_index, "durable", lambda df: written.append(df) or df)
    keyword_index.replace_sources(stored, docs)
    assert not written and stored.read().count() == len(got)
    keyword_index.replace_sources(stored, docs.where("source = 's'").limit(0), docs.where("source IS NULL").select("source"))
    assert {r.source for r in stored.read().collect()} == {"s"}


def test_keyword_index_by_source(spark, tmp_path):
    docs, asked = corpus_of(spark), spark.createDataFrame(QUESTIONS, "query_id long, query string")
    stored = keyword_index.open_index(spark, str(tmp_path / "k"))
    keyword_index.replace_sources(stored, docs)
    new = corpus_of(spark, 90, 9).where("source = 's2' OR source IS NULL").withColumn("doc_id", F.col("doc_id") + 10_000)
    keyword_index.replace_sources(stored, new, spark.createDataFrame([("s1",)], "source string"))
    now = docs.where("source NOT IN ('s1', 's2')").unionByName(new)
    assert results(keyword_index.search(stored, asked, 6)) == results(lexical.keyword_search(now, asked, 6))
    stored.compact()
    assert results(keyword_index.search(stored, asked, 6)) == results(lexical.keyword_search(now, asked, 6))
    assert results(keyword_index.search(stored, asked, 6, version=0)) == results(lexical.keyword_search(docs, asked, 6))


# sections


def layout(spark, own, source="s"):
    return spark.createDataFrame([(source, i, kind, 1, t, None, None, None, None) for i, (kind, t) in enumerate(own)], ITEM)


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_ranges_equal_plain_loop(spark, span):
    """One source cut into ranges of any size, also between a number and the heading that it belongs to."""
    r = random.Random(4)
    heads = ["1", "2.1", "3.", "4 Wait", "1.2 Deep\nwater", "1.2.3 In", "Abstract", "", None, "2.2.2.2.2.2 Six", "7", "8.1.1"]
    own = [("paragraph", "before")] * 3 + [(r.choice(("heading", "title")), r.choice(heads)) if r.random() < 0.5 else ("paragraph", r.choice(["text", "12", "", "two\nlines"])) for _ in range(400)]
    rows = sections.place_items(chunking.prepare_items(layout(spark, own)), span)
    got = {x.item_index: (f"section_{x.section_no:04d}", x.section_title, x.section_path) for x in rows.collect() if x.type == "paragraph"}
    want = {i: tuple(rest) for i, *rest in plain_sections(own)}
    assert {i: got[i] for i in want} == want and len(want) > 50


def test_many_sections_in_order(spark):
    """Chunks follow the number of their section, not its text, beyond 10,000 sections."""
    rows = spark.range(20_010).selectExpr("'s' AS source", "id AS item_index", "if(id % 2 = 0, 'heading', 'paragraph') AS type", "1 AS page", "concat(if(id % 2 = 0, 'Head ', 'body '), id) AS content", *[f"CAST(NULL AS STRING) AS {c}" for c in ("title", "table_data", "text_fallback", "image_path")])
    got = chunking.create_chunks(rows).orderBy("chunk_index").select("content", "chunk_index", "parent_id").collect()
    assert [r.content for r in got] == [f"body {2 * i + 1}" for i in range(10_005)] and [r.chunk_index for r in got] == list(range(10_005))
    assert got[-1].parent_id == "section_10005"


def test_levels_cost_nothing(spark):
    """Three hundred levels of one heading within another."""
    own = [x for d in range(1, 301) for x in (("heading", ".".join(["1"] * d) + f" L{d}"), ("paragraph", f"p{d}"))]
    got = {r.content: r.section_path for r in chunking.assign_sections(layout(spark, own)).collect()}
    assert got["p300"].count(" > ") == 299 and got["p2"] == "1 L1 > 1.1 L2"


def test_running_number_in_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", None]), i, r.choice(["x", "y", None])) for i in range(500)]
    got = sections.number_in_ranges(spark.createDataFrame(rows, "source string, item_index long, type string"), ["source", "type"], "item_index", "n", 9).collect()
    seen = {}
    for x in sorted(got, key=lambda x: x.item_index):
        assert x.n == seen.get((x.source, x.type), 0)
        seen[x.source, x.type] = x.n + 1
    assert len(got) == 500


# conversations


def test_conversations_over_restarts(spark, tmp_path):
    """Turn by turn, over several micro-batches and starts, the stream gives what windows over the whole table give; a repeated batch too."""
    rows = [(c, t, ["user", "assistant", "Human", None][(c + t) % 4], f"m{c}.{t}" if (c * t) % 7 else None) for t in range(12) for c in range(5)]
    source, out, state, mark = (str(tmp_path / x) for x in ("in", "out", "state", "mark"))
    for part in range(4):
        new = [r for r in rows if r[1] // 3 == part]
        spark.createDataFrame(new, conversations.MESSAGES).coalesce(1).write.mode("append").parquet(source)
        conversations.replay(spark, source, out, state, mark, n=4)
    read = lambda: sorted(map(repr, (tuple(r) for r in conversations.read_questions(spark, out).collect())))
    every = spark.createDataFrame(rows, conversations.MESSAGES)
    want = sorted(map(repr, (tuple(r) for r in conversations.questions_of(every, 4).collect())))
    assert read() == want and len(want) == 30
    table = conversations.state_table(spark, state)
    again = conversations.advance(table, every.where("turn DIV 3 = 2"), 2, 4)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in conversations.questions_of(every, 4).where("turn DIV 3 = 2").collect()} and table.version() == 3
    assert table.read().groupBy("conv_id").count().agg(F.max("count")).first()[0] == 4


def test_answers_in_a_batch(spark):
    """Questions of several conversations are answered in one plan as one at a time."""
    items = [("a.pdf", "title", "Cats"), ("a.pdf", "paragraph", "Cats purr when they are happy."), ("b.pdf", "title", "Dogs"), ("b.pdf", "paragraph", "Dogs bark at night.")]
    rows = [(s, i, k, 1, t, None, None, None, None) for i, (s, k, t) in enumerate(items)]
    store = providers.embed_column(chunking.create_chunks(spark.createDataFrame(rows, ITEM)), providers.HashingEmbedder).cache()
    asked = [(1, "when do cats purr?", ""), (2, "dogs bark?", ""), (3, "cats?", "User: hello")]
    got = {r.query_id: r for r in conversations.answer_batch(store, spark.createDataFrame(asked, "query_id long, question string, history string"), providers.HashingEmbedder, providers.generator).collect()}
    for i, question, history in asked:
        bot = answering.Answerer(store, providers.HashingEmbedder, providers.generator(), history=[("User", "hello")] if history else [])
        one = bot.answer(question)
        assert (got[i].answer, got[i].search_query, [s.chunk_id for s in got[i].sources]) == (one["answer"], one["search_query"], [s["chunk_id"] for s in one["sources"]])
    none = conversations.answer_batch(store, spark.createDataFrame([(9, "cats?", "")], "query_id long, question string, history string"), providers.HashingEmbedder, providers.generator, chunk_type="table").first()
    assert none.answer == answering.NO_ANSWER and none.sources == []


def test_sections_of_many_sources_share_batches(spark):
    """Ranges and sources that share a task's batches, or are cut by their ends, don't mix; a null source is one of its own."""
    one = [("paragraph", "before"), ("heading", "1 A"), ("paragraph", "x"), ("heading", "1.1 B"), ("paragraph", "y"), ("heading", "Free"), ("paragraph", "z")]
    rows = [(s, i, k, 1, t, None, None, None, None) for s in (*(f"s{n}" for n in range(40)), None) for i, (k, t) in enumerate(one)]
    items = spark.createDataFrame(rows, chunking.ITEMS).repartition(3)
    want = [(0, 0, "", ""), (2, 2, "1 A", "1 A"), (4, 3, "1.1 B", "1 A > 1.1 B"), (6, 4, "Free", "Free")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for span in (2, 10_000):
            placed = sections.place_items(items, span).where("type = 'paragraph'").select("source", "item_index", "section_no", "section_title", "section_path").collect()
            numbers = {0: 0, 2: 2, 4: 3, 6: 4}
            assert sorted((tuple(r) for r in placed), key=repr) == sorted(((s, i, numbers[i], t, p) for s in {r[0] for r in rows} for i, _, t, p in want), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
