import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import layout, providers, text
from cairn.operators import chunking, context, dense, fusion, geometry, index, lexical, splitting
from cairn.plans import answering
from cairn.sources import readers, writers
from cairn.streaming import ingest

ITEM = chunking.ITEMS


def items(spark, rows):
    """rows: (source, type, text)."""
    full = [(s, i, k, 1 + i // 3, t if k not in ("table", "figure") else None, t if k == "figure" else None, t if k == "table" else None, None, None) for i, (s, k, t) in enumerate(rows)]
    return spark.createDataFrame(full, ITEM)


def test_text_functions(spark):
    one = lambda e, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(e).first()[0]
    c = F.col("c0")
    assert one(text.clean_text(c), "\xa0 a \t b\r\n\r\n\r\n\rc\n ") == "a b\n\nc" and one(text.clean_text(c), None) == ""
    assert one(text.unwrap_lines(c), "é-\né a\nb\n\nc  d") == "éé a b\n\nc d"
    assert one(text.safe_name(c), "--A b/é!") == "--A_b" and one(text.safe_name(c), "é") == "untitled"
    assert one(text.first_line(c), " a b") == "a"
    assert one(F.array_join(text.tokenize(c), "|"), "The x_1.2-b of É the Cat's") == "x_1.2-b|cat|s"
    assert one(text.stem_of(c), "a/b.tar.gz") == "b.tar" and one(text.stem_of(c), "") == "document"
    assert one(text.image_url(c), "\\a\\b.png") == "a/b.png" and one(text.to_int(c), "x") is None
    table = spark.sql("SELECT array(array('a|b', null), array('<', ' x  y '), array('<', 'x y')) AS t, array() AS e")
    r = table.select(text.table_to_markdown(F.col("t")), text.table_to_html(F.col("t")), text.is_valid_table(F.col("t")), text.table_to_html(F.col("e").cast("array<array<string>>"))).first()
    assert r[0] == "| a/b |  |\n|---|---|\n| < | x y |" and "<td>&lt;</td>" in r[1] and r[2] and r[3] == "<table></table>"


def test_upper_median(spark):
    got = spark.sql("SELECT array(3.0D, 1.0D, 2.0D, 9.0D) AS a, cast(array() AS array<double>) AS b").select(layout.upper_median(F.col("a")), layout.upper_median(F.col("b"))).first()
    assert tuple(got) == (3.0, 11.0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. ?\n", max_size=3000), st.integers(20, 200))
def test_split_keeps_everything(value, size):
    pieces = splitting.split_pieces(value, size, size // 4)
    assert all(0 < len(p) <= size for p in pieces)
    bare, spans = value.strip(), list(splitting.windows(value.strip(), size, size // 4))
    assert not bare or spans[0][0] == 0 and spans[-1][1] == len(bare) and all(a[1] >= b[0] > a[0] for a, b in zip(spans, spans[1:], strict=False))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=500))
def test_recursive_split(value):
    pieces = splitting.split_recursive(value, 40)
    assert all(len(p) <= 40 for p in pieces) and sum(map(len, "".join(pieces).split())) <= len(value)


def test_split_table(spark):
    rows = ["Table: t", "| a |", "| - |", *[f"| {i:03d} |" for i in range(9)]]
    for source, want in (("\n".join(rows), 3), ("no table", None), ("| a |\n| - |", None)):
        got = spark.createDataFrame([(source,)], "t string").select(splitting.split_table(F.col("t"), 50).alias("p")).first().p
        assert (len(got) if got else None) == want
        for p in got or []:
            assert p.startswith("Table: t\n| a |\n| - |\n") and len(p) <= 50


def test_sections(spark):
    rows = [("a", "paragraph", "before"), ("a", "heading", "1"), ("a", "heading", "Intro"), ("a", "paragraph", "p1"), ("a", "heading", "1.1 Deep"), ("a", "paragraph", "p2"), ("a", "paragraph", "12"),
            ("a", "heading", "1.1.1 Deeper"), ("a", "paragraph", "p3"), ("a", "heading", "2 Next"), ("a", "paragraph", "p4"), ("a", "heading", "Free"), ("a", "paragraph", "p5"), ("b", "paragraph", "q1"), ("b", "heading", "3"), ("b", "heading", "4 Own"), ("b", "paragraph", "q2")]
    got = {r.text: (r.parent_id, r.section_path) for r in chunking.assign_sections(items(spark, rows)).collect()}
    assert got == {
        "before": ("section_0000", ""), "p1": ("section_0002", "1 Intro"), "p2": ("section_0003", "1 Intro > 1.1 Deep"), "p3": ("section_0004", "1 Intro > 1.1 Deep > 1.1.1 Deeper"),
        "p4": ("section_0005", "2 Next"), "p5": ("section_0006", "Free"), "q1": ("section_0000", ""), "q2": ("section_0002", "4 Own")}


def test_chunks(spark):
    long = " ".join(f"word{i}." for i in range(200))
    rows = [("a.pdf", "title", "Doc"), ("a.pdf", "paragraph", long), ("a.pdf", "figure", "A picture"), ("a.pdf", "paragraph", "x" * 700), ("a.pdf", "paragraph", "tiny tail " + "y" * 95), ("a.pdf", "heading", "Two"), ("a.pdf", "paragraph", "same"), ("a.pdf", "heading", "Two"), ("a.pdf", "paragraph", "same"), ("b.pdf", "paragraph", "z" * 799), ("b.pdf", "paragraph", "end")]
    got = chunking.create_chunks(items(spark, rows)).orderBy("source", "chunk_index").collect()
    assert len({r.chunk_id for r in got}) == len(got) and all(r.char_count == len(r.content) for r in got)
    a = [r for r in got if r.source == "a.pdf"]
    assert [r.chunk_index for r in a] == list(range(len(a))) and [r.type for r in a].count("figure") == 1 and sum(r.content == "same" for r in a) == 1
    assert a[0].embedding_text.startswith("Document: Doc\nSection: Doc\n\n")
    assert [r.content for r in got if r.source == "b.pdf"] == ["z" * 799 + "\n\nend"]


def test_pack_equals_plain_loop(spark):
    r = random.Random(1)
    for _ in range(20):
        texts = ["x" * r.randint(1, 60) for _ in range(r.randint(0, 15))]
        groups, size = [], 0
        for i, t in enumerate(texts):
            if groups and size + len(t) <= 100:
                groups[-1].append(i)
            else:
                groups.append([i])
                size = 0
            size += len(t) + 2
        got = spark.createDataFrame([(texts,)], "t array<string>").select(chunking.pack(F.col("t"), 100)).first()[0]
        assert got == groups


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, ""), (3, None), (4, "dog cat cat")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "cat cat the"), (1, "of the"), (2, "bird")], "query_id long, query string")
    got = lexical.keyword_search(docs, q, 5).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(0, 1, 1), (0, 4, 2)]
    assert lexical.keyword_search(docs.where("doc_id = 2"), q, 5).count() == 0 == lexical.keyword_search(docs.limit(0), q, 5).count()


def test_fusion_ties(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")
    got = fusion.fuse(hits([(0, "v", 0.9, 1), (0, "x", 0.5, 2)]), hits([(0, "k", 3.0, 1), (0, "x", 2.0, 2)]), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["x", "v", "k"] and got[1].keyword_rank is None


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 12), st.integers(1, 15), st.sampled_from([0.0, 0.5, 1.0]), st.integers(0, 10**6))
def test_mmr(n, k, trade, seed):
    r = np.random.default_rng(seed)
    q, v = r.normal(size=4), r.normal(size=(n, 4)).round(1)
    got = dense.mmr_pick(q, v, k, trade)
    assert len(got) == len(set(got)) == min(n, k)
    if trade == 1 and n:
        rel = (dense._unit(v) @ dense._unit([q])[0]).round(9)
        assert got == sorted(range(n), key=lambda i: (-rel[i], i))[:k]


def test_vector_search_edges(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0]), (1, None)], "query_id long, vector array<double>")
    assert [(r.vec_id, r["rank"]) for r in dense.vector_search(c, q, 2).orderBy("rank").collect()] == [(1, 1), (4, 2)]
    assert dense.vector_search(c, q.limit(0), 2).count() == 0 == dense.vector_search(c.limit(0), q, 2).count()
    assert dense.redundancy(c.where("vec_id IN (1, 4)").withColumn("g", F.lit(0)), "g", "vec_id", "embedding").first().redundancy == pytest.approx(1.0)


def rect(spark, rows, extra):
    return spark.createDataFrame([("s", 1, *r) for r in rows], f"source string, page int, {extra}, x0 double, y0 double, x1 double, y1 double")


def test_geometry(spark):
    captions = rect(spark, [(1, 100.0, 500.0, 200.0, 510.0), (2, 100.0, 5000.0, 200.0, 5010.0)], "caption_id int")
    rects = rect(spark, [(0, 100.0, 300.0, 250.0, 480.0), (0, 265.0, 300.0, 400.0, 480.0), (0, 100.0, 100.0, 300.0, 200.0), (0, 0.0, 0.0, 20.0, 20.0)], "k int")
    pages = spark.createDataFrame([("s", 1, 600.0, 800.0)], "source string, page int, width double, height double")
    got = {r.caption_id: (r.f_x0, r.f_y0, r.f_x1, r.f_y1) for r in geometry.figure_regions(captions, rects, pages).collect()}
    assert got == {1: (92.0, 292.0, 408.0, 488.0), 2: (None,) * 4}
    blocks = rect(spark, [("Table 1: far", 0.0, 0.0, 9.0, 99.0), ("table 2. near", 0.0, 0.0, 9.0, 150.0), ("Table 3 tie\nTable 4 atie", 0.0, 0.0, 9.0, 150.0)], "text string")
    tables = rect(spark, [(1, 0.0, 200.0, 9.0, 300.0), (2, 0.0, 90.0, 9.0, 95.0)], "table_id int")
    assert {r.table_id: r.title for r in geometry.table_captions(tables, blocks).collect()} == {1: "atie", 2: None}
    spans = spark.createDataFrame([("s", 1, 0, 0, 0, "He", 10.0, False, 0.0, 0.0, 1.0, 1.0), ("s", 1, 0, 0, 1, "llo", 20.0, True, 1.0, 0.0, 2.0, 1.0), ("s", 1, 0, 1, 0, "you", None, False, 0.0, 1.0, 1.0, 2.0)], readers.SPANS)
    b = geometry.rich_blocks(spans).first()
    assert (b.text, b.font_size, b.is_bold, b.y1) == ("Hello\nyou", 15.0, True, 2.0)
    box = spark.range(1).select(geometry.crop_box(*[F.lit(float(x)) for x in (1, 1, 50, 50, 40, 100)]).alias("b"), geometry.crop_box(*[F.lit(float(x)) for x in (90, 1, 99, 50, 40, 100)]).alias("n")).first()
    assert tuple(box.b) == (0.0, 0.0, 40.0, 54.0) and box.n is None


def test_rich_blocks_puts_spans_together_before_the_shuffle(spark):
    nan, none = float("nan"), None
    rows = [("s", 1, b, l, i, t, z, o, *x) for b, l, i, t, z, o, x in (
        (0, 1, 0, "c", 12.0, False, (3.0, 7.0, 4.0, nan)), (0, 0, 1, "b", none, none, (nan, 5.0, 2.0, 1.0)), (0, 0, 0, "a", 6.0, True, (nan, none, none, 1.0)), (0, 2, 0, none, none, none, (9.0, 9.0, 1.0, 1.0)),
        (0, 3, 5, "d", none, none, (9.0, 9.0, 1.0, 1.0)), (0, none, 0, "n", none, none, (9.0, 9.0, 1.0, 1.0)), (1, 0, 0, " ", 1.0, True, (0.0, 0.0, 0.0, 0.0)), (2, 0, 0, "z", none, none, (nan, 1.0, 1.0, 1.0)), (2, 0, 0, "y", none, none, (nan, 1.0, none, 1.0)))]
    spans = spark.createDataFrame(rows, readers.SPANS)
    want = [(0, "n\nab\nc\n\nd", 9.0, True, "3.0", "5.0", "4.0", "nan"), (2, "yz", 10.0, None, "nan", "1.0", "1.0", "1.0")]
    for given in (spans.coalesce(1), spans.repartition(9, "line", "span", "text")):  # a block in one batch, and in several
        got = geometry.rich_blocks(given).orderBy("block").collect()
        assert [(r.block, r.text, r.font_size, r.is_bold, *(str(r[c]) for c in ("x0", "y0", "x1", "y1"))) for r in got] == want
        assert [r.block_order for r in sorted(got, key=lambda r: r.y0)] == [1, 2]
    # the plan shuffles pieces of blocks, once: no exchange below the place where spans are put together
    plan = geometry.rich_blocks(spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")
    assert geometry.rich_blocks(spans.limit(0)).count() == 0


def test_index_sync(spark):
    ids = lambda *v: spark.createDataFrame([(x, i) for i, x in enumerate(v)], "chunk_id string, chunk_index long")
    plan = lambda *a, **k: sorted(map(tuple, index.sync_plan(*a, **k).collect()))
    assert plan(ids("a", "b"), ids("b", "c", "c"), order="chunk_index") == [("a", "delete"), ("c", "add")]
    assert plan(ids("a"), ids("a")) == [] and plan(ids("a"), ids("a"), reindex=True) == [("a", "add"), ("a", "delete")]
    seen = []
    out = index.apply_sync(ids("a", "b"), ids("b", "c", "c"), lambda rows: (seen.append(rows.count()), rows)[1], order="chunk_index")
    assert sorted(r.chunk_id for r in out.collect()) == ["b", "c"] and seen == [1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_text_folder(spark, str(tmp_path / "texts"))
    (tmp_path / "texts/a.txt").write_text("héllo\nyou")
    (tmp_path / "texts/b.md").write_text("no")
    assert [r.text for r in readers.read_text_folder(spark, str(tmp_path / "texts")).collect()] == ["héllo\nyou"]
    (tmp_path / "x.json").write_text('[{"text": "a", "topic": "t"},\n {"text": "b"}]')
    assert [tuple(r) for r in readers.read_topics(spark, str(tmp_path / "x.json")).collect()] == [("a", "t", "chunk_0"), ("b", "unknown", "chunk_1")]
    (tmp_path / "y.json").write_text('{"text": 1}')
    with pytest.raises(ValueError):
        readers.read_topics(spark, str(tmp_path / "y.json"))
    (tmp_path / "i.json").write_text('[{"type": "heading", "source": "s", "content": "H"}, {"type": "paragraph", "source": "s", "content": "p", "page": 2}]')
    assert [(r.item_index, r.type, r.page) for r in readers.read_items(spark, str(tmp_path / "i.json")).collect()] == [(0, "heading", None), (1, "paragraph", 2)]
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    files = readers.pdf_files(spark, str(tmp_path))
    assert [r.source for r in files.collect()] == ["a.PDF"]
    assert readers.parse_pdfs(files, lambda: lambda name, data: [{"n": name, "size": len(data)}], "n string, size long").first().size == 8
    schema, path = "source string, v int", str(tmp_path / "t")
    for v in (1, 2):
        writers.replace_stored_source(spark, path, schema, "a", spark.createDataFrame([("a", v)], schema))
    writers.replace_stored_source(spark, path, schema, "b", spark.createDataFrame([("b", 3)], schema))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 2), ("b", 3)]
    writers.write_json(spark.range(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    chunks = chunking.create_chunks(readers.read_items(spark, str(tmp_path / "i.json")))
    assert "image_paths" not in writers.to_metadata(chunks).first().metadata


def test_answering(spark):
    rows = [("a.pdf", "title", "Cats"), ("a.pdf", "paragraph", "Cats purr when they are happy."), ("b.pdf", "title", "Dogs"), ("b.pdf", "paragraph", "Dogs bark at night.")]
    empty = providers.embed_column(chunking.create_chunks(items(spark, rows).limit(0)), providers.HashingEmbedder)
    store = answering.ingest(items(spark, rows), empty, providers.HashingEmbedder).cache()
    assert store.count() == 2
    assert answering.ingest(items(spark, rows[2:3] + [("b.pdf", "paragraph", "Dogs sleep.")]), store, providers.HashingEmbedder).count() == 2
    bot = answering.Answerer(store, providers.HashingEmbedder, providers.generator())
    got = bot.answer("when do cats purr?")
    assert "purr" in got["answer"] and got["sources"][0]["citation"] == "a.pdf, p.1, Cats" and len(bot.history) == 2
    assert bot.answer("cats?", chunk_type="table")["answer"] == answering.NO_ANSWER
    bot.reset()
    assert not bot.history
    with pytest.raises(ValueError):
        bot.answer(" ")
    with pytest.raises(ValueError):
        providers.generator("nothing")
    q = spark.createDataFrame([(0, "dogs bark")], "query_id long, query string")
    assert answering.retrieve_reranked(store, q, providers.HashingEmbedder).orderBy("rerank").first().source == "b.pdf"
    hits = context.answer_sources(answering.retrieve(store, q, providers.HashingEmbedder)).first().sources
    assert [s.n for s in hits] == [1, 2]


def test_streaming_ingest(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    items(spark, [("a", "paragraph", "one"), ("b", "paragraph", "two")]).write.parquet(folder)
    ingest.run_ingest(spark, folder, out, mark).awaitTermination()
    assert sorted(r.content for r in ingest.chunk_table(spark, out).read().collect()) == ["one", "two"]
    items(spark, [("a", "paragraph", "three")]).write.mode("append").parquet(folder)
    ingest.run_ingest(spark, folder, out, mark).awaitTermination()
    assert sorted(r.content for r in ingest.chunk_table(spark, out).read().collect()) == ["three", "two"]


# --- against plain versions ---

def plain_sections(rows):
    """(parent_id, title, path) of each kept item of one source, item by item, from the rules of SURVEY W1 to W3."""
    import re

    clean = lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", (t or "").replace("\r\n", "\n").replace("\r", "\n"))).strip()
    unwrap = lambda t: re.sub(" {2,}", " ", re.sub(r"(?<!\n)\n(?!\n)", " ", re.sub(r"(\w)-\n(\w)", r"\1\2", t))).strip()
    opened, held, levels, now, out = 0, None, [], None, []
    for i, (kind, content) in enumerate(rows):
        t = clean(content)
        if kind in ("heading", "title"):
            if re.fullmatch(r"\d+(\.\d+)*", t):
                held = t
                continue
            m = re.match(r"(\d+(?:\.\d+)*)\.?\s+(\S.*)", t, re.DOTALL)
            number, held = (m[1] if m else held), None
            title = f"{number} {unwrap(m[2] if m else t)}" if number else unwrap(t)
            depth = number.count(".") + 1 if number else 0
            levels = [(d, x) for d, x in levels if d < depth] + [(depth, title)] if number else []
            opened += 1
            now = (f"section_{opened:04d}", title, " > ".join(x for _, x in levels) if number else title)
            continue
        if now is None:
            opened, now = 1, ("section_0000", "", "")
        t = unwrap(t)
        if t and not (kind == "paragraph" and re.fullmatch(r"\d{1,4}", t)):
            out.append((i, *now))
    return out


def test_sections_equal_plain_loop(spark):
    r = random.Random(11)
    heads = ["1", "2.1", "3.", "4 Wait", "5. Next", "1.2 Deep\nwater", "1.2.3 Intro-\nduction", "Abstract", "", " ", None, "2.2.2.2.2.2.2.2.2.2.2 Eleven", "A 1", "7  Two\n\nparts", "10.1\tTab", "1.2."]
    bodies = ["text", "12", "12345", "", None, " \n", "two\nlines", "hy-\nphen"]
    rows, want = [], {}
    for k in range(60):
        own = [(r.choice(("heading", "title")), r.choice(heads)) if r.random() < 0.45 else (r.choice(("paragraph", "caption")), r.choice(bodies)) for _ in range(r.randint(1, 14))]
        rows += [(f"s{k:02d}", i, kind, 1, t, None, None, None, None) for i, (kind, t) in enumerate(own)]
        want |= {(f"s{k:02d}", i): rest for i, *rest in plain_sections(own)}
    got = {(x.source, x.item_index): [x.parent_id, x.section_title, x.section_path] for x in chunking.assign_sections(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == want and any(" > " in v[2] for v in want.values())


def test_merged_tail(spark):
    """A short last chunk gives its items, and its last page, to the one before, but not its images."""
    text = "x" * 798
    rows = [("s", 0, "paragraph", 1, text, None, None, None, "a.png"), ("s", 1, "paragraph", 3, "tail", None, None, None, "b.png"), ("t", 0, "paragraph", 2, text, None, None, None, None), ("t", 1, "paragraph", None, "tail", None, None, None, None)]
    got = {c.source: c for c in chunking.create_chunks(spark.createDataFrame(rows, ITEM)).collect()}
    assert len(got) == 2 and got["s"].content == f"{text}\n\ntail" and got["s"].item_indices == [0, 1]
    assert (got["s"].page_start, got["s"].page_end, got["s"].image_paths) == (1, 3, ["a.png"]) and (got["t"].page_start, got["t"].page_end) == (2, 2)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. ?!\n", max_size=900), st.integers(10, 90), st.integers(0, 30))
def test_windows_equal_search(value, size, overlap):
    """The bisection against looking for the last boundary of each piece anew."""
    text_, want, at = value.strip(), [], 0
    while at < len(text_):
        stop = min(at + size, len(text_))
        if stop < len(text_):
            low = at + int((stop - at) * splitting.MIN_SPLIT_RATIO)
            found = [text_.rfind(b, low, stop) + len(b) for b in splitting.BOUNDARIES if text_.rfind(b, low, stop) >= 0]
            stop = found[0] if found else stop
        want.append((at, stop))
        if stop >= len(text_):
            break
        back = max(0, stop - overlap)
        if back and not text_[back - 1].isspace():
            back = text_.find(" ", back, stop) + 1 or stop
        at = back if back > at else stop
    assert list(splitting.windows(text_, size, overlap)) == want


def plain_recursive(text_, size, separators):
    """Split by the first separator there is, the large parts again by the later ones; then put neighbours together while they fit."""
    glue = next((x for x in separators if x == "" or x in text_), separators[-1])
    later = separators[separators.index(glue) + 1 :]
    out, run = [], ""
    for part in (text_.split(glue) if glue else text_):
        if not part:
            continue
        if len(part) > size:
            out += [run] if run else []
            run = ""
            out += plain_recursive(part, size, later) if later else [part]
        elif run and len(run) + len(glue) + len(part) <= size:
            run += glue + part
        else:
            out += [run] if run else []
            run = part
    return [x.strip() for x in [*out, run] if x.strip()]


def test_split_recursive_equals_plain_version(spark):
    from cairn.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: plain_recursive(r.text, splitting.RECURSIVE_SIZE, list(splitting.RECURSIVE_SEPARATORS)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["split_recursive"](spark, sf).orderBy("doc_id", "piece_index").collect():
        got.setdefault(r.doc_id, []).append(r.piece)
    assert got == {d: p for d, p in want.items() if p}


def test_semantic_merge_equals_plain_version(spark):
    from cairn.plans.catalogue import QUERIES

    sf, model = "/root/testdata/sf0.001", providers.HashingEmbedder()
    pieces, want = {}, []
    for r in QUERIES["split_recursive"](spark, sf).orderBy("doc_id", "piece_index").collect():
        pieces.setdefault(r.doc_id, []).append(r.piece)
    for d, own in pieces.items():
        done = [own[0]]
        for t in own[1:]:
            a, b = (np.array(model.embed([x])[0]) for x in (done[-1], t))
            alike = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else 0
            if alike >= 0.7 and len(done[-1]) + len(t) + 2 <= 1000:
                done[-1] += "\n\n" + t
            else:
                done.append(t)
        want += [(d, i, t) for i, t in enumerate(done)]
    assert sorted(map(tuple, QUERIES["semantic_merge"](spark, sf).collect())) == sorted(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_reads_texts_once(spark):
    """No shuffle of texts or of pairs: what is planned over the written postings is a task's best, ranked; and both ways agree."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    keep = F.col("lang") == "fr"
    for condition in (None, keep):
        one = lexical.keyword_search(docs, asked, 7, keep=condition)
        two = lexical.keyword_search(docs, asked, 7, keep=condition, query_terms_at_most=0)
        both = [sorted((r.query_id, r.doc_id, round(r.score, 7), r["rank"]) for r in x.collect()) for x in (one, two)]
        assert both[0] == both[1] and len(both[0]) > 100
    plan = plan_of(lexical.keyword_search(docs, asked, 7))
    assert plan.count("FileScan") == 1 and "text" not in plan.split("FileScan")[1].split("\n")[0] and plan.count("Exchange hashpartitioning") == 1
    named = lexical.keyword_search(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), asked, 7)
    best = lambda x: sorted((r.query_id, round(r.score, 7), r["rank"]) for r in x.collect())
    assert named.schema["doc_id"].dataType.simpleString() == "string" and best(named) == best(lexical.keyword_search(docs, asked, 7))


def test_classify_strips_once(spark):
    from cairn.plans.catalogue import QUERIES

    plan = plan_of(QUERIES["classify_blocks"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange") == 1 and plan.count("regexp_replace") <= 2


def test_weights_and_string_keys(spark):
    rows = [("a.pdf", "title", "Cats"), ("a.pdf", "paragraph", "Cats purr when they are happy."), ("b.pdf", "title", "Dogs"), ("b.pdf", "paragraph", "Dogs bark at night.")]
    store = providers.embed_column(chunking.create_chunks(items(spark, rows)), providers.HashingEmbedder).cache()
    q = spark.createDataFrame([(0, "dogs bark")], "query_id long, query string")
    one = answering.retrieve(store, q, providers.HashingEmbedder).orderBy("rank").first()
    assert one.chunk_id.startswith("b_") and one.score == pytest.approx(2 / 61)
    best = answering.retrieve_reranked(store, q, providers.HashingEmbedder).orderBy("rerank").first()
    assert best.score == pytest.approx(0.7 / 61 + 0.3 / 61) and answering.distinct_contents(spark.createDataFrame([(0, "a\n", 1), (0, "\u00a0a", 2), (0, "b", 3)], "query_id long, content string, rank int")).count() == 2
    gone = answering.attach_contents(spark.createDataFrame([(1, "no"), (2, one.chunk_id)], "n int, chunk_id string"), store).orderBy("n").collect()
    assert (gone[0].content, gone[0].section_path) == ("", "") and gone[1].content == one.content


def test_messages_and_older_chats(spark):
    rows = [{"n": 1, "citation": "c", "context": "x", "type": "figure", "image_paths": ["a", "b", "a"]}, {"n": 2, "citation": "d", "context": "y", "type": "text", "image_paths": None}, {"n": 3, "citation": "e", "context": "z", "type": "table", "image_paths": ["b", "no", "c", "d"]}]
    blocks = answering.user_message("why?", rows, lambda p: None if p == "no" else p.encode())
    assert isinstance(answering.user_message("why?", rows), str) and blocks[0]["text"].endswith("Question: why?")
    assert [b["text"] for b in blocks[1::2]] == ["Image for source [1] (figure):"] * 2 + ["Image for source [3] (table):"] and len(blocks) == 7
    texts = providers.embed_column(spark.createDataFrame([("1", "cats purr"), ("2", "cats purr \n"), ("3", "dogs bark")], "chunk_id string, text string"), providers.HashingEmbedder, "text").cache()

    class Model:
        seen = []

        def generate(self, prompt):
            self.seen.append(prompt)
            return f"reply {len(self.seen)}"

    chat = answering.OlderChat(texts, providers.HashingEmbedder, Model())
    assert chat.ask("cats purr") == "reply 1" and "cats purr\n\ncats purr" in Model.seen[0]
    assert chat.ask("and dogs?") == "reply 3" and "reply 1" in Model.seen[1] and "reply 1" not in Model.seen[2]
    assert answering.answer_once(texts, "cats purr", providers.HashingEmbedder, Model()) == "reply 4" and Model.seen[3].count("cats purr") == 2
    assert answering.answer_once(texts.limit(0), "cats", providers.HashingEmbedder, Model()) == answering.NO_ANSWER


def test_conversion(spark):
    from cairn.operators import conversion

    box = (10.0, 10.0, 50.0, 20.0)
    node = lambda i, kind, label, text_=None, ref=None, captions=None, caption=None, cells=None, at=(None,) * 4, page=1: ("d/x.pdf", i, kind, label, page, text_, ref, captions, caption, cells, *at)
    rows = [
        node(0, "text", "page_header", "furniture"), node(1, "text", "title", "Name\r\nrest"), node(2, "picture", "picture", captions=["#c"], caption="Figure 2: A b/c", at=(0.0, 100.0, 100.0, 200.0)),
        node(3, "text", "caption", "Figure 2: A b/c", "#c"), node(4, "text", "caption", "loose", "#d"), node(5, "text", "text", "axis", at=(20.0, 30.0, 60.0, 40.0)), node(6, "text", "text", "3 numbered", at=(20.0, 30.0, 60.0, 40.0)),
        node(7, "text", "section_header", "far", at=(20.0, 900.0, 60.0, 910.0)), node(8, "table", "table", cells=[["a", " "], ["a", " "], ["b|c", None]], caption="Table 1. T"), node(9, "table", "table", cells=[["-", ""]]),
        node(10, "text", "formula", "x = y", page=None), node(11, "text", "list_item", "  "), node(12, "text", "text", "axis too", at=box, page=2)]
    got = conversion.convert_nodes(spark.createDataFrame(rows, conversion.NODES)).orderBy("item_index").collect()
    assert [(r.type, r.content or r.title or r.text_fallback) for r in got] == [
        ("title", "Name"), ("figure", "A b/c"), ("caption", "loose"), ("paragraph", "3 numbered"), ("heading", "far"), ("table", "T"), ("equation", "x = y"), ("paragraph", "axis too")]
    assert [r.image_path for r in got if r.image_path] == ["images/x_p1_figure_0_A_b_c.png", "images/tables/x_p1_table_0_T.png", "images/equations/x_pNone_equation_0.png"]
    assert got[5].table_data == "| a |  |\n|---|---|\n| b/c |  |" and [r.item_index for r in got] == list(range(8))
    assert conversion.convert_nodes(spark.createDataFrame([], conversion.NODES)).count() == 0


def test_table_recovers(spark, tmp_path):
    """A writer that ended between its two renames loses nothing, and a move that fails puts the old table back."""
    path, schema = str(tmp_path / "t"), "v int"
    writers.write_table(spark.createDataFrame([(1,)], schema), path)
    (tmp_path / "t").rename(tmp_path / "t.0.old")
    assert [r.v for r in readers.read_or_empty(spark, path, schema).collect()] == [1]
    (tmp_path / "t").rename(tmp_path / "t.1.old")
    writers.write_table(readers.read_or_empty(spark, path, schema).selectExpr("v + 1 AS v"), path)
    assert [r.v for r in spark.read.schema(schema).parquet(path).collect()] == [2]


def test_documents_and_jobs(spark, tmp_path):
    folder, out, mark, store, kept, log = (str(tmp_path / x) for x in ("in", "out", "mark", "index", "items", "jobs"))
    items(spark, [("a", "heading", "H"), ("a", "paragraph", "one"), ("b", "paragraph", "two")]).write.parquet(folder)
    run = lambda: ingest.run_ingest(spark, folder, out, mark, embedder=providers.HashingEmbedder, index_path=store, items_path=kept, jobs_path=log).awaitTermination()
    run()
    items(spark, [("b", "paragraph", "three")]).write.mode("append").parquet(folder)
    run()
    index_ = ingest.index_table(spark, store).read()
    assert sorted(r.content for r in index_.collect()) == ["one", "three"] and all(len(r.embedding) == 64 for r in index_.collect())
    every = ingest.jobs(spark, log).collect()
    assert len(every) == 2 and {(r.status, r.items, r.chunks, r.sections) for r in every} == {("done", 3, 2, 2), ("done", 1, 1, 1)} and ingest.jobs(spark, log, "running").count() == 0
    assert ingest.job_status(spark, log, every[0].job_id)["progress"] == 1.0
    with pytest.raises(LookupError):
        ingest.job_status(spark, log, "none")
    stored = ingest.item_table(spark, kept).read()
    own = index.document_detail(stored, ingest.chunk_table(spark, out).read(), "a")
    assert [r.type for r in own[0].collect()] == ["heading", "paragraph"] and [r.content for r in own[1].collect()] == ["one"]
    with pytest.raises(LookupError):
        index.document_detail(stored, ingest.chunk_table(spark, out).read(), "zzz")
    summary = index.document_listing(ingest.chunk_table(spark, out).read(), stored).collect()
    assert [r.source for r in summary] == ["a", "b"] and summary[0].types == {"heading": 1, "paragraph": 1}
    assert index.same_rows(stored, stored.repartition(2)) and not index.same_rows(stored, stored.limit(1))


def test_extract_items(spark):
    """A page with a table, a captioned figure, an equation and text; blocks under the table and the equation are not items."""
    from cairn.operators import conversion

    formula = "Attention(Q, K, V) = softmax(QK^T) V"
    lines = [("Great Title", 20.0, 50.0, 300.0, 60.0), ("1 Intro", 12.0, 150.0, 300.0, 160.0), ("some plain text here", 10.0, 170.0, 300.0, 180.0), ("Table 1: Costs", 10.0, 190.0, 300.0, 200.0), ("in the table", 10.0, 215.0, 200.0, 225.0),
             (formula, 10.0, 300.0, 300.0, 312.0), ("Figure 2. A cat/dog", 10.0, 600.0, 300.0, 610.0), ("tiny", 0.0, 700.0, 300.0, 710.0)]
    blocks = spark.createDataFrame([("d/x.pdf", 1, t, size, size == 12.0, 50.0, y0, x1, y1, i + 1) for i, (t, size, y0, x1, y1) in enumerate(lines)], "source string, page int, text string, font_size double, is_bold boolean, x0 double, y0 double, x1 double, y1 double, block_order int")
    cells = [["a", "b"], ["1", "2"]]
    tables = spark.createDataFrame([("d/x.pdf", 1, 7, [["a"]], 0.0, 0.0, 9.0, 9.0), ("d/x.pdf", 1, 8, cells, 40.0, 210.0, 400.0, 260.0)], "source string, page int, table_id int, cells array<array<string>>, x0 double, y0 double, x1 double, y1 double")
    rects = rect(spark, [(0, 60.0, 450.0, 300.0, 590.0)], "k int").withColumn("source", F.lit("d/x.pdf"))
    pages = spark.createDataFrame([("d/x.pdf", 1, 600.0, 800.0)], "source string, page int, width double, height double")
    got = conversion.extract_items(blocks, tables, rects, pages).orderBy("item_index").collect()
    assert [(r.type, r.content or r.title or r.text_fallback) for r in got] == [
        ("title", "Great Title"), ("heading", "1 Intro"), ("paragraph", "some plain text here"), ("caption", "Table 1: Costs"), ("caption", "Figure 2. A cat/dog"), ("paragraph", "tiny"), ("table", "Costs"), ("figure", "A cat/dog"), ("equation", formula)]
    assert got[6].image_path == "images/tables/x_page_1_table_0_Costs.png" and got[7].image_path == "images/x_page_1_figure_0_A_cat_dog.png" and "<th>a</th>" in got[6].table_data and got[1].font_size == 12.0


def test_metadata_and_command_line(spark, tmp_path, capsys, monkeypatch):
    import json

    from cairn import __main__ as line

    class Model:
        def generate(self, prompt):
            return "```json\n{\"title\": \"T\", \"summary\": \"" + prompt.splitlines()[-1] + "\"}\n```"

    r = providers.generate_metadata(spark.createDataFrame([("a text",)], "piece string"), Model).first()
    assert (r.piece, r.title, r.section, r.summary) == ("a text", "T", "", "a text") and not providers.supports_images("echo")
    monkeypatch.setattr(line, "_spark", lambda: spark)
    (tmp_path / "i.json").write_text('[{"type": "title", "source": "a.pdf", "content": "Cats"}, {"type": "paragraph", "source": "a.pdf", "content": "Cats purr.", "page": 2}]')
    run = lambda *a: (line.main([str(x) for x in a]), capsys.readouterr().out.strip().splitlines())[1]
    assert json.loads(run("chunk", tmp_path / "i.json", tmp_path / "c.json")[0])["chunks"] == 1
    assert [c.content for c in readers.read_chunks(spark, str(tmp_path / "c.json")).collect()] == ["Cats purr."]
    run("sync", tmp_path / "i.json", tmp_path / "index")
    assert json.loads(run("search", tmp_path / "index", "cats")[0])["citation"] == "a.pdf, p.2, Cats" and json.loads(run("search", tmp_path / "index", "cats", "--rerank")[0])["rank"] == 1
    assert "purr" in json.loads(run("ask", tmp_path / "index", "do cats purr?")[0])["answer"]
    assert json.loads(run("documents", tmp_path / "index", tmp_path / "i.json")[0])["types"] == {"paragraph": 1, "title": 1}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_text("one two")
    assert json.loads(run("split", tmp_path / "t", "--how", "recursive")[0])["piece"] == "one two"


def test_json_array_by_parts(spark, tmp_path):
    """Every task writes and reads its own objects; files put together by name are one array, and numbers go through all of them."""
    import glob
    import json

    path = str(tmp_path / "a.json")
    rows = spark.range(0, 5000, 1, 7).select(F.col("id").alias("v"), F.concat(F.lit("a\n,[\u2028 "), F.col("id")).alias("s")).where("v < 700 OR v > 2000")
    writers.write_json_array(rows, path, "v")
    parts = sorted(glob.glob(f"{path}/part-*"))
    assert sum("-c000" in p and not p.endswith(".comma") for p in parts) > 1
    whole = json.loads("".join(open(p, encoding="utf-8").read() for p in parts))
    want = [(i, r.v, r.s) for i, r in enumerate(rows.orderBy("v").collect())]
    assert [(i, r["v"], r["s"]) for i, r in enumerate(whole)] == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_json_array(spark, path, "v bigint, s string")
        assert spark.read.text(path).rdd.getNumPartitions() > 9 and sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    writers.write_json_array(rows, path)  # in the order of rows
    assert sorted(map(tuple, readers.read_json_array(spark, path, "v bigint, s string").collect())) == want
    writers.write_json_array(rows.where("false"), path, "v")
    assert json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))) == [] and readers.read_chunks(spark, path).count() == 0


def test_nearest_holds_little(monkeypatch):
    """A task holds k rows a query, however many batches and ties it meets, and products are cut to SCORES."""
    r = np.random.default_rng(5)
    x, q = r.normal(size=(4000, 6)).round(1), r.normal(size=(30, 6))
    x[::3] = x[0]  # many ties
    best, keys, most = dense.Nearest(30, 7), r.permutation(4000), 0
    for i in range(0, 4000, 400):
        at = i + np.argsort(keys[i : i + 400])
        best.offer(np.arange(30), q @ x[at].T, keys[at])
        most = max(most, sum(len(w[0]) for w in best.waiting))
        best.settle()
        assert len(best.held[0]) == 210
    near = (q @ x.T).round(9)
    want = {(i, keys[c]) for i in range(30) for c in np.lexsort((keys, -near[i]))[:7]}
    got = list(best.frames(np.arange(30), "key"))
    assert {(a, b) for f in got for a, b in zip(f["query_id"], f["key"])} == want and most <= 30 * 400


def test_vector_search_by_blocks(spark, monkeypatch):
    """Each task returns its k best a query once, not those of every batch and block."""
    monkeypatch.setattr(dense, "SCORES", 900)
    r = np.random.default_rng(6)
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(r.normal(size=(700, 4)).round(1).tolist())], "vec_id long, embedding array<double>").repartition(2)
    queries = corpus.where("vec_id % 5 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    x = dense._unit(v["embedding"] for v in corpus.orderBy("vec_id").collect())
    near = (x[::5] @ x.T).round(9)
    want = {(5 * i, int(c)) for i in range(140) for c in np.lexsort((np.arange(700), -near[i]))[:3]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        hits = dense.vector_search(corpus, queries, 3)
        assert {(h.query_id, h.vec_id) for h in hits.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def sizes_of(udf, batch):
    return [len(x) for x in udf.func(iter([batch]))]


def test_pieces_leave_in_slices(spark):
    """However many texts a batch has, their pieces and counts leave a worker some hundreds of texts at a time."""
    import pandas as pd

    texts = pd.Series([f"w{i} " * 300 for i in range(1201)] + [None, ""])
    for udf in (splitting.split_text(), splitting.recursive_splitter(), splitting.plain_splitter()):
        assert sizes_of(udf, texts) == [500, 500, 203]
        assert list(udf.func(iter([texts[:0]])))[0].empty
    one = [p for x in splitting.split_text().func(iter([texts])) for p in x]
    assert one == [splitting.split_pieces(t) for t in texts]


def test_keyword_scores_are_cut(spark, monkeypatch):
    """The same hits however few postings are added up at a time."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, 30, 1 + i % 3))) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 3} w9") for i in range(20)], "query_id long, query string")
    want = sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in lexical.keyword_search(docs, asked, 5).collect())
    monkeypatch.setattr(lexical, "SCORES", 60)
    assert sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in lexical.keyword_search(docs, asked, 5).collect()) == want


def test_semantic_merge_across_batches(spark):
    """A document's pieces are merged together also where a batch ends between them; keys of any size and type, and null, stay apart."""
    embed = lambda texts: [[1.0, 0.0] if t.startswith("a") else [0.0, 1.0] for t in texts]
    for kind, keys in (("long", [None, 1, 2**62 + 1, 2**62 + 2]), ("string", ["x", "y", None])):
        rows = [(k, i, f"{'ab'[i // 3 % 2]}{i}") for k in keys for i in range(12)]
        pieces = spark.createDataFrame(rows, f"doc_id {kind}, piece_index int, piece string").repartition(5)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        try:
            got = [tuple(r) for r in splitting.semantic_merge(pieces, embed).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        text = lambda n: "\n\n".join(f"{'ab'[n % 2]}{3 * n + j}" for j in range(3))
        assert sorted(got, key=repr) == sorted(((k, n, text(n)) for k in keys for n in range(4)), key=repr)
    assert splitting.semantic_merge(pieces.limit(0), embed).count() == 0
