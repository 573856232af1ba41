import pytest

import corpus_pipeline
from cairn.llm import decontaminate
from cairn.llm.common import table
from cairn.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", ["op3_language_id", "op9_quality_rules", "op10_toxicity"])
def test_a_row_for_every_document(spark, name):
    docs = table(spark, SF, "documents").select("doc_id")
    got = QUERIES[name](spark, SF).select("doc_id")
    assert got.count() == docs.count() == got.intersect(docs).count()


def test_pipeline_takes_effect(spark):
    """Every stage against what it should do to the rows that it got."""
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        kept.append((name, before, docs))
    assert all(out.columns == before.columns for _, before, out in kept[:-1])
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = kept
    assert 0.5 * a.count() < b.count() <= a.count() and b.count() == c.count()
    want, _ = brute.near_components({r.doc_id: r.text for r in c.collect()}, 80)
    assert {r.doc_id for r in d.collect()} == {i for i in want if want[i] == i}
    leaked = {r.doc_id for r in decontaminate.leaks(d, table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in e.collect()} == {r.doc_id for r in d.collect()} - leaked
    copies = {r.doc_id: r["count"] for r in f.groupBy("doc_id").count().collect()}
    assert set(copies) <= {r.doc_id for r in e.collect()} and max(copies.values()) <= 3
    words = sum(len(brute.words(r.text)) for r in f.collect())
    assert abs(words - sum(len(brute.words(r.text)) for r in e.collect())) < 0.2 * words
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, f.collect()))


def test_first_stages_equal_plain_versions(spark):
    """The toxicity stage against scoring text by text, the line stage against counting lines in plain Python."""
    from collections import Counter, defaultdict

    from cairn.llm import line_dedup, toxicity

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    kept = corpus_pipeline.toxic(spark, docs, sf)
    rows = [r.asDict() for r in docs.collect() if model.score(r.text) < 0.5]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r["doc_id"] for r in rows)
    pages, holders = Counter(r["source"] for r in rows), defaultdict(Counter)
    edge = " \t\r\x0b\x0c"
    for r in rows:
        holders[r["source"]].update({x.strip(edge) for x in (r["text"] or "").split("\n")} - {""})
    gone = {s: {x for x, n in c.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.MAX_RATIO * pages[s]} for s, c in holders.items()}
    want = {r["doc_id"]: r["text"] and "\n".join(x for x in r["text"].split("\n") if x.strip(edge) not in gone[r["source"]]) for r in rows}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, kept, sf).collect()} == want and any(gone.values())


def write_tables(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids; and empty tables."""
    r = __import__("random").Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    texts = [prose(60) for _ in range(30)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    item = prose(40)
    docs += [(None, None, None, None, None), (50, None, "en", "s0", 0), (51, "", "en", None, 0), (52, prose(50_000), "en", "s1", 9), (3, texts[3], "en", "s0", 9), (3, texts[3], "en", "s0", 9), (3, prose(60), "en", "s0", 9), (53, texts[5] + " end", None, "s2", 9),
             (None, prose(60), "en", "s0", 9), (54, f"{prose(20)} {item} {prose(20)}", "en", "s1", 9)]
    sf = write_tables(spark, tmp_path / "a", docs, [(0, None, None), (1, 1, 0), (None, 0, 1), (2, 0, 0)], [(0, item), (None, None), (1, "")])
    got = corpus_pipeline.run(spark, sf).collect()
    ids = {x.doc_id for x in got}
    assert 53 not in ids and 54 not in ids and {50, 51, 52, None} <= ids | {50, 51} and sum(x.copy == 0 and x.doc_id == 3 for x in got) <= 2
    stage = corpus_pipeline.near_copies(spark, table(spark, sf, "documents"), sf)
    assert sorted((x.doc_id for x in stage.collect() if x.doc_id == 3 or x.doc_id is None), key=str) == [3, 3, None, None] and stage.count() == len(docs) - 3
    none = write_tables(spark, tmp_path / "b", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
    no_items = write_tables(spark, tmp_path / "c", docs, [], [])
    assert corpus_pipeline.leaks(spark, table(spark, no_items, "documents"), no_items).count() == len(docs) == corpus_pipeline.toxic(spark, table(spark, no_items, "documents"), no_items).count()
