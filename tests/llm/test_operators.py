import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cairn.llm import decontaminate, langid, line_dedup, mixing, near_dedup, pii, quality, queries, toxicity, url_filter, warc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en", source="a"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))


# --- URL filters ---

def test_url_rules(spark):
    urls = ["http://A.Example.org/es/x", "https://example.org/en/12?q", "http://notexample.org/es/", "x://a.com/de/", "http://a.com", None, "nothing", "",
            "http://org/", "http://a.com/fr/#f", "http://a.com/fr/#f", "http://" + "a." * 300 + "org/" + "p" * 5000]
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'clash' AS host", "1 AS verdict")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.example.org", "example.org/es/", "block") and got[1][1:] == ("example.org/en/1", "block")
    assert got[2][1:] == ("org/", "allow") and got[3][1:] == ("com/de/", "block") and got[4][1:] == (None, "allow")
    assert got[5] == got[6] == got[7] == ("", None, "allow") and got[8][1] == "org/" and got[9] == got[10] == ("a.com", "com/fr/", "allow")
    assert got[11][1] == "org/"
    assert url_filter.filter_urls(pages, rules.limit(0)).where("rule IS NULL AND verdict = 'allow'").count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    both = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block")], rules.schema)
    assert {r.verdict for r in url_filter.filter_urls(pages, both, broadcast_rows=0).where("rule = 'com/'").collect()} == {"block"}


# --- WARC ---

def test_warc_round_trip(spark, tmp_path):
    long = "é" * 700
    rows = [(1, "http://a/\r\nX: y", long), (2, "http://b", long), (3, None, long), (4, "u", "x"), (5, "u", "x"), (6, "u", None), (7, "u", ""), (3, "again", long), (None, "n", long), (8, "😀", "z" * 999), (9, "v", "z" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS digest", "1 AS offset")
    index = warc.write_warc(pages, str(tmp_path), max_file_bytes=600)
    got = warc.read_warc(index, str(tmp_path), range_bytes=300).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in by[3]] == ["response"] * 2 and {r.url for r in by[3]} == {None, "again"}
    for i in (1, 2, None):
        assert by[i][0].record_type == "revisit" and by[i][0].refers_to == 3 and by[i][0].payload is None and by[i][0].payload_bytes == 1400
    assert bytes(by[3][0].payload).decode() == long and by[6][0].payload_bytes == by[7][0].payload_bytes == 0
    assert by[8][0].record_type == by[9][0].record_type == "response" and by[8][0].url == "😀"
    assert warc.read_warc(index.where("page_id = 4"), str(tmp_path)).count() == 1
    assert warc.read_warc(warc.write_warc(pages.limit(0), str(tmp_path)), str(tmp_path)).count() == 0


def test_warc_shuffled_lookup(spark):
    pages = spark.createDataFrame([(i, "u", "y" * 2000) for i in range(50)], "page_id long, url string, html string")
    plan = warc.plan_records(pages, broadcast_rows=0)
    assert plan.where("record_type = 'revisit' AND refers_to = 49").count() == 49


def test_warc_long_payloads_and_damage(spark, tmp_path):
    """Payloads of many ranges come back whole, ids are unique, and a payload that differs from its head is an error."""
    import gzip
    import hashlib

    texts = [prose(k, 40_000) for k in range(4)] + ["small"] * 3 + [None]
    pages = spark.createDataFrame([(k % 5, f"u{k}", t) for k, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_warc(pages, str(tmp_path))
    got = warc.read_warc(index, str(tmp_path), range_bytes=50_000, gap_bytes=10).collect()
    want = sorted(((t or "").encode() for t in texts))
    assert sorted(bytes(r.payload) for r in got) == want and all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.digest and len(r.payload) == r.payload_bytes for r in got)
    rows = index.collect()
    raw = [open(r.path, "rb").read()[r.offset : r.offset + r.length] for r in rows]
    ids = {x for m in raw for x in gzip.decompress(m).decode().split("\r\n") if x.startswith("WARC-Record-ID")}
    assert len(ids) == len(texts)
    with pytest.raises(ValueError):
        warc._parse(gzip.compress(gzip.decompress(raw[0]).replace(texts[0][:9].encode(), b"123456789")))


# --- line dedup ---

def test_line_dedup(spark):
    rows = [(i, f"menu\nown {i}\n menu \t", "a") for i in range(20)] + [(i, "menu", "b") for i in range(20, 24)]
    rows += [(30, None, "a"), (31, "", "a"), (32, "menu", "a"), (33, "\n\n", None), (32, "menu", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS n_dropped", "length(text) AS n_chars")
    for limit in (10**6, 0):
        got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, broadcast_rows=limit).collect()}
        assert got[3].text == "own 3" and got[3].n_dropped == 2 and got[3].n_lines == 3 and got[3].n_chars == 5
        assert got[21].text == "menu" and got[30].text is None and got[30].n_lines == 0 and got[31].text == "" and got[32].text == "" and got[33].text == "\n\n"
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0
    assert line_dedup.drop_boilerplate(docs).count() == len(rows)


# --- near copies ---

def near_cases():
    base = prose(1, 200).split()
    texts = [" ".join(base)]
    for k in range(1, 30):  # a chain of copies that drift away from the first
        base = list(base)
        base[(7 * k) % 200] = f"w{k}"
        texts.append(" ".join(base))
    shared = prose(2, 60)
    texts += [f"{shared} {prose(100 + k, 60)}" for k in range(20)]  # half alike only
    texts += [prose(3), prose(3).upper(), prose(3).replace(" ", "\n\t"), None, "", " \n", "one two", "ONE  two", "one two three", prose(4, 3000), prose(4, 3000) + " end", "a", "a"]
    return texts


def test_near_dedup_equals_brute_force(spark):
    texts = near_cases()
    docs = docs_of(spark, texts).selectExpr("*", "1 AS component_id", "'x' AS node")
    want, size = brute.near_components(dict(enumerate(texts)))
    got = near_dedup.find_components(docs).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (want[i], size[i]) for i in want}
    kept = {r.doc_id for r in near_dedup.drop_near_copies(docs).collect()}
    assert kept == {i for i in want if want[i] == i} and near_dedup.drop_near_copies(docs).columns == docs.columns


def test_near_dedup_in_small_blocks(spark, monkeypatch):
    """Buckets of many blocks and classes of sizes lose no link, at their edges neither."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    texts = near_cases()
    want, size = brute.near_components(dict(enumerate(texts)))
    got = near_dedup.find_components(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (want[i], size[i]) for i in want}
    sizes = [10, 11, 12, 85, 100, 100, 117, 118, 137, 138, 850, 1000, 1176, 1177] * 2
    members = spark.createDataFrame([(0, 7, i, i, n) for i, n in enumerate(sizes)], "band int, value long, node long, root long, n_shingles long")
    met = {}
    for r in near_dedup.cells(members, 85).collect():
        met.setdefault((r.x, r.y, r.i, r.j), set()).add((r.node, (r.c != r.x) if r.x != r.y else (r.k != r.i)))
    pairs = set()
    for cell in met.values():
        sides = {s for _, s in cell}
        pairs |= {(a, b) for a, s in cell for b, t in cell if a < b and (len(sides) == 1 or s != t)}
    assert {(a, b) for a in range(len(sizes)) for b in range(a + 1, len(sizes)) if 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])} <= pairs


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_near_dedup_on_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, size = brute.near_components({r.doc_id: r.text for r in rows})
    got = queries.near_copies(spark, sf).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (want[i], size[i]) for i in want}


def test_near_dedup_repeats_and_nulls(spark):
    rows = [(5, prose(5)), (5, prose(5)), (None, prose(5)), (9, prose(6)), (9, prose(7)), (4, prose(7) + " x"), (None, prose(8))]
    got = near_dedup.find_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 5] == [(5, True)] * 2
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(5, False), (None, False)}
    assert {(r.component_id, r.kept) for r in got if r.doc_id == 9} == {(9, True), (4, False)}
    assert near_dedup.find_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_dedup_keys_of_other_types(spark):
    """Keys of text, and numbers that a float can't hold beside nulls."""
    texts = [prose(1), prose(1) + " end", prose(2), None]
    named = spark.createDataFrame([(k, t) for k, t in zip(["b", "a", "c", None], texts, strict=True)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.find_components(named).collect()} == {("a", "a", True), ("b", "a", False), ("c", "c", True), (None, None, False)}
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_copies(named).collect()) == ["None", "a", "c"]
    big = 2**60 + 1
    large = spark.createDataFrame([(big, texts[0]), (big + 1, texts[1]), (None, texts[2])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.find_components(large).collect()} == {(big, big), (big + 1, big), (None, None)}


def test_drop_near_copies_by_row(spark):
    """Rows are told apart by key and words: repeated and null keys lose no text and save no copy."""
    far = [prose(40 + k, 60) for k in range(6)]
    rows = [(9, far[0], 1), (9, far[1], 2), (4, far[1] + " x", 3), (None, far[0], 4), (None, far[2], 5), (None, far[2], 6), (5, far[3], 7), (5, far[3], 8), (6, far[3] + " y", 9),
            (7, None, 10), (7, "", 11), (None, " ", 12), (8, far[4], 13), (8, far[4].upper(), 14), (None, far[5], 15), (3, far[5], 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "'c' AS _digest", "1 AS _id", "2 AS root", "map('k', n) AS m")
    got = near_dedup.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = sorted((r.n for r in got.collect()))
    groups = [{1, 4}, {2, 3}, {5, 6}, {7, 8, 9}, {13, 14}, {15, 16}]
    assert [len(g & set(kept)) for g in groups] == [1] * 6 and {10, 11, 12} <= set(kept) and len(kept) == 9
    assert {1, 3, 16} <= set(kept) and kept == sorted(r.n for r in near_dedup.drop_near_copies(docs.repartition(3)).collect())
    assert near_dedup.drop_near_copies(docs.limit(0)).count() == 0
    want = {r.n: r.d for r in docs.select("n", near_dedup.words_digest(docs.text).alias("d")).collect()}
    assert {n: d and bytes(d) for n, d in want.items()} == {r[2]: near_dedup.hashlib.md5(near_dedup.normalised(r[1])).digest() if near_dedup.normalised(r[1]) else None for r in rows}


def test_word_hashes_by_block():
    import numpy as np

    from cairn.llm import common

    data = ("  a bc\n" * 40 + "x" * 300 + " é😀 " * 50 + "y").encode()
    whole = common.word_hashes(data)
    assert len(whole) == len(data.split()) and len(set(whole.tolist())) == len(set(data.split()))
    for block in (1, 2, 7, 64, 299, 5000):
        assert (common.word_hashes(data, block=block) == whole).all()
    assert len(common.word_hashes(b"")) == 0 == len(common.word_hashes(b"  "))
    assert np.array_equal(common.word_hashes(b" " * 9 + b"q", block=3), common.word_hashes(b"q"))


def test_registers_merge():
    import numpy as np

    h = np.random.default_rng(5).integers(0, 2**63, 5000).astype(np.uint64)
    parts = np.stack([near_dedup.sketch(h[i::3]) for i in range(3)])
    assert (near_dedup.merge(parts) == near_dedup.sketch(h)).all()


def test_likelihood_is_as_exact_as_its_margin_needs():
    """The margin of four standard errors rests on the estimate's mean and deviation near the threshold."""
    import numpy as np

    r = np.random.default_rng(1)
    for j, percent in ((0.85, 85), (0.8, 80)):
        got = []
        for _ in range(300):
            both, own = int(1000 * j), (1000 - int(1000 * j)) // 2
            h = r.integers(0, 2**63, both + 2 * own).astype(np.uint64)
            a, b = h[: both + own], np.concatenate([h[:both], h[both + own :]])
            got.append(near_dedup.estimate(near_dedup.sketch(a)[None], near_dedup.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0])
        error = (j - near_dedup.plan(percent)[1]) / 4
        assert abs(np.mean(got) - j) < 0.3 * error and np.std(got) < 1.2 * error and min(got) >= near_dedup.plan(percent)[1]


def test_likelihood_estimate():
    import numpy as np

    r = np.random.default_rng(0)
    for j in (0.3, 0.65, 0.85, 1.0):
        both, own = int(2000 * j), (2000 - int(2000 * j)) // 2
        h = r.integers(0, 2**63, both + 2 * own).astype(np.uint64)
        a, b = h[: both + own], np.concatenate([h[:both], h[both + own :]])
        got = near_dedup.estimate(near_dedup.sketch(a)[None], near_dedup.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - both / (both + 2 * own)) < 0.12


# --- languages ---

def test_codewords_are_apart():
    for k in (2, 3, 4, 9, 20):
        c = langid.codewords(k)
        assert c.shape[0] == k and all((c[i] != c[j]).sum() >= max(1, c.shape[1] // 5) for i in range(k) for j in range(i))


def test_language_id(spark):
    got = queries.languages(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got) > 100 and all(0 <= r.score <= 1 for r in got)


def test_language_id_cases(spark):
    docs = docs_of(spark, ["the cat sat on the mat " * 5] * 3).unionAll(docs_of(spark, ["le chat est sur la table " * 5] * 3, "fr")).unionAll(docs_of(spark, ["x y z"], None))
    model = langid.train(docs)
    test = docs_of(spark, [None, "", "123 !!", "the mat", "LA TABLE", "the cat " * 20000]).selectExpr("*", "1 AS score", "2 AS lang_pred")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(test, model, ["doc_id"]).collect()}
    assert got[0][0] == got[1][0] == got[2][0] == "und" and got[3][0] == "en" == got[5][0] and got[4][0] == "fr"
    assert langid.predict(test, langid.train(docs.limit(0)), ["doc_id"]).where("lang_pred = 'und'").count() == 6
    assert langid.predict(test, langid.train(docs.where("lang = 'fr'")), ["doc_id"]).where("lang_pred = 'fr'").count() == 3
    assert langid.predict(test.limit(0), model, ["doc_id"]).count() == 0


def test_language_features_by_block():
    """Blocks neither lose nor repeat an n-gram, wherever a text is cut."""
    import numpy as np

    for n in (0, 1, 2, 3, 5, langid.BLOCK - 2, langid.BLOCK - 1, langid.BLOCK, langid.BLOCK + 1, langid.BLOCK + 3, 2 * langid.BLOCK + 1):
        text = (prose(n, 9) + "  ") * (n // 20 + 1)
        text = text[:n]
        data = b"".join([b" ", text.encode(), b" "])
        data = b" ".join(data.split()).join([b" ", b" "]) if text.split() else b" "
        want = sorted((k, sum(c * 257 ** (m - 1 - i) for i, c in enumerate(data[j : j + m]))) for k, m in enumerate((2, 3, 4)) for j in range(len(data) - m + 1))
        got = [f for f in langid.features(text)]
        if any(c.isalpha() for c in text):
            flat = np.concatenate(got)
            assert len(flat) == len(want)
            assert sorted(flat.tolist()) == sorted((((x + m) * 0x9E3779B1 & 0xFFFFFFFF) >> 17) + k * langid.CELLS for k, x in want for m in (k + 2,))
        else:
            assert got == []


def test_many_languages(spark):
    """More languages than any list has, and the fit against a dense one."""
    import numpy as np

    names = [f"l{i:03d}" for i in range(600)]
    rows = [(i, f"{prose(i, 12)} {prose(i, 12)}", n, "a", 0) for i, n in enumerate(names)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    assert model.languages == names and model.code.shape[1] == model.weights.shape[1] < 200
    few = spark.createDataFrame([(i, t, lang, "a", 0) for i, (_, t, _, _, _) in enumerate(rows[:30]) for lang in [f"x{i % 3}"]], DOCS)
    model = langid.train(few)
    counts = np.zeros((3, len(langid.ORDERS) * langid.CELLS))
    for i, (_, t, _, _, _) in enumerate(rows[:30]):
        for f in langid.features(t):
            np.add.at(counts[i % 3], f, 1)
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
    for bit, column in enumerate(model.code.T):
        want = np.log(p[column > 0].mean(0)) - np.log(p[column < 0].mean(0))
        assert np.abs(model.weights[:, bit] - want).max() < 1e-5
    least = ((p @ model.weights) * model.code).min(0)
    assert np.allclose(model.scale, 3 / least, rtol=1e-4)


# --- personal data ---

PIECES = ["a.b@c.de", "@", "x@y", "a@b.c@d.e", "é", "1.2.3.4", "999.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (650) 555-0100", "+", "+1", " ", ".", "-", "%", "😀", "9" * 5000 + ".1.1.1"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_base_spans_equal_regexes(text):
    assert pii.base_spans(text) == brute.base_spans(text)


def test_pii(spark):
    mail = "reach mister snoopy at jo@ex.org for help now please"
    texts = [mail] * 4 + [None, "", "plain words only", "+" * 50 + " " + "1 " * 40, prose(9, 5000) + " 10.0.0.1"]
    docs = docs_of(spark, texts).selectExpr("*", "'c' AS base", "1 AS terms")
    got = {r.doc_id: r for r in pii.render(pii.detect(docs, ["doc_id"])).collect()}
    assert got[0].n_email == 1 and "email:23:32" in got[0].spans and "term:13:19" in got[0].spans and got[4].spans == got[5].spans == got[6].spans == ""
    assert got[8].n_ip == 1 and len(got) == len(texts)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, texts)).collect()}
    assert "jo@ex.org" not in clean[0] and "snoopy" not in clean[0] and "[email]" in clean[0] and clean[4] is None and clean[6] == texts[6]
    assert pii.render(pii.detect(docs_of(spark, []), ["doc_id"])).count() == 0


def test_letters():
    """Numbers that are no digits are no letters."""
    for text in ("½", "²", "①", "12 ½ !", "Ⅷ"[:0], "_"):
        assert not list(langid.features(text))
    assert list(langid.features("é")) and [x for _, _, x in pii.terms_of("mañana²² ½½½ abc_def", [])] == ["mañana", "abc", "def"]


def test_pii_numbers_in_time():
    import time

    began = time.time()
    for text in ("1" * 300_000, "1." * 150_000, "1.2.3." * 50_000, "+1 " + " " * 300_000, "a@" * 100_000, "x" * 300_000 + "@", "1 " * 150_000, "k@e.io," * 20_000 + "word " * 20):
        pii.contexts(text, pii.base_spans(text))
    assert time.time() - began < 20


def brute_terms(texts):
    """The marked terms by comparing every term with every entity, in plain Python."""
    import math
    from collections import Counter

    base = [pii.base_spans(t) for t in texts]
    near, n_e, n_t, n_et = Counter(), Counter(), Counter(), Counter()
    for t, b in zip(texts, base, strict=True):
        own, all_terms = set(pii.entities(t or "", b)), {x for _, _, x in pii.terms_of(t or "", b)}
        near.update(pii.contexts(t or "", b))
        n_e.update(own)
        n_t.update(all_terms)
        n_et.update((e, x) for e in own for x in all_terms)
    n = len(texts)
    told = {(e, x) for (e, x), k in near.items() if k >= pii.SUPPORT and math.log(n_et[e, x] * n / (n_e[e] * n_t[x])) >= math.log(n / n_e[e]) / pii.ALPHA - 1e-9}
    return [[(a, b) for a, b, x in pii.terms_of(t or "", s) if any((e, x) in told for e in pii.entities(t or "", s))] for t, s in zip(texts, base, strict=True)]


def test_pii_terms_equal_brute_force(spark):
    """The same terms, marked at the same places, whether pairs are few enough to be sent or not; also far from the entity."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    texts += [f"Ma\u00f1ana\u00b2\u00b2 snoopy boss wrote to jo@ex.org on day{i} {prose(i, 40)} and snoopy left, \u0130STANBUL stra\u00dfe" for i in range(4)]
    want = brute_terms(texts)
    assert sum(map(len, want)) > 8
    for rows in (200_000, 0):
        got = {r.doc_id: [(x.start, x.end) for x in r.terms] for r in pii.detect(docs_of(spark, texts), ["doc_id"], broadcast_rows=rows).collect()}
        assert got == dict(enumerate(want))


def test_pii_terms_of_the_table_itself(spark):
    """On given rows too the method marks terms, and just those that brute force marks."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    want = dict(zip(texts, brute_terms(list(texts.values())), strict=True))
    got = {r.doc_id: [(x.start, x.end) for x in r.terms] for r in pii.detect(rows, ["doc_id"]).collect()}
    assert got == want and sum(map(len, want.values())) > 50


def test_pii_on_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.personal_data(spark, SF).collect():
        base = brute.base_spans(docs[r.doc_id])
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [f"{k}:{a}:{b}" for k, a, b in base]


# --- mixing ---

def test_mixing(spark):
    rows = [(i, prose(i, 10), f"s{i % 5}") for i in range(400)] + [(900, None, None), (901, "", "empty"), (902, "w " * 3, None), (902, "w " * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "5 AS size", "'x' AS target")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    total = sum(r["size"] for r in got)
    target = {r.source: r.target for r in got}
    assert abs(sum(target.values()) - total) < 1e-6 and all(r.target <= 3 * r.source_size + 1e-9 for r in got)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in target}
    assert all(abs(taken[f"s{k}"] - target[f"s{k}"]) < 0.3 * target[f"s{k}"] for k in range(5)) and target["empty"] == 0
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_equal_water_filling(sizes):
    """The closed form, in plain Python, against the rule as it is told."""
    w, most, total = [i % 3 + 1 for i in range(len(sizes))], [3 * s for s in sizes], sum(sizes)
    at = set()
    while True:
        left, share = total - sum(most[i] for i in at), sum(w[i] for i in range(len(w)) if i not in at)
        over = {i for i in range(len(w)) if i not in at and left * w[i] > most[i] * share}
        if not over:
            break
        at |= over
    want = [most[i] if i in at else left * w[i] / share for i in range(len(w))]
    order = sorted(range(len(w)), key=lambda i: (most[i] / w[i], i))
    got, before = [0.0] * len(w), 0
    for k, i in enumerate(order):
        share = sum(w[j] for j in order[k:])
        if most[i] * share > (total - before) * w[i]:
            for j in order[k:]:
                got[j] = (total - before) * w[j] / share
            break
        got[i], before = most[i], before + most[i]
    assert got == pytest.approx(want)


# --- decontamination ---

def test_leaks(spark):
    items = [(0, prose(50, 40)), (1, prose(51, 12)), (2, "only four words here"), (3, None), (4, prose(50, 40)), (5, "five words are in this"), (6, "one"), (None, "null id with five words"), (8, "...")]
    some = items[0][1].split()
    for k in range(0, 40, 6):
        some[k] = "other"
    texts = [f"{prose(1)} {items[0][1].upper()}, {prose(2)}", " ".join(some), prose(3, 5000) + "\n" + items[1][1], None, "", "so\nOnly four: words here!\nonly four words", prose(60, 100), " ".join(items[0][1].split()[:20]),
             "and five words are\nin this!", prose(70, 3) + " " + " ".join(items[1][1].split()[:10]), "we have only four words here", "five words xx in this", "five words are xx yy", "five yy are in this", "one",
             "null id with five words", items[2][1] + "\n" + prose(71, 20_000) + "\none"]
    docs = docs_of(spark, texts).selectExpr("*", "1 AS item_id", "'c' AS digest", "2 AS _digest", "3 AS node", "4 AS words")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    want = {(0, 0), (0, 4), (1, 0), (1, 4), (2, 1), (5, 2), (8, 5), (9, 1), (11, 5), (13, 5), (14, 6), (15, None), (16, 2), (16, 6)}
    for options in ({}, {"broadcast_rows": 0}, {"most_seeds": 0}):
        got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, **options).collect()]
        assert set(got) == want and len(got) == len(want)
        kept = decontaminate.decontaminate(docs, bench, **options)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(17)) - {d for d, _ in want}
    twice = docs.unionAll(docs)
    assert decontaminate.leaks(twice, bench).count() == 2 * len(want) and decontaminate.decontaminate(twice, bench).count() == 2 * kept.count()
    named = bench.selectExpr("concat('item ', item_id) AS item_id", "text")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, named).collect()} == {(d, i if i is None else f"item {i}") for d, i in want}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 == decontaminate.leaks(docs.limit(0), bench).count()
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_leaks_equal_brute_force(spark):
    """On sf0.01 every item that a diagonal of a text has OVERLAP or PART of is found, and whatever is found is there in order."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: decontaminate.tokens(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: decontaminate.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in queries.benchmark_leaks(spark, sf).collect()}
    must = brute.diagonal_overlaps(docs, items)
    assert len(must) > 10
    for pair, n in must.items():
        assert pair in got and got[pair].n_matched >= n, pair
    for (d, i), r in got.items():
        there = docs[d][r.first_word : r.last_word + 1]
        assert brute.in_order(items[i].tolist(), there.tolist()) == r.n_matched or (items[i][: len(there)] == there).sum() <= r.n_matched
        assert r.n_matched >= min(0.8 * r.n_item, max(13, 0.6 * r.n_item)) and r.n_item == len(items[i])


def test_leak_recall():
    """Items of 5 to 100 words with as many random substitutions as the check allows."""
    r = random.Random(7)
    for n in (5, 6, 9, 10, 12, 15, 19, 20, 22, 24, 28, 30, 31, 33, 36, 40, 50, 70, 100):
        item = [f"w{i}" for i in range(n)]
        seeds = {int(x) for m in decontaminate.masks_of(n) for x in decontaminate._seeds(decontaminate.tokens(" ".join(item)), m)}
        found = 0
        for _ in range(1000):
            places = set(r.sample(range(n), n - -(-4 * n // 5)))
            text = decontaminate.tokens(" ".join(f"y{i}" if i in places else w for i, w in enumerate(item)))
            found += any(int(x) in seeds for m in decontaminate.masks_of(n) for x in decontaminate._seeds(text, m))
        assert found == 1000 if n <= decontaminate.SHORT else found >= 990, (n, found)


# --- quality ---

@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é😀", " ", "\n", "\t", "\x0b", "#", "|x", "\x1c", "\xa0"]), max_size=40).map("".join))
def test_quality_counts_equal_brute_force(text):
    assert quality.base_counts(text) == brute.quality_counts(text)


def test_quality(spark):
    good = [prose(i, 60 + i) for i in range(200)]
    bad = [" ".join(f"{w}###" for w in prose(300 + i, 100).split()) for i in range(3)]
    docs = docs_of(spark, good + bad + [None, "", "same words again " * 40]).selectExpr("*", "'k' AS cell", "1 AS n_words").unionAll(docs_of(spark, [prose(7)], None, None).selectExpr("*", "'k'", "1"))
    got = quality.judge(docs.withColumnRenamed("n_words", "clash"), ["doc_id", "clash"]).collect()
    assert len(got) == 207
    kept = [r for r in got if r.kept]
    assert {r.doc_id for r in kept} == set(range(200)) and sum(r.base_failed for r in got) == 3
    assert quality.judge(docs.limit(0), ["doc_id"]).count() == 0


def test_quality_equals_plain_estimates(spark):
    """kept and distance of all documents of sf0.01 against the estimates in plain numpy; every language and source is judged."""
    sf = "/root/testdata/sf0.01"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute.quality_distances(docs)
    got = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).collect()}
    assert len(got) == len(docs) and any(d is not None for d in want.values())
    for i, d in want.items():
        assert (got[i].distance is None) == (d is None) == got[i].base_failed
        if d is not None:
            assert got[i].distance == pytest.approx(d, rel=1e-5, abs=1e-7) and got[i].kept == (d <= quality.chi2_quantile(1 - quality.TAIL, quality.P))


def test_quality_steps_lower_the_determinant(spark):
    """A third of a group that lies apart does not draw the estimate to it, whatever start it hides from."""
    import numpy as np

    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (400, 5)), r.normal(6, 0.3, (100, 5))])
    rows = spark.createDataFrame([("c", *map(float, v)) for v in x], "cell string, x0 double, x1 double, x2 double, x3 double, x4 double")
    first = {e.start: e.logdet for e in quality.starts(rows, lambda t: t).collect()}
    assert set(first) == {"diagonal", "classical", "tanh", "signs"}
    (found,) = quality.fit(rows).collect()
    assert found.n == 500 and np.abs(np.array(found.center)).max() < 0.5 and found.logdet < first["classical"]


# --- toxicity ---

TOXIC = ["blorg", "snarfle", "grumbix"]


def toxic_model():
    r = random.Random(3)
    texts, y = [], []
    for i in range(400):
        w = prose(i, 40).split()
        if i % 4 == 0:
            for x in TOXIC:
                if r.random() < 0.6:
                    w.insert(r.randrange(40), x)
        c = toxicity.word_counts(" ".join(w))
        texts.append((list(c), list(c.values())))
        y.append(int(any(x in c for x in TOXIC)))
    import numpy as np

    return toxicity.fit(texts, np.array(y))


def test_toxicity_restores_disguises():
    m = toxic_model()
    for word in ("blorg", "BLORG", "bl0rg", "b l o r g", "b.l.o.r.g", "blooorg", "$narfle", "sn4rfl3", "s n a r f l e"):
        assert m.score(f"{prose(999, 30)} {word} {prose(998, 30)}") >= 0.5, word
    for text in (prose(997, 500), "", None, "!!! 1234 $$$ ...", "a b c d e f g h", "x" * 100000):
        assert m.score(text) < 0.5


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.toxic_texts(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.95 * len(got) > 100 and {r.predicted for r in got} == {0, 1}
    toxic, clean = ([r for r in got if r.toxic == y] for y in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.92 * len(toxic) and sum(r.predicted for r in clean) <= 0.035 * len(clean)


def test_toxicity_cases(spark):
    docs = docs_of(spark, [None, "", "x"]).selectExpr("*", "'c' AS score")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score < 0.5 for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [True] * 3
    odd = spark.createDataFrame([(0, None), (1, 1), (1, 1), (None, 0), (2, 5)], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(0), toxicity.train(docs, odd)).count() == 0


def test_toxicity_characters_of_all_texts(spark):
    """The character model knows the words of texts that the classifier's sample leaves out."""
    rows = [(i, f"all well {'blorg' if i % 2 else 'full'} hall") for i in range(40)] + [(100 + i, "quoin") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, per_class=10)
    assert "quo" in model.chars and toxicity.decode("quo1n", model.chars) == "quoin" and toxicity.decode("ha1l", model.chars) == "hall"
    size, one, two, three = toxicity.count_grams(docs.select("text"))
    assert size == 80 and one["q"] == two["^q"] == three["quo"] == three["in$"] == 40 and one["$"] == 200
    few = toxicity.count_grams(docs.select("text"), grams=3)
    assert few[1] == one and len(few[2]) == len(few[3]) == 3
    assert toxicity.count_grams(docs.select("text").limit(0))[0] == 0


def test_toxicity_gaps():
    m = toxic_model()
    for gap in (*toxicity.GAPS, " - "):
        for word in ("blorg", "snarfle"):
            assert m.score(f"{prose(999, 30)} {gap.join(word)} {prose(998, 30)}") >= 0.5, (gap, word)
    for other in "/:;<=>?[]^":
        assert m.score(f"{prose(999, 30)} {other.join('blorg')} {prose(998, 30)}") < 0.5, other


def test_toxicity_any_disguise():
    """Doubling, single gaps, mixed disguises, and repetitions and gaps of any length."""
    m = toxic_model()
    for word in ("bllorg", "bl0rrg", "blo rg", "b-lorg", "bl.org", "b lo rg", "bl00rg", "bl" + "o" * 10 + "rg", "bl" + "o" * 63 + "rg", "bl" + "0" * 5000 + "rg", "b" + " " * 500 + "lorg",
                 "b" * 70 + "l0rg", "$n4rf1e", "s n 4 r f l e", "sn-arf-le!", "grum8ix"):
        assert m.score(f"{prose(999, 30)} {word}, {prose(998, 30)}") >= 0.5, word
        assert m.score(word) >= 0.5, word
    for text in (prose(996, 3000), "to be or not to be, 100 000 l' a b" * 50, "b", "b l", "bl", "zzz " * 1000, "1" * 100_000, "l1" * 50_000, "-" * 1000, "blorb blarg"):
        assert m.score(text) < 0.5, text[:40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["blorg", "b", "l", "0", "o", "rg", "1", "i", "!", "$", " ", ".", "-", ",", "\n", "x", "nn", "snar", "f1e", "é"]), max_size=14).map("".join))
def test_gate_loses_nothing(text):
    """Every feature that some path through the lattice of the text between hard ends reads is in one of the gate's stretches,
    unless the text holds it as written."""
    import itertools
    import re

    features = [" blor", " snarfle ", " lil"]
    gate = toxicity.Gate(features)
    stretches = [p for s in gate.stretches(text) for p in read_all(s)]
    plain = f" {text.translate(toxicity._EDGES)} "
    for part in re.split(r"[,\n]", text):
        for read in itertools.islice(read_all(part.strip("!|+" + toxicity.GAPS)), 3000):
            for f in features:
                if f in f" {read} " and f not in plain:
                    assert any(f.strip() in x for x in stretches), (f, read)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_spacing_table_equals_translate(text):
    assert toxicity._spaced(toxicity._points(text)) == text.translate(toxicity._EDGES)


def read_all(text):
    import itertools

    return ("".join(p).replace("$^", " ") for p in itertools.product(*toxicity.lattice(text)))


def found_in(items, words):
    """What match() says of each item, given the diagonals that its seeds meet."""
    text, out = decontaminate.tokens(" ".join(words)), []
    for name, own in items.items():
        own, shifts = decontaminate.tokens(" ".join(own)), set()
        for m in decontaminate.masks_of(len(own)):
            at = {}
            for i, x in enumerate(decontaminate._seeds(own, m).tolist()):
                at.setdefault(x, []).append(i)
            shifts |= {j - i for j, x in enumerate(decontaminate._seeds(text, m).tolist()) for i in at.get(x, ())}
        got = decontaminate.match(own, text, sorted(shifts)) if shifts else None
        if got:
            out.append((name, got[0], len(own), *got[1:]))
    return out


def test_leaks_in_part_and_shifted():
    item = [f"w{i}" for i in range(40)]
    short = [f"s{i}" for i in range(20)]
    about = [f"x{i}" for i in range(30)]
    find = lambda w: found_in({7: item, 8: short}, about + w + about)
    assert find(item) == [(7, 40, 40, 30, 69)]
    assert find(item[:20] + ["new"] + item[20:]) == [(7, 40, 40, 30, 70)]
    assert find(item[:19] + item[20:]) == [(7, 39, 40, 30, 68)]
    assert find(item[6:34]) == [(7, 28, 40, 30, 57)] and find(item[:20]) == find(item[::2]) == [] == find(item[::-1])
    for places in ((3, 7, 11, 15), (4, 8, 12, 16), (2, 6, 11, 15), (4, 9, 14, 19)):  # no seed of twelve words is left by some
        assert [r[:3] for r in find([f"y{i}" if i in places else w for i, w in enumerate(short)])] == [(8, 16, 20)]
    r = random.Random(0)
    for _ in range(500):
        places = r.sample(range(20), 4)
        assert [x[:2] for x in find([f"y{i}" if i in places else w for i, w in enumerate(short)])] == [(8, 16)]


def test_near_dedup_at_another_threshold(spark):
    """Recall holds at any threshold: pairs just above it share a band, and brute force finds the same components."""
    for percent in (60, 70, 80, 85, 90):
        rows, maybe, equal = near_dedup.plan(percent)
        assert (1 - near_dedup._agree(percent / 100) ** rows) ** (near_dedup.REGISTERS // rows) <= near_dedup.MISS
        assert maybe < percent / 100 - 0.05 and equal < near_dedup.REGISTERS * near_dedup._agree(maybe)
    assert near_dedup.plan(85)[0] == 8 and near_dedup.plan(85)[2] == 176 and abs(near_dedup.plan(85)[1] - 0.76) < 0.005
    texts = []
    for k in range(150):  # of 196 shingles 175 are shared: 175 / 217 = 0.806
        base = prose(500 + k, 200).split()
        texts += [" ".join(base), " ".join(base[:-21] + [f"w{k}_{i}" for i in range(21)])]
    want, size = brute.near_components(dict(enumerate(texts)), 80)
    assert sum(want[i] != i for i in want) == 150
    got = near_dedup.find_components(docs_of(spark, texts), percent=80).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (want[i], size[i]) for i in want}


#: Names that operators use inside, add, or once crashed on.
CLASHES = (
    "base terms near _row row cell wider widest mine found held told l n_words n_lines n_dropped distance kept start center scatter inverse bin host path rule verdict _host _drop _kept digest _digest _id _of _gone gone "
    "node root score lang_pred ambiguous seen _seen _rule0 short size source_size target copies taken copy words first at seeds shifts item band value component_id n_shingles doc entity term n record_type refers_to payload "
    "page_id url html item_id key number share h v p best _best x0 _found widest_ _ m u _source _copy _n _size"
).split()

def staged(name, docs, spark):
    """A stage of the pipeline, with the labels and the benchmark of a table of files."""
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name](spark, docs, SF)


APPLIED = {
    "filter_urls": lambda d, spark: url_filter.filter_urls(d, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")),
    "filter_urls_wide": lambda d, spark: url_filter.filter_urls(d, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"), shapes=0, broadcast_rows=0),
    "drop_boilerplate": lambda d, spark: line_dedup.drop_boilerplate(d),
    "drop_near_copies": lambda d, spark: near_dedup.drop_near_copies(d),
    "predict": lambda d, spark: langid.predict(d, langid.train(d), d.columns),
    "detect": lambda d, spark: pii.detect(d, d.columns),
    "detect_wide": lambda d, spark: pii.detect(d, d.columns, broadcast_rows=0),
    "sanitise": lambda d, spark: pii.sanitise(d),
    "mix": lambda d, spark: mixing.mix(d),
    "toxicity stage": lambda d, spark: staged("toxicity", d, spark),
    "line dedup stage": lambda d, spark: staged("line dedup", d, spark),
    "near dedup stage": lambda d, spark: staged("near dedup", d, spark),
    "decontamination stage": lambda d, spark: staged("decontamination", d, spark),
    "mixing stage": lambda d, spark: staged("mixing", d, spark).where("_copy_ = 0").drop("_copy_"),
    "emit": lambda d, spark: mixing.emit(d.withColumn("times", F.lit(2)), "times").where("copy = 1"),
    "decontaminate": lambda d, spark: decontaminate.decontaminate(d, spark.createDataFrame([(1, prose(50, 40))], "item_id long, text string")),
    "judge": lambda d, spark: quality.judge(d, d.columns),
    "score": lambda d, spark: toxicity.score(d, toxicity.train(d.where("doc_id >= 0"), d.select("doc_id", (d.doc_id % 2).cast("int").alias("toxic")))),
}
ADDED = {
    "filter_urls": {"host", "path", "rule", "verdict"}, "filter_urls_wide": {"host", "path", "rule", "verdict"}, "drop_boilerplate": {"n_lines", "n_dropped"}, "predict": {"lang_pred", "score", "ambiguous"},
    "detect": {"base", "terms"}, "detect_wide": {"base", "terms"}, "mix": {"size", "source_size", "target", "copies", "taken"}, "emit": {"copy"}, "judge": {*quality.BASE, "base_failed", "distance", "kept"}, "score": {"score"},
}


@pytest.mark.parametrize("name", sorted(APPLIED))
def test_clashing_columns(spark, name):
    """Columns of the caller with any inner name go through untouched; those named like an added column are replaced."""
    texts = [f"{prose(i, 60)} write to jo@ex.org snoopy" for i in range(8)] + [None, ""]
    docs = docs_of(spark, texts).selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES if c != "url"], "concat('http://a', doc_id, '.example.org/es/') AS url")
    got = APPLIED[name](docs, spark)
    added = ADDED.get(name, set())
    assert sorted(got.columns) == sorted({*docs.columns, *added}) and len(got.columns) == len(set(got.columns))
    rows = got.collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(range(len(texts)))
    for c in set(CLASHES) - added - {"url"}:
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows), c
    assert len(APPLIED[name](docs.limit(0), spark).columns) == len(got.columns)
