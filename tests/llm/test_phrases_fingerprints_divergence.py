import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import divergence, order_minhash, phrases
from cairn.llm.common import table
from tests.llm.brute import LOW

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None) for i, (t, l, s) in enumerate(rows)], COLUMNS)


# phrases


def plain_phrases(rows, min_count=30, longest=4, covered=80, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= min_count and len(p) > 1}
        most = defaultdict(int)
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        found = []
        for p, a in often.items():
            score, cut = min((2_000_000 * a // (counts[p[:c]] + counts[p[c:]]), c) for c in range(1, len(p)))
            if 100 * most[p] < covered * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


def phrase_rows(seed, n=300):
    r = random.Random(seed)
    words = ["The", "of", "a", "éa", "New", "York", "x", "\x00", "ÀB", "z z"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]
    text = lambda: "".join(r.choice(words) + r.choices(gaps, [20, 3, 2, 2, 1, 1, 1, 1])[0] for _ in range(r.randint(0, 40)))
    return [(text() + "new york city hall " * r.randint(0, 2), r.choice(["en", "en", "fr", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (" ", "fr"), ("...", "es")]


@pytest.mark.parametrize("bits", [phrases.MOST_BITS, 1 << 16])
def test_phrases_equal_plain_counts(spark, bits):
    rows = phrase_rows(1)
    got = phrases.mine(spark.createDataFrame(rows, "text string, lang string").repartition(5), min_count=10, most_bits=bits)
    assert {tuple(r) for r in got.collect()} == plain_phrases(rows, 10) and got.count() > 30


def test_phrases_ties_and_limits(spark):
    rows = [(f"{a} {b}", "en") for a, b in ("ab", "cd", "éf", "gh") for _ in range(30)] + [("one two", "en")] * 29
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = [(r["rank"], r["phrase"]) for r in phrases.mine(docs, top=3).orderBy("rank").collect()]
    assert got == [(1, "a b"), (2, "c d"), (3, "g h")]
    assert phrases.mine(docs.limit(0)).count() == 0 == phrases.mine(docs.where("text = 'one two'")).count()


def test_long_text_in_blocks(spark, monkeypatch):
    """A text longer than a block gives the same phrases, whatever lies at the cuts: also words longer than a block, and breaks."""
    r = random.Random(3)
    text = "".join(r.choice(["aa", "b", "cc" * 40, "é"]) + r.choice([" ", "  ", ". ", "\t"]) for _ in range(3000)).encode()
    want = {k: Counter(x for words in phrases.token_blocks([text], k - 1) for x in phrases.phrases_of(words, k, "en", None)) for k in range(1, 5)}
    monkeypatch.setattr(phrases, "BLOCK", 50)
    for k in range(1, 5):
        lists = list(phrases.token_blocks([b"short", text, b"", b"end"], k - 1))
        assert len(lists) > 50
        got = Counter(x for words in lists for x in phrases.phrases_of(words, k, "en", None))
        if k == 1:
            got.subtract([b"short", b"end"])
        assert +got == want[k]


def test_phrases_on_table(spark):
    docs = table(spark, SF, "documents")
    want = plain_phrases([(r.text, r.lang) for r in docs.collect()], 10)
    assert {tuple(r) for r in phrases.mine(docs, min_count=10).collect()} == want


# divergence


def plain_audit(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))) for text, lang, source in rows]
    held, n, by_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        n[lang, source].update(terms)
        by_lang[lang].update(terms)
    out = []
    for lang in held:
        keep = [t for t, c in held[lang].items() if c >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in keep) + len(keep)) for t in keep}
        p = {s: share(n[lang, s]) for one, s in n if one == lang}
        q = share(by_lang[lang])
        f = lambda x, y: (x - y) * (x - y) // y
        for s in p:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in keep), o.encode(), o) for o in p if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in keep if n[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i) for part, found in (("pair", pair), ("term", term)) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audit_rows(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "The", "É", "é", "a1b", "x_y", "z　w", "ÀB"] + [chr(97 + r.randint(0, 25)) * r.randint(1, 3)] * 3)
    rows = [(" ".join(word() for _ in range(r.randint(0, 30))), r.choice(["en", "en", "fr", None]), r.choice(["s0", "s0", "s1", "é", "z", None, ""])) for _ in range(120)]
    return rows + [(None, "en", "silent"), ("", "fr", "silent"), ("12 34", "es", "a"), (None, "es", "b"), (None, None, None)] + rows[:4]


def test_divergence_equals_plain_arithmetic(spark):
    rows = audit_rows(5)
    got = divergence.audit(frame(spark, rows).repartition(4), top=7)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, top=7)
    assert {("es", "a", "pair", "b", 0, 1), ("es", "b", "pair", "a", 0, 1)} <= {tuple(r) for r in got.collect()}
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_shares_pass_64_bits(spark):
    n, total = 9 * 10**18 - 1, 9 * 10**18
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + 7)


# fingerprints


def _xx(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def plain_signatures(text, k=3, m=64):
    """Order MinHash with numbered k-mers, start by start."""
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    if not words:
        return []
    short = lambda h: ((h << 28) + (1 << 63)) % (1 << 64) - (1 << 63) >> 28  # noqa: E731  the 36 bits that are kept, signed
    kmers = [short(_xx(*words[i : i + k])) for i in range(max(len(words) - k + 1, 1))]
    seen, items = Counter(), []
    for i, x in enumerate(kmers):
        items.append((short(_xx(x, struct.pack("<i", seen[x]))), i))
        seen[x] += 1
    items.sort()
    out = []
    for j in range(m):
        start = j * (1 << 36) // m - (1 << 35)
        after = [p for h, p in items if h >= start] + [p for h, p in items if h < start]
        a, b = sorted((after + after[:1])[:2])
        out.append(_xx(kmers[a], kmers[b]) & 0xFFFF)
    return out


def test_signatures_equal_plain_order_minhash(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefg") * r.randint(1, 40) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 30, 400]))) for _ in range(60)]
    texts += [None, "", " \n", "a", "a b", "a a a a a a a", "same " * 500, "日本語" * 30, "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x.i: x.s for x in order_minhash.with_signatures(rows, F.col("text"), "s").collect()}
    assert got == {i: plain_signatures(t) for i, t in enumerate(texts)}


def test_fingerprints_and_edits(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()] + [(-5, None), (-6, "same text"), (-7, "same text"), (None, "no key"), (-6, "same text"), (-8, "x")]
    got = order_minhash.compare_edits(spark.createDataFrame(rows, "doc_id long, text string"))
    out, texts = got.collect(), dict(rows)
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    ids = sorted({i for i, _ in rows} - {None}, reverse=True) + [None]
    follow = dict(zip(ids, ids[1:] + ids[:1], strict=True)) | {-6: -7}
    for i in set(ids) - {-6}:
        text, other = texts[i] or "", texts[follow[i]] or ""
        cut = len(text) // 3
        edit = text[: len(text) - cut] + other[:cut]
        a, b, c = (plain_signatures(t) for t in (text, edit, other))
        near = lambda x, y: float(x == y) if not (x and y) else sum(map(int.__eq__, x, y)) / 64
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x:04x}" for x in s) for s in (a, b))
        assert (r.near_edited, r.near_next) == (near(a, b), near(a, c))
    assert by_id[-6].fingerprint == by_id[-7].fingerprint and sum(r.doc_id == -6 for r in out) == 2


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_next_row_in_blocks(spark, blocks):
    keys = random.Random(2).sample(range(10_000), 300) + [None, None]
    for kind in ("long", "string"):
        rows = spark.createDataFrame([(k if k is None or kind == "long" else f"k{k}", str(k)) for k in keys], f"id {kind}, v string")
        got = order_minhash.with_next(rows, "id", ["v"], "n", blocks).collect()
        want = sorted({r.id for r in got} - {None}, reverse=True)
        following = {r.id: r.n.v for r in got}
        assert len(got) == len(keys) and [following[a] for a in want[:-1]] == [str(b).lstrip("k") for b in want[1:]] and following[want[-1]] == "None"
        assert sorted(r.n.v for r in got if r.id is None) == sorted(["None", str(want[0]).lstrip("k")])
    one = order_minhash.with_next(spark.createDataFrame([(1, "a")], "id long, v string"), "id", ["v"], "n").first()
    assert one.n.v == "a" and order_minhash.with_next(rows.limit(0), "id", ["v"], "n").count() == 0
    assert order_minhash.with_next(rows.where("id IS NULL"), "id", ["v"], "n").count() == 2


def test_order_and_edits_lower_likeness(spark):
    """Few edits leave a text alike, many do not, and the same words in another order less than in the same order."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    few, many = words[:], words[:]
    for i in r.sample(range(900), 9):
        few[i] = "changed"
    for i in r.sample(range(900), 300):
        many[i] = "changed"
    moved = [w for b in random.Random(5).sample(range(30), 30) for w in words[30 * b : 30 * b + 30]]
    docs = spark.createDataFrame(list(enumerate(" ".join(x) for x in (words, few, many, moved))), "i int, text string")
    s = {x.i: x.s for x in order_minhash.with_signatures(docs, F.col("text"), "s").collect()}
    near = [sum(map(int.__eq__, s[0], s[i])) / 64 for i in range(4)]
    assert near[0] == 1 and near[1] > 0.75 and near[2] < 0.3 and 0.15 < near[3] < 0.6 < near[1]


def test_other_columns_do_not_matter(spark):
    """Columns of any inner name change nothing."""
    docs = table(spark, SF, "documents").limit(40)
    odd = ["k", "phrase", "n", "_n", "a", "l", "r", "score", "rank", "_w", "cut", "term", "terms", "held", "once", "by_source", "p", "q", "value", "item", "groups", "total", "key", "own", "next", "edit", "new", "_words", "_items", "_at", "_guest", "at"]
    wide = docs.select("*", *[F.lit(1).alias(c) for c in odd])
    for run in (lambda d: phrases.mine(d, min_count=3), divergence.audit, order_minhash.compare_edits):
        assert sorted(map(repr, run(wide).collect())) == sorted(map(repr, run(docs).collect()))
