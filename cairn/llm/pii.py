"""Personal data: base patterns, then information-theoretic sanitisation of the terms that give protected entities away."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import durable, letter_class, small

KINDS = ("email", "ip", "card", "phone")
_FIND = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # a match that fails from the first digit of a run fails from the others too, so only the first is tried
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: So many terms on either side of an entity are its context, from which candidates for disclosing it come.
WINDOW = 8
#: A term is judged if it stands in a context of an entity in at least this many documents; at 1, every one is.
SUPPORT = 1
#: A term discloses an entity e if PMI(e, term) >= IC(e) / ALPHA. At 1, only a term that never occurs without the entity does;
#: at 1.5, one that tells two thirds of what there is to know about which entity it is.
ALPHA = 1.5
_TERM = re.compile(r"[^\W\d_]{3,}")
_LETTERS = re.compile(letter_class() + "{3,}")
#: Pairs of a term and an entity that it discloses that are sent to the texts as hashes of eight bytes; more are joined.
BROADCAST_PAIRS = 4_000_000
#: Different pairs that a task adds up before it hands them on.
HELD = 300_000


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in found.split("."))
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def _candidates(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """What the kind's pattern matches, leftmost and without overlaps. Emails are only looked for around an at sign: their
    pattern starts with the run of characters that may stand before it, as far left as that run or the last match goes."""
    if kind != "email":
        if kind != "phone" or "+" in text:
            for m in _FIND[kind].finditer(text):
                yield m.span()
        return
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        m = _FIND["email"].match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: kinds in the order of KINDS, then by start. Matches that fail their kind's test are dropped."""
    return [(kind, a, b) for kind in KINDS for a, b in _candidates(kind, text or "") if _holds(kind, text[a:b])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """For each span a digest of its kind and lower-cased text, so that no personal data stands in intermediate tables."""
    return [hashlib.blake2b(f"{kind}:{text[a:b].lower()}".encode(), digest_size=12).hexdigest() for kind, a, b in spans]


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the runs of at least three letters that no span touches, in order; terms are lower-cased."""
    covered: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    out, k = [], 0
    for a, b, term in _words(text):
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k == len(covered) or b <= covered[k][0]:
            out.append((a, b, term.lower()))
    return out


def _words(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of the runs of three letters or more; numbers like ½ are told from letters only where a run has one."""
    for m in _TERM.finditer(text):
        if m[0].isalpha():
            yield (*m.span(), m[0])
        else:
            for x in _LETTERS.finditer(text, *m.span()):
                yield (*x.span(), x[0])


def _distinct(text: str) -> set[str]:
    """The terms of a text without spans."""
    runs = set(_TERM.findall(text))
    odd = {x for x in runs if not x.isalpha()}
    return {x.lower() for x in runs - odd} | {m.lower() for x in odd for m in _LETTERS.findall(x)}


def contexts(text: str, spans: list[tuple[str, int, int]]) -> set[tuple[str, str]]:
    """The pairs of an entity and a term that is among the WINDOW terms before or behind one of its spans."""
    terms, out = terms_of(text, spans), set()
    starts, ends = [t[0] for t in terms], [t[1] for t in terms]
    for (_, a, b), entity in zip(spans, entities(text, spans), strict=True):
        before, behind = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        out.update((entity, t) for _, _, t in terms[max(0, before - WINDOW) : before] + terms[behind : behind + WINDOW])
    return out


def _tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """entity, term, n, near: how many texts hold both, and how many hold the term in a context of the entity; without an entity, how
    many hold the term, and without a term, the entity. Added up in the task, and handed on in parts."""
    terms, pairs, near = Counter(), Counter(), Counter()

    def frame(names: list, n: list, close: list) -> pd.DataFrame:
        return pd.DataFrame({"entity": pd.Series([e for e, _ in names], dtype=object), "term": pd.Series([x for _, x in names], dtype=object), "n": pd.Series(n, dtype="int64"), "near": pd.Series(close, dtype="int64")})

    def flush() -> Iterator[pd.DataFrame]:
        names = [("", x) for x in terms] + list(pairs)
        n, close = [*terms.values(), *pairs.values()], [0] * len(terms) + [near[x] for x in pairs]
        for i in range(0, len(names), 50_000):
            yield frame(names[i : i + 50_000], n[i : i + 50_000], close[i : i + 50_000])
        for c in (terms, pairs, near):
            c.clear()

    for b in batches:
        for t in b["text"]:
            if not t:
                continue
            spans = base_spans(t)
            if not spans:
                terms.update(_distinct(t))
                continue
            own = {x for _, _, x in terms_of(t, spans)}
            terms.update(own)
            for e in set(entities(t, spans)):
                pairs.update((e, x) for x in own)
                pairs[e, ""] += 1
            near.update(contexts(t, spans))
            if len(terms) + len(pairs) > HELD:
                yield from flush()
        if len(terms) + len(pairs) > HELD:
            yield from flush()
    yield from flush()


def pair_hashes(entity: str, terms: list[str]) -> np.ndarray:
    """What xxhash64(entity, term) gives in a plan."""
    seed = xxhash.xxh64_intdigest(entity.encode(), 42)
    return np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in terms], np.uint64).view(np.int64)


def disclosing(docs: DataFrame, text: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """entity, term, pmi, ic of the terms that disclose an entity, from all texts of docs.

    With p(.) the share of documents, PMI(e, t) = log p(e, t) / (p(e) p(t)) and IC(e) = -log p(e); t discloses e if PMI >= IC /
    alpha. Terms that stand in a context of e in support documents are judged; all counts are of whole documents: p(e, t) of those
    that hold e and, anywhere outside spans, t. One pass over the texts counts all of it, term by term and pair by pair.
    """
    texts = docs.select(F.col(text).alias("text"))
    counts = durable(texts.mapInPandas(_tell, "entity string, term string, n long, near long").groupBy("entity", "term").agg(F.sum("n").alias("n"), F.sum("near").alias("near")))
    pairs = counts.where((F.col("entity") != "") & (F.col("term") != "") & (F.col("near") >= support)).select("entity", "term", "n")
    n_e = counts.where((F.col("term") == "") & (F.col("entity") != "")).select("entity", F.col("n").alias("n_e"))
    n_t = counts.where(F.col("entity") == "").select("term", F.col("n").alias("n_t"))
    total = texts.agg(F.count("*").alias("all"))
    ic = -F.log(F.col("n_e") / F.col("all"))
    pmi = F.log(F.col("n") * F.col("all") / (F.col("n_e") * F.col("n_t")))
    return (
        pairs.join(n_e, "entity").join(n_t, "term").crossJoin(F.broadcast(total))  # total is one row
        .withColumn("pmi", pmi).withColumn("ic", ic).where(F.col("pmi") >= F.col("ic") / alpha - 1e-9).select("entity", "term", "pmi", "ic")
    )


FOUND = "base array<struct<kind:string,start:int,end:int>>, terms array<struct<start:int,end:int>>"


def _spans(base, terms) -> dict:
    return {"base": [dict(zip(("kind", "start", "end"), x, strict=True)) for x in base], "terms": [{"start": a, "end": b} for a, b in terms]}


def _found(docs: DataFrame, text: str, **options) -> DataFrame:
    """mine (a struct of all columns of docs), base and terms of every row of docs."""
    broadcast_rows = options.pop("broadcast_rows", BROADCAST_PAIRS)
    strong = durable(disclosing(docs, text, **options).select("entity", "term"))
    rows = docs.select(F.struct(*docs.columns).alias("mine"), F.col(text).alias("text"))
    if small(strong, broadcast_rows):
        told = strong.select(F.xxhash64("entity", "term").alias("h")).toPandas()["h"].to_numpy(np.int64)  # broadcast_rows bounds it
        shared = docs.sparkSession.sparkContext.broadcast(np.unique(told))

        @F.pandas_udf(FOUND)
        def find(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                base, told = base_spans(t), shared.value
                marked = []
                if base and len(told):
                    terms = terms_of(t, base)
                    names = sorted({x for _, _, x in terms})
                    given = set()
                    for e in set(entities(t, base)):
                        own = pair_hashes(e, names)
                        given.update(names[i] for i in np.flatnonzero(told[np.minimum(np.searchsorted(told, own), len(told) - 1)] == own))
                    marked = [(a, b) for a, b, x in terms if x in given]
                out.append(_spans(base, marked))
            return pd.DataFrame(out, columns=["base", "terms"])

        return rows.select("mine", find("text").alias("found")).select("mine", "found.*")

    @F.pandas_udf("entities array<string>, terms array<string>")
    def held(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            base = base_spans(t)
            out.append({"entities": sorted(set(entities(t, base))), "terms": sorted({x for _, _, x in terms_of(t, base)}) if base else []} if base else {"entities": [], "terms": []})
        return pd.DataFrame(out, columns=["entities", "terms"])

    rows = rows.withColumn("held", held("text"))
    none = rows.where(F.size("held.entities") == 0).select("mine", F.from_json(F.lit('{"base": [], "terms": []}'), FOUND).alias("found"))  # without an entity there are no spans
    rows = durable(rows.where(F.size("held.entities") > 0).withColumn("row", F.monotonically_increasing_id()))
    pairs = rows.select("row", F.explode("held.entities").alias("entity"), F.col("held.terms").alias("terms")).select("row", "entity", F.explode("terms").alias("term"))
    told = pairs.join(strong, ["entity", "term"], "left_semi").groupBy("row").agg(F.collect_set("term").alias("told"))

    @F.pandas_udf(FOUND)
    def mark(texts: pd.Series, told: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(texts, told, strict=True):
            base = base_spans(t)
            own = frozenset(own) if own is not None else ()
            out.append(_spans(base, [(a, b) for a, b, x in terms_of(t, base) if x in own] if own else ()))
        return pd.DataFrame(out, columns=["base", "terms"])

    return rows.join(told, "row", "left").select("mine", mark("text", "told").alias("found")).unionByName(none).select("mine", "found.*")


def detect(docs: DataFrame, keep: list[str], text: str = "text", **options) -> DataFrame:
    """The columns in keep, base and terms (spans of kind "term") of every row of docs.

    Null and empty texts have no spans; every occurrence is a span, also in repeated rows; without an entity in any document, or
    in an empty table, there are no terms. A term that discloses an entity is marked wherever it stands in a document that holds
    the entity, outside base spans. Texts are searched whole, in time in proportion to their length. Columns in keep that are
    called base or terms are replaced; other names don't matter.
    """
    mine = [c for c in dict.fromkeys(keep) if c not in ("base", "terms")]
    found = _found(docs.select(*dict.fromkeys([*keep, text])), text, **options)
    return found.select(*[F.col("mine")[c].alias(c) for c in mine], "base", "terms")


def render(found: DataFrame) -> DataFrame:
    """found with the counts of each kind, base_sha256 and spans as text, instead of base and terms."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    show = lambda k, x: F.concat_ws(":", k, x["start"], x["end"])
    base = F.transform("base", lambda x: show(x["kind"], x))
    terms = F.transform("terms", lambda x: show(F.lit("term"), x))
    return (
        found.withColumns({f"n_{k}": n(k) for k in KINDS}).withColumn("base_sha256", F.sha2(F.array_join(base, ","), 256))
        .withColumn("spans", F.array_join(F.concat(base, terms), ",")).withColumn("n_term", F.size("terms").cast("long")).drop("base", "terms")
    )


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every base span in text generalised to its kind in brackets, and every disclosing term removed ("[term]").

    Overlapping spans are replaced as one, under the first one's kind; null texts stay null; other columns stay as they are,
    whatever their names; repeated rows are rewritten alike, and an empty table stays empty.
    """

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is None or not s:
                out.append(t)
                continue
            done, parts = 0, []
            for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in s.split(","))):
                if a >= done:
                    parts += [t[done:a], f"[{kind}]"]
                done = max(done, b)
            out.append("".join(parts) + t[done:])
        return pd.Series(out, dtype=object)

    found = render(_found(docs, text, **options))
    return found.select(*[rewrite(F.col("mine")[c], F.col("spans")).alias(c) if c == text else F.col("mine")[c].alias(c) for c in docs.columns])
