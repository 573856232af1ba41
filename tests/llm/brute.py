"""Plain versions of operators, to test against."""

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(texts, percent=85):
    """texts: doc_id -> text. doc_id -> smallest doc_id reachable, by comparing all sets that share a shingle."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in holders[s]).items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if _valid(k, m[0])]


def quality_counts(text):
    text = text or ""
    w, lines = words(text), text.split("\n")
    three, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def _statistics(text):
    n, chars, symbols, dup, repeat = quality_counts(text)
    lines = text.count("\n") + 1 if text else 0
    return np.array([np.log(1 + n), np.log((1 + chars) / (1 + n)), symbols / (1 + chars), dup / (1 + lines), repeat / (1 + n)])


def _least_determinant(x, share, factor, floors):
    """(n, center, scatter) of the rows of x, by concentration from four starts."""
    low = lambda v: np.sort(v, axis=0)[-(-len(v) // 2) - 1]
    c = low(x)
    s = np.sqrt((1.4826 * low(np.abs(x - c))) ** 2 + floors**2)
    z, p = (x - c) / s, x.shape[1]
    t, r = np.tanh(z), (z**2).sum(1)
    cov = lambda v: v.T @ v / len(v) - np.outer(v.mean(0), v.mean(0))
    unit = z[r > 0] / np.sqrt(r[r > 0])[:, None]
    shapes = {"classical": cov(z) + 0.05 * np.eye(p), "diagonal": np.eye(p), "signs": p * (unit.T @ unit) / len(z) + 0.05 * np.eye(p), "tanh": cov(t) + 0.05 * np.eye(p)}

    def step(center, scatter):
        d = x - center
        bins = np.floor(np.log(np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d) + 1e-6) * 64)
        order = np.sort(bins)
        near = x[bins <= order[-(-int(np.ceil(share * len(x) * 1e9)) // 10**9) - 1]]
        return near.mean(0), factor * cov(near) + np.diag(floors**2)

    trials = []
    for name, shape in shapes.items():
        now = (c + s * z.mean(0) if name == "classical" else c), shape * np.outer(s, s)
        for _ in range(2):
            now = step(*now)
        trials.append((np.linalg.slogdet(now[1])[1], name, now))
    det, _, now = min(trials, key=lambda e: e[:2])
    while True:
        then = step(*now)
        new = np.linalg.slogdet(then[1])[1]
        if det - new <= 1e-6:
            return len(x), *now
        det, now = new, then


def quality_distances(docs):
    """doc_id -> squared distance, None for documents that fail the base rules."""
    from cairn.llm import quality

    floors, share = np.array(quality.FLOORS), quality.SHARE
    factor = share / quality.chi2_cdf(quality.chi2_quantile(share, quality.P), quality.P + 2)
    counts = {d["doc_id"]: quality_counts(d["text"]) for d in docs}
    fair = [d for d in docs if counts[d["doc_id"]][0] >= 50 and 100 * counts[d["doc_id"]][4] <= 50 * counts[d["doc_id"]][0]]
    x = {d["doc_id"]: _statistics(d["text"]) for d in fair}
    held = defaultdict(list)
    for d in fair:
        for key in ((), (d["lang"],), (d["lang"], d["source"])):
            held[key].append(x[d["doc_id"]])
    found = {k: _least_determinant(np.array(v), share, factor, floors) for k, v in held.items()}
    out = dict.fromkeys(counts)
    for d in fair:
        _, center, scatter = found[()]
        for key in ((d["lang"],), (d["lang"], d["source"])):
            n, m, c = found[key]
            w = n / (n + quality.SHRINK)
            center, scatter = w * m + (1 - w) * center, w * c + (1 - w) * scatter
        off = x[d["doc_id"]] - center
        out[d["doc_id"]] = float(off @ np.linalg.inv(scatter) @ off)
    return out


def diagonal_overlaps(docs, items):
    """(document, item) -> most words on one diagonal, where that is 80 % of the item, or 60 % and 13 words; of word arrays."""
    out = {}
    for i, own in items.items():
        for d, words in docs.items():
            places = defaultdict(list)
            for at in np.flatnonzero(np.isin(words, own)).tolist():
                places[int(words[at])].append(at)
            counts = Counter(at - k for k, w in enumerate(own.tolist()) for at in places.get(w, ()))
            most = max(counts.values(), default=0)
            if len(own) >= 5 and (most >= 0.8 * len(own) or most >= max(13, 0.6 * len(own))):
                out[d, i] = most
    return out


def in_order(item, words):
    """The longest common subsequence."""
    row = [0] * (len(words) + 1)
    for x in item:
        new = [0]
        for j, w in enumerate(words):
            new.append(row[j] + 1 if w == x else max(row[j + 1], new[-1]))
        row = new
    return row[-1]
