"""Toxicity: a noisy channel restores disguised words, then a linear model scores the restored text."""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import durable

#: Labelled texts of either class that training may read at most, in expectation; chosen by a hash of doc_id, whole texts.
TRAIN_TEXTS = 2_000
#: Features are whole words and beginnings of words of so many characters.
PREFIXES = range(3, 9)
#: A feature stands in at least this many toxic training texts, and this many times as often as in the others.
SUPPORT, LIFT = 4, 8.0
#: Features that the model may have, and how many each toxic training text should hold, where it can. The first are chosen as
#: long as they explain SUPPORT more texts, further ones as long as they explain this share of all toxic texts.
FEATURES, COVER, COVER_SHARE = 4_000, 3, 0.02
#: Toxic texts that a feature must explain for each other text that has it, were there as many of both.
PENALTY = 3.0
#: Beyond those, what this share of toxic texts holds, and holds so many times as often as others do, is a feature.
COMMON_SHARE, COMMON_LIFT = 0.05, 30.0
#: What a disguising character may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
#: What may be put between the letters of a word.
GAPS = " .-_*"
#: Steps of a lattice that are decoded behind the last one that a feature reaches; what follows cannot change how that is read.
BEHIND = 64
#: Sequences of two and of three characters that the character model holds, each: the most frequent ones, if there are more.
#: Single characters are all held, so nothing that any text has is unknown.
GRAMS = 300_000


class CharModel:
    """Log probabilities of a character after the two before it, with backing off by interpolation; "^" starts a word, "$" ends it.

    Sequences are kept as arrays, which are small to hold and to send; a worker makes its dictionary when it first needs it.
    """

    def __init__(self, grams: Sequence[str] = (), logs: Sequence[float] = (), floor: float = -12.0):
        self.grams, self.logs, self.floor, self._table = np.array(grams, dtype="U3"), np.array(logs, np.float32), floor, None

    @classmethod
    def learn(cls, n1: Counter, n2: Counter, n3: Counter) -> CharModel:
        """From how often a character, two and three of them stand in words, the last of them behind what "^^" begins (see trigrams).

        What follows a context is counted by the context itself: all but "$" is followed by something, and "^" by each word.
        """
        total, words = max(sum(n1.values()), 1), n1["$"]
        one = {x: k / total for x, k in n1.items()}
        two = {x: 0.8 * k / (words if x[0] == "^" else n1[x[0]]) + 0.2 * one[x[1]] for x, k in n2.items()}
        three = {x: 0.8 * k / (words if x[:2] == "^^" else n2[x[:2]]) + 0.2 * two[x[1:]] for x, k in n3.items() if x[1:] in two and (x[:2] == "^^" or x[:2] in n2)}
        grams = [*three, *two, *one]
        share = np.repeat([1.0, 0.2, 0.04], [len(three), len(two), len(one)])
        return cls(grams, np.log(share * np.array([*three.values(), *two.values(), *one.values()])) if grams else ())

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def __contains__(self, gram: str) -> bool:
        return gram in self.table()

    def table(self) -> dict[str, float]:
        if self._table is None:
            self._table = dict(zip(self.grams.tolist(), self.logs.tolist(), strict=True))
        return self._table

    def after(self, a: str, b: str, c: str) -> float:
        table = self.table()
        got = table.get(a + b + c)
        if got is None:
            got = table.get(b + c)
        if got is None:
            got = table.get(c, self.floor)
        return got


def lattice(text: str) -> list[list[str]]:
    """What each step of a stretch of text may have been: readings of a character, one or two for a repeated one, and nothing, or
    the end of a word and the start of the next, for a run of gaps."""
    out, i = [], 0
    while i < len(text):
        c, j = text[i], i + 1
        if c in GAPS:
            while j < len(text) and text[j] in GAPS:
                j += 1
            out.append(["", "$^"])
        else:
            while j < len(text) and text[j] == c:
                j += 1
            reads = [*LEET.get(c, ""), c]
            out.append(reads if j - i == 1 else [r + r for r in reads] + reads if j - i == 2 else reads + [r + r for r in reads])
        i = j
    return out


#: Log costs of the channel: reading a disguise as itself though it stands in a word, a repetition as two letters, two letters as
#: one, and a gap as put into a word.
KEEP_COST, DOUBLE_COST, SINGLE_COST, GAP_COST = 3.0, 0.7, 2.0, 5.0


def decode(text: str, model: CharModel) -> str:
    """The likeliest text behind a stretch, by Viterbi's algorithm over its lattice: states are the two characters before a step."""
    states: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
    for reads in [*lattice(text), ["$"]]:
        new: dict[tuple[str, str], tuple[float, str]] = {}
        pair = len(reads[0]) == 2 and reads[0] != "$^"  # two letters as written
        for (a, b), (score, done) in states.items():
            for r in reads:
                s, x, y = score, a, b
                if not r:
                    s -= GAP_COST
                elif r[0] in LEET:
                    s -= KEEP_COST
                if len(r) == 2 and r[0] == r[1] and not pair:
                    s -= DOUBLE_COST
                elif len(r) == 1 and pair:
                    s -= SINGLE_COST
                for c in r:
                    if c != "^":
                        s += model.after(x, y, c)
                    x, y = (("^", "^") if c == "^" else (y, c))
                k = (x, y)
                if k not in new or s > new[k][0]:
                    new[k] = (s, done + r.replace("$^", " "))
        states = new
    return max(states.values())[1].removesuffix("$")


_EDGES = str.maketrans({c: " " for c in "\t\n\r\x0b\x0c.,;:!?\"'()[]{}<>#*%&/\\=~`^|_-"})


@functools.cache
def _spacing() -> np.ndarray:
    """For every character itself, or a space for what stands at the edges of words."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[list(_EDGES)] = 32
    return out


def _spaced(points: np.ndarray) -> str:
    """The text of points as translate(_EDGES) gives it, by a table, which is several times as fast."""
    return _spacing()[points].tobytes().decode("utf-32-le", "surrogatepass")


@functools.cache
def _classes() -> np.ndarray:
    """For every character the number of the class that all its readings are in, 1 for gaps, and 0 for what no word reaches over."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalnum():
            out[c] = c
    for c, reads in LEET.items():
        out[ord(c)] = ord(reads[0])
    out[[ord("l"), ord("|")]] = ord("i")  # 1 is read as either
    out[[ord(c) for c in GAPS]] = 1
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def _leet_points() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in LEET]] = True
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


class Gate:
    """Where a text may hold a feature in disguise.

    All readings of a lattice's step are in one class, gaps may be read as nothing, and a repetition as one letter or two. So the
    classes of a text, without gaps and repetitions, are the same whatever is read, and a text can only be read as holding a
    feature where its classes hold the feature's, from the start of a word on. Nothing else needs to be decoded.
    """

    def __init__(self, features: list[str]):
        begin, whole = defaultdict(set), defaultdict(set)  # by number of classes: hashes of features' beginnings, and of features
        for f in features:
            c = _classes()[_points(f.strip())]
            c = c[c > 1]
            h = 1
            own = c[np.append(True, c[1:] != c[:-1])].tolist() if len(c) else []
            for k, x in enumerate(own, 1):
                h = (h * int(_ODD) + x) & 0xFFFFFFFFFFFFFFFF
                begin[k].add(h)
            whole[len(own)].add(h)
        array = lambda d: {k: np.array(sorted(h), np.uint64) for k, h in d.items() if k}
        self.begin, self.whole = array(begin), array(whole)

    def stretches(self, low: str, points: np.ndarray | None = None) -> Iterator[str]:
        """The distinct stretches of a lower-cased text (of these points) that some path reads as holding a feature, and that hold
        a disguising character, a repetition or a gap where it does."""
        points = _points(low) if points is None else points
        c = _classes()[points]
        at = np.flatnonzero(c != 1)  # all but gaps
        if not len(at) or not self.begin:
            return
        c = c[at]
        run = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (c[1:] == 0)))  # where a class other than the one before begins
        classes = np.append(c[run], np.zeros(len(self.begin), np.uint32)).astype(np.uint64)
        begins = (c > 0) & np.append(True, (np.diff(at) > 1) | (c[:-1] == 0))  # a word begins here
        size = np.diff(np.append(run, len(c)))
        odd = np.append(0, np.cumsum(np.logical_or.reduceat(_leet_points()[points[at]], run) | (size > 1)))
        gaps = np.append(0, np.cumsum(np.append(False, np.diff(at[run]) != np.diff(run))))  # a gap before a run, or in the one before
        start = np.flatnonzero(np.logical_or.reduceat(begins, run))
        h, seen = np.ones(len(start), np.uint64), set()
        for k in range(1, len(self.begin) + 1):
            h = h * _ODD + classes[start + k - 1]
            alive = _among(h, self.begin[k])
            start, h = start[alive], h[alive]
            if not len(start):
                return
            if k in self.whole:
                hit = start[_among(h, self.whole[k])]
                for i in hit[(odd[hit + k] > odd[hit]) | (gaps[hit + k] > gaps[hit + 1])].tolist():
                    first = int(run[i])
                    a = int(at[first + int(np.argmax(begins[first : first + size[i]]))])
                    last = int(run[i + k - 1] + size[i + k - 1]) - 1
                    stretch = low[a : _word_end(low, int(at[last]) + 1)].rstrip("!|+" + GAPS)
                    if stretch and stretch not in seen:
                        seen.add(stretch)
                        yield stretch


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are in known, which is sorted."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _word_end(text: str, at: int) -> int:
    """The end of the word that goes on at a place, BEHIND steps of its lattice further at most."""
    left, before = BEHIND, text[at - 1]
    while at < len(text) and text[at] not in GAPS and _classes()[ord(text[at])]:
        if text[at] != before:
            left, before = left - 1, text[at]
            if not left:
                break
        at += 1
    return at


@dataclass
class Model:
    features: list[str]  # with a space before a word's beginning, and one behind a whole word
    weights: np.ndarray
    bias: float
    chars: CharModel
    machine: object = None
    gate: Gate | None = None
    decoded: dict[str, str] = field(default_factory=dict)

    def restore(self, stretch: str) -> str:
        """decode(), with the latest stretches kept."""
        got = self.decoded.get(stretch)
        if got is None:
            if len(self.decoded) > 50_000:
                self.decoded.clear()
            got = self.decoded[stretch] = decode(stretch, self.chars)
        return got

    def find(self, text: str | None) -> Counter:
        """How often a text holds each feature, in itself and where it is restored."""
        if not text or not self.features:
            return Counter()
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for i, f in enumerate(self.features):
                self.machine.add_word(f, i)
            self.machine.make_automaton()
            self.gate = Gate(self.features)
        low = text.lower()
        points = _points(low)
        plain = f" {_spaced(points)} "
        restored = []
        for stretch in self.gate.stretches(low, points):
            got = self.restore(stretch)
            if got.split() != stretch.translate(_EDGES).split():  # else it is in the text as written
                restored.append(got)
        if restored:
            plain += f"  {'  '.join(restored)} "
        return Counter(i for _, i in self.machine.iter(plain))

    def score(self, text: str | None) -> float:
        z = self.bias + sum(float(self.weights[i]) * math.log1p(n) for i, n in sorted(self.find(text).items()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def word_counts(text: str | None) -> Counter:
    return Counter(_spaced(_points((text or "").lower())).split())


#: Longer runs of letters are no words, and the character model does not learn from them.
LONGEST_WORD = 64


def trigrams(words: Counter) -> Counter:
    """How often each three characters stand in words of letters, with "^^" before each word and "$" behind it."""
    out = Counter()
    for w, k in words.items():
        if w.isalpha() and len(w) <= LONGEST_WORD:
            s = f"^^{w}$"
            for i in range(len(s) - 2):
                out[s[i : i + 3]] += k
    return out


def _shorter(n3: Counter, size: int) -> Counter:
    """How often the last characters of trigrams stand in words."""
    out = Counter()
    for x, k in n3.items():
        out[x[3 - size :]] += k
    return out


def _parts(word: str) -> list[str]:
    return [f" {word[:k]}" for k in PREFIXES if k <= len(word)] + [f" {word} "]


class Texts(Sequence):
    """Training texts: the distinct words of each, held as one string, and how often it has them."""

    def __init__(self, words: list[str], counts: list[Sequence[int]]):
        self.words, self.counts = words, counts

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, i: int) -> tuple[list[str], Sequence[int]]:
        return self.words[i].split(), self.counts[i]


def fit(texts: Sequence[tuple[Sequence[str], Sequence[int]]], toxic: np.ndarray, grams: tuple[int, Counter, Counter, Counter] | None = None) -> Model:
    """A model from the distinct words of training texts, how often each has them, and the texts' labels.

    grams: what the character model learns from, as count_grams gives it for a corpus; by default that of the training texts.
    """
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    c1, c0 = Counter(), Counter()
    for (words, _), y in zip(texts, toxic, strict=True):
        if y:
            c1.update({p for w in words for p in _parts(w)})
    wanted = {f for f, k in c1.items() if k >= SUPPORT}
    among = _kept_parts(wanted)
    for (words, _), y in zip(texts, toxic, strict=True):
        if not y:
            c0.update({p for w in words for p in among(w)})
    ratio = {f: (c1[f] + 0.5) / (n1 + 1) / ((c0[f] + 0.5) / (n0 + 1)) for f in wanted}
    telling = _kept_parts({f for f in wanted if ratio[f] >= LIFT})
    chosen = _cover([{p for w in words for p in telling(w)} for (words, _), y in zip(texts, toxic, strict=True) if y], {f: PENALTY * c0[f] * n1 / n0 for f in wanted})
    for f in sorted((f for f in wanted if c1[f] >= max(SUPPORT, COMMON_SHARE * n1) and ratio[f] >= COMMON_LIFT), key=lambda f: (-c1[f], -len(f), f)):
        if len(chosen) < FEATURES and not any(_alike(f, g) for g in chosen):
            chosen.append(f)
    number = {f: i for i, f in enumerate(chosen)}
    own_parts = _kept_parts(number)
    rows = []
    for own, counts in texts:
        held = Counter()
        for w, k in zip(own, counts, strict=True):
            for p in own_parts(w):
                held[number[p]] += int(k)
        rows.append(held)
    weights, bias = _logistic(rows, toxic.astype(float), len(chosen))
    # the language model of what disguises hide: the corpus' words, and the words that give toxic texts away many times over
    strong = {f for f in chosen if weights[number[f]] > 0.1}
    words = Counter()
    for (own, _), y in zip(texts, toxic, strict=True):
        if y:
            words.update(w for w in own if any(p in strong for p in own_parts(w)))
    if grams is None:
        n3 = trigrams(Counter(w for own, _ in texts for w in own))
        grams = len(texts), _shorter(n3, 1), _shorter(n3, 2), n3
    size, *counts = grams
    more = trigrams(words)
    for k, n in enumerate(counts, 1):
        for x, c in _shorter(more, k).items():  # they weigh as much in a corpus as in the training texts
            n[x] += 50 * c * max(size, len(texts)) // len(texts)
    return Model(chosen, weights, bias, CharModel.learn(*counts))


def _kept_parts(wanted):
    """A function from a word to its parts that are wanted, which remembers the words it has seen."""
    seen: dict[str, tuple[str, ...]] = {}

    def parts(word: str) -> tuple[str, ...]:
        got = seen.get(word)
        if got is None:
            got = seen[word] = tuple(p for p in _parts(word) if p in wanted)
        return got

    return parts


def _alike(f: str, g: str) -> bool:
    """Whether one of two features is the beginning of the other."""
    return f.startswith(g.rstrip()) or g.startswith(f.rstrip())


def _cover(texts: list[set[str]], cost: dict[str, float]) -> list[str]:
    """Features that explain the toxic texts: in turn the one that most texts still lack, less its cost; of equal ones the longest.

    A feature that begins like a chosen one, or is the beginning of one, is not chosen, so that chance companions of the words
    that make texts toxic, such as other words of much copied texts, stay out of the model. What a feature explains only ever
    shrinks, so a heap of old values finds the best one without looking at all of them.
    """
    holders = defaultdict(list)
    for i, t in enumerate(texts):
        for f in t:
            holders[f].append(i)
    holders = {f: np.array(h) for f, h in holders.items() if len(h) >= SUPPORT}
    chosen: list[str] = []
    for level in range(1, COVER + 1):
        need = SUPPORT if level == 1 else max(SUPPORT, COVER_SHARE * len(texts))
        lacking = np.array([sum(f in t for f in chosen) < level for t in texts], float)
        worth = lambda f: float(lacking[holders[f]].sum()) - cost[f]  # noqa: B023, E731
        heap = [(-worth(f), -len(f), f) for f in holders if not any(_alike(f, g) for g in chosen)]
        heapq.heapify(heap)
        while heap and len(chosen) < FEATURES:
            _, size, f = heapq.heappop(heap)
            now = worth(f)
            if now < need or any(_alike(f, g) for g in chosen):
                continue
            if heap and (-now, size, f) > heap[0]:
                heapq.heappush(heap, (-now, size, f))
                continue
            chosen.append(f)
            lacking[holders[f]] = 0
    return chosen


#: The log odds of a text without any feature. They are given, not learned: the many texts without features would drive them down
#: until one feature, once, no longer outweighs them.
PRIOR = -2.0


def _logistic(rows: list[Counter], y: np.ndarray, n: int, steps: int = 4000, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on the logarithms of one plus the features' counts, with weights of at least 0, both classes
    weighing alike; by gradient steps that adapt to each weight."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([i for r in rows for i in r], int)
    v = np.log1p(np.array([k for r in rows for k in r.values()], float))
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, seen = np.zeros(n), np.full(n, 1e-8)
    for _ in range(steps):
        z = PRIOR + np.bincount(owner, w[at] * v, len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        g = np.bincount(at, e[owner] * v, n) + l2 * w / max(n, 1)
        seen += g * g
        w = np.maximum(w - 0.5 * g / np.sqrt(seen), 0)
    return w, PRIOR


def count_grams(texts: DataFrame, grams: int = GRAMS) -> tuple[int, Counter, Counter, Counter]:
    """The number of rows of texts (text), and in how many of them single characters, two and three of them stand in each word.

    A distributed sum over all rows: only its result comes to the driver, of sequences of two and three at most so many each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, rows = Counter(), 0  # of a task: its distinct words are far fewer than those of its texts
        for batch in batches:
            rows += len(batch)
            for x in batch["text"]:
                words.update(set(_spaced(_points((x or "").lower())).split()))
            if len(words) > 200_000:
                yield frame(words, rows)
                words, rows = Counter(), 0
        yield frame(words, rows)

    def frame(words: Counter, rows: int) -> pd.DataFrame:
        got = trigrams(words)
        got[""] = rows
        return pd.DataFrame({"gram": list(got), "n": pd.Series(list(got.values()), dtype="int64")})

    n3 = durable(texts.mapInPandas(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    size = n3.where("gram = ''").agg(F.sum("n")).first()[0] or 0
    n3 = n3.where("gram <> ''")
    out = []
    for k in (1, 2, 3):
        n = n3.groupBy(F.substring("gram", 4 - k, k).alias("gram")).agg(F.sum("n").alias("n")) if k < 3 else n3
        n = n.orderBy(F.desc("n"), "gram").limit(grams) if k > 1 else n  # Unicode bounds single characters
        got = n.toPandas()
        out.append(Counter(dict(zip(got["gram"].tolist(), got["n"].tolist(), strict=True))))
    return size, *out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = TRAIN_TEXTS) -> Model:
    """A model from the rows of docs that labels calls toxic (1) or not (0), about per_class whole texts of either at most.

    Rows without a label take no part in the classifier. A hash of the key alone chooses among more. The character model counts
    all rows of docs, labelled or not. What reaches the driver is the distinct words of the chosen texts and the bounded table of
    count_grams. Without labels of either class the model finds nothing and scores every text alike.
    """
    own = labels.select(F.col(key).alias("_key"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").distinct()
    size = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model([], np.zeros(0), PRIOR, CharModel())
    unit = F.pmod(F.xxhash64(F.col("_key").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = own.where(unit < F.when(F.col("toxic") == 1, F.lit(per_class / size[1])).otherwise(F.lit(per_class / size[0])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [word_counts(x) for x in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "key": batch["_key"].astype(str), "words": [" ".join(c) for c in counts], "n": [list(c.values()) for c in counts]})

    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    # about 2 * per_class rows of two integers: bounded by the parameter
    got = texts.join(F.broadcast(chosen), "_key").mapInPandas(run, "toxic int, key string, words string, n array<int>").toPandas().sort_values(["key", "toxic"])
    return fit(Texts(got["words"].tolist(), got["n"].tolist()), got["toxic"].to_numpy(), count_grams(docs.select(F.col(text).alias("text"))))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score, from 0 to 1, of every text in a column that replaces one of that name; other names don't matter.

    A null text counts as empty and gets the score of a text without features. Texts are searched whole, in time in proportion to
    their length; what is decoded is the stretches that may hold a feature. Equal texts score alike, so repeated rows do; of
    readings equally likely the alphabetically last is taken. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES and the character model's alphabet bound its size

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.withColumn(name, run(F.col(text)))
