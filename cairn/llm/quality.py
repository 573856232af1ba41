"""Quality rules: base rules on each text, then robust multivariate outliers per language and source.

The estimates are minimum covariance determinants (Rousseeuw and Van Driessen 1999) from deterministic starts (Hubert, Rousseeuw
and Verdonck 2012), with a fixed diagonal added to every scatter (after Boudt and others 2020).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, durable, mix64, small, word_hashes

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The share of a group that the determinant is minimised over, and the tail of chi-square beyond which a document is an outlier.
SHARE, TAIL = 0.75, 1e-4
#: A group's estimate is drawn towards that of its language as if so many documents more had been seen, and a language's towards
#: that of all documents. So small groups are judged too, and nothing changes at any size.
SHRINK = 50
#: Concentration steps from every start, after which a group goes on from the one with the least determinant; steps at most; and
#: the fall of the logarithm of the determinant that ends them.
TRIAL_STEPS, MOST_STEPS, FALL = 2, 30, 1e-6
#: Counts of distances are kept in so many bins for each factor of e.
BINS = 64


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = word_hashes(text.encode())
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for x in lines:
            if x in seen:
                dup += bool(x.strip(" \t\r\x0b\x0c"))
            seen.add(x)
    repeat = 0
    if n > 3:
        odd = np.uint64(0x9DDFEA08EB382D69)
        three = mix64(mix64(words[:-2] * odd + words[1:-1]) * odd + words[2:])
        _, back, count = np.unique(three, return_inverse=True, return_counts=True)
        if len(count) < n - 2:
            at = np.flatnonzero(count[back] > 1)
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[at + j] = True
            repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


def measure(text: Column) -> Column:
    """A struct of the base counts and n_lines of a whole text; all 0 for null."""

    @F.pandas_udf(", ".join(f"{c} long" for c in [*BASE, "n_lines"]))
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.array([base_counts(x) for x in texts], np.int64).reshape(-1, 5), columns=BASE)
        out["n_lines"] = [x.count("\n") + 1 if x else 0 for x in texts]
        return out

    return run(text)


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square's distribution function with k (odd) degrees of freedom."""
    p, j = math.erf(math.sqrt(x / 2)), 1
    while j < k:
        p, j = p - (x / 2) ** (j / 2) * math.exp(-x / 2) / math.gamma(j / 2 + 1), j + 2
    return p


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = (mid, high) if chi2_cdf(mid := (low + high) / 2, k) < p else (low, mid)
    return high


#: Transformed statistics: log length, log mean word length, and shares of symbols, repeated lines and repeated words.
STATISTICS = {
    "x0": "ln(1 + n_words)", "x1": "ln((1 + word_chars) / (1 + n_words))", "x2": "n_symbols / (1 + word_chars)",
    "x3": "n_dup_lines / (1 + n_lines)", "x4": "n_repeat_words / (1 + n_words)",
}
P = len(STATISTICS)
#: Standard deviations that are added to each statistic's: most texts of a source have none of some flaws at all, and without
#: these any trace of one would be infinitely far away. A symbol for every ten letters is five of these.
FLOORS = (0.3, 0.1, 0.02, 0.1, 0.1)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


_SUMS = [*[f"m{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _PAIRS]]
ESTIMATE = "cell string, start string, n long, center array<double>, scatter array<double>, inverse array<double>, logdet double"


def _distance(center: str = "center", inverse: str = "inverse") -> Column:
    """The squared Mahalanobis distance of x0.. from the group's center."""
    d = [F.col(f"x{i}") - F.col(center)[i] for i in range(P)]
    return sum(((1 if i == j else 2) * F.col(inverse)[i * P + j] * d[i] * d[j] for i, j in _PAIRS), F.lit(0.0))


def _square(row, prefix: str) -> np.ndarray:
    c = np.zeros((P, P))
    for i, j in _PAIRS:
        c[i, j] = c[j, i] = getattr(row, f"{prefix}{i}{j}")
    return c


def _estimate(cell, start, n: int, center: np.ndarray, scatter: np.ndarray) -> tuple:
    return cell, start, int(n), center.tolist(), scatter.ravel().tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])


_COLUMNS = ["cell", "start", "n", "center", "scatter", "inverse", "logdet"]


def starts(rows: DataFrame, joined) -> DataFrame:
    """ESTIMATE: four starts for each cell of rows (cell, x0..), from medians and median deviations, and sums over scaled values.

    "diagonal" takes only the scales; "classical" the means and covariance of all rows; "tanh" the covariance of the scaled
    values' hyperbolic tangents; "signs" that of their directions.
    """
    median = durable(rows.groupBy("cell").agg(*[F.percentile_approx(f"x{i}", 0.5).alias(f"c{i}") for i in range(P)]))
    off = rows.join(joined(median), "cell")
    spread = durable(off.groupBy("cell").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(P)], *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5).alias(f"s{i}") for i in range(P)]))
    scale = lambda i: F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[i] ** 2)
    z = rows.join(joined(spread), "cell").withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"c{i}")) / scale(i) for i in range(P)})
    z = z.withColumns({"r": sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)), **{f"t{i}": F.tanh(f"z{i}") for i in range(P)}})
    both = lambda a, i, j: F.col(f"{a}{i}") * F.col(f"{a}{j}")
    sums = z.groupBy("cell").agg(
        F.count("*").alias("n"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(P)], *[F.first(scale(i)).alias(f"s{i}") for i in range(P)],
        *[F.avg(f"{a}{i}").alias(f"{a}{i}") for a in "zt" for i in range(P)], *[F.avg(both(a, i, j)).alias(f"{a}{a}{i}{j}") for a in "zt" for i, j in _PAIRS],
        *[F.avg(F.when(F.col("r") > 0, both("z", i, j) / F.col("r")).otherwise(0.0)).alias(f"g{i}{j}") for i, j in _PAIRS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                of = lambda a: np.array([getattr(r, f"{a}{i}") for i in range(P)])  # noqa: B023, E731
                c, s, least = of("c"), of("s"), 0.05 * np.eye(P)
                shapes = {"diagonal": np.eye(P), "classical": _square(r, "zz") - np.outer(of("z"), of("z")) + least, "tanh": _square(r, "tt") - np.outer(of("t"), of("t")) + least, "signs": P * _square(r, "g") + least}
                out += [_estimate(r.cell, name, r.n, c + s * of("z") if name == "classical" else c, shape * np.outer(s, s)) for name, shape in shapes.items()]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return sums.mapInPandas(run, ESTIMATE)


def concentrate(rows: DataFrame, now: DataFrame, share: float, joined) -> DataFrame:
    """ESTIMATE after a concentration step: the mean and scatter of the share of each cell that is nearest to the estimate in now.

    Rows are added up by bins of their distance, where they are, and the nearest bins are taken until they hold the share: one
    pass, in which no row is moved, and a cell of any size is spread over all tasks.
    """
    factor = share / chi2_cdf(chi2_quantile(share, P), P + 2)  # makes the scatter of the nearest consistent for normal data
    binned = rows.join(joined(now), "cell").withColumn("bin", F.floor(F.log(_distance() + F.lit(1e-6)) * BINS))
    sums = binned.groupBy("cell", "start", "bin").agg(F.count("*").alias("k"), *[F.sum(f"x{i}").alias(f"m{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS])
    by = W.partitionBy("cell", "start")
    nearer = F.coalesce(F.sum("k").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("nearer", nearer).withColumn("n", F.sum("k").over(by)).where(F.col("nearer") < share * F.col("n"))
    total = near.groupBy("cell", "start").agg(F.first("n").alias("n"), F.sum("k").alias("k"), *[F.sum(c).alias(c) for c in _SUMS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = np.array([getattr(r, f"m{i}") for i in range(P)]) / r.k
                out.append(_estimate(r.cell, r.start, r.n, m, factor * (_square(r, "q") / r.k - np.outer(m, m)) + np.diag(np.square(FLOORS))))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return total.mapInPandas(run, ESTIMATE)


def fit(rows: DataFrame, share: float = SHARE, few: bool = False) -> DataFrame:
    """ESTIMATE: the minimum covariance determinant of each cell of rows (cell, x0..). few: whether a row a cell may be broadcast.

    Every start makes TRIAL_STEPS concentration steps; the one with the least determinant goes on until no cell's determinant
    falls any more. Of equal determinants the start that comes first by name is taken. All rows take part in every step.
    """
    joined = F.broadcast if few else (lambda t: t)
    now = durable(starts(rows, joined))
    for _ in range(TRIAL_STEPS):
        now = durable(concentrate(rows, now, share, joined))
    best = F.min_by(F.struct(*_COLUMNS[1:]), F.struct("logdet", "start")).alias("best")
    now = durable(now.groupBy("cell").agg(best).select("cell", "best.*"))
    for _ in range(MOST_STEPS - TRIAL_STEPS):
        then = durable(concentrate(rows, now, share, joined))
        both = now.join(joined(then.select("cell", F.col("logdet").alias("new"))), "cell")
        if both.where(F.col("logdet") - F.col("new") > FALL).isEmpty():
            break
        now = durable(now.unionByName(then).groupBy("cell").agg(best).select("cell", "best.*"))
    return now


def shrunk(groups: DataFrame, found: DataFrame, shrink: int = SHRINK) -> DataFrame:
    """cell, center, inverse: each cell of groups (cell, wider, widest) drawn towards its wider cells, from what fit() found."""
    of = lambda k: found.select(F.col("cell").alias(k), F.struct("n", "center", "scatter").alias(f"_{k}"))
    all3 = groups.join(of("cell"), "cell").join(of("wider"), "wider").join(of("widest"), "widest").select("cell", *[F.col(f"_{k}").alias(k) for k in ("widest", "wider")], F.col("_cell").alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                center, scatter = (np.array(r.widest[k]) for k in ("center", "scatter"))
                for level in (r.wider, r.own):
                    w = level["n"] / (level["n"] + shrink)
                    center, scatter = (w * np.array(level[k]) + (1 - w) * x for k, x in (("center", center), ("scatter", scatter)))
                out.append((r.cell, center.tolist(), np.linalg.inv(scatter.reshape(P, P)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["cell", "center", "inverse"])

    return all3.mapInPandas(run, "cell string, center array<double>, inverse array<double>")


def judge(docs: DataFrame, keep: list[str], tail: float = TAIL, shrink: int = SHRINK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The columns in keep (of docs, which have text, lang and source), the base counts, base_failed, distance and kept.

    Rows that fail the base rules are rejected and take no part in the estimates; their distance is null. Of the others a row is
    rejected if its squared distance from its language and source, in distance, is beyond the chi-square quantile of 1 - tail.
    Every language and source is estimated from all its rows, and drawn towards its language, and that towards all documents, the
    more the fewer rows it has; none is left out. Null languages and sources are groups of their own. A null or empty text has no
    words and fails the base rules; texts are measured whole, whatever their length; repeated rows are judged alike; an empty
    table stays empty. Columns in keep that are named like the added ones are replaced; other names don't matter.
    """
    added = [*BASE, "base_failed", "distance", "kept"]
    mine = [c for c in dict.fromkeys(keep) if c not in added]
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = docs.select(F.struct(*(mine or [F.lit(0).alias("none")])).alias("mine"), F.to_json(F.array(name("lang"), name("source"))).alias("cell"), F.to_json(F.array(name("lang"))).alias("wider"), measure(F.col("text")).alias("found"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = durable(rows.select("mine", "cell", "wider", "found.*").withColumn("base_failed", failed)).withColumns({k: F.expr(v) for k, v in STATISTICS.items()}).withColumn("widest", F.lit("[]"))
    fair = rows.where("NOT base_failed")
    groups = durable(fair.select("cell", "wider", "widest").distinct())
    few = small(groups, broadcast_rows // 8)  # each has estimates from four starts, and there are at most twice as many cells
    found = fit(fair.select(F.explode(F.array("cell", "wider", "widest")).alias("cell"), *STATISTICS), few=few)
    cells = durable(shrunk(groups, found, shrink))
    out = rows.join(F.broadcast(cells) if few else cells, "cell", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(1 - tail, P)))
    return out.select(*[F.col("mine")[c].alias(c) for c in mine], *added)
