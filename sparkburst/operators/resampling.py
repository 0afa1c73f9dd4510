"""Bootstrap intervals of AUC, and exact small-sample tails, from sorted ranges of scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import method_summary, rank_tests, roc_auc

#: Rows whose weights of all draws are held at once.
CHUNK = 512
#: Greatest product of two sample sizes for which U's distribution is counted.
COUNTED = 1_000_000


def _poisson_table() -> np.ndarray:
    """Poisson(1) counts of 16-bit numbers, by inversion."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return np.searchsorted(below[:-1], (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


POISSON = _poisson_table()


def draw_weights(keys: np.ndarray, draws: int) -> np.ndarray:
    """(rows, draws) Poisson(1) weights: each 64-bit mix of a row's key and a number serves four draws."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + np.arange(1, -(-draws // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return POISSON[z.view(np.uint16)][:, :draws]


class _Run:
    """Weighted sums of one method's rows in a task, in order of score: first and last value apart, pairs among those between."""

    def __init__(self, method: str, draws: int):
        self.method, self.draws = method, draws
        self.first = self.last = None
        self.middle = None

    def add(self, scores: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        values, p, n = scores[starts], np.add.reduceat(p, starts), np.add.reduceat(n, starts)
        if self.last is not None and self.last[0] == values[0]:
            self.last[1][:] += p[0]
            self.last[2][:] += n[0]
            values, p, n = values[1:], p[1:], n[1:]
        if not len(values):
            return
        closed = [self.last] if self.last is not None else []
        if self.first is None and closed:
            self.first = closed.pop()
        elif self.first is None and len(values) > 1:
            self.first, values, p, n = (values[0], p[0].copy(), n[0].copy()), values[1:], p[1:], n[1:]
        if closed:
            values, p, n = np.r_[closed[0][0], values], np.vstack([closed[0][1], p]), np.vstack([closed[0][2], n])
        self.last = (values[-1], p[-1].copy(), n[-1].copy())
        if len(values) > 1:
            if self.middle is None:
                self.middle = [values[0], np.zeros(self.draws), np.zeros(self.draws), np.zeros(self.draws)]
            _, u, all_p, all_n = self.middle
            below = all_n + np.cumsum(n[:-1], axis=0) - n[:-1]
            u += (p[:-1] * (below + n[:-1] / 2)).sum(axis=0)
            all_p += p[:-1].sum(axis=0)
            all_n += n[:-1].sum(axis=0)

    def pieces(self) -> pd.DataFrame:
        rows = [(self.method, v, True, np.zeros(self.draws), p, n) for v, p, n in filter(None, (self.first, self.last))]
        if self.middle is not None:
            rows.append((self.method, self.middle[0], False, *self.middle[1:]))
        return pd.DataFrame(rows, columns=["method", "lo", "tied", "u", "p", "n"])


def bootstrap_draws(bank: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(method, draw, auc) of Poisson bootstrap draws; draws with one class only are left out.

    A sample's weight in a draw follows from hashes of its id, the same in all methods. Rows
    are sorted over tasks by (method, score); each task gives, per method, three rows of
    sums per draw: pairs among the scores between its first and last, and those two apart, as
    a value that many rows share may lie in many tasks. No resampled row exists.
    """
    rows = bank.where("score is not null").select("method", F.col("score").cast("double").alias("score"), "y", F.xxhash64(F.lit(seed), "sample_idx").alias("key"))
    rows = rows.repartitionByRange("method", "score", "key").sortWithinPartitions("method", "score")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for f in frames:
            names = f["method"].to_numpy(object)
            edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True]) if len(f) else np.zeros(0, int)
            for a, b in zip(edges, edges[1:]):
                if at is None or at.method != names[a]:
                    if at is not None:
                        yield at.pieces()
                    at = _Run(names[a], draws)
                for i in range(a, b, CHUNK):
                    part = f.iloc[i : min(i + CHUNK, b)]
                    w = draw_weights(part["key"].to_numpy(), draws).astype(float)
                    p = w * part["y"].to_numpy(float)[:, None]
                    at.add(part["score"].to_numpy(float), p, w - p)
        if at is not None:
            yield at.pieces()

    pieces = rows.mapInPandas(run, "method string, lo double, tied boolean, u array<double>, p array<double>, n array<double>")
    cells = pieces.select("method", "lo", "tied", F.posexplode(F.arrays_zip("u", "p", "n")).alias("draw", "s")).select("method", "lo", "tied", "draw", "s.u", "s.p", "s.n")
    merged = cells.groupBy("method", "draw", "lo", "tied").agg(*[F.sum(c).alias(c) for c in "upn"])
    before = Window.partitionBy("method", "draw").orderBy("lo", F.desc("tied")).rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("u") + F.when(F.col("tied"), F.col("p") * F.col("n") / 2).otherwise(0.0) + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0.0))
    sums = merged.withColumn("u", own).groupBy("method", "draw").agg(*[F.sum(c).alias(c) for c in "upn"])
    return sums.where("p > 0 and n > 0").select("method", "draw", (F.col("u") / F.col("p") / F.col("n")).alias("auc"))


def bootstrap_auc(bank: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(method, auc, ci_lo, ci_hi): AUC and the middle 95 % of its bootstrap draws; the AUC itself where no draw has both classes."""
    ci = bootstrap_draws(bank, draws, seed).groupBy("method").agg(F.percentile("auc", 0.025).alias("ci_lo"), F.percentile("auc", 0.975).alias("ci_hi"))
    return roc_auc(bank).join(F.broadcast(ci), "method", "left").select("method", "auc", F.coalesce("ci_lo", "auc").alias("ci_lo"), F.coalesce("ci_hi", "auc").alias("ci_hi"))


def method_report(bank: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    """The summary of methods with bootstrap intervals, greatest AUC first."""
    ci = bootstrap_auc(bank, draws, seed).select("method", "ci_lo", "ci_hi")
    both = method_summary(bank).join(F.broadcast(ci), "method")  # a row a method
    return both.select("method", "auc", "ap", "ci_lo", "ci_hi", "tpr_1", "tpr_5", "tpr_c1", "tpr_c2").orderBy(F.desc("auc"), "method")


def exact_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties: twice the share of rank orders whose U is as far out, at most 1.

    Orders with each U are the coefficients of the Gaussian binomial of n1 + n2 over the
    smaller size, in whole numbers.
    """
    small, large = sorted((int(n1), int(n2)))
    top = int(min(u, small * large - u))
    counts = np.zeros(top + 1, object)
    counts[0] = 1
    for i in range(1, small + 1):
        if large + i <= top:
            counts[large + i :] = counts[large + i :] - counts[: -(large + i)]
        for r in range(min(i, top + 1)):
            counts[r::i] = np.cumsum(counts[r::i])
    return min(1.0, float(2 * int(counts.sum()) / math.comb(small + large, small)))


def with_exact_tails(tests: DataFrame, small: int = 8) -> DataFrame:
    """Put exact p-values where ranks have no ties and one sample has at most ``small`` rows.

    ``tests`` has u, n1, n2, ties and p_value. Pairs of sizes with a product over COUNTED keep
    the normal p, which is then near the exact one.
    """

    @F.pandas_udf("double")
    def tail(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([exact_tail(*v) for v in zip(u, n1, n2)], dtype=float)

    counted = (F.col("ties") == 0) & (F.least("n1", "n2") <= small) & (F.least("n1", "n2") > 0) & (F.col("n1") * F.col("n2") <= COUNTED)
    kept = [c for c in tests.columns if c != "p_value"]
    exact = tests.where(counted).select(*kept, tail("u", "n1", "n2").alias("p_value"))
    return exact.unionByName(tests.where(~counted))


def feature_discrimination(vectors: DataFrame, names: list[str] | None = None) -> DataFrame:
    """How well each place of (x, y) sets anomalies apart, best first: (feature_idx, feature_name, effect_size, p_value, significant).

    ``names`` must be as many as the places of every vector; without them a feature is "Feature i".
    Exact p for small samples without ties; significant below 0.05. Null values don't take part.
    """
    if names is not None and vectors.where(F.size("x") != len(names)).limit(1).count():
        raise ValueError("a name is needed for each feature, and no more")
    cells = vectors.select("y", F.posexplode("x").alias("feature", "value")).where("value is not null").withColumn("value", F.col("value").cast("double"))
    tests = with_exact_tails(rank_tests(cells))
    name = F.concat(F.lit("Feature "), F.col("feature").cast("string")) if names is None else F.array(*[F.lit(n) for n in names])[F.col("feature")]
    out = tests.select(F.col("feature").alias("feature_idx"), name.alias("feature_name"), F.col("effect").alias("effect_size"), "p_value", (F.col("p_value") < 0.05).alias("significant"))
    return out.orderBy(F.desc("effect_size"), "p_value", "feature_idx")
