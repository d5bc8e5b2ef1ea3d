"""Statistics: resampling intervals, paired tests and agreement.

Counting runs in Spark; what is left are a handful of cells, or one row a question,
from which the figures are computed on the driver with bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.session import cut_lineage

#: Rows of a paired matrix whose weights a task holds at once; each takes 8 bytes a draw.
WEIGHT_ROWS = 256


def confusion(df: DataFrame, truth: str, guess: str) -> dict[str, int]:
    """tp, tn, fp, fn of two 0/1 columns; rows with a null are left out."""
    x = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    t, g = F.col(truth).cast("int") == 1, F.col(guess).cast("int") == 1
    r = x.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & ~g).alias("tn"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn")).first()
    return r.asDict()


def kappa(tp: int, tn: int, fp: int, fn: int) -> float | None:
    """Cohen's kappa; None where chance agreement is complete or there are no rows."""
    n = tp + tn + fp + fn
    if not n:
        return None
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / n**2
    return None if chance == 1 else ((tp + tn) / n - chance) / (1 - chance)


def kappa_interval(tp: int, tn: int, fp: int, fn: int, draws: int = 10_000, seed: int = 1, level: float = 0.95) -> tuple[float, float] | None:
    """Percentile bootstrap interval of kappa, drawn on the four cells."""
    n = tp + tn + fp + fn
    if not n:
        return None
    cells = np.random.default_rng(seed).multinomial(n, np.array([tp, tn, fp, fn]) / n, size=draws).astype(float)
    a, b, c, d = cells.T
    chance = ((a + c) * (a + d) + (b + d) * (b + c)) / n**2
    k = np.where(chance < 1, ((a + b) / n - chance) / np.where(chance < 1, 1 - chance, 1), np.nan)
    k = k[~np.isnan(k)]
    return (float(np.quantile(k, (1 - level) / 2)), float(np.quantile(k, (1 + level) / 2))) if len(k) else None


def mcnemar_exact(b: int, c: int) -> float | None:
    """Two-sided exact p of discordant counts; None without any."""
    n = b + c
    if not n:
        return None
    return min(1.0, 2 * _binomial_cdf(min(b, c), n, 0.5))


def holm(ps: list[float]) -> list[float]:
    """Holm's adjusted p values in the given order, monotone and at most 1."""
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, top = [0.0] * len(ps), 0.0
    for place, i in enumerate(order):
        top = max(top, min(1.0, ps[i] * (len(ps) - place)))
        out[i] = top
    return out


def _binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    log_of = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    # Terms fall away from the mode on both sides, so those below e^-60 of the greatest add nothing.
    mode = min(k, int((n + 1) * p))
    top, total = log_of(mode), []
    for steps in (range(mode, -1, -1), range(mode + 1, k + 1)):
        for i in steps:
            x = log_of(i) - top
            if x < -60:
                break
            total.append(math.exp(x))
    return min(1.0, math.exp(top) * math.fsum(total))


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval by bisection."""
    alpha = (1 - level) / 2

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: 1 - _binomial_cdf(k - 1, n, p) < alpha)
    high = 1.0 if k == n else solve(lambda p: _binomial_cdf(k, n, p) > alpha)
    return low, high


def paired(df: DataFrame, key: str, system: str, metric: str, systems: list[str]) -> DataFrame:
    """One row a key with the mean of `metric` for each system, keys that lack one left out."""
    wide = df.filter(F.col(metric).isNotNull() & ~F.isnan(metric)).groupBy(key).pivot(system, systems).agg(F.avg(metric))
    return wide.dropna(subset=systems)


def bootstrap_intervals(wide: DataFrame, systems: list[str], draws: int = 10_000, seed: int = 1) -> list[dict]:
    """Mean and 95 percent interval of each system, all systems resampled by the same draws.

    Each row has a Poisson(1) weight a draw, from a generator keyed by a hash of the
    row's other columns, so draws do not depend on partitions. Tasks sum their rows by
    matrix products; one row a draw comes back, whatever the number of rows.
    """
    spark = wide.sparkSession
    keys = [c for c in wide.columns if c not in systems]
    rows = cut_lineage(wide.select(F.xxhash64(*keys, F.lit(seed)).alias("_k"), *[F.col(s).cast("double").alias(s) for s in systems]))
    n = rows.count()
    if not n:
        return []
    parts = min(math.ceil(n / 1000), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws, len(systems) + 1))
        for pdf in batches:
            for at in range(0, len(pdf), WEIGHT_ROWS):
                part = pdf.iloc[at : at + WEIGHT_ROWS]
                w = np.stack([np.random.Generator(np.random.Philox(key=int(k) % 2**64)).poisson(1.0, draws) for k in part["_k"]]).astype(float)
                total += w.T @ np.column_stack([part[systems].to_numpy(float), np.ones(len(part))])
        yield pd.DataFrame({"_i": np.arange(draws), **{f"_{j}": total[:, j] for j in range(len(systems) + 1)}})

    cols = [f"_{j}" for j in range(len(systems) + 1)]
    sums = rows.repartition(parts, "_k").mapInPandas(run, "_i long, " + ", ".join(f"{c} double" for c in cols))
    sums = sums.groupBy("_i").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()[cols].to_numpy(float)
    sums = sums[sums[:, -1] > 0]  # a draw of no row has no mean
    means = sums[:, :-1] / sums[:, -1:]
    centre = rows.agg(*[F.avg(s).alias(s) for s in systems]).first()
    return [{"system": s, "mean": centre[s], "low": float(np.quantile(means[:, i], 0.025)), "high": float(np.quantile(means[:, i], 0.975))} for i, s in enumerate(systems)]


#: Ranges of values that counts are summed over before anything is ordered; no window holds more than a range.
RANGES = 4096


def _counts_below(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """`counts` (keys, value, n; one row a value) with `below`: the sum of n of all lesser values of its keys.

    Values fall into RANGES equal ranges between the least and greatest; range sums are
    cumulated first, and values are ordered within their range only.
    """
    span = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = counts.join(F.broadcast(span), keys)  # a row a group
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    at = at.withColumn("_r", F.least(F.floor(width * RANGES), F.lit(RANGES - 1)).cast("int")).drop("_lo", "_hi")
    before = lambda w: F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = at.groupBy(*keys, "_r").agg(F.sum(n).alias("_s")).withColumn("_before", before(Window.partitionBy(*keys).orderBy("_r"))).drop("_s")
    within = F.coalesce(F.sum(n).over(Window.partitionBy(*keys, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.join(ranges, [*keys, "_r"]).withColumn("below", F.col("_before") + within).drop("_r", "_before")


def exact_percentiles(rows: DataFrame, group: str, value: str, ps: list[float]) -> DataFrame:
    """(group, n, p0, p1, ...): interpolated percentiles of a column, from counts of its distinct values by ranges."""
    x = rows.select(F.col(group), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = x.groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    names = counts.select(group).distinct().withColumn("_g", F.xxhash64(group))  # nulls are a group of their own
    placed = _counts_below(counts.withColumn("_g", F.xxhash64(group)).drop(group), ["_g"], "_v", "_n")
    totals = counts.groupBy(F.xxhash64(group).alias("_g")).agg(F.sum("_n").alias("n"))
    at = placed.join(F.broadcast(totals), "_g")
    pick = lambda rank: F.max(F.when((F.col("below") <= rank) & (F.col("below") + F.col("_n") > rank), F.col("_v")))
    places = [(F.col("n") - 1) * F.lit(p) for p in ps]
    found = at.groupBy("_g").agg(F.first("n").alias("n"), *[pick(F.floor(r)).alias(f"_lo{i}") for i, r in enumerate(places)], *[pick(F.ceil(r)).alias(f"_hi{i}") for i, r in enumerate(places)])
    cols = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (r - F.floor(r))).alias(f"p{i}") for i, r in enumerate(places)]
    return found.join(F.broadcast(names), "_g").select(group, "n", *cols)


def wilcoxon(wide: DataFrame, a: str, b: str) -> dict:
    """Signed-rank test of paired columns by the normal approximation with tie correction; p is 1 where all differences are 0.

    Ranks come from counts of each absolute difference, summed by ranges, so nothing is sorted in one task.
    """
    d = wide.select(F.round(F.col(a) - F.col(b), 12).alias("d")).filter("d <> 0")
    counts = d.groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    ranked = _counts_below(counts.withColumn("_g", F.lit(0)), ["_g"], "m", "t").withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    r = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties")).first()
    n = r["n"] or 0
    if not n:
        return {"n": 0, "w_plus": 0.0, "p": 1.0}
    var = n * (n + 1) * (2 * n + 1) / 24 - (r["ties"] or 0) / 48
    z = (r["w"] - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else 0.0
    return {"n": n, "w_plus": float(r["w"]), "p": math.erfc(abs(z) / math.sqrt(2))}


def pearson(df: DataFrame, x: str, y: str, groups: list[str] | None = None) -> DataFrame:
    """n, r and r squared of two columns, of all rows or by group."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return rows.groupBy(*(groups or [])).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r")).withColumn("r2", F.col("r") * F.col("r"))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p of a correlation by Fisher's transform."""
    if n < 4 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    return math.erfc(abs(math.atanh(r)) * math.sqrt(n - 3) / math.sqrt(2))


def over_limit(df: DataFrame, column: str, limit: float, group: str) -> DataFrame:
    """(group, n, n_over, most): rows and those above `limit`."""
    return df.groupBy(group).agg(F.count(column).alias("n"), F.count_if(F.col(column) > limit).alias("n_over"), F.max(column).alias("most"))


def assert_within(df: DataFrame, column: str, limit: float) -> None:
    """Raise if a row is above `limit`, with how many are."""
    n = df.filter(F.col(column) > limit).count()
    if n:
        raise ValueError(f"{n} rows have {column} above {limit}")


def gate(tp: int, fp: int, fn: int, tn: int, least_true: int) -> dict:
    """Precision with its exact interval, recall, accuracy, and whether the count of true flags reaches a bar set beforehand."""
    n = tp + fp + fn + tn
    low, high = clopper_pearson(tp, tp + fp) if tp + fp else (float("nan"), float("nan"))
    nan = float("nan")
    return {"precision": tp / (tp + fp) if tp + fp else nan, "low": low, "high": high, "recall": tp / (tp + fn) if tp + fn else nan, "accuracy": (tp + tn) / n if n else nan, "passed": tp >= least_true}


def integrity(before: DataFrame, after: DataFrame, key: str, column: str) -> None:
    """Raise if a row that had a positive `column` before has none after."""
    lost = before.filter(F.col(column) > 0).select(key).join(after.filter(F.col(column) > 0).select(key), key, "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"rows lost {column}")
