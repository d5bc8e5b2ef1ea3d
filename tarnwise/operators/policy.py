"""Choosing a retrieval mode: oracle labels, fixed policies and what they cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Modes from cheap to dear, their price in the ranking, what counts as a tie, and cost units a mode and a wrong choice.
MODES = ["T", "T+E", "T+E+K"]
PRICE = {"T": 0.0, "T+E": 0.001, "T+E+K": 0.002}
EPSILON = 1e-4
UNITS = {"T": 1.0, "T+E": 3.0, "T+E+K": 10.0}
WRONG = 15.0


def _map(values: dict, mode: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), mode)


def oracle_labels(scores: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """(q, best_mode, best_score, was_tie): the cheapest mode whose priced score is within EPSILON of the best.

    scores: q, mode, score. A question must have every mode, once; others are left out.
    was_tie tells that more than one mode reached the best unpriced score. One aggregate
    a question, no window.
    """
    x = scores.filter(F.col("mode").isin(list(modes)) & F.col("score").isNotNull()).withColumn("adj", F.col("score") - _map(PRICE, F.col("mode")))
    rank = _map({m: i for i, m in enumerate(modes)}, F.col("mode"))
    per = x.groupBy("q").agg(F.max("adj").alias("top"), F.max("score").alias("raw"), F.collect_list(F.struct(rank.alias("rank"), "mode", "adj", "score")).alias("all")).filter(F.size("all") == len(modes))
    tied = F.filter("all", lambda m: F.col("top") - m["adj"] <= EPSILON)
    best = F.array_min(F.transform(tied, lambda m: F.struct(m["rank"], m["mode"], m["score"])))
    return per.select("q", best["mode"].alias("best_mode"), best["score"].alias("best_score"), (F.size(F.filter("all", lambda m: F.col("raw") - m["score"] <= EPSILON)) > 1).alias("was_tie"))


def missing_modes(scores: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """Questions that lack a mode."""
    return scores.groupBy("q").agg(F.countDistinct(F.when(F.col("mode").isin(list(modes)), F.col("mode"))).alias("n")).filter(F.col("n") < len(modes))


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the commonest value of each group, the first in order on ties."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), value)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(group, value)


def static_policy(train: DataFrame, asked: DataFrame, group: str, mode: str) -> DataFrame:
    """`asked` with the majority mode of its group in `train`, or of all of it where the group is new."""
    overall = train.filter(F.col(mode).isNotNull()).groupBy(mode).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), mode).first()
    return asked.join(majority(train, group, mode), group, "left").withColumn(mode, F.coalesce(mode, F.lit(overall[0] if overall else None)))


def random_policy(asked: DataFrame, key: str, modes: Sequence[str] = MODES, weights: Sequence[float] | None = None, seed: int = 17) -> DataFrame:
    """`asked` with a mode drawn by hash of its key, so the draw does not depend on partitions."""
    w = weights or [1.0] * len(modes)
    u = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) / 1_000_000 * sum(w)
    out, edge = F.lit(modes[-1]), 0.0
    for m, x in reversed(list(zip(modes, w))):
        edge = sum(w[: modes.index(m) + 1])
        out = F.when(u < edge, m).otherwise(out)
    return asked.withColumn("mode", out)


def project(policy: DataFrame, results: DataFrame, keys: Sequence[str] = ("q",)) -> DataFrame:
    """Answers of a system: the results of the mode its policy chose for each question."""
    return policy.join(results, [*keys, "mode"])


def routing_cost(rows: DataFrame, chosen: str, best: str) -> Column:
    """Mean cost units of choices: the mode's own, and WRONG more where it is not the best."""
    return F.avg(_map(UNITS, F.col(chosen)) + F.when(F.col(chosen) != F.col(best), WRONG).otherwise(0.0))


def upper_bound(results: DataFrame, key: str, score: Column) -> DataFrame:
    """The row of each question with the best score, the cheapest mode on ties."""
    rank = _map({m: i for i, m in enumerate(MODES)}, F.col("mode"))
    w = Window.partitionBy(key).orderBy(score.desc_nulls_last(), rank)
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
