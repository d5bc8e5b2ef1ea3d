import pytest
from pyspark.sql import functions as F

from tarnwise.operators import policy, sampling, stats


def test_agreement():
    assert stats.kappa(0, 0, 0, 0) is None and stats.kappa(5, 0, 0, 0) is None
    assert stats.kappa(20, 15, 5, 10) == pytest.approx(0.4)
    low, high = stats.kappa_interval(20, 15, 5, 10)
    assert low < 0.4 < high
    assert stats.mcnemar_exact(0, 0) is None and stats.mcnemar_exact(1, 9) == pytest.approx(0.021484375)
    assert stats.holm([0.0156, 0.0312, 1.0]) == pytest.approx([0.0468, 0.0624, 1.0])
    low, high = stats.clopper_pearson(41, 41)
    assert low == pytest.approx(0.9140, abs=1e-4) and high == 1.0


def test_paired(spark):
    rows = [(q, s, 0.5 + 0.1 * (s == "b") + 0.001 * q) for q in range(40) for s in "ab"] + [(99, "a", None)]
    df = spark.createDataFrame(rows, "q long, system string, m double")
    wide = stats.paired(df, "q", "system", "m", ["a", "b"])
    assert wide.count() == 40
    for r in stats.bootstrap_intervals(wide, ["a", "b"], draws=500):
        assert r["low"] < r["mean"] < r["high"]
    assert stats.wilcoxon(wide, "b", "a")["p"] < 1e-6
    assert stats.wilcoxon(wide, "a", "a") == {"n": 0, "w_plus": 0.0, "p": 1.0}
    assert stats.bootstrap_intervals(wide.limit(0), ["a", "b"]) == []
    with pytest.raises(ValueError):
        stats.integrity(spark.createDataFrame([(1, 2)], "q long, n long"), spark.createDataFrame([(1, 0)], "q long, n long"), "q", "n")


def test_splits(spark):
    ids = spark.range(1000).withColumnRenamed("id", "k")
    parts = [("a", 0.7), ("b", 0.2), ("c", 0.1)]
    got = {r["split"]: r["n"] for r in sampling.exact_split(ids.unionByName(ids), "k", parts).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 700, "b": 200, "c": 100}
    again = sampling.exact_split(ids.repartition(5), "k", parts)
    assert sampling.exact_split(ids, "k", parts).exceptAll(again).count() == 0
    assert sampling.hash_split(ids, "k", parts).groupBy("split").count().count() == 3
    assert sampling.stratified(ids.withColumn("s", F.when(F.col("k") < 3, "x").otherwise("y")), "s", "k", {"x": 5, "y": 2}).count() == 5


def test_families_stay_together():
    names = [f"d{i}" for i in range(25)]
    families = [["d0", "d1", "d2", "d3"], ["d4", "d5"], ["d6", "zz"]]
    a, b = sampling.family_split(names, families)
    assert a | b == set(names) and not a & b and abs(len(a) - len(b)) <= 4
    assert all(not (set(f) & a and set(f) & b) for f in families)


def test_oracle_choice(spark):
    rows = [(1, "T", 0.5), (1, "T+E", 0.5), (1, "T+E+K", 0.5), (2, "T", 0.5), (2, "T+E", 0.5012), (2, "T+E+K", 0.4), (3, "T", 0.9), (3, "T+E", 0.1), (4, "T", 0.5), (4, "T+E", 0.50105), (4, "T+E+K", 0.1)]
    got = {r["q"]: (r["best_mode"], r["was_tie"]) for r in policy.oracle_labels(spark.createDataFrame(rows, "q long, mode string, score double")).collect()}
    assert got == {1: ("T", True), 2: ("T+E", False), 4: ("T", False)}
