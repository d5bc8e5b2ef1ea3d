import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tarnwise.operators import contexts, metrics, model, relational, sampling, stats, units


def test_exact_percentiles_and_ranks(spark):
    rows = [("a", float(v)) for v in [3, 1, 4, 1, 5, 9, 2, 6, 1e9]] + [("b", 7.0), (None, 2.0), (None, 4.0), ("a", None), ("a", float("nan"))]
    got = {r["g"]: r.asDict() for r in stats.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.5, 0.9]).collect()}
    assert (got["a"]["n"], got["a"]["p0"], got["b"]["p0"], got[None]["p0"]) == (9, 4.0, 7.0, 3.0)
    assert got["a"]["p1"] == pytest.approx(9 + 0.2 * (1e9 - 9))
    assert stats.exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0


def test_mcnemar_is_exact_on_both_sides_of_a_thousand():
    for n in (999, 1001, 3000):
        b = n // 2 - 20
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(b + 1)) / 2**n)
        assert stats.mcnemar_exact(b, n - b) == pytest.approx(exact, rel=1e-9)


def test_gates_and_limits(spark):
    assert stats.gate(8, 2, 1, 9, 8)["passed"] and not stats.gate(7, 3, 1, 9, 8)["passed"] and math.isnan(stats.gate(0, 0, 1, 1, 1)["precision"])
    df = spark.createDataFrame([("x", 5), ("x", 11), ("y", None)], "g string, n long")
    assert {(r["g"], r["n"], r["n_over"]) for r in stats.over_limit(df, "n", 10, "g").collect()} == {("x", 2, 1), ("y", 0, 0)}
    stats.assert_within(df, "n", 11)
    with pytest.raises(ValueError):
        stats.assert_within(df, "n", 10)


def test_facts_and_fallbacks(spark):
    df = spark.createDataFrame([("A is b. C is d.",), ("No relevant facts.",), (None,), (" . ",)], "t string")
    assert [r[0] for r in df.select(contexts.split_facts(F.col("t"))).collect()] == [["A is b.", "C is d."], [], [], []]
    modes = spark.createDataFrame([("T", None), ("T+E", None), ("T+E+K", 3)], "mode string, e long")
    assert [r[0] for r in modes.select(contexts.served_mode(F.col("mode"), F.col("e"))).collect()] == ["T", "T", "T+E+K"]


def test_samples(spark):
    df = spark.createDataFrame([(i, i / 10) for i in range(10)] + [(99, None)], "k long, f double")
    got = sampling.review_strata(df, F.col("f") > 0.6, F.col("f") > 0.4)
    assert {r["stratum"]: r["count"] for r in got.groupBy("stratum").count().collect()} == {"flagged": 3, "possible_miss": 2, "control": 5}
    one = sampling.numbered_sample(df.unionByName(df), ["k"], 4)
    assert sorted(r["sample_id"] for r in one.collect()) == [1, 2, 3, 4] and one.select("k").distinct().count() == 4


def test_decoys_are_near_and_never_the_row_itself(spark):
    rows = spark.createDataFrame([(i, i * 3) for i in range(60)], "k long, n long")
    got = metrics.decoys(rows, "k", "n", near=10).collect()
    assert len(got) == 60 and all(r["k"] != r["decoy"] and abs(r["k"] - r["decoy"]) <= 10 for r in got)
    assert metrics.decoys(rows.limit(1), "k", "n").count() == 0
    assert {(r["k"], r["decoy"]) for r in metrics.decoys(rows.filter("k < 2"), "k", "n").collect()} == {(0, 1), (1, 0)}


def test_newest_within_days(spark):
    day = lambda i: dt.datetime(2022, 1, i)
    df = spark.createDataFrame([(1, day(9), 1), (1, day(8), 2), (1, day(1), 3), (None, day(1), 4), (2, None, 5)], "e long, ts timestamp, id long")
    assert {r["id"] for r in relational.newest(df, "e", "ts", ["id"], 5, last_days=3).collect()} == {1, 2, 4}


def test_offsets(spark):
    items = spark.createDataFrame([(1, "Temp")], "itemid long, label string")
    table = spark.createDataFrame([("Temp", "C", 1.0, True, 0.0), ("Temp", "F", 5 / 9, False, -160 / 9)], "label string, unit_code string, factor_to_common double, is_common boolean, offset_to_common double")
    rows = spark.createDataFrame([(1, "Temp", 98.6, "F"), (1, "Temp", 37.0, "C"), (1, "Temp", None, "F")], "itemid long, label string, valuenum double, valueuom string")
    got = [r["value_common"] for r in units.to_common_units(rows, items, table).orderBy("valuenum").collect()]
    assert got[0] is None and got[1:] == pytest.approx([37.0, 37.0])


def test_settings_and_ranks():
    some = model.random_settings({"a": [1, 2, 3], "b": [4, 5]}, 4)
    assert len({tuple(s.items()) for s in some}) == 4 and model.random_settings({"a": [1]}, 9) == [{"a": 1}]
    assert model.ranked_features({"x": 0.1, "y": 0.5, "z": 0.1}) == [("y", 0.5, 1), ("x", 0.1, 2), ("z", 0.1, 3)]
