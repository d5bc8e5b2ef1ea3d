"""Jobs that once were cut: each test failed before the cut was taken out."""

import datetime
import os

import numpy as np
import pytest

from tarnwise.operators import stats, vectors
from tarnwise.plans import relational, retrieval

DATA = "/root/testdata/sf0.001"


def test_ivf_recall_where_sixteen_lists_are_few(spark):
    x = np.random.default_rng(5).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = base.filter("vec_id % 50 = 0").toDF("q_id", "q")
    assert vectors.recall(vectors.knn_ivf(q, base), vectors.knn_exact(q, base)) >= 0.9


def test_bootstrap_has_one_method_for_all_sizes(spark):
    wide = spark.range(0, 205_000).selectExpr("id as q", "cast(id % 7 as double) as a", "cast(id % 7 as double) + 1 as b")
    seen = []
    for rows in (wide.limit(3000).coalesce(1), wide.limit(3000).repartition(5)):
        seen.append([round(r[x], 9) for r in stats.bootstrap_intervals(rows, ["a", "b"], draws=300) for x in ("low", "high")])
    assert seen[0] == seen[1]
    # Above the former bound of 200,000 rows, `draws` still rules: one draw leaves no width.
    assert all(r["low"] == r["high"] for r in stats.bootstrap_intervals(wide, ["a", "b"], draws=1))
    x = np.random.default_rng(2).normal(size=1500)
    r = stats.bootstrap_intervals(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "q long, a double"), ["a"])[0]
    assert abs(r["high"] - r["low"] - 2 * 1.96 * x.std() / 1500**0.5) < 0.004


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_text_is_embedded(spark):
    got = {r["kind"]: r["n"] for r in retrieval.text_embedding(spark, DATA).groupBy("kind").agg({"*": "count"}).toDF("kind", "n").collect()}
    rows = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet").count()
    assert got == {"document": rows("documents"), "eval": rows("ehrqa_eval"), "finetune": rows("ehrqa_finetune"), "disease": rows("seed_diseases")}
    assert {r["norm"] for r in retrieval.text_embedding(spark, DATA).select("norm").distinct().collect()} <= {0.0, 1.0}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_orders_and_labels_of_every_key(spark):
    orders = [tuple(r) for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey").collect()]
    late = datetime.datetime.max
    want = sorted((c, o or late, k) for c, o, k in orders if c is not None)
    assert [(r["o_custkey"], r["o_orderdate"] or late, r["o_orderkey"]) for r in relational.admissions_of_each(spark, DATA).collect()] == want
    items = {}
    for i, label in spark.read.parquet(f"{DATA}/labs.parquet").select("itemid", "label").distinct().collect():
        if i is not None and label and label.strip(" "):
            items.setdefault(i, []).append(label)
    want = {(i, n + 1, x) for i, xs in items.items() for n, x in enumerate(sorted(xs)[:25])}
    assert {(r["itemid"], r["rn"], r["label"]) for r in relational.distinct_order_limit_each(spark, DATA).collect()} == want and len(items) > 1
