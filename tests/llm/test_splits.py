import random

from pyspark.sql import functions as F

from tarnwise.llm import splits


def test_components_against_brute_force(spark):
    rnd = random.Random(2)
    edges = [(f"n{rnd.randint(0, 150):03d}", f"n{rnd.randint(0, 150):03d}") for _ in range(90)] + [("hub", f"h{i}") for i in range(50)] + [(None, "x"), ("solo", "solo")] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {k: v for k, v in got.items() if k != "x"} == {k: find(k) for k in root}


def test_groups_and_assignment(spark):
    rows = [(1, "s", "l", 10, "b"), (2, "s", "l", 10, None), (3, "s", "m", None, "b"), (4, "s", "l", 11, "a"), (5, "s", "l", 11, "b"), (6, "s", "m", 12, None), (7, "s", "m", 12, None), (8, "s", None, None, None)]
    rows += [(100 + i, "s", "lmn"[i % 3], 1000 + i // 2, None) for i in range(400)]
    records = spark.createDataFrame(rows, "record_id long, source string, label string, subject_id long, kg string")
    g = splits.groups(records)
    key = {r["record_id"]: r["group_key"] for r in g.collect()}
    assert len(key) == len(rows) and {key[i] for i in range(1, 6)} == {"kg:a"} and key[6] == key[7] == "subject:12" and key[8] == "record:8"
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, proportion double")
    a = splits.assign(g, targets)
    assert a.count() == a.select("group_key").distinct().count() == len(set(key.values()))
    n = {r["split_name"]: r["n"] for r in g.join(a, "group_key").groupBy("split_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(n["train"] / len(rows) - 0.8) < 0.02
    per = {(r["label"], r["split_name"]): r["n"] for r in g.join(a, "group_key").filter("record_id >= 100").groupBy("label", "split_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(per["lmn"[i], "test"] / 133 - 0.2) < 0.06 for i in range(3))
    assert splits.groups(records.limit(0)).count() == 0
