"""Splits that keep related records together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwise.session import cut_lineage


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's connected component.

    `edges`: a, b (strings; nulls are no edge). Alternates the large-star and small-star
    steps, which end after O(log^2) rounds whatever the shape. Neighbourhoods are never
    collected: each step needs only the smallest neighbour of a node, an aggregate that
    combines map-side, and a join that AQE splits at hot nodes. Rounds write to the
    shared checkpoint folder, so lost executors cost no recomputation of earlier rounds.
    """
    e = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).filter(F.col("node").isNotNull()).distinct()
    e = cut_lineage(e)
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x"))
        e = cut_lineage(small.select("x.a", "x.b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(e.groupBy("a").agg(F.min("b").alias("root")), F.col("node") == F.col("a"), "left").select("node", F.coalesce("root", "node").alias("root"))


def record_keys(evals: DataFrame, examples: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """record_id, source, label, subject_id and kg (null where absent) of each record of the two tables."""
    known = diagnoses.filter(F.col("hadm_id").isNotNull() & F.col("subject_id").isNotNull()).groupBy("hadm_id").agg(F.min("subject_id").alias("_s"))
    kg = F.nullif(F.lower(F.trim(F.regexp_replace("kg_disease", r"\s+", " "))), F.lit(""))
    a = evals.select(F.col("qa_id").alias("record_id"), F.lit("ehrqa_eval").alias("source"), "hadm_id", F.lit(None).cast("long").alias("subject_id"), kg.alias("kg"), F.col("question_type").alias("label"))
    b = examples.select(F.col("example_id").alias("record_id"), F.lit("router_train_examples").alias("source"), "hadm_id", "subject_id", F.lit(None).cast("string").alias("kg"), F.upper(F.trim("mode")).alias("label"))
    return a.unionByName(b).join(known, "hadm_id", "left").select("record_id", "source", "label", F.coalesce("subject_id", "_s").alias("subject_id"), "kg")


def groups(records: DataFrame) -> DataFrame:
    """`records` with `group_key`, alike for records linked by subject or kg, directly or through others.

    The key is `kg:` and the first kg of the group, else `subject:` and its subject; a
    record with neither stands alone under `record:` and its id. Subjects and kg values
    are the nodes, so a third of all records under one of them is one edge.
    """
    subject, kg = F.concat(F.lit("subject:"), F.col("subject_id").cast("string")), F.concat(F.lit("kg:"), F.col("kg"))
    keyed = records.withColumn("_subject", subject).withColumn("_kg", kg).withColumn("_node", F.coalesce("_kg", "_subject"))
    # A subject under one kg only links nothing: it takes that kg as it is. The others are edges between kg values.
    links = keyed.filter("_subject is not null and _kg is not null").groupBy("_subject").agg(F.min("_kg").alias("_first"), F.max("_kg").alias("_last"))
    edges = keyed.filter("_subject is not null and _kg is not null").select(F.col("_subject").alias("a"), F.col("_kg").alias("b")).distinct()
    many = links.filter("_first <> _last").select(F.col("_subject").alias("a"))
    found = components(edges.join(many, "a", "left_semi"))
    # "kg:" sorts before "subject:", so a root is the first kg of its component.
    root_of = found.select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    of_subject = links.select(F.col("_subject").alias("_s2"), F.col("_first").alias("_f2"))
    at = keyed.join(of_subject, F.col("_subject") == F.col("_s2"), "left").withColumn("_node", F.coalesce("_kg", "_f2", "_subject"))
    at = at.join(root_of, F.col("_node") == F.col("_n"), "left")
    key = F.coalesce("_root", "_node", F.concat(F.lit("record:"), F.col("record_id").cast("string")))
    return at.select(*records.columns, key.alias("group_key"))


def assign(grouped: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(group_key, split_name) by grouped iterative stratification.

    Each group's labels are summed to a vector; groups are placed by their rarest
    outstanding label, larger ones first, into the split that still needs it most. Groups of more than a thousandth of all records are placed one
    by one on the driver (fewer than a thousand of them); the rest are small and are
    placed within hash shards on the executors, each shard filling its part of what the
    large groups left, so neither side holds more than its shard.
    """
    splits = [(r["split_name"], float(r["proportion"])) for r in targets.orderBy("split_name").collect()]
    total_p = sum(p for _, p in splits)
    names, props = [s for s, _ in splits], [p / total_p for _, p in splits]
    label = F.coalesce("label", F.lit(""))
    sizes = grouped.groupBy("group_key", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = {r["label"]: r["n"] for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    everything = sum(totals.values())
    vectors = sizes.groupBy("group_key").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("vector"))
    cut = max(1, everything // 1000)
    want = [{k: v * p for k, v in totals.items()} for p in props]
    big = [(r["group_key"], r["size"], r["vector"]) for r in vectors.filter(F.col("size") > cut).orderBy("group_key").collect()]
    placed = _place(big, want, [everything * p for p in props])
    spark = grouped.sparkSession
    schema = "group_key string, split_name string"
    head = spark.createDataFrame([(g, names[i]) for g, i in placed], schema)
    small = vectors.filter(F.col("size") <= cut)
    shards = max(1, everything // 200_000)
    left = [sum(w.values()) for w in want]
    left_all = sum(max(0.0, x) for x in left) or 1.0
    left_p = [max(0.0, x) / left_all for x in left]

    def place_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(g, int(n), dict(v)) for g, n, v in zip(pdf["group_key"], pdf["size"], pdf["vector"])]
        sums: dict[str, float] = {}
        for _, _, v in rows:
            for k, n in v.items():
                sums[k] = sums.get(k, 0) + n
        share = {k: [max(0.0, w.get(k, 0.0)) for w in want] for k in sums}
        local = [{k: s * (share[k][i] / sum(share[k]) if sum(share[k]) else left_p[i]) for k, s in sums.items()} for i in range(len(names))]
        out = _place(rows, local, [sum(sums.values()) * p for p in left_p])
        return pd.DataFrame([(g, names[i]) for g, i in out], columns=["group_key", "split_name"])

    tail = small.withColumn("shard", F.pmod(F.xxhash64("group_key", F.lit(seed)), F.lit(shards))).groupBy("shard").applyInPandas(lambda pdf: place_shard(pdf), schema)
    return head.unionByName(tail)


def _place(rows: list, want: list[dict], room: list[float]) -> list[tuple[str, int]]:
    """Greedy placement; `want` (per split and label) and `room` (per split) are used up in place.

    The label with the fewest outstanding records comes next; its groups go, larger ones
    first, to the split with the largest part of its need for that label and of its room
    still open, so that shares hold for labels and for all records.
    """
    whole, space = [dict(w) for w in want], list(room)
    outstanding: dict[str, float] = {}
    holders: dict[str, list] = {}
    for row in rows:
        for k, n in row[2].items():
            outstanding[k] = outstanding.get(k, 0) + n
            holders.setdefault(k, []).append(row)
    open_part = lambda left, of: left / of if of > 0 else -1.0
    done: dict[str, int] = {}
    out = []
    while outstanding:
        key = min(outstanding, key=lambda k: (outstanding[k], k))
        for g, n, v in sorted(holders[key], key=lambda r: (-r[1], r[0])):
            if g in done:
                continue
            best = max(range(len(want)), key=lambda i: (open_part(want[i].get(key, 0.0), whole[i].get(key, 0.0)) + open_part(room[i], space[i]), -i))
            for k, c in v.items():
                want[best][k] = want[best].get(k, 0.0) - c
                if k in outstanding:
                    outstanding[k] -= c
            room[best] -= n
            done[g] = best
            out.append((g, best))
        del outstanding[key]
    return out
