"""Mixing sources to target weights, measured in tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.session import broadcast_if_small

#: Hash buckets a length is spread over, so that no window holds a whole length class.
BUCKETS = 256


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their tokens come to `budget`, or as close below it as can be.

    A share of every length in proportion fills most of the budget, so the choice is not
    tilted to long or short documents; what remains is closed by a bounded-knapsack
    dynamic programme over the documents left of each length.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    take = (counts * (budget / total)).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    free = counts - take
    # Whole documents, the most plentiful lengths first, until the programme's table is small.
    small = 4 * int(lengths.max())
    for i in np.argsort(-free * lengths, kind="stable"):
        if rest <= small:
            break
        more = min(int(free[i]), (rest - small) // int(lengths[i]) + 1, rest // int(lengths[i]))
        take[i] += more
        free[i] -= more
        rest -= more * int(lengths[i])
    # The programme needs room: copies already taken are given back, the most plentiful lengths first.
    room = min(budget, 3 * int(lengths.max()))
    for i in np.argsort(-take, kind="stable"):
        if rest >= room:
            break
        less = min(int(take[i]), -(-(room - rest) // int(lengths[i])))
        take[i] -= less
        free[i] += less
        rest += less * int(lengths[i])
    # item[j], copies[j]: the step that first reached sum j, and its size.
    item, copies = np.full(rest + 1, -1, dtype=np.int64), np.zeros(rest + 1, dtype=np.int64)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    steps: list[tuple[int, int]] = []
    for i in np.flatnonzero((free > 0) & (lengths > 0) & (lengths <= rest)):
        left, k = min(int(free[i]), rest // int(lengths[i])), 1
        while left > 0:
            k_now = min(k, left)
            jump = int(lengths[i]) * k_now
            new = np.zeros_like(reached)
            if jump <= rest:
                new[jump:] = reached[: rest + 1 - jump] & ~reached[jump:]
            step = len(steps)
            steps.append((int(i), k_now))
            item[new], copies[new] = step, jump
            reached |= new
            left -= k_now
            k *= 2
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, k = steps[item[at]]
        take[i] += k
        at -= int(copies[at])
    return take


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Copies of each document, and the shares they make.

    `sizes`: doc_id, source, n_tokens. `targets`: source, weight, max_repeats. Sources
    without weight, without documents or not named in `targets` give nothing; weights are
    scaled over those that have documents. Without `total` the mixture is the largest in
    which every such source gives its whole share within its repeats; with `total` a
    source that cannot fill its share gives all it may and the report says so.

    A source uses each of its documents the same whole number of times, and a seeded
    selection of them once more to meet its budget, so copies never exceed max_repeats.
    Returns (doc_id, source, n_tokens, copies) with copies > 0, and per target source its
    weight, documents, tokens available and used, target and actual share.
    """
    want = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = sizes.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).filter("source is not null and n_tokens > 0")
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    rows = rows.join(broadcast_if_small(want.select("source")), "source", "left_semi").withColumn("_h", h).withColumn("_bucket", (F.col("_h") % BUCKETS).cast("int"))
    histogram = rows.groupBy("source", "n_tokens", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    by_length = histogram.groupBy("source", "n_tokens").agg(F.sum("_c").alias("c"))
    held = by_length.groupBy("source").agg(F.sum("c").alias("n_docs"), F.sum(F.col("c") * F.col("n_tokens")).alias("tokens"))
    plan = want.join(held, "source", "left").fillna(0, ["n_docs", "tokens"]).toPandas()  # one row a target source
    plan["weight"], plan["max_repeats"] = plan["weight"].fillna(0.0).clip(lower=0.0), plan["max_repeats"].fillna(0).clip(lower=0).astype(int)
    usable = (plan["weight"] > 0) & (plan["tokens"] > 0) & (plan["max_repeats"] > 0)
    share = np.where(usable, plan["weight"], 0.0)
    share = share / share.sum() if share.sum() else share
    room = (plan["tokens"] * plan["max_repeats"]).to_numpy(float)
    size = float(total) if total is not None else (float(np.min(room[usable] / share[usable])) if usable.any() else 0.0)
    plan["target_share"] = share
    plan["budget"] = np.minimum(np.floor(share * size + 1e-9), room).astype(np.int64)
    plan["whole"] = np.where(plan["tokens"] > 0, plan["budget"] // plan["tokens"].clip(lower=1), 0).astype(np.int64)
    plan["rest"] = plan["budget"] - plan["whole"] * plan["tokens"]
    spark = sizes.sparkSession
    per_source = spark.createDataFrame(plan[["source", "whole", "rest"]].astype({"source": str, "whole": "int64", "rest": "int64"}), "source string, whole long, rest long")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")  # the choice must not depend on the order rows arrive in
        quota = fit_budget(pdf["n_tokens"].to_numpy(), pdf["c"].to_numpy(), int(pdf["rest"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "quota": quota, "whole": pdf["whole"]})

    # A source's length classes number at most its longest document's tokens, whatever its documents number.
    quotas = by_length.join(F.broadcast(per_source), "source").groupBy("source").applyInPandas(fit, "source string, n_tokens long, quota long, whole long")
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("source", "n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = histogram.withColumn("_before", before).join(quotas, ["source", "n_tokens"]).select("source", "n_tokens", "_bucket", "whole", (F.col("quota") - F.col("_before")).alias("_open"), "_c")
    at = rows.join(cells, ["source", "n_tokens", "_bucket"])
    sure = at.filter("_open >= _c or _open <= 0").withColumn("copies", F.col("whole") + (F.col("_open") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "_bucket").orderBy("_h", "doc_id"))
    edge = at.filter("_open > 0 and _open < _c").withColumn("copies", F.col("whole") + (rank <= F.col("_open")).cast("long"))
    chosen = sure.unionByName(edge).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.count(F.lit(1)).alias("docs_used"), F.max("copies").alias("most_copies"))
    facts = spark.createDataFrame(
        plan[["source", "weight", "max_repeats", "n_docs", "tokens", "target_share", "budget"]].astype({"source": str, "n_docs": "int64", "tokens": "int64", "max_repeats": "int32"}),
        "source string, weight double, max_repeats int, n_docs long, tokens_available long, target_share double, tokens_target long",
    )
    report = facts.join(used, "source", "left").fillna(0, ["tokens_used", "docs_used", "most_copies"])
    all_used = F.sum("tokens_used").over(Window.partitionBy())  # over the target sources only
    report = report.withColumn("actual_share", F.when(all_used > 0, F.col("tokens_used") / all_used).otherwise(0.0))
    return chosen, report
