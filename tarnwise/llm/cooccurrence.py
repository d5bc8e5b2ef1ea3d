"""Items that appear together more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwise.session import broadcast_if_small, cut_lineage


def pair_counts(left: DataFrame, right: DataFrame, baskets: DataFrame) -> DataFrame:
    """Pairs of a left and a right item: both, n_left, n_right, n_baskets, frequency, lift, pmi.

    `left`, `right`: basket, item; `baskets`: basket, the baskets that count. Nulls are no
    basket and no item; an item counts once a basket, and an item in no counted basket
    gives no row. For pairs within one set pass it twice and keep left < right.

    Items are made distinct a basket with map-side combining, so a basket that is sent a
    third of all rows shrinks to its distinct items before it is shuffled; pairs are
    emitted inside the join and combined map-side by pair. The distinct items are written
    once; marginals and pairs start from there.
    """
    all_ = cut_lineage(baskets.select("basket").filter(F.col("basket").isNotNull()).distinct())
    one = lambda df: df.select("basket", "item").filter(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()
    a = cut_lineage(one(left).join(all_, "basket", "left_semi"))
    b = cut_lineage(one(right).join(all_, "basket", "left_semi"))
    n_left = broadcast_if_small(a.groupBy("item").agg(F.count(F.lit(1)).alias("n_left")).withColumnRenamed("item", "left_item"))
    n_right = broadcast_if_small(b.groupBy("item").agg(F.count(F.lit(1)).alias("n_right")).withColumnRenamed("item", "right_item"))
    n = all_.count()
    both = a.withColumnRenamed("item", "left_item").join(b.withColumnRenamed("item", "right_item"), "basket").groupBy("left_item", "right_item").agg(F.count(F.lit(1)).alias("both"))
    lift = F.col("both") * F.lit(float(n)) / (F.col("n_left") * F.col("n_right"))
    return both.join(n_left, "left_item").join(n_right, "right_item").select(
        "left_item", "right_item", "both", "n_left", "n_right", F.lit(n).cast("long").alias("n_baskets"),
        (F.col("both") / F.col("n_left")).alias("frequency"), lift.alias("lift"), F.log(lift).alias("pmi"),
    )


def disease_baskets(diagnoses: DataFrame, seeds: DataFrame) -> DataFrame:
    """(basket, item): admissions and the seed diseases one of their codes starts with, by the code's own version.

    The prefixes of a code, up to the length of the longest seed prefix, are exploded, so the match is an equi-join.
    """
    code = F.upper(F.regexp_replace(F.replace("icd_code", F.lit("."), F.lit("")), r"^\s+|\s+$", ""))
    seeds = seeds.select("name", F.explode(F.array(F.struct(F.lit(9).alias("v"), F.col("icd9_prefix").alias("p")), F.struct(F.lit(10).alias("v"), F.col("icd10_prefix").alias("p")))).alias("s"))
    seeds = broadcast_if_small(seeds.select("name", F.col("s.v").alias("v"), F.upper(F.trim("s.p")).alias("p")).filter(F.length("p") > 0))
    rows = diagnoses.select("hadm_id", F.col("icd_version").alias("v"), code.alias("code")).filter(F.col("hadm_id").isNotNull() & (F.length("code") > 0)).distinct()
    longest = seeds.agg(F.max(F.length("p"))).first()[0] or 1
    rows = rows.withColumn("p", F.explode(F.expr(f"transform(sequence(1, least(length(code), {longest})), i -> substring(code, 1, i))")))
    return rows.join(seeds, ["v", "p"]).select(F.col("hadm_id").alias("basket"), F.col("name").alias("item"))


def lab_baskets(labs: DataFrame, items: DataFrame) -> DataFrame:
    """(basket, item): admissions and the trimmed label of each item they have a row of."""
    names = broadcast_if_small(items.select("itemid", F.trim("label").alias("item")).filter(F.length("item") > 0).distinct())
    return labs.select(F.col("hadm_id").alias("basket"), "itemid").join(names, "itemid").select("basket", "item")
