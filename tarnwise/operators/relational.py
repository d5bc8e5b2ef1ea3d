"""Lookups, joins and filters that take any column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dictionary_join(facts: DataFrame, words: DataFrame, keys: Sequence[str], code: str, text: str, out: str) -> DataFrame:
    """Left join to a dictionary on one or more keys; the text where known and not blank, else the code. The dictionary's first text by order wins where a key repeats."""
    one = words.groupBy(*keys).agg(F.min(F.when(F.length(F.trim(text)) > 0, F.trim(text))).alias("_text"))
    return facts.join(one, list(keys), "left").withColumn(out, F.coalesce("_text", F.col(code).cast("string"))).drop("_text")


def newest(df: DataFrame, entity: str, ts: str, ties: Sequence[str], n: int, last_days: int | None = None) -> DataFrame:
    """The `n` newest rows of each entity, rows without time last; with `last_days`, only those within so many days of the entity's newest row."""
    rows = df
    if last_days is not None:
        top = df.groupBy(F.col(entity).alias("_entity")).agg(F.max(ts).alias("_top"))  # combined map-side, so no entity's rows are held for it
        rows = df.join(top, F.col(entity).eqNullSafe(F.col("_entity"))).filter(F.col(ts) >= F.col("_top") - F.expr(f"make_dt_interval({int(last_days)})")).drop("_entity", "_top")
    w = Window.partitionBy(entity).orderBy(F.col(ts).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def prefix_cohort(facts: DataFrame, seeds: DataFrame, entity: str, code: str, version: str | None = None) -> DataFrame:
    """(name, entity) of entities with a code that starts with a prefix of a seed.

    `seeds`: name, version, prefix. Without `version` any version's code matches, as an
    equi-join on the exploded beginnings of the codes.
    """
    rows = facts.select(F.col(entity).alias("entity"), F.col(code).alias("_code"), *([F.col(version).alias("version")] if version else [])).distinct()
    rows = rows.withColumn("prefix", F.explode(F.expr("transform(sequence(1, greatest(length(_code), 1)), i -> substring(_code, 1, i))")))
    return rows.join(seeds, ["prefix", "version"] if version else "prefix").select("name", "entity").distinct()


def matched_set(df: DataFrame, question: str, system: str, scorable: Column, systems: Sequence[str]) -> DataFrame:
    """Rows of questions for which every one of `systems` is scorable."""
    ok = df.filter(scorable & F.col(system).isin(list(systems))).groupBy(question).agg(F.countDistinct(system).alias("_n")).filter(F.col("_n") == len(set(systems)))
    return df.join(ok.select(question), question, "left_semi")


def refresh_columns(df: DataFrame, fresh: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Replace stale columns of `df` by those of `fresh` (one row a key), with defaults where it has none."""
    columns = [c for c in fresh.columns if c != key]
    return df.drop(*columns).join(fresh, key, "left").fillna({c: v for c, v in defaults.items() if c in columns})


def leaks(parts: DataFrame, ident: str, split: str) -> DataFrame:
    """Ids that stand in more than one split."""
    return parts.filter(F.col(ident).isNotNull()).groupBy(ident).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def assert_no_leak(parts: DataFrame, ident: str, split: str) -> None:
    """Raise if an id stands in more than one split."""
    if not leaks(parts, ident, split).isEmpty():
        raise ValueError(f"{ident} stands in more than one {split}")
