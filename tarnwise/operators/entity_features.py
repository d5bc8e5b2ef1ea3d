"""Per-entity features from a cumulative store of events.

The store keeps, for each entity, event type and day, the counts and totals up to
and including that day. Any window is the difference of two as-of lookups in it, so
new windows cost no new pass over the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative_store(events: DataFrame, distinct_on: Sequence[str] | None = None) -> DataFrame:
    """Cumulative counts and totals by entity, event_type and day.

    `events` has entity, event_type, ts (may be null: undated) and value (may be null).
    With `distinct_on`, rows alike in entity, event_type and those columns count once.
    Rows without entity or event_type belong to no cell and are left out. Undated
    events come first (day null). Null and NaN values add nothing to totals.

    All three shuffles are preceded by map-side combining, and no key holds more than
    one row per entity, type and day after the second, so a very large entity is spread
    over its types and days.
    """
    rows = events.filter(F.col("entity").isNotNull() & F.col("event_type").isNotNull())
    if distinct_on is not None:
        rows = rows.dropDuplicates(["entity", "event_type", *distinct_on])
    value = F.when(F.isnan(F.col("value").cast("double")), None).otherwise(F.col("value").cast("double"))
    daily = (
        rows.withColumn("day", F.to_date("ts"))
        .groupBy("entity", "event_type", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max("ts").alias("last_ts"))
    )
    up_to = Window.partitionBy("entity", "event_type").orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        "entity",
        "event_type",
        "day",
        F.sum("n").over(up_to).alias("cum_n"),
        F.sum("total").over(up_to).alias("cum_total"),
        F.max("last_ts").over(up_to).alias("last_ts"),
    )


def cells_as_of(store: DataFrame, as_of: DataFrame | Column | None = None, windows: Sequence[int] = ()) -> DataFrame:
    """One row per entity and event type: n_events, total, seconds_since and, per window of w days, n_<w>d and total_<w>d.

    `as_of` is a frame (entity, as_of) with one row per entity, a column, or None for
    each entity's own last event. Days after it are left out; windows hold the w days
    that end with the as-of day. seconds_since is null for undated types. A cell whose
    events all come later than the as-of day gives no row.
    """
    if as_of is None:
        as_of = store.groupBy("entity").agg(F.max("last_ts").alias("as_of"))
    if isinstance(as_of, DataFrame):
        at = store.join(as_of.select("entity", "as_of"), "entity", "left")
    else:
        at = store.withColumn("as_of", as_of)
    end = F.to_date("as_of")
    known = F.col("day").isNull() | end.isNull() | (F.col("day") <= end)
    order = F.coalesce(F.col("day"), F.lit("0001-01-01").cast("date"))

    def at_day(column: str, limit: Column) -> Column:
        return F.max_by(F.when(limit, F.col(column)), F.when(limit, order))

    aggs = [
        at_day("cum_n", known).alias("n_events"),
        at_day("cum_total", known).alias("total"),
        F.max(F.when(known, F.col("last_ts"))).alias("last_ts"),
        F.first("as_of").alias("as_of"),
    ]
    for w in windows:
        before = F.col("day").isNull() | (F.col("day") <= F.date_sub(end, w))
        aggs += [at_day("cum_n", before).alias(f"_n{w}"), at_day("cum_total", before).alias(f"_t{w}")]
    out = at.groupBy("entity", "event_type").agg(*aggs).filter(F.col("n_events").isNotNull())
    seconds = F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("last_ts").cast("timestamp"))
    cols = ["entity", "event_type", "n_events", "total", seconds.alias("seconds_since")]
    for w in windows:
        cols += [
            (F.col("n_events") - F.coalesce(f"_n{w}", F.lit(0))).alias(f"n_{w}d"),
            (F.coalesce("total", F.lit(0.0)) - F.coalesce(f"_t{w}", F.lit(0.0))).alias(f"total_{w}d"),
        ]
    return out.select(*cols)


def feature_rows(cells: DataFrame) -> DataFrame:
    """One row per entity: a map from event type to its features.

    A map holds at most one entry per event type, so a row is bounded by the number of types.
    """
    values = [c for c in cells.columns if c not in ("entity", "event_type")]
    entry = F.struct("event_type", F.struct(*values))
    return cells.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_types"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("features"),
    )


def feature_columns(cells: DataFrame, types: Sequence[str], values: Sequence[str] = ("n_events", "total", "seconds_since")) -> DataFrame:
    """One row per entity with a column `<type>__<value>` for each named type; absent cells are null."""
    picked = cells.filter(F.col("event_type").isin(list(types)))
    wide = picked.groupBy("entity").pivot("event_type", list(types)).agg(*[F.first(v).alias(v) for v in values])
    renamed = wide.select(F.col("entity").alias("_e"), *[F.col(f"`{t}_{v}`").alias(f"{t}__{v}") for t in types for v in values])
    return cells.select("entity").distinct().join(renamed, F.col("entity") == F.col("_e"), "left").drop("_e")


def clinical_events(labs: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Lab rows with admission and time, and diagnosis rows, as events (entity = hadm_id).

    `k` tells apart events of one cell: unit for labs, code and version for diagnoses.
    """
    from tarnwise.functions.clinical import clean_code

    code = clean_code(F.col("icd_code"))
    lab = labs.filter(F.col("charttime").isNotNull()).select(
        F.col("hadm_id").alias("entity"), F.concat(F.lit("lab:"), F.col("itemid").cast("string")).alias("event_type"),
        F.col("charttime").alias("ts"), F.col("valuenum").alias("value"), F.col("valueuom").alias("k"),
    )
    dx = diagnoses.select(
        F.col("hadm_id").alias("entity"), F.concat(F.lit("dx:"), F.substring(code, 1, 3)).alias("event_type"),
        F.lit(None).cast(labs.schema["charttime"].dataType).alias("ts"), F.lit(None).cast("double").alias("value"),
        F.concat_ws("|", code, F.coalesce(F.col("icd_version").cast("string"), F.lit("-"))).alias("k"),
    )
    return lab.unionByName(dx)
