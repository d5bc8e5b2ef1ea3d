"""Queries on measurements: unit conversion, bad readings, per-admission features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.functions.clinical import is_number
from tarnwise.operators import bad_readings, entity_features, units
from tarnwise.session import broadcast_if_small
from tarnwise.sources.catalog import table


def _common(spark: SparkSession, d: str) -> DataFrame:
    return units.to_common_units(table(spark, d, "labs"), table(spark, d, "d_labitems"), table(spark, d, "lab_units"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows recorded in a unit of their test other than the common one."""
    x = _common(spark, d)
    return x.filter(is_number(F.col("valuenum")) & F.col("unit_from").isin("field", "text") & ~F.col("in_common_unit")).select("labevent_id", "unit_code")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every lab row with its value in the common unit of its test."""
    return _common(spark, d).select("labevent_id", "unit_code", "unit_from", "common_code", F.round("value_common", 6).alias("value_common"))


def p5_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Per test: rows by where their unit was told."""
    return _common(spark, d).groupBy("common_code", "unit_code", "unit_from").agg(F.count(F.lit(1)).alias("n"))


def _store(spark: SparkSession, d: str) -> DataFrame:
    return entity_features.cumulative_store(
        entity_features.clinical_events(table(spark, d, "labs"), table(spark, d, "diagnoses")), distinct_on=["ts", "value", "k"]
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty cells of the feature table, with their counts up to the last day stored."""
    cells = entity_features.cells_as_of(_store(spark, d), F.lit(None).cast("timestamp"))
    return cells.select(F.col("entity").alias("hadm_id"), "event_type", "n_events")


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per admission: count, recency, total and one-week window of each event type."""
    cells = entity_features.cells_as_of(_store(spark, d), None, windows=(7,))
    return entity_features.feature_rows(cells).withColumnRenamed("entity", "hadm_id")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Labs in common units and vitals as one frame; a missing charttime is replaced by storetime, a missing admission by the patient."""
    labs = _common(spark, d).select(
        F.lit("labs").alias("source"), F.col("labevent_id").alias("row_id"), F.coalesce("hadm_id", -F.col("subject_id")).alias("entity"), F.col("itemid").alias("item"),
        F.coalesce("charttime", "storetime").alias("ts"), F.col("value_common").alias("value"), F.col("common_code").alias("unit"),
    )
    units_of = broadcast_if_small(table(spark, d, "d_vitalitems").select("itemid", "unit").dropDuplicates(["itemid"]))
    vitals = table(spark, d, "vitals").join(units_of, "itemid", "left").select(
        F.lit("vitals").alias("source"), F.col("vital_id").alias("row_id"), F.col("hadm_id").alias("entity"), F.col("itemid").alias("item"),
        F.col("charttime").alias("ts"), F.col("valuenum").alias("value"), "unit",
    )
    return labs.unionByName(vitals)


def p2_bad(spark: SparkSession, d: str) -> DataFrame:
    """Bad readings with their reason."""
    return bad_readings.bad_readings(_readings(spark, d)).select(F.col("source").alias("source_table"), "row_id", "reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Bad readings."""
    return p2_bad(spark, d).select("source_table", "row_id")


QUERIES = {"p2_found": p2_found, "p2_bad": p2_bad, "p5_found": p5_found, "p5_values": p5_values, "p5_by_source": p5_by_source, "p4_found": p4_found, "p4_features": p4_features}

_FOLD = "regexp_replace(regexp_replace(regexp_replace(translate(lower({0}), 'µμ³', 'uu3'), '\\blit(?:re|er)s?\\b', 'l', 'g'), '\\bper\\b', '/', 'g'), '[\\s ]+', '', 'g')"


def _spellings() -> str:
    quoted = ", ".join(f"('{own}', '{s}')" for own, all_ in units.SPELLINGS.items() for s in all_)
    return f"(VALUES {quoted}) AS s(own, k)"


_UNITS = f"""
WITH tests AS (SELECT itemid, min(trim(label)) AS test FROM d_labitems WHERE length(trim(label)) > 0 GROUP BY itemid),
own AS (SELECT lower(trim(label)) AS t, unit_code, factor_to_common AS f, coalesce(is_common, false) AS c, {_FOLD.format("unit_code")} AS own FROM lab_units WHERE unit_code IS NOT NULL),
keys AS (SELECT t, unit_code, f, c, own, own AS k FROM own UNION SELECT t, unit_code, f, c, own.own, s.k FROM own JOIN {_spellings()} ON own.own = s.own),
best AS (SELECT * FROM keys QUALIFY row_number() OVER (PARTITION BY t, k ORDER BY CASE WHEN own = k THEN 0 ELSE 1 END, CASE WHEN c THEN 0 ELSE 1 END, unit_code) = 1),
com AS (SELECT t, min(unit_code) AS common FROM own WHERE c GROUP BY t),
u AS (
  SELECT l.*, tests.test, {_FOLD.format("l.valueuom")} AS uk,
    {_FOLD.format("regexp_replace(regexp_replace(replace(lower(l.label), lower(tests.test), ' '), '^[\\s,;:()\\[\\]{}–-]+|[\\s,;:()\\[\\]{}–-]+$', '', 'g'), '^(?:(?:result|results|in|as|unit|units|reported)\\b[\\s:]*)+', '')".replace("{}", "{{}}").replace("{{}}", "{}"))} AS lk
  FROM labs l LEFT JOIN tests USING (itemid)),
r AS (
  SELECT u.*, com.common, coalesce(a.unit_code, b.unit_code, com.common) AS code, coalesce(a.f, b.f, 1.0) AS f, coalesce(a.c, b.c, true) AS c,
    CASE WHEN a.unit_code IS NOT NULL THEN 'field' WHEN b.unit_code IS NOT NULL THEN 'text' WHEN com.common IS NOT NULL THEN 'default' ELSE 'none' END AS src
  FROM u LEFT JOIN best a ON lower(u.test) = a.t AND u.uk = a.k LEFT JOIN best b ON lower(u.test) = b.t AND u.lk = b.k LEFT JOIN com ON lower(u.test) = com.t)
"""

SQL = {
    "p5_found": _UNITS + "SELECT labevent_id, code AS unit_code FROM r WHERE valuenum IS NOT NULL AND NOT isnan(valuenum) AND src IN ('field', 'text') AND NOT c",
    "p5_values": _UNITS + "SELECT labevent_id, code AS unit_code, src AS unit_from, common AS common_code, round(CASE WHEN isnan(valuenum) THEN NULL ELSE valuenum END * f, 6) AS value_common FROM r",
    "p5_by_source": _UNITS + "SELECT common AS common_code, code AS unit_code, src AS unit_from, count(*) AS n FROM r GROUP BY ALL",
    "p4_found": """
SELECT hadm_id, 'lab:' || itemid AS event_type, count(*) AS n_events
FROM (SELECT DISTINCT hadm_id, itemid, charttime, valuenum, valueuom FROM labs WHERE hadm_id IS NOT NULL AND charttime IS NOT NULL AND itemid IS NOT NULL) GROUP BY ALL
UNION ALL
SELECT hadm_id, 'dx:' || substr(code, 1, 3), count(*) FROM (
  SELECT DISTINCT hadm_id, upper(regexp_replace(replace(icd_code, '.', ''), '^\\s+|\\s+$', '', 'g')) AS code, icd_version FROM diagnoses WHERE hadm_id IS NOT NULL)
WHERE code <> '' GROUP BY ALL""",
}
