"""Queries on items that appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.llm import cooccurrence as co
from tarnwise.sources.catalog import table


def _counts(spark: SparkSession, d: str) -> DataFrame:
    dx = table(spark, d, "diagnoses")
    x = co.pair_counts(co.disease_baskets(dx, table(spark, d, "seed_diseases")), co.lab_baskets(table(spark, d, "labs"), table(spark, d, "d_labitems")), dx.select(F.col("hadm_id").alias("basket")))
    return x.withColumnsRenamed({"left_item": "disease", "right_item": "lab_test"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs found together often enough and at least twice as often as chance."""
    x = _counts(spark, d)
    return x.filter((F.col("both") >= 5) & (F.col("both") * 200 >= F.col("n_baskets")) & (F.col("both") * F.col("n_baskets") >= 2 * F.col("n_left") * F.col("n_right"))).select("disease", "lab_test")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its counts, frequency within the disease and ratio to chance."""
    return _counts(spark, d).select(
        "disease", "lab_test", F.col("both").alias("n_admissions_with_lab"), F.col("n_left").alias("total_admissions"), F.round("frequency", 6).alias("frequency"), F.round("lift", 6).alias("lift")
    )


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs}
_BASE = """
WITH dx AS (SELECT DISTINCT hadm_id, icd_version AS v, upper(regexp_replace(replace(icd_code, '.', ''), '^\\s+|\\s+$', '', 'g')) AS code FROM diagnoses WHERE hadm_id IS NOT NULL),
n AS (SELECT count(DISTINCT hadm_id) AS n FROM diagnoses),
dis AS (SELECT DISTINCT hadm_id, name AS disease FROM dx JOIN seed_diseases s ON (v = 9 AND starts_with(code, s.icd9_prefix)) OR (v = 10 AND starts_with(code, s.icd10_prefix))),
lab AS (SELECT DISTINCT hadm_id, trim(d.label) AS lab_test FROM labs JOIN d_labitems d USING (itemid) WHERE length(trim(d.label)) > 0 AND hadm_id IN (SELECT hadm_id FROM diagnoses)),
nd AS (SELECT disease, count(*) AS nd FROM dis GROUP BY disease), nl AS (SELECT lab_test, count(*) AS nl FROM lab GROUP BY lab_test),
pairs AS (SELECT disease, lab_test, count(*) AS n_both FROM dis JOIN lab USING (hadm_id) GROUP BY ALL),
x AS (SELECT * FROM pairs JOIN nd USING (disease) JOIN nl USING (lab_test), n)
"""
SQL = {
    "p3_found": _BASE + "SELECT disease, lab_test FROM x WHERE n_both >= 5 AND n_both * 200 >= n AND n_both * n >= 2 * nd * nl",
    "p3_pairs": _BASE + "SELECT disease, lab_test, n_both AS n_admissions_with_lab, nd AS total_admissions, round(n_both / nd, 6) AS frequency, round(n_both * n / (nd * nl), 6) AS lift FROM x",
}
