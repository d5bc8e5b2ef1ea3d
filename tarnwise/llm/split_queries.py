"""Queries on grouped splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.llm import splits
from tarnwise.sources.catalog import table


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return splits.groups(splits.record_keys(table(spark, d, "ehrqa_eval"), table(spark, d, "router_train_examples"), table(spark, d, "diagnoses")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose group has two or more records."""
    x = _grouped(spark, d)
    many = x.groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group_key")
    return x.join(many, "group_key", "left_semi").select("record_id", "group_key")


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    """The split of every record."""
    x = _grouped(spark, d)
    return x.join(splits.assign(x, table(spark, d, "split_targets")), "group_key").select("record_id", "source", "group_key", "split_name")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records, groups and actual share of each split beside its target."""
    got = p1_split(spark, d).groupBy("split_name").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("group_key").alias("n_groups"))
    total = got.agg(F.sum("n_records").alias("total"))
    return table(spark, d, "split_targets").join(got, "split_name", "left").crossJoin(F.broadcast(total)).select("split_name", "proportion", F.coalesce("n_records", F.lit(0)).alias("n_records"), "n_groups", (F.col("n_records") / F.col("total")).alias("share"))


QUERIES = {"p1_found": p1_found, "p1_split": p1_split, "p1_shares": p1_shares}
SQL = {
    "p1_found": """
WITH RECURSIVE dx AS (SELECT hadm_id, min(subject_id) AS s FROM diagnoses WHERE hadm_id IS NOT NULL AND subject_id IS NOT NULL GROUP BY hadm_id),
rec AS (
  SELECT qa_id AS record_id, dx.s AS subject, nullif(lower(trim(regexp_replace(kg_disease, '\\s+', ' ', 'g'))), '') AS kg FROM ehrqa_eval LEFT JOIN dx USING (hadm_id)
  UNION ALL SELECT example_id, coalesce(subject_id, dx.s), NULL FROM router_train_examples LEFT JOIN dx USING (hadm_id)),
link AS (SELECT DISTINCT subject, kg FROM rec WHERE subject IS NOT NULL AND kg IS NOT NULL),
edge AS (SELECT DISTINCT a.kg AS a, b.kg AS b FROM link a JOIN link b USING (subject)),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
kgroot AS (SELECT a AS kg, min(b) AS root FROM reach GROUP BY a),
subroot AS (SELECT subject, min(root) AS root FROM link JOIN kgroot USING (kg) GROUP BY subject),
keyed AS (
  SELECT record_id, CASE WHEN rec.kg IS NOT NULL THEN 'kg:' || coalesce(k.root, rec.kg) WHEN s.root IS NOT NULL THEN 'kg:' || s.root WHEN rec.subject IS NOT NULL THEN 'subject:' || rec.subject END AS group_key
  FROM rec LEFT JOIN kgroot k ON rec.kg = k.kg LEFT JOIN subroot s ON rec.subject = s.subject)
SELECT record_id, group_key FROM keyed WHERE group_key IN (SELECT group_key FROM keyed GROUP BY group_key HAVING count(*) > 1)""",
}
