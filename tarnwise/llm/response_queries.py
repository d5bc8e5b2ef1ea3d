"""Queries on prompt and response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.llm import responses
from tarnwise.sources.catalog import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers and their defect."""
    rows = table(spark, d, "per_question_results").select(F.col("result_id").alias("id"), "question", "reference", F.col("predicted_answer").alias("answer"))
    return responses.find_defects(rows).select(F.col("id").alias("result_id"), "defect")


def p6_by_system(spark: SparkSession, d: str) -> DataFrame:
    """Defects of each system."""
    rows = table(spark, d, "per_question_results").select("result_id", "system")
    return rows.join(p6_found(spark, d), "result_id", "left").groupBy("system", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p6_found": p6_found, "p6_by_system": p6_by_system}
SQL: dict[str, str] = {}
