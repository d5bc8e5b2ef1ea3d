"""Queries on records that stand in two splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.llm import overlap
from tarnwise.sources.catalog import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an evaluation and a fine-tuning row that agree up to writing."""
    side = lambda name: table(spark, d, name).select(F.col("qa_id").alias("id"), F.col("question").alias("a"), F.col("answer").alias("b"))
    return overlap.find_overlaps(side("ehrqa_eval"), side("ehrqa_finetune")).select(F.col("eval_id").alias("eval_qa_id"), F.col("train_id").alias("finetune_qa_id"))


def p7_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source: rows, rows with a counterpart in the other split, and pairs."""
    pairs = p7_found(spark, d)
    out = None
    for split, name, key in (("eval", "ehrqa_eval", "eval_qa_id"), ("finetune", "ehrqa_finetune", "finetune_qa_id")):
        per_row = pairs.groupBy(F.col(key).alias("qa_id")).agg(F.count(F.lit(1)).alias("n"))
        part = table(spark, d, name).select("qa_id", "source").join(per_row, "qa_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
        part = part.select(F.lit(split).alias("split"), "*")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"p7_found": p7_found, "p7_by_source": p7_by_source}
SQL: dict[str, str] = {}
