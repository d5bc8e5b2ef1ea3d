"""Queries on tokens, mixtures and cut texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.llm import mixture, tokens, truncation
from tarnwise.session import cut_lineage
from tarnwise.sources.catalog import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens; empty and null texts have none."""
    return tokens.encode(table(spark, d, "documents"), "doc_id").select("doc_id", "ids")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document; written once, since a mixture reads them several times."""
    docs = table(spark, d, "documents")
    keyed = docs.withColumn("key", F.struct("doc_id", "source")).select("key", "text")
    return cut_lineage(tokens.encode(keyed, "key", ids=False).select("key.doc_id", "key.source", "n_tokens"))


def p8_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens of each source."""
    return _sizes(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of each document in the largest mixture that meets every weight."""
    return mixture.mix(_sizes(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual share of each source in that mixture."""
    return mixture.mix(_sizes(spark, d), table(spark, d, "mix_targets"))[1]


def p9_shares_whole(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares when the mixture is to have as many tokens as the target sources hold; small sources fall short at their repeats."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    total = sizes.join(targets, "source", "left_semi").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return mixture.mix(sizes, targets, total=total)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text breaks off."""
    return truncation.find_cut(table(spark, d, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each source's rate of cut texts."""
    docs = table(spark, d, "documents")
    return truncation.rates(docs, truncation.find_cut(docs))


QUERIES = {"p8_ids": p8_ids, "p8_sizes": p8_sizes, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shares_whole": p9_shares_whole, "p10_found": p10_found, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
