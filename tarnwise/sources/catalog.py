"""The table lake: Parquet scans, CSV ingest, sinks and schema probing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan of one lake table (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, required: Iterable[str], optional: Iterable[str] = ()) -> dict[str, bool]:
    """Register views; a missing required table raises, a missing optional one is reported as False."""
    present: dict[str, bool] = {}
    for name in required:
        if not _exists(spark, f"{folder}/{name}.parquet"):
            raise FileNotFoundError(f"required table {name} is not in {folder}")
        table(spark, folder, name).createOrReplaceTempView(name)
        present[name] = True
    for name in optional:
        present[name] = _exists(spark, f"{folder}/{name}.parquet")
        if present[name]:
            table(spark, folder, name).createOrReplaceTempView(name)
    return present


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def pick(df: DataFrame, candidates: Iterable[str]) -> Column:
    """First of `candidates` that `df` has (case-insensitive), else a null column."""
    name = pick_name(df, candidates)
    return F.col(f"`{name}`") if name else F.lit(None)


def pick_name(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """Name of the first candidate column that exists, or None."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def ingest_csv(spark: SparkSession, path: str, out: str, schema: T.StructType, columns: Iterable[str] | None = None) -> dict[str, int]:
    """CSV (gz too) to ZSTD Parquet with a declared schema; returns written and malformed row counts.

    Malformed rows go to `<out>_bad` rather than vanish.
    """
    bad = "_malformed"
    raw = spark.read.csv(
        path,
        schema=T.StructType([*schema.fields, T.StructField(bad, T.StringType())]),
        header=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=bad,
    )
    keep = list(columns) if columns is not None else [f.name for f in schema.fields]
    # A CSV scan finds only malformed values of columns it is asked for, so all columns are parsed once, and split after.
    stage = f"{out}_stage"
    raw.write.mode("overwrite").parquet(stage)
    parsed = spark.read.parquet(stage)
    parsed.filter(F.col(bad).isNull()).select(*keep).write.mode("overwrite").option("compression", "zstd").parquet(out)
    parsed.filter(F.col(bad).isNotNull()).write.mode("overwrite").parquet(f"{out}_bad")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return {"rows": spark.read.parquet(out).count(), "malformed": spark.read.parquet(f"{out}_bad").count()}


def ingest_all(spark: SparkSession, specs: Mapping[str, tuple[str, T.StructType, list[str] | None]], out: str) -> dict[str, dict[str, int]]:
    """`ingest_csv` for each table name -> (path, schema, columns)."""
    return {name: ingest_csv(spark, path, f"{out}/{name}.parquet", schema, cols) for name, (path, schema, cols) in specs.items()}


def frame_view(spark: SparkSession, rows: list[tuple], schema: str, name: str) -> DataFrame:
    """Register an in-memory relation under `name`."""
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df


def distinct_ids(spark: SparkSession, pattern: str, column: str) -> DataFrame:
    """Distinct non-null ids over all files matching a glob."""
    return spark.read.parquet(pattern).select(column).dropna().distinct()


def write_both(df: DataFrame, stem: str) -> None:
    """Write `stem`.parquet and `stem`.csv from one evaluation of `df`."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{stem}.parquet")
    df.sparkSession.read.parquet(f"{stem}.parquet").write.mode("overwrite").option("header", True).csv(f"{stem}.csv")


def resolve_path(candidates: Iterable[str]) -> str:
    """First existing path of `candidates`."""
    tried = list(candidates)
    for path in tried:
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"none of {tried} exists")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Read by suffix: .parquet, .csv (also .csv.gz), .json/.jsonl."""
    name = path.lower().removesuffix(".gz")
    kind = Path(name).suffix
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if kind in (".json", ".jsonl"):
        return spark.read.json(path)
    raise ValueError(f"unknown format: {path}")


EDGE_SCHEMA = "disease string, edge_type string, target string, target_type string, notes string"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge CSV with declared schema; blank notes become null."""
    df = spark.read.csv(path, schema=EDGE_SCHEMA, header=True)
    return df.withColumn("notes", F.when(F.length(F.trim("notes")) > 0, F.col("notes")))


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Resume: append only rows whose keys are not yet stored at `path`; returns the full table."""
    spark = df.sparkSession
    fresh = df
    if _exists(spark, path):
        fresh = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_json(obj: object, path: str) -> None:
    """Small artefact sink, written beside and renamed so that no reader sees half a file."""
    import json

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(obj, indent=2, sort_keys=True, default=str))
    part.replace(target)
