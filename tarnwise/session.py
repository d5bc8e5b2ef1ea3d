"""Session defaults, shared checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings an engine session starts with; callers may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Rows up to which a dimension is sent to every executor.
BROADCAST_ROWS = 200_000


def session(master: str = "local[*]", app: str = "tarnwise", **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster without that path, ship the package with --py-files instead; this then does no harm.
    """
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: `spark.checkpoint.dir`, or a temporary one where that is unset and all runs in one process.

    On a cluster the setting must name a folder all executors share; without it this raises.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tarnwise-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` as a local relation with a broadcast hint when it is proven to hold at most `rows` rows, else `df`.

    The proof evaluates at most `rows` + 1 rows, once, and they become the local
    relation. Above the bound the plan is left to AQE, which shuffles and splits
    skewed keys, so the result is the same at any size.
    """
    head = df.limit(rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema)) if head.num_rows <= rows else df
