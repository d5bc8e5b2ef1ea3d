"""Vector search: exact and by inverted lists, and a deterministic text embedding."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def embed_text(df: DataFrame, key: str, text: str, dim: int = 128, prefix: str = "") -> DataFrame:
    """(key, embedding): hashed term frequencies of unit length; the default where no model is plugged in. Empty and null texts give the zero vector."""
    tokens = F.regexp_extract_all(F.lower(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    pairs = df.select(key, F.explode_outer(tokens).alias("t")).withColumn("i", F.pmod(F.xxhash64("t"), F.lit(dim)).cast("int"))
    counts = pairs.groupBy(key, "i").agg(F.count("t").alias("c")).filter("i is not null")
    norm = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("c").cast("double")))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)).cast("float"))
    return df.select(key).join(norm, key, "left").select(key, F.coalesce(vec, F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"))


def knn_exact(queries: DataFrame, base: DataFrame, k: int = 5, block_rows: int = 4096) -> DataFrame:
    """(q_id, vec_id, score, rank): the `k` rows of `base` of largest inner product for each query.

    queries: q_id, q; base: vec_id, embedding. Queries go round in blocks of at most
    `block_rows` rows, each a bounded broadcast; a block meets the base by matrix products
    on the scan's own partitions, which send on k rows a query only. Ties go to the lesser
    vec_id. Null vectors are left out.
    """
    spark = base.sparkSession
    rows = queries.filter("q is not null").select("q_id", "q")
    id_type, vec_type = queries.schema["q_id"].dataType.simpleString(), base.schema["vec_id"].dataType.simpleString()
    schema = f"q_id {id_type}, vec_id {vec_type}, score double"
    blocks = max(1, math.ceil(rows.count() / block_rows))
    numbered = rows.withColumn("_b", F.pmod(F.xxhash64("q_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        pdf = numbered.filter(F.col("_b") == b).select("q_id", "q").toPandas()
        shared = spark.sparkContext.broadcast((pdf["q_id"].to_numpy(), np.stack(pdf["q"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 1))))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best: list[list] = [[] for _ in ids]
            for pdf in batches:
                pdf = pdf[pdf["embedding"].notna()]
                if not len(pdf) or not len(ids):
                    continue
                scores = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) @ q.T
                vec = pdf["vec_id"].to_numpy()
                for j in range(len(ids)):
                    s = scores[:, j]
                    top = np.argpartition(-s, min(k, len(s) - 1))[: k + 1] if len(s) > k + 1 else np.arange(len(s))
                    floor = np.sort(s[top])[::-1][min(k, len(top)) - 1]
                    near = np.flatnonzero(s >= floor)  # with its ties
                    best[j] = heapq.nlargest(k, best[j] + [(float(s[i]), -vec[i]) for i in near])
            rows = [(ids[j], -v, s) for j in range(len(ids)) for s, v in best[j]]
            yield pd.DataFrame(rows, columns=["q_id", "vec_id", "score"])

        part = base.select("vec_id", "embedding").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def coarse_lists(base: DataFrame, sample_rows: int = 20_000, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Centroids of an inverted-list index: min(floor(sqrt n), 256) of them, fitted on at most `sample_rows` rows chosen by hash."""
    n = base.count()
    lists = max(1, min(int(math.sqrt(n)), 256))
    pdf = base.filter("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(sample_rows).select("embedding").toPandas()
    x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / (np.linalg.norm(m) or 1.0)
    return c


def with_list(df: DataFrame, vector: str, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """`df` with column `lists`: the `probes` nearest lists of each row's vector."""

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(list(np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return df.filter(F.col(vector).isNotNull()).withColumn("lists", nearest(vector))


def enough_probes(queries: DataFrame, base: DataFrame, centroids: np.ndarray, k: int = 5, target: float = 0.95, sample: int = 256) -> int:
    """Least number of lists that holds a share `target` of the true neighbours, measured by `knn_exact` for `sample` queries chosen by hash.

    The default of 0.95 leaves room above a recall of 0.9 for the queries not sampled.
    """
    some = queries.filter("q is not null").orderBy(F.xxhash64("q_id"), "q_id").limit(sample)
    truth = knn_exact(some, base, k).select("q_id", "vec_id")
    pdf = truth.join(some, "q_id").join(base.select("vec_id", "embedding"), "vec_id").select("q", "embedding").toPandas()
    if not len(pdf):
        return 1
    q, x = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("q", "embedding"))
    at = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, 0]
    order = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
    needed = np.sort((order == at[:, None]).argmax(1) + 1)
    return int(needed[math.ceil(target * len(needed)) - 1])


def knn_ivf(queries: DataFrame, base: DataFrame, k: int = 5, probes: int | None = None, centroids: np.ndarray | None = None) -> DataFrame:
    """Approximate `knn_exact`: only the lists nearest to a query are searched, by an equi-join on the list.

    Every row of the base is in one list. probes defaults to what `enough_probes`
    measures, and min(lists, 16) at least. Compare with `knn_exact` by recall.
    """
    c = coarse_lists(base) if centroids is None else centroids
    p = max(min(len(c), 16), enough_probes(queries, base, c, k)) if probes is None else probes
    b = with_list(base.select("vec_id", "embedding"), "embedding", c).select("vec_id", "embedding", F.col("lists")[0].alias("list"))
    q = with_list(queries.select("q_id", "q"), "q", c, p).select("q_id", "q", F.explode("lists").alias("list"))
    scored = b.join(q, "list").select("q_id", "vec_id", dot(F.col("q"), F.col("embedding")).alias("score"))
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of `truth` pairs (q_id, vec_id) that are in `found`."""
    n = truth.count()
    return truth.join(found.select("q_id", "vec_id"), ["q_id", "vec_id"], "left_semi").count() / n if n else 1.0
