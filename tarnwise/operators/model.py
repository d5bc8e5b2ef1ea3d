"""A router trained on question vectors and record features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwise.operators.sampling import unit_hash


def features(df: DataFrame, numeric: Sequence[str], vector: str | None = None) -> DataFrame:
    """`df` with a `features` vector: numbers (null as 0) scaled to mean 0 and deviation 1, then the array column `vector`."""
    x = df.fillna(0, list(numeric)).select("*", *[F.col(c).cast("double").alias(f"_{c}") for c in numeric])
    if vector:
        x = x.withColumn("_vec", array_to_vector(F.col(vector)))
    raw = VectorAssembler(inputCols=[f"_{c}" for c in numeric], outputCol="_num", handleInvalid="keep")
    scale = StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)
    both = VectorAssembler(inputCols=["_scaled", *(["_vec"] if vector else [])], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[raw, scale, both]).fit(x).transform(x).drop("_num", "_scaled", "_vec", *[f"_{c}" for c in numeric])


def balanced(df: DataFrame, label: str) -> DataFrame:
    """`df` with `weight`: rows over classes times the class's rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n, k = df.count(), counts.count()
    return df.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(n)) / (F.lit(float(k)) * F.col("_n"))).drop("_n")  # one row a class


def train(df: DataFrame, label: str = "label", trees: int = 60, depth: int = 6, seed: int = 42) -> PipelineModel:
    """A balanced random forest on `features`; label: 0, 1, ..."""
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[forest]).fit(balanced(df, label))


def train_boosted(df: DataFrame, label: str = "label", rounds: int = 20, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Balanced boosted trees on `features`, one class against the rest."""
    trees = GBTClassifier(featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed)
    many = OneVsRest(classifier=trees, labelCol=label, featuresCol="features", weightCol="weight")
    return Pipeline(stages=[many]).fit(balanced(df, label))


def scores(df: DataFrame, truth: str, guess: str) -> dict[str, float]:
    """Accuracy, balanced accuracy, macro precision, recall and F1, and weighted F1, from one confusion aggregate."""
    cells = {(r[truth], r[guess]): r["n"] for r in df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted({k for pair in cells for k in pair})
    n = sum(cells.values()) or 1
    per = []
    for c in labels:
        tp = cells.get((c, c), 0)
        real, said = sum(v for (t, _), v in cells.items() if t == c), sum(v for (_, g), v in cells.items() if g == c)
        p, r = tp / said if said else 0.0, tp / real if real else 0.0
        per.append((p, r, 2 * p * r / (p + r) if p + r else 0.0, real))
    seen = [x for x in per if x[3]] or [(0.0, 0.0, 0.0, 0)]
    k = len(per) or 1
    return {
        "accuracy": sum(cells.get((c, c), 0) for c in labels) / n, "balanced_accuracy": sum(x[1] for x in seen) / len(seen), "macro_precision": sum(x[0] for x in per) / k,
        "macro_recall": sum(x[1] for x in per) / k, "macro_f1": sum(x[2] for x in per) / k, "weighted_f1": sum(x[2] * x[3] for x in per) / n,
    }


def random_settings(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """`n` different settings drawn from a space of values, or all of them where there are no more."""
    import itertools
    import random

    every = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def search(df: DataFrame, key: str, label: str, grid: Sequence[dict], folds: int = 5, seed: int = 42, fit=train) -> tuple[dict, list[dict]]:
    """The settings of best mean macro-F1 over folds drawn within each label by hash, and every setting's mean."""
    x = df.withColumn("_fold", F.pmod(F.xxhash64(F.col(key), F.col(label), F.lit(seed)), F.lit(folds)).cast("int")).cache()
    tried = []
    for g in grid:
        got = [scores(fit(x.filter(F.col("_fold") != f), label, seed=seed, **g).transform(x.filter(F.col("_fold") == f)), label, "prediction")["macro_f1"] for f in range(folds)]
        tried.append({**g, "macro_f1": sum(got) / len(got)})
    x.unpersist()
    return max(tried, key=lambda t: t["macro_f1"]), tried


def permutation_importance(model: PipelineModel, df: DataFrame, label: str, key: str, groups: dict[str, Sequence[str]], make, seed: int = 3) -> dict[str, float]:
    """Loss of accuracy when a group of columns is exchanged between rows in hash order; `make` builds features from columns.

    Rows are paired through their hash within 1024 ranges, so no task orders them all.
    """
    from pyspark.sql import Window

    base = scores(model.transform(make(df)), label, "prediction")["accuracy"]
    out = {}
    for name, cols in groups.items():
        h = F.xxhash64(F.col(key), F.lit(seed), F.lit(name))
        shift = Window.partitionBy(F.pmod(h, F.lit(1024))).orderBy(h)
        mixed = df.withColumns({c: F.coalesce(F.lead(c).over(shift), F.first(c).over(shift)) for c in cols})
        out[name] = base - scores(model.transform(make(mixed)), label, "prediction")["accuracy"]
    return out


def ranked_features(importance: dict[str, float]) -> list[tuple[str, float, int]]:
    """(feature, importance, rank), the greatest first and ties by name."""
    order = sorted(importance.items(), key=lambda kv: (-kv[1], kv[0]))
    return [(name, value, i + 1) for i, (name, value) in enumerate(order)]


def deletion_curve(model: PipelineModel, df: DataFrame, ranked: Sequence[str], make, steps: Sequence[int], seed: int = 3) -> list[dict]:
    """How far the probability of the predicted class falls when columns are set to their means: the k first of `ranked`, and k drawn at random.

    The mean of the falls over `steps` is the area over the perturbation curve.
    """
    import random

    means = df.agg(*[F.avg(c).alias(c) for c in ranked]).first()
    base = model.transform(make(df)).select("_row", F.col("prediction").alias("_said"), F.array_max(vector_to_array("probability")).alias("_was"))

    def fall(cols: Sequence[str]) -> tuple[float, float]:
        gone = model.transform(make(df.withColumns({c: F.lit(means[c]).cast("double") for c in cols}))).select("_row", "prediction", vector_to_array("probability").alias("_p"))
        x = base.join(gone, "_row")
        r = x.agg(F.avg(F.col("_was") - F.get("_p", F.col("_said").cast("int"))), F.avg((F.col("prediction") != F.col("_said")).cast("double"))).first()
        return float(r[0] or 0.0), float(r[1] or 0.0)

    rnd, out = random.Random(seed), []
    for k in steps:
        (top, flips), (other, _) = fall(list(ranked)[:k]), fall(rnd.sample(list(ranked), min(k, len(ranked))))
        out.append({"k": k, "drop_top": top, "flips_top": flips, "drop_random": other})
    return out


def seed_variance(train_df: DataFrame, test_df: DataFrame, label: str, seeds: Sequence[int], **how) -> list[dict]:
    """Scores of models that differ in their seed only; `how` goes to `train`."""
    return [{"seed": s, **scores(train(train_df, label, seed=s, **how).transform(test_df), label, "prediction")} for s in seeds]
