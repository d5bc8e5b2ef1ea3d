"""Entity snapshots, record sparsity and item frequency by cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.functions.clinical import is_number

# Thresholds and weights of the sparsity score.
TAU_LABS, TAU_DIAG, TAU_DAYS = 5, 3, 7
ALPHAS = (1.0, 1.0, 1.0)
HIGH, MEDIUM = 2, 1
NO_NOTE_DAYS = 999


def note_age(last_note: Column, reference: Column) -> Column:
    """Days from the last note to the reference date, not below 0; NO_NOTE_DAYS without a note. The null test comes before the clamp, since greatest(null, 0) is 0."""
    days = F.datediff(F.to_date(reference), F.to_date(last_note))
    return F.when(last_note.isNull(), F.lit(NO_NOTE_DAYS)).otherwise(F.coalesce(F.greatest(days, F.lit(0)), F.lit(NO_NOTE_DAYS)))


def sparsity(cohort: DataFrame, labs: DataFrame, diagnoses: DataFrame, notes: DataFrame, ends: DataFrame, taus: tuple[int, int, int] = (TAU_LABS, TAU_DIAG, TAU_DAYS), alphas: tuple[float, float, float] = ALPHAS) -> DataFrame:
    """Sparsity of each entity of `cohort` (hadm_id): counts, indicators, score and bucket.

    labs: hadm_id, itemid; diagnoses: hadm_id, icd_code; notes and ends: hadm_id,
    charttime. Each side is reduced to one row an entity with map-side combining before
    the chain of joins, which share one partitioning.
    """
    one = cohort.select("hadm_id").filter("hadm_id is not null").distinct()
    n_labs = labs.groupBy("hadm_id").agg(F.countDistinct("itemid").alias("n_labs"))
    n_diag = diagnoses.groupBy("hadm_id").agg(F.countDistinct("icd_code").alias("n_diag"))
    last = notes.groupBy("hadm_id").agg(F.max("charttime").alias("_note"))
    end = ends.groupBy("hadm_id").agg(F.max("charttime").alias("_end"))
    x = one.join(n_labs, "hadm_id", "left").join(n_diag, "hadm_id", "left").join(last, "hadm_id", "left").join(end, "hadm_id", "left").fillna(0, ["n_labs", "n_diag"])
    x = x.withColumn("d_note", note_age(F.col("_note"), F.col("_end")).cast("int"))
    flags = {"sparse_labs": F.col("n_labs") < taus[0], "sparse_diag": F.col("n_diag") < taus[1], "sparse_note": F.col("d_note") > taus[2]}
    x = x.withColumns({k: v.cast("int") for k, v in flags.items()})
    score = sum(F.lit(a) * F.col(k) for a, k in zip(alphas, flags))
    bucket = F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
    return x.select("hadm_id", "n_labs", "n_diag", "d_note", *flags, F.round(score, 2).alias("sparsity_score"), bucket.alias("sparsity_bucket"))


def snapshot_labs(labs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The `n` most telling labs of each admission: one row a label, abnormal before normal, newest first."""
    named = labs.filter("hadm_id is not null").filter(is_number(F.col("valuenum"))).join(items.select("itemid", F.trim("label").alias("name")).filter(F.length("name") > 0).distinct(), "itemid")
    abnormal = (F.col("flag") == "abnormal") & F.col("flag").isNotNull()
    rank = [F.when(abnormal, 0).otherwise(1), F.col("charttime").desc_nulls_last(), F.col("labevent_id")]
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("hadm_id", "name").orderBy(*rank))).filter("_r = 1")
    out = first.withColumn("rn", F.row_number().over(Window.partitionBy("hadm_id").orderBy(*rank[:2], "name"))).filter(F.col("rn") <= n)
    return out.select("hadm_id", "rn", "name", F.col("valuenum").alias("value"), F.trim("valueuom").alias("unit"), F.when(abnormal, "abnormal").otherwise("normal").alias("flag"))


def snapshot_vitals(vitals: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """Latest value of each vital, the `n` newest of an admission."""
    rows = vitals.filter(is_number(F.col("valuenum"))).filter("hadm_id is not null").join(items.select("itemid", F.col("label").alias("name"), "unit"), "itemid")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("hadm_id", "itemid").orderBy(F.col("charttime").desc_nulls_last(), "vital_id"))).filter("_r = 1")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("hadm_id").orderBy(F.col("charttime").desc_nulls_last(), "itemid"))).filter(F.col("rn") <= n)
    return rows.select("hadm_id", "rn", "name", F.col("valuenum").alias("value"), "unit")


def snapshot_diagnoses(diagnoses: DataFrame, n: int = 5) -> DataFrame:
    """First `n` distinct diagnoses of each admission by sequence, those without one last."""
    rows = diagnoses.filter("hadm_id is not null and icd_code is not null").groupBy("hadm_id", F.upper(F.trim("icd_code")).alias("code"), "icd_version").agg(F.min("seq_num").alias("seq_num"))
    w = Window.partitionBy("hadm_id").orderBy(F.col("seq_num").asc_nulls_last(), "code", "icd_version")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("hadm_id", "rn", "code", "icd_version")


def snapshot_text(labs: DataFrame, vitals: DataFrame, diagnoses: DataFrame, buckets: DataFrame, demographics: DataFrame | None = None) -> DataFrame:
    """hadm_id, snapshot_text: the snapshot written out, a line for each part an admission has.

    The parts are the frames of the functions above (at most a few entries an admission);
    demographics: hadm_id, age, gender. An admission without any part but a bucket keeps
    its bucket's line.
    """
    number = lambda c: F.format_string("%.4f", F.col(c))
    line = lambda df, item, head, name: df.groupBy("hadm_id").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("t")))), lambda x: x["t"]), "; "), F.lit(".")).alias(name))
    flag = F.when(F.col("flag") == "abnormal", " [ABNORMAL]").otherwise("")
    parts = [
        line(diagnoses, F.col("code"), "Diagnoses: ", "_dx"),
        line(labs, F.concat("name", F.lit(" "), number("value"), F.coalesce("unit", F.lit("")), flag), "Labs: ", "_labs"),
        line(vitals, F.concat("name", F.lit(" "), number("value"), F.coalesce("unit", F.lit(""))), "Vitals: ", "_vitals"),
        buckets.select("hadm_id", F.concat(F.lit("[EHR Sparsity: "), "sparsity_bucket", F.lit("]")).alias("_bucket")),
    ]
    if demographics is not None:
        who = F.concat(F.lit("Patient: "), F.concat_ws(" ", F.concat(F.nullif(F.col("age"), F.lit(0)).cast("string"), F.lit("-year-old")), "gender"), F.lit("."))
        parts.insert(0, demographics.filter("nullif(age, 0) is not null or gender is not null").select("hadm_id", who.alias("_who")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "hadm_id", "full")
    names = [p.columns[-1] for p in parts]
    return out.select("hadm_id", F.concat_ws("\n", *names).alias("snapshot_text"))


def item_frequency(cohorts: DataFrame, rows: DataFrame, least_cohort: int = 5, least: float = 0.05, top: int = 15) -> DataFrame:
    """Frequency of each item within a cohort: disease, lab_test, n_admissions_with_lab, total_admissions, frequency.

    cohorts: name, entity; rows: entity, item. Cohorts below `least_cohort` are skipped,
    items at or below `least` left out, and each cohort keeps its `top` items.
    """
    size = cohorts.groupBy("name").agg(F.countDistinct("entity").alias("total_admissions")).filter(F.col("total_admissions") >= least_cohort)
    got = cohorts.distinct().join(rows.filter("item is not null").distinct(), "entity").groupBy("name", "item").agg(F.count(F.lit(1)).alias("n_admissions_with_lab"))
    x = got.join(size, "name").withColumn("frequency", F.col("n_admissions_with_lab") / F.col("total_admissions")).filter(F.col("frequency") > least)
    w = Window.partitionBy("name").orderBy(F.col("n_admissions_with_lab").desc(), "item")
    return x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select(F.col("name").alias("disease"), F.col("item").alias("lab_test"), "n_admissions_with_lab", "total_admissions", "frequency")
