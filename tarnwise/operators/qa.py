"""Question and answer pairs from snapshots and graph edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.operators.sampling import order_hash

# Question types taken from a snapshot, with their wordings.
TEMPLATES = {
    "primary_diagnosis": ["What is the primary diagnosis for this patient?", "Which condition was the admission mainly for?"],
    "diagnoses": ["Which conditions were diagnosed in this admission?", "List the diagnoses recorded for this patient."],
    "lab": ["Which lab value of this patient is the most abnormal?", "Which lab abnormality matters most in this admission?"],
    "medication": ["Which medications were given in this admission?", "Which discharge medications does the patient have?"],
    "summary": ["Give a short clinical summary of this case.", "Summarise this admission in one sentence."],
    "next_step": ["What is the next clinical step for this patient?", "Which follow-up is fitting after discharge?"],
}
NOTHING = {"primary_diagnosis": "No diagnosis is recorded.", "diagnoses": "No diagnosis is recorded.", "lab": "No lab value is recorded.", "medication": "No medication is recorded.", "summary": "No data is recorded.", "next_step": "Follow up with the treating team."}


def extractive(snapshots: DataFrame, seed: int = 42) -> DataFrame:
    """One question of each type an admission, worded by hash, answered from its fields.

    snapshots: hadm_id, diagnoses array<string>, labs array<string> (most telling first),
    medications array<string>. Types are a literal array that is exploded: no join, no shuffle.
    """
    types = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*map(F.lit, w)).alias("w"), F.lit(NOTHING[t]).alias("none")) for t, w in TEMPLATES.items()])
    x = snapshots.withColumn("q", F.explode(types))
    pick = F.conv(F.substring(order_hash(F.concat_ws("|", "hadm_id", "q.t"), seed), 1, 6), 16, 10).cast("int") % F.size("q.w")
    filled = lambda c, n: F.when(F.size(c) > 0, F.concat(F.array_join(F.slice(c, 1, n), "; "), F.lit(".")))
    t = F.col("q.t")
    answer = (
        F.when(t == "primary_diagnosis", filled("diagnoses", 1)).when(t == "diagnoses", filled("diagnoses", 5)).when(t == "lab", filled("labs", 1)).when(t == "medication", filled("medications", 10))
        .when(t == "summary", F.when(F.size("diagnoses") > 0, F.concat(F.lit("Admitted with "), F.element_at("diagnoses", 1), F.when(F.size("labs") > 0, F.concat(F.lit("; notable "), F.element_at("labs", 1))).otherwise(""), F.lit("."))))
    )
    return x.select("hadm_id", t.alias("question_type"), F.get("q.w", pick).alias("question"), F.coalesce(answer, F.col("q.none")).alias("answer"))


def monitoring(cohorts: DataFrame, edges: DataFrame, lab_names: DataFrame, covered_from: float = 0.8) -> DataFrame:
    """Monitoring questions with how far the record covers the answer.

    cohorts: name, entity; edges: src, dst, ord (the labs a disease calls for); lab_names:
    entity, names array<string>, the admission's own distinct labs. A lab is covered when
    either name holds the other, whatever the case.
    """
    want = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("labs"))
    x = cohorts.join(want, F.col("name") == F.col("src")).join(lab_names, "entity", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    near = lambda a, b: F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))
    share = F.size(F.filter("labs", lambda a: F.exists("names", lambda b: near(a, b)))) / F.size("labs")
    return x.select(
        F.col("entity").alias("hadm_id"), F.lit("monitoring_labs").alias("question_type"), F.concat(F.lit("Which laboratory tests should be followed for this patient's "), "name", F.lit("?")).alias("question"),
        F.concat(F.array_join("labs", ", "), F.lit(".")).alias("answer"), F.col("name").alias("kg_disease"), (share >= covered_from).cast("int").alias("ehr_covers_answer"), F.round(share, 3).alias("ehr_lab_coverage"),
    )


def symptoms(cohorts: DataFrame, edges: DataFrame) -> DataFrame:
    """Questions on the symptoms a disease is known for."""
    want = edges.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]), ", ").alias("list"))
    return cohorts.join(want, F.col("name") == F.col("src")).select(
        F.col("entity").alias("hadm_id"), F.lit("expected_symptoms").alias("question_type"), F.concat(F.lit("Which symptoms go with this patient's "), "name", F.lit("?")).alias("question"), F.concat("list", F.lit(".")).alias("answer"), F.col("name").alias("kg_disease"),
    )


def contraindication(cohorts: DataFrame, bad: DataFrame, good: DataFrame, seed: int = 42) -> DataFrame:
    """Questions on a drug's fitness: an unfit one for about half of the pairs, where there are both. bad, good: src, dst; the drug is picked by hash."""
    arrays = lambda df, n: df.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias(n))
    x = cohorts.join(arrays(bad, "bad").withColumnRenamed("src", "name"), "name", "left").join(arrays(good, "good").withColumnRenamed("src", "name"), "name", "left")
    x = x.filter("bad is not null or good is not null").withColumn("_h", F.conv(F.substring(order_hash(F.concat_ws("|", "entity", "name"), seed), 1, 8), 16, 10).cast("long"))
    unfit = F.col("bad").isNotNull() & (F.col("good").isNull() | (F.col("_h") % 2 == 0))
    options = F.when(unfit, F.col("bad")).otherwise(F.col("good"))
    x = x.withColumn("unfit", unfit).withColumn("drug", F.get(options, ((F.col("_h") / 2).cast("long") % F.size(options)).cast("int")))
    answer = F.when(F.col("unfit"), F.concat(F.lit("No, "), "drug", F.lit(" is contraindicated in "), "name", F.lit("."))).otherwise(F.concat(F.lit("Yes, "), "drug", F.lit(" is a usual treatment of "), "name", F.lit(".")))
    return x.select(F.col("entity").alias("hadm_id"), F.lit("contraindication_check").alias("question_type"), F.concat(F.lit("Is "), "drug", F.lit(" fit for this patient's "), "name", F.lit("?")).alias("question"), answer.alias("answer"), F.col("name").alias("kg_disease"))


def quota(qa: DataFrame, group: str, per_entity: int, total: int | None = None, seed: int = 42) -> DataFrame:
    """Distinct (hadm_id, question, answer) rows, at most `per_entity` of each group an admission, then the first `total` in hash order."""
    rows = qa.dropDuplicates(["hadm_id", "question", "answer"]).withColumn("_h", order_hash(F.concat_ws("|", "hadm_id", "question", "answer"), seed))
    w = Window.partitionBy("hadm_id", group).orderBy("_h")
    kept = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_entity).drop("_r")
    return (kept.orderBy("_h").limit(total) if total is not None else kept).drop("_h")
