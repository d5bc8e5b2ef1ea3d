"""Named lookups, joins, filters and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwise.operators import relational as R
from tarnwise.sources.catalog import table as T


def entity_ids(s: SparkSession, d: str) -> DataFrame:
    """Distinct admissions of the labs table."""
    return T(s, d, "labs").select("hadm_id").distinct()


def demographics(s: SparkSession, d: str) -> DataFrame:
    """Customer of each order, with the segment normalised."""
    c, o = T(s, d, "customer"), T(s, d, "orders")
    seg = F.lower("c_mktsegment")
    label = F.when(seg == "building", "b").when(seg == "machinery", "m").otherwise(F.col("c_mktsegment"))
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey", label.alias("segment"), F.round("c_acctbal", 2).alias("balance"))


def admissions_of(s: SparkSession, d: str) -> DataFrame:
    """Orders of one customer in order of date."""
    return T(s, d, "orders").filter("o_custkey = 7").select("o_orderkey", "o_orderdate", "o_orderstatus").orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey")


def admissions_of_each(s: SparkSession, d: str) -> DataFrame:
    """Orders of every customer, each customer's in order of date."""
    x = T(s, d, "orders").filter("o_custkey is not null").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return x.orderBy("o_custkey", F.col("o_orderdate").asc_nulls_last(), "o_orderkey")


def lab_lookup(s: SparkSession, d: str) -> DataFrame:
    """Labs with their dictionary name, newest three of each admission and item."""
    labs = R.dictionary_join(T(s, d, "labs").filter("hadm_id is not null"), T(s, d, "d_labitems"), ["itemid"], "itemid", "label", "name")
    return R.newest(labs.withColumn("_k", F.concat_ws("|", F.col("hadm_id").cast("string"), F.coalesce(F.col("itemid").cast("string"), F.lit("")))), "_k", "charttime", ["labevent_id"], 3).select("labevent_id", "hadm_id", "name", "rn")


def recent_labs(s: SparkSession, d: str) -> DataFrame:
    """Labs of the last three days before each admission's newest one, the ten newest."""
    return R.newest(T(s, d, "labs").filter("hadm_id is not null and charttime is not null"), "hadm_id", "charttime", ["labevent_id"], 10, last_days=3).select("hadm_id", "labevent_id", "rn")


def dict_left_join_2key(s: SparkSession, d: str) -> DataFrame:
    """Diagnoses with the name of their seed disease, on code stem and version, else the code."""
    seeds = T(s, d, "seed_diseases").select("name", F.explode(F.create_map(F.lit(9), "icd9_prefix", F.lit(10), "icd10_prefix")).alias("icd_version", "stem"))
    dx = T(s, d, "diagnoses").filter("icd_code is not null and hadm_id is not null").withColumn("code", F.upper(F.trim("icd_code"))).withColumn("stem", F.substring("code", 1, 3))
    return R.dictionary_join(dx, seeds, ["stem", "icd_version"], "code", "name", "title").groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hadm_id").alias("n_hadm"))


def notes_newest(s: SparkSession, d: str) -> DataFrame:
    """Five newest notes of each admission with more than 20 characters of text."""
    notes = T(s, d, "documents").filter(F.length(F.trim("text")) > 20).filter("hadm_id is not null")
    return R.newest(notes, "hadm_id", "charttime", ["doc_id"], 5).select("hadm_id", "doc_id", "rn")


def id_filter(s: SparkSession, d: str) -> DataFrame:
    """Vitals of admissions that have an evaluation question."""
    return T(s, d, "vitals").join(T(s, d, "ehrqa_eval").select("hadm_id").dropna().distinct(), "hadm_id", "left_semi").groupBy("itemid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hadm_id").alias("n_hadm"))


def prefix_cohort(s: SparkSession, d: str) -> DataFrame:
    """Admissions of each seed disease by code prefix, whatever the version."""
    seeds = T(s, d, "seed_diseases").select("name", F.explode(F.array("icd9_prefix", "icd10_prefix")).alias("prefix"))
    return R.prefix_cohort(T(s, d, "diagnoses").filter("hadm_id is not null"), seeds, "hadm_id", "icd_code").groupBy("name").agg(F.count(F.lit(1)).alias("n_hadm"))


def prefix_cohort_versioned(s: SparkSession, d: str) -> DataFrame:
    """The same with the code's version."""
    seeds = T(s, d, "seed_diseases").select("name", F.explode(F.create_map(F.lit(9), "icd9_prefix", F.lit(10), "icd10_prefix")).alias("version", "prefix"))
    return R.prefix_cohort(T(s, d, "diagnoses").filter("hadm_id is not null"), seeds, "hadm_id", "icd_code", "icd_version").groupBy("name").agg(F.count(F.lit(1)).alias("n_hadm"))


def failed_rows_dropped(s: SparkSession, d: str) -> DataFrame:
    """Router examples with a usable mode, by mode."""
    x = T(s, d, "router_train_examples").withColumn("m", F.upper(F.trim("mode")))
    return x.filter(~F.col("m").isin("FAILED", "FAILED_GENERATION", "MISSING_MODES")).groupBy(F.col("m").alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def matched_set(s: SparkSession, d: str) -> DataFrame:
    """Result rows of questions for which T, T+E and T+E+K all have a BLEU."""
    x = R.matched_set(T(s, d, "per_question_results"), "q_idx", "system", F.col("bleu").isNotNull() & ~F.isnan("bleu"), ["T", "T+E", "T+E+K"])
    return x.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("q_idx").alias("n_q"))


def left_join_predicate_on(s: SparkSession, d: str) -> DataFrame:
    """Valid lab values per evaluated admission, 0 where there are none."""
    q = T(s, d, "ehrqa_eval").select("hadm_id").dropna().distinct()
    labs = T(s, d, "labs").filter("valuenum is not null").groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n"))
    return q.join(labs, "hadm_id", "left").select("hadm_id", F.coalesce("n", F.lit(0)).alias("n_values"))


def star_left_join(s: SparkSession, d: str) -> DataFrame:
    """Counts of labs, vitals and diagnoses of each evaluated admission; each side is aggregated on the join key first."""
    out = T(s, d, "ehrqa_eval").select("hadm_id").dropna().distinct()
    for name in ("labs", "vitals", "diagnoses"):
        out = out.join(T(s, d, name).groupBy("hadm_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "hadm_id", "left")
    return out.fillna(0)


def fanout_preagg(s: SparkSession, d: str) -> DataFrame:
    """Last note and last lab of each admission, aggregated before the join so that nothing fans out."""
    a = T(s, d, "documents").filter("hadm_id is not null").groupBy("hadm_id").agg(F.max("charttime").alias("last_note"))
    b = T(s, d, "labs").filter("hadm_id is not null").groupBy("hadm_id").agg(F.max("charttime").alias("last_lab"))
    x = a.join(b, "hadm_id")
    return x.select("hadm_id", F.datediff(F.to_date("last_lab"), F.to_date("last_note")).alias("days"))


def first_type_merge(s: SparkSession, d: str) -> DataFrame:
    """Results with the question type of their question, one type a question."""
    types = T(s, d, "per_question_results").filter("question_type is not null").groupBy("q_idx").agg(F.min_by("question_type", "result_id").alias("qtype"))
    return T(s, d, "per_question_results").select("q_idx", "system").join(types, "q_idx", "left").groupBy("qtype", "system").agg(F.count(F.lit(1)).alias("n"))


def refreshed(s: SparkSession, d: str) -> DataFrame:
    """Router examples with n_labs counted anew, 0 where the admission has none."""
    fresh = T(s, d, "labs").filter("hadm_id is not null").groupBy("hadm_id").agg(F.countDistinct("itemid").alias("n_labs"))
    return R.refresh_columns(T(s, d, "router_train_examples").select("example_id", "hadm_id", "n_labs"), fresh, "hadm_id", {"n_labs": 0}).select("example_id", "n_labs")


def anti_join(s: SparkSession, d: str) -> DataFrame:
    """Fine-tuning rows whose admission is not evaluated."""
    x = T(s, d, "ehrqa_finetune").join(T(s, d, "ehrqa_eval").select("hadm_id").dropna().distinct(), "hadm_id", "left_anti")
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def anti_join_one_per_entity(s: SparkSession, d: str) -> DataFrame:
    """One fine-tuning row of each admission that is not evaluated."""
    x = T(s, d, "ehrqa_finetune").filter("hadm_id is not null").join(T(s, d, "ehrqa_eval").select("hadm_id").dropna().distinct(), "hadm_id", "left_anti")
    return x.groupBy("hadm_id").agg(F.min("qa_id").alias("qa_id"))


def split_leakage(s: SparkSession, d: str) -> DataFrame:
    """Admissions that stand in both question sets."""
    both = T(s, d, "ehrqa_eval").select("hadm_id", F.lit("eval").alias("part")).unionByName(T(s, d, "ehrqa_finetune").select("hadm_id", F.lit("finetune").alias("part")))
    return R.leaks(both, "hadm_id", "part")


def union_all(s: SparkSession, d: str) -> DataFrame:
    """Questions of both sets by source and type."""
    both = T(s, d, "ehrqa_eval").unionByName(T(s, d, "ehrqa_finetune"))
    return both.groupBy("source", "question_type").agg(F.count(F.lit(1)).alias("n"))


def distinct_order_limit(s: SparkSession, d: str) -> DataFrame:
    """The first 25 distinct spellings of the sodium label in order."""
    return T(s, d, "labs").filter("itemid = 51101 and length(trim(label)) > 0").select("label").distinct().orderBy("label").limit(25)


def distinct_order_limit_each(s: SparkSession, d: str) -> DataFrame:
    """The first 25 distinct spellings of every item's label in order."""
    x = T(s, d, "labs").filter("itemid is not null and length(trim(label)) > 0").select("itemid", "label").distinct()
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("itemid").orderBy("label"))).filter("rn <= 25")


def null_counts(s: SparkSession, d: str) -> DataFrame:
    """Nulls of each column of the results, one row a column."""
    x = T(s, d, "per_question_results")
    cols = ["hadm_id", "question", "reference", "question_type", "sparsity_bucket", "predicted_answer", "vram_mb"]
    one = x.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "n_null")


QUERIES = {f.__name__: f for f in (
    entity_ids, demographics, admissions_of, admissions_of_each, lab_lookup, recent_labs, dict_left_join_2key, notes_newest, id_filter, prefix_cohort, prefix_cohort_versioned, failed_rows_dropped, matched_set,
    left_join_predicate_on, star_left_join, fanout_preagg, first_type_merge, refreshed, anti_join, anti_join_one_per_entity, split_leakage, union_all, distinct_order_limit, distinct_order_limit_each, null_counts,
)}

SQL = {
    "entity_ids": "SELECT DISTINCT hadm_id FROM labs",
    "demographics": "SELECT o_orderkey, c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'b' WHEN 'machinery' THEN 'm' ELSE c_mktsegment END AS segment, round(c_acctbal, 2) AS balance FROM orders JOIN customer ON o_custkey = c_custkey",
    "admissions_of": "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate NULLS LAST, o_orderkey",
    "lab_lookup": """
SELECT labevent_id, hadm_id, coalesce(t, CAST(itemid AS VARCHAR)) AS name, CAST(rn AS INTEGER) AS rn FROM (
  SELECT labevent_id, hadm_id, l.itemid, t, row_number() OVER (PARTITION BY hadm_id, l.itemid ORDER BY charttime DESC NULLS LAST, labevent_id) AS rn
  FROM labs l LEFT JOIN (SELECT itemid, min(trim(label)) AS t FROM d_labitems WHERE length(trim(label)) > 0 GROUP BY itemid) USING (itemid) WHERE hadm_id IS NOT NULL) WHERE rn <= 3""",
    "recent_labs": """
SELECT hadm_id, labevent_id, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime DESC, labevent_id) AS rn FROM (
    SELECT hadm_id, labevent_id, charttime, max(charttime) OVER (PARTITION BY hadm_id) AS top FROM labs WHERE hadm_id IS NOT NULL AND charttime IS NOT NULL)
  WHERE charttime >= top - INTERVAL 3 DAY) WHERE rn <= 10""",
    "dict_left_join_2key": """
WITH s AS (SELECT 9 AS v, icd9_prefix AS stem, name FROM seed_diseases UNION ALL SELECT 10, icd10_prefix, name FROM seed_diseases),
one AS (SELECT v, stem, min(trim(name)) AS t FROM s WHERE length(trim(name)) > 0 GROUP BY v, stem)
SELECT coalesce(t, upper(trim(icd_code))) AS title, count(*) AS n, count(DISTINCT hadm_id) AS n_hadm
FROM diagnoses LEFT JOIN one ON one.v = icd_version AND one.stem = substr(upper(trim(icd_code)), 1, 3) WHERE icd_code IS NOT NULL AND hadm_id IS NOT NULL GROUP BY 1""",
    "notes_newest": """
SELECT hadm_id, doc_id, CAST(rn AS INTEGER) AS rn FROM (
  SELECT hadm_id, doc_id, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime DESC NULLS LAST, doc_id) AS rn FROM documents WHERE length(trim(text)) > 20 AND hadm_id IS NOT NULL) WHERE rn <= 5""",
    "id_filter": "SELECT itemid, count(*) AS n, count(DISTINCT hadm_id) AS n_hadm FROM vitals WHERE hadm_id IN (SELECT hadm_id FROM ehrqa_eval WHERE hadm_id IS NOT NULL) GROUP BY itemid",
    "prefix_cohort": """
SELECT name, count(DISTINCT hadm_id) AS n_hadm FROM diagnoses JOIN (SELECT name, icd9_prefix AS p FROM seed_diseases UNION ALL SELECT name, icd10_prefix FROM seed_diseases) ON starts_with(icd_code, p)
WHERE hadm_id IS NOT NULL GROUP BY name""",
    "prefix_cohort_versioned": """
SELECT name, count(DISTINCT hadm_id) AS n_hadm FROM diagnoses JOIN (SELECT name, 9 AS v, icd9_prefix AS p FROM seed_diseases UNION ALL SELECT name, 10, icd10_prefix FROM seed_diseases) ON starts_with(icd_code, p) AND icd_version = v
WHERE hadm_id IS NOT NULL GROUP BY name""",
    "failed_rows_dropped": "SELECT upper(trim(mode)) AS mode, count(*) AS n FROM router_train_examples WHERE upper(trim(mode)) NOT IN ('FAILED', 'FAILED_GENERATION', 'MISSING_MODES') GROUP BY 1",
    "matched_set": """
SELECT system, count(*) AS n, count(DISTINCT q_idx) AS n_q FROM per_question_results WHERE q_idx IN (
  SELECT q_idx FROM per_question_results WHERE bleu IS NOT NULL AND NOT isnan(bleu) AND system IN ('T', 'T+E', 'T+E+K') GROUP BY q_idx HAVING count(DISTINCT system) = 3) GROUP BY system""",
    "left_join_predicate_on": "SELECT q.hadm_id, count(l.valuenum) AS n_values FROM (SELECT DISTINCT hadm_id FROM ehrqa_eval WHERE hadm_id IS NOT NULL) q LEFT JOIN labs l ON l.hadm_id = q.hadm_id AND l.valuenum IS NOT NULL GROUP BY q.hadm_id",
    "star_left_join": """
SELECT q.hadm_id, coalesce(a.n, 0) AS n_labs, coalesce(b.n, 0) AS n_vitals, coalesce(c.n, 0) AS n_diagnoses FROM (SELECT DISTINCT hadm_id FROM ehrqa_eval WHERE hadm_id IS NOT NULL) q
LEFT JOIN (SELECT hadm_id, count(*) AS n FROM labs GROUP BY 1) a USING (hadm_id) LEFT JOIN (SELECT hadm_id, count(*) AS n FROM vitals GROUP BY 1) b USING (hadm_id) LEFT JOIN (SELECT hadm_id, count(*) AS n FROM diagnoses GROUP BY 1) c USING (hadm_id)""",
    "fanout_preagg": """
SELECT hadm_id, CAST(datediff('day', CAST(n AS DATE), CAST(l AS DATE)) AS INTEGER) AS days FROM (SELECT hadm_id, max(charttime) AS n FROM documents WHERE hadm_id IS NOT NULL GROUP BY 1)
JOIN (SELECT hadm_id, max(charttime) AS l FROM labs WHERE hadm_id IS NOT NULL GROUP BY 1) USING (hadm_id)""",
    "first_type_merge": """
SELECT qtype, system, count(*) AS n FROM per_question_results LEFT JOIN (SELECT q_idx, arg_min(question_type, result_id) AS qtype FROM per_question_results WHERE question_type IS NOT NULL GROUP BY 1) USING (q_idx) GROUP BY 1, 2""",
    "refreshed": "SELECT example_id, coalesce(n, 0) AS n_labs FROM router_train_examples LEFT JOIN (SELECT hadm_id, count(DISTINCT itemid) AS n FROM labs WHERE hadm_id IS NOT NULL GROUP BY 1) USING (hadm_id)",
    "anti_join": "SELECT source, count(*) AS n FROM ehrqa_finetune f WHERE NOT EXISTS (SELECT 1 FROM ehrqa_eval e WHERE e.hadm_id = f.hadm_id) GROUP BY source",
    "anti_join_one_per_entity": "SELECT hadm_id, min(qa_id) AS qa_id FROM ehrqa_finetune f WHERE hadm_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ehrqa_eval e WHERE e.hadm_id = f.hadm_id) GROUP BY hadm_id",
    "split_leakage": "SELECT hadm_id, count(DISTINCT p) AS n_splits FROM (SELECT hadm_id, 1 AS p FROM ehrqa_eval UNION ALL SELECT hadm_id, 2 FROM ehrqa_finetune) WHERE hadm_id IS NOT NULL GROUP BY hadm_id HAVING count(DISTINCT p) > 1",
    "union_all": "SELECT source, question_type, count(*) AS n FROM (SELECT source, question_type FROM ehrqa_eval UNION ALL SELECT source, question_type FROM ehrqa_finetune) GROUP BY ALL",
    "distinct_order_limit": "SELECT DISTINCT label FROM labs WHERE itemid = 51101 AND length(trim(label)) > 0 ORDER BY label LIMIT 25",
    "null_counts": "UNPIVOT (SELECT count(*) - count(hadm_id) AS hadm_id, count(*) - count(question) AS question, count(*) - count(reference) AS reference, count(*) - count(question_type) AS question_type, count(*) - count(sparsity_bucket) AS sparsity_bucket, count(*) - count(predicted_answer) AS predicted_answer, count(*) - count(vram_mb) AS vram_mb FROM per_question_results) ON COLUMNS(*) INTO NAME column_name VALUE n_null",
}
