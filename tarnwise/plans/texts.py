"""Named queries on contexts, question generation and text metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.operators import chunks, contexts, entity, generate, metrics, qa, sampling
from tarnwise.operators import relational as R
from tarnwise.plans import entity as E
from tarnwise.sources.catalog import table as T

_R = "per_question_results"


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Router examples with their context split at its record, and their answer."""
    x = T(s, d, "router_train_examples").select("example_id", "question", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("prompt_context", F.lit("")).alias("context"))
    return x


def unsupported_rate(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d).select("example_id", F.round(metrics.unsupported(F.col("answer"), F.col("context")), 6).alias("rate"))


def exact_match(s: SparkSession, d: str) -> DataFrame:
    """Exact matches of predictions and references, in both readings, by system."""
    x = T(s, d, _R).filter("predicted_answer is not null and reference is not null")
    p, r = F.col("predicted_answer"), F.col("reference")
    return x.groupBy("system").agg(F.sum(metrics.exact_match(p, r)).alias("inner_blanks"), F.sum(metrics.exact_match_ends(p, r)).alias("ends_only"))


def unigram_precision(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, _R).filter("predicted_answer is not null and reference is not null")
    return x.select("result_id", F.round(metrics.unigram_precision(F.col("predicted_answer"), F.col("reference")), 6).alias("precision"))


def composite_score(s: SparkSession, d: str) -> DataFrame:
    """Composite of the stored metrics, with an answer that nothing supports as the hallucination."""
    x = T(s, d, _R)
    n = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    em = F.coalesce(metrics.exact_match(F.col("predicted_answer"), F.col("reference")), F.lit(0))
    h = (n("unsupported_rate") > 0.9).cast("int")
    score = metrics.composite(n("bertscore_f1"), n("rouge_l"), em, h)
    return x.groupBy("system").agg(F.round(F.avg(score), 3).alias("composite"))


def hallucination_flags(s: SparkSession, d: str) -> DataFrame:
    x = _answers(s, d).select("example_id", F.array_join(metrics.hallucination_flags(F.col("answer"), F.col("context")), ",").alias("flags"))
    return x.filter("flags <> ''")


def context_echo(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, _R).select(F.col("result_id"), metrics.context_echo(F.col("predicted_answer"), F.col("reference")).alias("echo"))
    return x.groupBy("echo").agg(F.count(F.lit(1)).alias("n"))


def negation_loose(s: SparkSession, d: str) -> DataFrame:
    x = _answers(s, d).withColumn("record", F.concat(F.lit("Diagnoses: "), F.lower("context")))
    return x.select("example_id", metrics.negation_score_loose(F.col("answer"), F.col("record")).alias("score")).filter("score > 0")


def negation_score(s: SparkSession, d: str) -> DataFrame:
    """Answers that negate what their record asserts."""
    x = _answers(s, d).withColumn("record", F.concat(F.lit("Diagnoses: "), "context"))
    return metrics.negation_score(x, "example_id", "answer", "record").groupBy("negation").agg(F.count(F.lit(1)).alias("n"))


def contraindication_verdict(s: SparkSession, d: str) -> DataFrame:
    """Verdicts on predictions, with the drugs the references warn of as the prohibitions."""
    x = T(s, d, _R).filter("question_type = 'contraindication_check' and reference is not null")
    drug = F.regexp_extract("question", r"(?i)Is ([a-z]+) a sound", 1)
    bad = x.filter(F.col("reference").rlike("(?i)contraindicated")).select(F.col("result_id").alias("key"), drug.alias("drug"))
    v = metrics.contraindication_verdicts(x.select(F.col("result_id").alias("key"), F.coalesce("predicted_answer", F.lit("")).alias("answer")), bad, x.select(drug.alias("drug")).distinct())
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def bleu(s: SparkSession, d: str) -> DataFrame:
    """Mean BLEU and ROUGE-L of predictions by system."""
    x = T(s, d, _R).filter("predicted_answer is not null and reference is not null").select("system", metrics.bleu("predicted_answer", "reference").alias("bleu"), metrics.rouge_l_nostem("predicted_answer", "reference").alias("rouge"))
    return x.groupBy("system").agg(F.round(F.avg("bleu"), 6).alias("bleu"), F.round(F.avg("rouge"), 6).alias("rouge_l_nostem"))


def grounding_excess(s: SparkSession, d: str) -> DataFrame:
    x = metrics.grounding_excess(_answers(s, d).filter("length(context) > 0"), "example_id", "answer", "context")
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("real"), 6).alias("real"), F.round(F.avg("excess"), 6).alias("excess"))


def _questions(s: SparkSession, d: str) -> DataFrame:
    """Evaluation questions with up to two passages of their admission's notes, its record and its facts."""
    ch = chunks.chunk_words(T(s, d, "documents").filter("hadm_id is not null"), "doc_id", size=40, overlap=0, most_words=None)
    per = R.newest(ch.join(T(s, d, "documents").select("doc_id", "hadm_id"), "doc_id").withColumn("ord", F.concat_ws("|", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("pos").cast("string"), 6, "0"))), "hadm_id", "ord", ["ord"], 2)
    passages = per.groupBy("hadm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "chunk"))), lambda x: x["chunk"]).alias("passages"))
    record = T(s, d, "ehrqa_eval").select("qa_id", "hadm_id", F.coalesce("labs", F.lit("")).alias("record"), F.filter(F.split(F.coalesce("diagnoses", F.lit("")), r"\s*\|\s*"), lambda v: v != "").alias("facts"))
    return record.join(passages, "hadm_id", "left").select(F.col("qa_id").alias("q"), F.coalesce("passages", F.array().cast("array<string>")).alias("passages"), "record", "facts")


def mode_contexts(s: SparkSession, d: str) -> DataFrame:
    """Contexts of the three modes and their estimated tokens."""
    x = contexts.assemble(contexts.by_mode(_questions(s, d)))
    return x.select("q", "mode", F.md5("context").alias("h"), "token_estimate")


def context_budget(s: SparkSession, d: str) -> DataFrame:
    """Contexts with 50 tokens of passages, 4 of record and 3 of facts."""
    x = contexts.budgeted(contexts.by_mode(_questions(s, d)), {"passages": 50, "record": 4, "facts": 3})
    return contexts.assemble(x).select("q", "mode", F.size("passages").alias("n_passages"), F.md5("context").alias("h"))


def context_sections(s: SparkSession, d: str) -> DataFrame:
    """Sections parsed back from assembled contexts."""
    x = contexts.sections_of(contexts.assemble(contexts.by_mode(_questions(s, d))), "context")
    return x.groupBy("mode").agg(F.count_if(F.length("s_passages") > 0).alias("passages"), F.count_if(F.length("s_record") > 0).alias("record"), F.count_if(F.length("s_facts") > 0).alias("facts"))


def distinct_contexts(s: SparkSession, d: str) -> DataFrame:
    """Contexts to rebuild: one of each admission, question and mode."""
    x = T(s, d, "router_train_examples").select("hadm_id", "question", F.upper(F.trim("mode")).alias("mode")).distinct()
    return x.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def chunk_json(s: SparkSession, d: str) -> DataFrame:
    """Chunks named in the stored JSON, and their best score."""
    x = T(s, d, "router_train_examples").select("example_id", F.explode(F.from_json("retrieved_chunks", "array<struct<chunk_id: bigint, score: double>>")).alias("c"))
    return x.groupBy("example_id").agg(F.count(F.lit(1)).alias("n"), F.max("c.score").alias("best"))


def generated_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers of the default generator to router examples."""
    return generate.extractive(_answers(s, d).drop("answer")).groupBy(F.length("answer") > 0).agg(F.count(F.lit(1)).alias("n")).toDF("answered", "n")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    collect = lambda df, c, n: df.groupBy("hadm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(c).alias("v")))), lambda x: x["v"]).alias(n))
    a = collect(E.entity_snapshot_diagnoses(s, d), "code", "diagnoses")
    b = collect(E.entity_snapshot_labs(s, d), "name", "labs")
    none = F.array().cast("array<string>")
    return a.join(b, "hadm_id", "full").select("hadm_id", F.coalesce("diagnoses", none).alias("diagnoses"), F.coalesce("labs", none).alias("labs"), none.alias("medications"))


def qa_extractive(s: SparkSession, d: str) -> DataFrame:
    """Questions from snapshots."""
    return qa.extractive(_snapshots(s, d))


def qa_coverage(s: SparkSession, d: str) -> DataFrame:
    """Monitoring questions and how far each record covers them."""
    seeds = T(s, d, "seed_diseases").select("name", F.explode(F.array("icd9_prefix", "icd10_prefix")).alias("prefix"))
    cohorts = R.prefix_cohort(T(s, d, "diagnoses").filter("hadm_id is not null"), seeds, "hadm_id", "icd_code")
    e = T(s, d, "cooccurrence_edges").filter("length(trim(disease)) > 0 and length(trim(lab_test)) > 0 and total_admissions > 0 and n_admissions_with_lab is not null")
    e = e.groupBy(F.trim("disease").alias("src"), F.trim("lab_test").alias("dst")).agg(F.max(F.col("n_admissions_with_lab") / F.col("total_admissions")).alias("f")).filter("f > 0.8").select("src", "dst", F.lit(0).alias("ord"))
    items = T(s, d, "d_labitems").select("itemid", F.trim("label").alias("n")).filter("length(n) > 0")
    names = T(s, d, "labs").filter("hadm_id is not null").select("hadm_id", "itemid").distinct().join(items, "itemid").groupBy(F.col("hadm_id").alias("entity")).agg(F.collect_set("n").alias("names"))
    return qa.monitoring(cohorts, e, names)


def qa_quota(s: SparkSession, d: str) -> DataFrame:
    """Two fine-tuning questions of each type an admission, by hash."""
    x = T(s, d, "ehrqa_finetune").filter("hadm_id is not null and question_type is not null").select("hadm_id", "question_type", "question", "answer")
    return qa.quota(x, "question_type", 2).select("hadm_id", "question_type", F.md5(F.concat_ws("|", "question", "answer")).alias("h"))


QUERIES = {f.__name__: f for f in (
    unsupported_rate, exact_match, unigram_precision, composite_score, hallucination_flags, context_echo, negation_loose, negation_score, contraindication_verdict, bleu, grounding_excess,
    mode_contexts, context_budget, context_sections, distinct_contexts, chunk_json, generated_answers, qa_extractive, qa_coverage, qa_quota,
)}

_W = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> ''))"
_COMMON = "[" + ", ".join(f"'{w}'" for w in metrics.COMMON) + "]"
_EX = "ex AS (SELECT example_id, coalesce(answer, '') AS answer, coalesce(prompt_context, '') AS context FROM router_train_examples)"
_FOLD = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'), ' ')"
_NUM = lambda c: f"coalesce(CASE WHEN NOT isnan({c}) THEN {c} END, 0)"
_ANY = lambda c, xs: "(" + " OR ".join(f"contains({c}, '{x}')" for x in xs) + ")"
_CTX = """
ch AS (SELECT doc_id, hadm_id, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE hadm_id IS NOT NULL AND text IS NOT NULL),
pc AS (SELECT doc_id, hadm_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 40) / 40)) AS BIGINT) + 1)) AS pos FROM ch WHERE len(w) > 0),
pr AS (SELECT hadm_id, array_to_string(w[pos * 40 + 1 : pos * 40 + 40], ' ') AS chunk, row_number() OVER (PARTITION BY hadm_id ORDER BY doc_id DESC, pos DESC) AS rn FROM pc),
ps AS (SELECT hadm_id, list(chunk ORDER BY rn) AS passages FROM pr WHERE rn <= 2 GROUP BY hadm_id),
qs AS (SELECT qa_id AS q, coalesce(passages, CAST([] AS VARCHAR[])) AS passages, coalesce(labs, '') AS record, list_filter(string_split_regex(coalesce(diagnoses, ''), '\\s*\\|\\s*'), lambda x: x <> '') AS facts FROM ehrqa_eval LEFT JOIN ps USING (hadm_id)),
md AS (SELECT q, mode, passages, CASE WHEN mode <> 'T' THEN record END AS record, CASE WHEN mode = 'T+E+K' THEN facts END AS facts FROM qs, (VALUES ('T'), ('T+E'), ('T+E+K')) m(mode))
"""
_ASSEMBLE = """CASE WHEN len(passages) = 0 AND coalesce(record, '') = '' AND coalesce(len(facts), 0) = 0 THEN 'No context available.' ELSE concat_ws(chr(10) || chr(10),
  CASE WHEN len(passages) > 0 THEN '## Retrieved Clinical Passages' || chr(10) || array_to_string(list_transform(passages, lambda p, i: '[Passage ' || i || ']' || chr(10) || p), chr(10) || chr(10)) END,
  CASE WHEN record <> '' THEN '## Patient EHR Snapshot' || chr(10) || record END,
  CASE WHEN len(facts) > 0 THEN '## Relevant Medical Knowledge' || chr(10) || '- ' || array_to_string(facts, chr(10) || '- ') END) END"""
_CUT = lambda c, n: f"CASE WHEN len(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')) <= {n} THEN {c} ELSE array_to_string(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')[1:{n}], ' ') END"
SQL = {
    "unsupported_rate": f"""WITH {_EX}, w AS (SELECT example_id, context, answer, list_filter({_W('answer')}, lambda x: NOT list_contains({_COMMON}, x)) AS a, {_W('context')} AS c FROM ex)
SELECT example_id, round(CASE WHEN answer <> '' AND context <> '' AND len(a) > 0 THEN len(list_filter(a, lambda x: NOT list_contains(c, x))) / len(a) ELSE 0 END, 6) AS rate FROM w""",
    "exact_match": f"SELECT system, CAST(sum(CASE WHEN {_FOLD('predicted_answer')} = {_FOLD('reference')} THEN 1 ELSE 0 END) AS BIGINT) AS inner_blanks, CAST(sum(CASE WHEN trim(lower(predicted_answer), ' ') = trim(lower(reference), ' ') THEN 1 ELSE 0 END) AS BIGINT) AS ends_only FROM per_question_results WHERE predicted_answer IS NOT NULL AND reference IS NOT NULL GROUP BY system",
    "unigram_precision": """WITH w AS (SELECT result_id, list_filter(string_split_regex(lower(predicted_answer), '\\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(lower(reference), '\\s+'), lambda x: x <> '') AS r FROM per_question_results WHERE predicted_answer IS NOT NULL AND reference IS NOT NULL)
SELECT result_id, round(CASE WHEN len(a) > 0 THEN list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) / len(a) ELSE 0 END, 6) AS precision FROM w""",
    "composite_score": f"SELECT system, round(avg(round(0.6 * {_NUM('bertscore_f1')} + 0.25 * {_NUM('rouge_l')} + 0.15 * CASE WHEN {_FOLD('predicted_answer')} = {_FOLD('reference')} THEN 1 ELSE 0 END - 0.3 * CASE WHEN {_NUM('unsupported_rate')} > 0.9 THEN 1 ELSE 0 END, 4)), 3) AS composite FROM per_question_results GROUP BY system",
    "hallucination_flags": f"""WITH {_EX}, l AS (SELECT example_id, answer, lower(answer) AS a, lower(context) AS c FROM ex),
f AS (SELECT example_id, concat_ws(',', CASE WHEN {_ANY('c', metrics.ABNORMAL)} AND {_ANY('a', metrics.NORMAL_CLAIMS)} THEN 'H1' END, CASE WHEN contains(c, 'medication') AND {_ANY('a', metrics.NO_MED_CLAIMS)} THEN 'H2' END,
  CASE WHEN {' OR '.join(f"(contains(a, '{x}') AND NOT contains(c, '{x}'))" for x in metrics.SPECIFIC)} THEN 'H3' END, CASE WHEN contains(a, 'mg') AND NOT contains(c, 'mg') THEN 'H6' END) AS flags FROM l WHERE answer <> '')
SELECT example_id, flags FROM f WHERE flags <> ''""",
    "context_echo": """WITH x AS (SELECT trim(coalesce(predicted_answer, ''), ' ') AS a, trim(coalesce(reference, ''), ' ') AS c FROM per_question_results)
SELECT a <> '' AND c <> '' AND (starts_with(a, '## ') OR contains(substr(a, 1, 200), '[Passage ') OR (length(a) >= 150 AND contains(substr(c, 1, 300), substr(a, 1, 60)))) AS echo, count(*) AS n FROM x GROUP BY 1""",
    "negation_loose": """WITH x AS (SELECT example_id, lower(coalesce(answer, '')) AS a, list_filter(string_split_regex('diagnoses: ' || lower(coalesce(prompt_context, '')), '\\s+'), lambda t: length(t) > 5) AS ts FROM router_train_examples WHERE NOT contains(coalesce(prompt_context, ''), chr(10)))
SELECT example_id, round(least(n * 0.2, 1.0), 4) AS score FROM (SELECT example_id, list_sum(list_transform(ts, lambda t: """ + " + ".join(f"CASE WHEN contains(a, '{c} ' || t) THEN 1 ELSE 0 END" for c in metrics.NEGATIONS) + """)) AS n FROM x) WHERE n > 0""",
    "mode_contexts": f"WITH {_CTX}, c AS (SELECT q, mode, {_ASSEMBLE} AS context FROM md) SELECT q, mode, md5(context) AS h, CAST(floor(length(context) / 4) AS BIGINT) AS token_estimate FROM c",
    "context_budget": f"""WITH {_CTX}, n AS (SELECT *, list_transform(passages, lambda p: len(string_split(p, ' '))) AS k FROM md),
b AS (SELECT q, mode, CASE WHEN len(passages) = 0 THEN passages WHEN k[1] > 50 THEN [array_to_string(string_split(passages[1], ' ')[1:50], ' ')] WHEN len(passages) > 1 AND k[1] + k[2] <= 50 THEN passages ELSE passages[1:1] END AS passages,
  {_CUT('record', 4)} AS record, CASE WHEN facts IS NOT NULL THEN list_filter(string_split({_CUT("array_to_string(facts, chr(10))", 3)}, chr(10)), lambda x: x <> '') END AS facts FROM n)
SELECT q, mode, CAST(len(passages) AS INTEGER) AS n_passages, md5({_ASSEMBLE}) AS h FROM b""",
    "context_sections": f"WITH {_CTX} SELECT mode, count(*) FILTER (WHERE len(passages) > 0 OR (coalesce(record, '') = '' AND coalesce(len(facts), 0) = 0)) AS passages, count(*) FILTER (WHERE coalesce(record, '') <> '') AS record, count(*) FILTER (WHERE coalesce(len(facts), 0) > 0) AS facts FROM md GROUP BY mode",
    "distinct_contexts": "SELECT mode, count(*) AS n FROM (SELECT DISTINCT hadm_id, question, upper(trim(mode)) AS mode FROM router_train_examples) GROUP BY mode",
    "chunk_json": "WITH c AS (SELECT example_id, unnest(from_json(retrieved_chunks, '[{\"chunk_id\": \"BIGINT\", \"score\": \"DOUBLE\"}]')) AS c FROM router_train_examples WHERE retrieved_chunks IS NOT NULL) SELECT example_id, count(*) AS n, max(c.score) AS best FROM c GROUP BY example_id",
    "qa_quota": """WITH x AS (SELECT DISTINCT hadm_id, question_type, question, answer, md5('42|' || concat_ws('|', CAST(hadm_id AS VARCHAR), question, answer)) AS k FROM ehrqa_finetune WHERE hadm_id IS NOT NULL AND question_type IS NOT NULL)
SELECT hadm_id, question_type, md5(concat_ws('|', question, answer)) AS h FROM x QUALIFY row_number() OVER (PARTITION BY hadm_id, question_type ORDER BY k) <= 2""",
    "qa_coverage": """
WITH c AS (SELECT DISTINCT name, hadm_id FROM diagnoses JOIN (SELECT name, icd9_prefix AS p FROM seed_diseases UNION ALL SELECT name, icd10_prefix FROM seed_diseases) ON starts_with(icd_code, p) WHERE hadm_id IS NOT NULL),
e AS (SELECT trim(disease) AS src, trim(lab_test) AS dst FROM cooccurrence_edges WHERE length(trim(disease)) > 0 AND length(trim(lab_test)) > 0 AND total_admissions > 0 AND n_admissions_with_lab IS NOT NULL GROUP BY ALL HAVING max(n_admissions_with_lab / total_admissions) > 0.8),
w AS (SELECT src, list(dst ORDER BY dst) AS ls FROM e GROUP BY src),
n AS (SELECT hadm_id, list(DISTINCT trim(d.label)) AS ns FROM labs JOIN d_labitems d USING (itemid) WHERE hadm_id IS NOT NULL AND length(trim(d.label)) > 0 GROUP BY hadm_id),
s AS (SELECT hadm_id, name, ls, len(list_filter(ls, lambda a: len(list_filter(coalesce(ns, CAST([] AS VARCHAR[])), lambda b: contains(lower(a), lower(b)) OR contains(lower(b), lower(a)))) > 0)) / len(ls) AS share FROM c JOIN w ON name = src LEFT JOIN n USING (hadm_id))
SELECT hadm_id, 'monitoring_labs' AS question_type, 'Which laboratory tests should be followed for this patient''s ' || name || '?' AS question, array_to_string(ls, ', ') || '.' AS answer, name AS kg_disease, CASE WHEN share >= 0.8 THEN 1 ELSE 0 END AS ehr_covers_answer, round(share, 3) AS ehr_lab_coverage FROM s""",
}
