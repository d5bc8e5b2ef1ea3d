"""Named queries on fallbacks, generated questions, review samples, gates and the router's model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.operators import contexts, metrics, model, policy, qa, sampling, stats
from tarnwise.plans import evaluation as E
from tarnwise.sources.catalog import table as T

_R = "per_question_results"


def facts_resplit(s: SparkSession, d: str) -> DataFrame:
    """Answers read as paragraphs of facts, split at full stops."""
    facts = contexts.split_facts(F.col("answer"))
    return T(s, d, "ehrqa_finetune").select("qa_id", F.size(facts).alias("n_facts"), F.md5(F.array_join(facts, "|")).alias("h"))


def mode_fallback(s: SparkSession, d: str) -> DataFrame:
    """Questions in each mode, with the mode that serves them and whether they have a record and facts."""
    x = T(s, d, "ehrqa_eval").select("qa_id", "hadm_id", F.array().cast("array<string>").alias("passages"), F.when(F.col("hadm_id").isNotNull(), F.coalesce("labs", F.lit(""))).alias("record"), F.when(F.col("hadm_id").isNotNull(), F.array("diagnoses")).alias("facts"))
    x = contexts.by_mode(x).withColumn("served", contexts.served_mode(F.col("mode"), F.col("hadm_id")))
    return x.groupBy("mode", "served").agg(F.count(F.lit(1)).alias("n"), F.count("record").alias("n_record"), F.count("facts").alias("n_facts"))


def _cohorts(s: SparkSession, d: str) -> DataFrame:
    """Admissions of the evaluation questions and their disease."""
    x = T(s, d, "ehrqa_eval").select(F.trim("kg_disease").alias("name"), F.col("hadm_id").alias("entity"))
    return x.filter("length(name) > 0 and entity is not null").distinct()


def qa_symptoms(s: SparkSession, d: str) -> DataFrame:
    """Questions on what goes with a disease; the lab edges, in order of name, stand in for symptom edges."""
    e = T(s, d, "cooccurrence_edges").select(F.trim("disease").alias("src"), F.trim("lab_test").alias("dst")).filter("length(src) > 0 and length(dst) > 0").distinct().withColumn("ord", F.lit(0))
    return qa.symptoms(_cohorts(s, d), e)


def qa_contraindication(s: SparkSession, d: str) -> DataFrame:
    """Questions on a drug's fitness, an unfit one for about half; edges are read from reference answers."""
    x = T(s, d, _R).filter("question_type = 'contraindication_check' and reference is not null")
    part = lambda i: F.regexp_extract("question", r"^Is (.+) a sound choice here, given (.+)\?$", i)
    x = x.select(part(2).alias("src"), part(1).alias("dst"), F.contains("reference", F.lit("contraindicated")).alias("unfit")).filter("src <> ''").distinct()
    return qa.contraindication(_cohorts(s, d), x.filter("unfit").drop("unfit"), x.filter("not unfit").drop("unfit"))


def strata_sample(s: SparkSession, d: str) -> DataFrame:
    """Flagged answers, unflagged ones that look missed, and controls, so many of each in hash order."""
    x = T(s, d, _R).filter("mode_used <> 'T' and not isnan(ehr_contradiction)")
    x = sampling.review_strata(x, F.col("ehr_contradiction") > 0.5, (F.col("unsupported_rate") > 0.5) & ~F.isnan("unsupported_rate"))
    return sampling.stratified(x, "stratum", "result_id", {"flagged": 40, "control": 30, "possible_miss": 20}, seed=42).select("result_id", "stratum", "rn")


def edge_sample(s: SparkSession, d: str) -> DataFrame:
    """Fifty edges for review, numbered."""
    x = T(s, d, "cooccurrence_edges").select("disease", "lab_test", "n_admissions_with_lab")
    return sampling.numbered_sample(x, ["disease", "lab_test", "n_admissions_with_lab"], 50, name="edge_id")


def agreement_gate(s: SparkSession, d: str) -> DataFrame:
    """The detector against the truth by system: precision, recall and a bar of half of its flags."""
    x = E.detector_cells(s, d)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return x.select("system", "precision", "recall", F.round((tp + tn) / (tp + fp + fn + tn), 6).alias("accuracy"), (tp * 2 >= tp + fp).alias("passed"))


def gate_intervals(s: SparkSession, d: str) -> DataFrame:
    """The same gate with exact intervals of the precision."""
    rows = [(r["system"], *stats.gate(r["tp"], r["fp"], r["fn"], r["tn"], (r["tp"] + r["fp"] + 1) // 2).values()) for r in E.detector_cells(s, d).collect()]  # a row a system
    return s.createDataFrame(rows, "system string, precision double, low double, high double, recall double, accuracy double, passed boolean")


def length_over(s: SparkSession, d: str) -> DataFrame:
    """Answers above 300 characters by question type; `stats.assert_within` aborts on any."""
    return stats.over_limit(T(s, d, "ehrqa_finetune").withColumn("chars", F.length("answer")), "chars", 300, "question_type")


def missing_modes_scored(s: SparkSession, d: str) -> DataFrame:
    """Questions of which a mode has no scored answer."""
    x = T(s, d, _R).filter("q_idx is not null").select(F.col("q_idx").alias("q"), F.when(F.col("bertscore_f1").isNotNull() & ~F.isnan("bertscore_f1") & F.col("rouge_l").isNotNull() & ~F.isnan("rouge_l") & (F.col("rouge_l") > 0.1), F.col("system")).alias("mode"))
    return policy.missing_modes(x)


def context_echo_examples(s: SparkSession, d: str) -> DataFrame:
    """Answers of router examples, and the openings of their contexts, that give the context back."""
    x = T(s, d, "router_train_examples").select("example_id", metrics.context_echo(F.col("answer"), F.col("prompt_context")).alias("echo"), metrics.context_echo(F.substring("prompt_context", 1, 200), F.col("prompt_context")).alias("opening"))
    return x.groupBy("echo", "opening").agg(F.count(F.lit(1)).alias("n"))


_COLUMNS = ["n_kg_facts", "prompt_tokens", "qtype", "bucket"]


def _examples(s: SparkSession, d: str) -> DataFrame:
    """Numbers and label of each question, a fifth of them for tests."""
    best = policy.oracle_labels(E._scores(s, d)).select(F.col("q").alias("q_idx"), (F.array_position(F.array(*map(F.lit, policy.MODES)), F.col("best_mode")) - 1).cast("double").alias("label"))
    code = lambda c, n: F.pmod(F.crc32(F.coalesce(c, F.lit(""))), F.lit(n)).cast("double")
    x = E._once(s, d).filter("system = 'T+E+K'").join(best, "q_idx").select(F.col("q_idx").alias("_row"), "label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _COLUMNS[:2]], code("question_type", 97).alias("qtype"), code("sparsity_bucket", 11).alias("bucket"))
    return sampling.hash_split(x, "_row", [("train", 0.8), ("test", 0.2)])


def router_boosted(s: SparkSession, d: str) -> DataFrame:
    """Boosted trees, one mode against the rest, on held-out questions."""
    x = model.features(_examples(s, d), _COLUMNS)
    got = model.scores(model.train_boosted(x.filter("split = 'train'"), rounds=5, depth=3).transform(x.filter("split = 'test'")), "label", "prediction")
    return s.createDataFrame([(k, float(v)) for k, v in sorted(got.items())], "metric string, value double")


def router_search(s: SparkSession, d: str) -> DataFrame:
    """Mean macro-F1 over stratified folds of settings drawn at random."""
    x = model.features(_examples(s, d).filter("split = 'train'"), _COLUMNS)
    tried = model.search(x, "_row", "label", model.random_settings({"trees": [5, 10, 20], "depth": [3, 5, 7]}, 2), folds=3)[1]
    return s.createDataFrame([(t["trees"], t["depth"], float(t["macro_f1"])) for t in tried], "trees int, depth int, macro_f1 double")


def router_seeds(s: SparkSession, d: str) -> DataFrame:
    """Scores of forests that differ in their seed only."""
    x = model.features(_examples(s, d), _COLUMNS)
    rows = model.seed_variance(x.filter("split = 'train'"), x.filter("split = 'test'"), "label", [1, 2], trees=10, depth=4)
    return s.createDataFrame([(r["seed"], float(r["accuracy"]), float(r["macro_f1"])) for r in rows], "seed int, accuracy double, macro_f1 double")


def router_attribution(s: SparkSession, d: str) -> DataFrame:
    """Columns ranked by the accuracy lost when they are exchanged between questions, and the fall when the first of them are deleted."""
    x = _examples(s, d)
    make = lambda df: model.features(df, _COLUMNS)
    fitted = model.train(make(x.filter("split = 'train'")), trees=10, depth=4)
    test = x.filter("split = 'test'")
    ranked = model.ranked_features(model.permutation_importance(fitted, test, "label", "_row", {c: [c] for c in _COLUMNS}, make))
    curve = {r["k"]: r for r in model.deletion_curve(fitted, test, [f for f, _, _ in ranked], make, [1, 2])}
    rows = [(f, float(v), i, *(([curve[i]["drop_top"], curve[i]["drop_random"]]) if i in curve else [None, None])) for f, v, i in ranked]
    return s.createDataFrame(rows, "feature string, importance double, rank int, drop_top double, drop_random double")


QUERIES = {f.__name__: f for f in (
    facts_resplit, mode_fallback, qa_symptoms, qa_contraindication, strata_sample, edge_sample, agreement_gate, gate_intervals, length_over, missing_modes_scored, context_echo_examples,
    router_boosted, router_search, router_seeds, router_attribution,
)}

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_COHORTS = "c AS (SELECT DISTINCT trim(kg_disease) AS name, hadm_id AS entity FROM ehrqa_eval WHERE length(trim(kg_disease)) > 0 AND hadm_id IS NOT NULL)"
_ECHO = lambda a, c: f"(length(trim(coalesce({a}, ''))) > 0 AND length(trim(coalesce({c}, ''))) > 0 AND (starts_with(trim(coalesce({a}, '')), '## ') OR contains(substr(trim(coalesce({a}, '')), 1, 200), '[Passage ') OR (length(trim(coalesce({a}, ''))) >= 150 AND contains(substr(trim(coalesce({c}, '')), 1, 300), substr(trim(coalesce({a}, '')), 1, 60)))))"
_FINE = lambda c: f"{c} IS NOT NULL AND NOT isnan({c})"

SQL = {
    "facts_resplit": f"""
WITH f AS (SELECT qa_id, CASE WHEN answer IS NULL OR contains(answer, 'No relevant') THEN CAST([] AS VARCHAR[]) ELSE list_transform(list_filter(list_transform(string_split(answer, '.'), lambda p: {_TRIM.format('p')}), lambda p: p <> ''), lambda p: p || '.') END AS f FROM ehrqa_finetune)
SELECT qa_id, CAST(len(f) AS INTEGER) AS n_facts, md5(coalesce(array_to_string(f, '|'), '')) AS h FROM f""",
    "mode_fallback": """
WITH m AS (SELECT unnest(['T', 'T+E', 'T+E+K']) AS mode)
SELECT mode, CASE WHEN hadm_id IS NULL THEN 'T' ELSE mode END AS served, count(*) AS n, count(*) FILTER (WHERE hadm_id IS NOT NULL AND mode <> 'T') AS n_record, count(*) FILTER (WHERE hadm_id IS NOT NULL AND mode = 'T+E+K') AS n_facts
FROM ehrqa_eval, m GROUP BY 1, 2""",
    "qa_symptoms": f"""
WITH {_COHORTS}, e AS (SELECT DISTINCT trim(disease) AS src, trim(lab_test) AS dst FROM cooccurrence_edges WHERE length(trim(disease)) > 0 AND length(trim(lab_test)) > 0), l AS (SELECT src, string_agg(dst, ', ' ORDER BY dst) AS list FROM e GROUP BY src)
SELECT entity AS hadm_id, 'expected_symptoms' AS question_type, 'Which symptoms go with this patient''s ' || name || '?' AS question, list || '.' AS answer, name AS kg_disease FROM c JOIN l ON name = src""",
    "qa_contraindication": f"""
WITH {_COHORTS}, x AS (SELECT DISTINCT regexp_extract(question, '^Is (.+) a sound choice here, given (.+)\\?$', 2) AS src, regexp_extract(question, '^Is (.+) a sound choice here, given (.+)\\?$', 1) AS dst, contains(reference, 'contraindicated') AS unfit FROM per_question_results WHERE question_type = 'contraindication_check' AND reference IS NOT NULL),
o AS (SELECT src, list_sort(list(DISTINCT dst) FILTER (WHERE unfit)) AS bad, list_sort(list(DISTINCT dst) FILTER (WHERE NOT unfit)) AS good FROM x WHERE src <> '' GROUP BY src),
h AS (SELECT c.*, o.bad, o.good, CAST('0x' || substr(md5('42|' || entity || '|' || name), 1, 8) AS BIGINT) AS h FROM c JOIN o ON name = src),
p AS (SELECT *, bad IS NOT NULL AND (good IS NULL OR h % 2 = 0) AS unfit FROM h),
q AS (SELECT *, CASE WHEN unfit THEN bad[(h // 2) % len(bad) + 1] ELSE good[(h // 2) % len(good) + 1] END AS drug FROM p)
SELECT entity AS hadm_id, 'contraindication_check' AS question_type, 'Is ' || drug || ' fit for this patient''s ' || name || '?' AS question, CASE WHEN unfit THEN 'No, ' || drug || ' is contraindicated in ' || name || '.' ELSE 'Yes, ' || drug || ' is a usual treatment of ' || name || '.' END AS answer, name AS kg_disease FROM q""",
    "strata_sample": """
WITH x AS (SELECT result_id, CASE WHEN ehr_contradiction > 0.5 THEN 'flagged' WHEN unsupported_rate > 0.5 AND NOT isnan(unsupported_rate) THEN 'possible_miss' ELSE 'control' END AS stratum FROM per_question_results WHERE mode_used <> 'T' AND ehr_contradiction IS NOT NULL AND NOT isnan(ehr_contradiction))
SELECT result_id, stratum, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || result_id), result_id) AS rn FROM x) WHERE rn <= CASE stratum WHEN 'flagged' THEN 40 WHEN 'control' THEN 30 ELSE 20 END""",
    "edge_sample": """
WITH x AS (SELECT DISTINCT disease, lab_test, n_admissions_with_lab FROM cooccurrence_edges)
SELECT disease, lab_test, n_admissions_with_lab, CAST(edge_id AS INTEGER) AS edge_id FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || coalesce(disease, '-') || '|' || coalesce(lab_test, '-') || '|' || coalesce(CAST(n_admissions_with_lab AS VARCHAR), '-'))) AS edge_id FROM x) WHERE edge_id <= 50""",
    "agreement_gate": f"WITH g AS ({E.SQL['detector_cells']}) SELECT system, precision, recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, tp * 2 >= tp + fp AS passed FROM g",
    "length_over": "SELECT question_type, count(answer) AS n, count(*) FILTER (WHERE length(answer) > 300) AS n_over, CAST(max(length(answer)) AS INTEGER) AS most FROM ehrqa_finetune GROUP BY question_type",
    "missing_modes_scored": f"""
WITH x AS (SELECT q_idx AS q, CASE WHEN {_FINE('bertscore_f1')} AND {_FINE('rouge_l')} AND rouge_l > 0.1 THEN system END AS mode FROM per_question_results WHERE q_idx IS NOT NULL)
SELECT q, count(DISTINCT mode) FILTER (WHERE mode IN ('T', 'T+E', 'T+E+K')) AS n FROM x GROUP BY q HAVING count(DISTINCT mode) FILTER (WHERE mode IN ('T', 'T+E', 'T+E+K')) < 3""",
    "context_echo_examples": f"SELECT {_ECHO('answer', 'prompt_context')} AS echo, {_ECHO('substr(prompt_context, 1, 200)', 'prompt_context')} AS opening, count(*) AS n FROM router_train_examples GROUP BY 1, 2",
}
