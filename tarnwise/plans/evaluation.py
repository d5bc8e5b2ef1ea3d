"""Named queries on results: summaries, policies, agreement and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwise.operators import model, policy, sampling, stats
from tarnwise.sources.catalog import table as T

_R = "per_question_results"


def _num(c: str):
    return F.when(~F.isnan(c), F.col(c))


def _once(s: SparkSession, d: str) -> DataFrame:
    """One result a question and system, the one of least id."""
    x = T(s, d, _R).filter("q_idx is not null and system is not null")
    cols = ["result_id", "mode_used", "question_type", "sparsity_bucket", "bleu", "rouge_l", "bertscore_f1", "unsupported_rate", "retrieval_latency_ms", "total_latency_ms", "n_kg_facts", "has_ehr", "prompt_tokens"]
    return x.groupBy("q_idx", "system").agg(F.min_by(F.struct(*cols), "result_id").alias("r")).select("q_idx", "system", "r.*")


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Quality of the three modes a question."""
    x = _once(s, d).filter(F.col("system").isin(policy.MODES))
    raw = 0.6 * F.coalesce(_num("bertscore_f1"), F.lit(0.0)) + 0.25 * F.coalesce(_num("rouge_l"), F.lit(0.0))
    quality = F.floor(raw * 10000 + 0.5) / 10000  # engines round halves of doubles differently
    return x.select(F.col("q_idx").alias("q"), F.col("system").alias("mode"), quality.alias("score"))


def summary_by_system(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, _R).groupBy("system").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(_num(c)), 6).alias(c) for c in ("bleu", "rouge_l", "bertscore_f1", "unsupported_rate")])
    return x


def by_system_bucket(s: SparkSession, d: str) -> DataFrame:
    """Means by system, by system and bucket and by system and type, in one pass of grouping sets."""
    T(s, d, _R).createOrReplaceTempView("_results")
    return s.sql("""
        SELECT system, sparsity_bucket, question_type, CAST(grouping_id(system, sparsity_bucket, question_type) AS INT) AS level, count(*) AS n, round(avg(if(isnan(bleu), null, bleu)), 6) AS bleu
        FROM _results GROUP BY GROUPING SETS ((system), (system, sparsity_bucket), (system, question_type))""")


def pivot_metric(s: SparkSession, d: str) -> DataFrame:
    """Mean BLEU of each mode's system by question type."""
    return T(s, d, _R).groupBy("question_type").pivot("system", ["T", "T+E", "T+E+K"]).agg(F.round(F.avg(_num("bleu")), 6)).toDF("question_type", "t", "te", "tek")


def unstack_fill(s: SparkSession, d: str) -> DataFrame:
    """Choices of each mode by bucket, 0 where there are none."""
    return T(s, d, _R).groupBy("sparsity_bucket").pivot("mode_used", ["T", "T+E", "T+E+K"]).count().fillna(0).toDF("sparsity_bucket", "t", "te", "tek")


def percentiles(s: SparkSession, d: str) -> DataFrame:
    """Latency quantiles by system, exact."""
    x = T(s, d, _R).filter("total_latency_ms >= 0 and not isnan(total_latency_ms)")
    q = stats.exact_percentiles(x, "system", "total_latency_ms", [0.5, 0.95, 0.99]).withColumnRenamed("system", "_system")
    means = x.groupBy("system").agg(F.round(F.avg("total_latency_ms"), 4).alias("mean"), F.max("total_latency_ms").alias("most"))
    return means.join(q, F.col("system").eqNullSafe(F.col("_system"))).select("system", "mean", *[F.round(c, 4).alias(n) for c, n in (("p0", "median"), ("p1", "p95"), ("p2", "p99"))], "most")


def latency_split(s: SparkSession, d: str) -> DataFrame:
    """Retrieval and generation time by system."""
    x = T(s, d, _R).filter("total_latency_ms >= 0 and retrieval_latency_ms >= 0 and not isnan(total_latency_ms) and not isnan(retrieval_latency_ms)")
    x = x.groupBy("system").agg(F.avg("retrieval_latency_ms").alias("r"), F.avg("total_latency_ms").alias("t"))
    return x.select("system", F.round("r", 4).alias("retrieval"), F.round(F.col("t") - F.col("r"), 4).alias("generation"), F.round(F.col("r") / F.col("t") * 100, 4).alias("retrieval_percent"))


def value_shares(s: SparkSession, d: str) -> DataFrame:
    """Share of each mode used."""
    x = T(s, d, _R).groupBy("mode_used").agg(F.count(F.lit(1)).alias("n"))
    return x.select("mode_used", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # a row a mode


def conditional_rate(s: SparkSession, d: str) -> DataFrame:
    """Percent of answers with an unsupported rate above one half."""
    return T(s, d, _R).filter(_num("unsupported_rate").isNotNull()).groupBy("system").agg(F.round(F.avg((F.col("unsupported_rate") > 0.5).cast("double")) * 100, 4).alias("percent"))


def majority_mode(s: SparkSession, d: str) -> DataFrame:
    """Commonest mode of each question type."""
    return policy.majority(T(s, d, _R).filter("question_type is not null"), "question_type", "mode_used")


def argmax_row(s: SparkSession, d: str) -> DataFrame:
    """The system of best BLEU of each question."""
    x = _once(s, d).filter(_num("bleu").isNotNull())
    return x.groupBy("q_idx").agg(F.max_by(F.struct("system", "bleu"), F.struct("bleu", -F.col("result_id"))).alias("b")).select("q_idx", "b.*")


def pearson_length(s: SparkSession, d: str) -> DataFrame:
    """Correlation of prompt length and unsupported rate by system."""
    x = T(s, d, _R).withColumn("p", F.col("prompt_tokens").cast("double"))
    return stats.pearson(x, "p", "unsupported_rate", ["system"]).select("system", "n", F.round("r", 6).alias("r"), F.round("r2", 6).alias("r2"))


def describe_metrics(s: SparkSession, d: str) -> DataFrame:
    """Count, mean, deviation and range of two metrics."""
    x = T(s, d, _R)
    parts = [x.filter(_num(c).isNotNull()).agg(F.lit(c).alias("metric"), F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high")) for c in ("bleu", "rouge_l")]
    return parts[0].unionByName(parts[1])


def length_distribution(s: SparkSession, d: str) -> DataFrame:
    """Quantiles of answer lengths in characters by question type."""
    x = T(s, d, "ehrqa_finetune").withColumn("n", F.length("answer").cast("double"))
    return x.groupBy("question_type").agg(F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"), F.max("n").alias("most"))


def mode_totals(s: SparkSession, d: str) -> DataFrame:
    """Mean estimate and facts of router examples by mode."""
    return T(s, d, "router_train_examples").groupBy(F.upper(F.trim("mode")).alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prompt_token_estimate"), 6).alias("tokens"), F.round(F.avg("n_kg_facts"), 6).alias("facts"))


def oracle_label(s: SparkSession, d: str) -> DataFrame:
    return policy.oracle_labels(_scores(s, d))


def oracle_tie_rate(s: SparkSession, d: str) -> DataFrame:
    return policy.oracle_labels(_scores(s, d)).groupBy("best_mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("was_tie").cast("double")), 6).alias("tie_rate"))


def missing_modes(s: SparkSession, d: str) -> DataFrame:
    return policy.missing_modes(_scores(s, d))


def static_policy(s: SparkSession, d: str) -> DataFrame:
    """Oracle's majority mode of each question type, applied to the questions."""
    x = _once(s, d).filter("system = 'T'").select(F.col("q_idx").alias("q"), "question_type")
    labelled = x.join(policy.oracle_labels(_scores(s, d)), "q").withColumnRenamed("best_mode", "mode")
    return policy.static_policy(labelled, x, "question_type", "mode").groupBy("question_type", "mode").agg(F.count(F.lit(1)).alias("n"))


def random_policy(s: SparkSession, d: str) -> DataFrame:
    x = _once(s, d).filter("system = 'T'").select(F.col("q_idx").alias("q"))
    return policy.random_policy(x, "q").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def routing_cost(s: SparkSession, d: str) -> DataFrame:
    """Mean cost of each routed system against the oracle."""
    best = policy.oracle_labels(_scores(s, d)).select(F.col("q").alias("q_idx"), "best_mode")
    x = _once(s, d).filter("mode_used is not null").join(best, "q_idx")
    return x.groupBy("system").agg(F.round(policy.routing_cost(x, "mode_used", "best_mode"), 6).alias("cost"), F.round(F.avg((F.col("mode_used") == F.col("best_mode")).cast("double")), 6).alias("accuracy"))


def system_answers(s: SparkSession, d: str) -> DataFrame:
    """Quality a policy gets by taking the chosen mode's answer."""
    chosen = _once(s, d).filter("system = 'Router' and mode_used is not null").select(F.col("q_idx").alias("q"), F.col("mode_used").alias("mode"))
    return policy.project(chosen, _scores(s, d)).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


def oracle_upper_bound(s: SparkSession, d: str) -> DataFrame:
    x = policy.upper_bound(_scores(s, d), "q", F.col("score"))
    return x.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


def baselines(s: SparkSession, d: str) -> DataFrame:
    """Accuracy of always choosing the commonest label, and of drawing by label shares."""
    c = policy.oracle_labels(_scores(s, d)).groupBy("best_mode").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.round(F.max("n") / F.sum("n"), 6).alias("majority"), F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("drawn"))


def confusion(s: SparkSession, d: str) -> DataFrame:
    """Oracle label against the router's mode."""
    best = policy.oracle_labels(_scores(s, d)).select(F.col("q").alias("q_idx"), "best_mode")
    x = _once(s, d).filter("system = 'Router'").join(best, "q_idx")
    return x.groupBy("best_mode").pivot("mode_used", ["T", "T+E", "T+E+K"]).count().fillna(0).toDF("best_mode", "t", "te", "tek")


def _detector(s: SparkSession, d: str) -> DataFrame:
    x = _once(s, d).filter(_num("unsupported_rate").isNotNull() & _num("bleu").isNotNull())
    return x.select("system", (F.col("unsupported_rate") > 0.5).cast("int").alias("guess"), (F.col("bleu") < 0.5).cast("int").alias("truth"), "unsupported_rate")


def detector_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells, kappa, precision and recall of a detector by system."""
    t, g = F.col("truth") == 1, F.col("guess") == 1
    x = _detector(s, d).groupBy("system").agg(F.count_if(t & g).alias("tp"), F.count_if(~t & ~g).alias("tn"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    po = (F.col("tp") + F.col("tn")) / n
    pe = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp"))) / (n * n)
    return x.select("*", F.round(F.when(pe != 1, (po - pe) / (1 - pe)), 6).alias("kappa"), F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6).alias("precision"), F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6).alias("recall"))


def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    """Cells at thresholds 0.1 to 0.9; thresholds are a literal array, exploded."""
    x = _detector(s, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("g", F.col("unsupported_rate") * 10 > F.col("k"))
    t = F.col("truth") == 1
    return x.groupBy("k").agg(F.count_if(t & F.col("g")).alias("tp"), F.count_if(~t & F.col("g")).alias("fp"), F.count_if(t & ~F.col("g")).alias("fn"))


def mcnemar_cells(s: SparkSession, d: str) -> DataFrame:
    """Discordant counts of two systems' success on the same question."""
    x = _once(s, d).filter(F.col("system").isin("T", "T+E") & _num("bleu").isNotNull()).withColumn("ok", (F.col("bleu") >= 0.5).cast("int"))
    wide = x.groupBy("q_idx").pivot("system", ["T", "T+E"]).agg(F.max("ok")).toDF("q_idx", "a", "b").dropna()
    return wide.agg(F.count_if(F.expr("a = 1 and b = 0")).alias("b"), F.count_if(F.expr("a = 0 and b = 1")).alias("c"), F.count(F.lit(1)).alias("n"))


def drift(s: SparkSession, d: str) -> DataFrame:
    """Label flips and mean change between two scores of the same answers."""
    x = T(s, d, _R).filter(_num("bleu").isNotNull() & _num("rouge_l").isNotNull())
    return x.groupBy("system").agg(F.count_if((F.col("bleu") > 0.5) != (F.col("rouge_l") > 0.5)).alias("flips"), F.round(F.avg(F.abs(F.col("bleu") - F.col("rouge_l"))), 6).alias("change"))


def not_applicable(s: SparkSession, d: str) -> DataFrame:
    """Record metrics by mode: null where the mode has no record, counted apart."""
    x = T(s, d, _R).filter("mode_used is not null").withColumn("m", F.when(F.col("mode_used") != "T", _num("ehr_contradiction")))
    return x.groupBy("mode_used").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mode_used") == "T").alias("n_na"), F.round(F.avg("m"), 6).alias("mean"))


def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap intervals of BLEU."""
    systems = ["T", "T+E", "T+E+K"]
    rows = stats.bootstrap_intervals(stats.paired(T(s, d, _R), "q_idx", "system", "bleu", systems), systems)
    return s.createDataFrame([(r["system"], r["mean"], r["low"], r["high"]) for r in rows], "system string, mean double, low double, high double")


def wilcoxon(s: SparkSession, d: str) -> DataFrame:
    """Signed-rank tests of the modes against the dearest, with Holm's correction."""
    wide = stats.paired(T(s, d, _R), "q_idx", "system", "bleu", ["T", "T+E", "T+E+K"])
    tests = [(a, stats.wilcoxon(wide, "T+E+K", a)) for a in ("T", "T+E")]
    adjusted = stats.holm([t["p"] for _, t in tests])
    return s.createDataFrame([(a, t["n"], t["w_plus"], t["p"], p) for (a, t), p in zip(tests, adjusted)], "versus string, n long, w_plus double, p double, p_holm double")


def split_assign(s: SparkSession, d: str) -> DataFrame:
    """Patients of the diagnoses in exact shares of 70, 10, 5 and 15 percent."""
    return sampling.exact_split(T(s, d, "diagnoses"), "subject_id", [("finetune", 0.7), ("router_train", 0.1), ("router_val", 0.05), ("eval", 0.15)]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("subject_id").alias("low"))


def hash_split(s: SparkSession, d: str) -> DataFrame:
    """Fine-tuning rows with 4 percent held out by hash."""
    return sampling.hash_split(T(s, d, "ehrqa_finetune"), "qa_id", [("train", 0.96), ("held_out", 0.04)]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("qa_id").alias("ids"))


def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """Seventy results spread over the systems, in hash order."""
    q = sampling.even_quotas(["T", "T+E", "T+E+K", "Router", "Random", "StaticQType"], 70)
    return sampling.stratified(T(s, d, _R), "system", "result_id", q).select("result_id", "system", "rn")


def annotation_sheet(s: SparkSession, d: str) -> DataFrame:
    """A numbered sample with attention checks between."""
    rows = stratified_sample(s, d).filter("rn <= 5").join(T(s, d, _R).select("result_id", "predicted_answer"), "result_id").withColumn("is_attention_check", F.lit(False)).drop("rn")
    both = rows.unionByName(sampling.attention_checks(rows.drop("is_attention_check"), "result_id", "predicted_answer", 6))
    return sampling.with_ids(both, [sampling.order_hash(F.concat_ws("|", "result_id", F.col("is_attention_check").cast("string")), 3)]).select("annot_id", "result_id", "is_attention_check")


def router_model(s: SparkSession, d: str) -> DataFrame:
    """A router trained on record features, scored on a held-out fifth of the questions."""
    return _router(s, d, ["n_kg_facts", "prompt_tokens", "qtype", "bucket"])


def ablation(s: SparkSession, d: str) -> DataFrame:
    """The router without each group of features."""
    groups = {"all": [], "no question": ["qtype"], "no record": ["bucket", "n_kg_facts", "prompt_tokens"]}
    cols = ["n_kg_facts", "prompt_tokens", "qtype", "bucket"]
    out = None
    for name, gone in groups.items():
        part = _router(s, d, [c for c in cols if c not in gone]).select(F.lit(name).alias("features"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _router(s: SparkSession, d: str, numeric: list[str]) -> DataFrame:
    best = policy.oracle_labels(_scores(s, d)).select(F.col("q").alias("q_idx"), (F.array_position(F.array(*map(F.lit, policy.MODES)), F.col("best_mode")) - 1).cast("double").alias("label"))
    x = _once(s, d).filter("system = 'T+E+K'").join(best, "q_idx")
    x = x.withColumn("qtype", F.pmod(F.crc32(F.coalesce("question_type", F.lit(""))), F.lit(97)).cast("double")).withColumn("bucket", F.pmod(F.crc32(F.coalesce("sparsity_bucket", F.lit(""))), F.lit(11)).cast("double"))
    f = sampling.hash_split(model.features(x, numeric), "q_idx", [("train", 0.8), ("test", 0.2)])
    fitted = model.train(f.filter("split = 'train'"), trees=20, depth=5)
    got = model.scores(fitted.transform(f.filter("split = 'test'")), "label", "prediction")
    return s.createDataFrame([(k, float(v)) for k, v in sorted(got.items())], "metric string, value double")


QUERIES = {f.__name__: f for f in (
    summary_by_system, by_system_bucket, pivot_metric, unstack_fill, percentiles, latency_split, value_shares, conditional_rate, majority_mode, argmax_row, pearson_length, describe_metrics, length_distribution, mode_totals,
    oracle_label, oracle_tie_rate, missing_modes, static_policy, random_policy, routing_cost, system_answers, oracle_upper_bound, baselines, confusion, detector_cells, threshold_sweep, mcnemar_cells, drift, not_applicable,
    bootstrap_ci, wilcoxon, split_assign, hash_split, stratified_sample, annotation_sheet, router_model, ablation,
)}

_ONCE = "one AS (SELECT * FROM per_question_results WHERE q_idx IS NOT NULL AND system IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q_idx, system ORDER BY result_id) = 1)"
_N = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END"
_SCORES = _ONCE + f", sc AS (SELECT q_idx AS q, system AS mode, floor((CAST(0.6 AS DOUBLE) * coalesce({_N('bertscore_f1')}, 0) + CAST(0.25 AS DOUBLE) * coalesce({_N('rouge_l')}, 0)) * 10000 + CAST(0.5 AS DOUBLE)) / 10000 AS score, CASE system WHEN 'T' THEN 0 WHEN 'T+E' THEN 1 ELSE 2 END AS rk FROM one WHERE system IN ('T', 'T+E', 'T+E+K'))"
_ORACLE = _SCORES + """, full3 AS (SELECT q, max(score - rk * 0.001) AS top, max(score) AS raw FROM sc GROUP BY q HAVING count(*) = 3),
orc AS (SELECT q, arg_min(mode, rk) FILTER (WHERE top - (score - rk * 0.001) <= 1e-4) AS best_mode, arg_min(score, rk) FILTER (WHERE top - (score - rk * 0.001) <= 1e-4) AS best_score, count(*) FILTER (WHERE raw - score <= 1e-4) > 1 AS was_tie FROM sc JOIN full3 USING (q) GROUP BY q)"""
_MD5 = "md5('{0}|' || CAST({1} AS VARCHAR))"
_UNIT = "CAST(('0x' || substr(" + _MD5 + ", 1, 8)) AS BIGINT)"
SQL = {
    "summary_by_system": "SELECT system, count(*) AS n, " + ", ".join(f"round(avg({_N(c)}), 6) AS {c}" for c in ("bleu", "rouge_l", "bertscore_f1", "unsupported_rate")) + " FROM per_question_results GROUP BY system",
    "by_system_bucket": f"SELECT system, sparsity_bucket, question_type, CAST(grouping_id(system, sparsity_bucket, question_type) AS INTEGER) AS level, count(*) AS n, round(avg({_N('bleu')}), 6) AS bleu FROM per_question_results GROUP BY GROUPING SETS ((system), (system, sparsity_bucket), (system, question_type))",
    "pivot_metric": "SELECT question_type, " + ", ".join(f"round(avg({_N('bleu')}) FILTER (WHERE system = '{m}'), 6) AS {a}" for m, a in (("T", "t"), ("T+E", "te"), ("T+E+K", "tek"))) + " FROM per_question_results GROUP BY question_type",
    "unstack_fill": "SELECT sparsity_bucket, " + ", ".join(f"count(*) FILTER (WHERE mode_used = '{m}') AS {a}" for m, a in (("T", "t"), ("T+E", "te"), ("T+E+K", "tek"))) + " FROM per_question_results GROUP BY sparsity_bucket",
    "percentiles": "SELECT system, round(avg(total_latency_ms), 4) AS mean, round(quantile_cont(total_latency_ms, 0.5), 4) AS median, round(quantile_cont(total_latency_ms, 0.95), 4) AS p95, round(quantile_cont(total_latency_ms, 0.99), 4) AS p99, max(total_latency_ms) AS most FROM per_question_results WHERE total_latency_ms >= 0 AND NOT isnan(total_latency_ms) GROUP BY system",
    "latency_split": "SELECT system, round(avg(retrieval_latency_ms), 4) AS retrieval, round(avg(total_latency_ms) - avg(retrieval_latency_ms), 4) AS generation, round(avg(retrieval_latency_ms) / avg(total_latency_ms) * 100, 4) AS retrieval_percent FROM per_question_results WHERE total_latency_ms >= 0 AND retrieval_latency_ms >= 0 AND NOT isnan(total_latency_ms) AND NOT isnan(retrieval_latency_ms) GROUP BY system",
    "value_shares": "SELECT mode_used, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM per_question_results GROUP BY mode_used",
    "conditional_rate": f"SELECT system, round(avg(CASE WHEN unsupported_rate > 0.5 THEN 1.0 ELSE 0.0 END) * 100, 4) AS percent FROM per_question_results WHERE {_N('unsupported_rate')} IS NOT NULL GROUP BY system",
    "majority_mode": "SELECT question_type, mode_used FROM (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY n DESC, mode_used) AS r FROM (SELECT question_type, mode_used, count(*) AS n FROM per_question_results WHERE question_type IS NOT NULL AND mode_used IS NOT NULL GROUP BY ALL)) WHERE r = 1",
    "argmax_row": f"WITH {_ONCE} SELECT q_idx, system, bleu FROM one WHERE {_N('bleu')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q_idx ORDER BY bleu DESC, result_id) = 1",
    "pearson_length": "SELECT system, count(*) AS n, round(corr(prompt_tokens, unsupported_rate), 6) AS r, round(corr(prompt_tokens, unsupported_rate) ** 2, 6) AS r2 FROM per_question_results WHERE prompt_tokens IS NOT NULL AND unsupported_rate IS NOT NULL AND NOT isnan(unsupported_rate) GROUP BY system",
    "describe_metrics": " UNION ALL ".join(f"SELECT '{c}' AS metric, count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, min({c}) AS low, max({c}) AS high FROM per_question_results WHERE {_N(c)} IS NOT NULL" for c in ("bleu", "rouge_l")),
    "length_distribution": "SELECT question_type, quantile_cont(CAST(length(answer) AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(length(answer) AS DOUBLE), 0.9) AS p90, CAST(max(length(answer)) AS DOUBLE) AS most FROM ehrqa_finetune GROUP BY question_type",
    "mode_totals": "SELECT upper(trim(mode)) AS mode, count(*) AS n, round(avg(prompt_token_estimate), 6) AS tokens, round(avg(n_kg_facts), 6) AS facts FROM router_train_examples GROUP BY 1",
    "oracle_label": f"WITH {_ORACLE} SELECT q, best_mode, best_score, was_tie FROM orc",
    "oracle_tie_rate": f"WITH {_ORACLE} SELECT best_mode, count(*) AS n, round(avg(CASE WHEN was_tie THEN 1.0 ELSE 0.0 END), 6) AS tie_rate FROM orc GROUP BY 1",
    "missing_modes": f"WITH {_SCORES} SELECT q, count(DISTINCT mode) AS n FROM sc GROUP BY q HAVING count(DISTINCT mode) < 3",
    "static_policy": f"""WITH {_ORACLE}, x AS (SELECT q_idx AS q, question_type FROM one WHERE system = 'T'), l AS (SELECT * FROM x JOIN orc USING (q)),
m AS (SELECT question_type, best_mode AS mode FROM (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY n DESC, best_mode) AS r FROM (SELECT question_type, best_mode, count(*) AS n FROM l GROUP BY ALL)) WHERE r = 1),
o AS (SELECT best_mode AS om FROM l GROUP BY 1 ORDER BY count(*) DESC, best_mode LIMIT 1)
SELECT x.question_type, coalesce(m.mode, o.om) AS mode, count(*) AS n FROM x LEFT JOIN m ON x.question_type = m.question_type, o GROUP BY ALL""",
    "random_policy": f"WITH {_ONCE}, u AS (SELECT {_UNIT.format(17, 'q_idx')} % 1000000 / 1000000 * 3 AS u FROM one WHERE system = 'T') SELECT CASE WHEN u < 1 THEN 'T' WHEN u < 2 THEN 'T+E' ELSE 'T+E+K' END AS mode, count(*) AS n FROM u GROUP BY 1",
    "routing_cost": f"WITH {_ORACLE} SELECT system, round(avg(CASE mode_used WHEN 'T' THEN 1.0 WHEN 'T+E' THEN 3.0 ELSE 10.0 END + CASE WHEN mode_used <> best_mode THEN 15.0 ELSE 0.0 END), 6) AS cost, round(avg(CASE WHEN mode_used = best_mode THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM one JOIN orc ON q = q_idx WHERE mode_used IS NOT NULL GROUP BY system",
    "system_answers": f"WITH {_SCORES} SELECT sc.mode, count(*) AS n, round(avg(score), 6) AS score FROM one JOIN sc ON sc.q = q_idx AND sc.mode = mode_used WHERE system = 'Router' GROUP BY 1",
    "oracle_upper_bound": f"WITH {_SCORES} SELECT mode, count(*) AS n, round(avg(score), 6) AS score FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, rk) = 1) GROUP BY mode",
    "baselines": f"WITH {_ORACLE}, c AS (SELECT best_mode, count(*) AS n FROM orc GROUP BY 1) SELECT round(max(n) / sum(n), 6) AS majority, round(sum(n * n) / (sum(n) * sum(n)), 6) AS drawn FROM c",
    "confusion": f"WITH {_ORACLE} SELECT best_mode, " + ", ".join(f"count(*) FILTER (WHERE mode_used = '{m}') AS {a}" for m, a in (("T", "t"), ("T+E", "te"), ("T+E+K", "tek"))) + " FROM one JOIN orc ON q = q_idx WHERE system = 'Router' GROUP BY 1",
    "detector_cells": f"""WITH {_ONCE}, x AS (SELECT system, unsupported_rate > 0.5 AS g, bleu < 0.5 AS t FROM one WHERE {_N('unsupported_rate')} IS NOT NULL AND {_N('bleu')} IS NOT NULL),
c AS (SELECT system, count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND NOT g) AS tn, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn FROM x GROUP BY system),
k AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS po, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn)) AS pe FROM c)
SELECT system, tp, tn, fp, fn, round(CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM k""",
    "threshold_sweep": f"WITH {_ONCE}, x AS (SELECT unsupported_rate AS u, bleu < 0.5 AS t FROM one WHERE {_N('unsupported_rate')} IS NOT NULL AND {_N('bleu')} IS NOT NULL) SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE t AND u * 10 > k) AS tp, count(*) FILTER (WHERE NOT t AND u * 10 > k) AS fp, count(*) FILTER (WHERE t AND NOT u * 10 > k) AS fn FROM x, range(1, 10) r(k) GROUP BY k",
    "mcnemar_cells": f"WITH {_ONCE}, w AS (SELECT q_idx, max(CASE WHEN bleu >= 0.5 THEN 1 ELSE 0 END) FILTER (WHERE system = 'T') AS a, max(CASE WHEN bleu >= 0.5 THEN 1 ELSE 0 END) FILTER (WHERE system = 'T+E') AS b FROM one WHERE {_N('bleu')} IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (WHERE a = 1 AND b = 0) AS b, count(*) FILTER (WHERE a = 0 AND b = 1) AS c, count(*) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL",
    "drift": f"SELECT system, count(*) FILTER (WHERE (bleu > 0.5) <> (rouge_l > 0.5)) AS flips, round(avg(abs(bleu - rouge_l)), 6) AS change FROM per_question_results WHERE {_N('bleu')} IS NOT NULL AND {_N('rouge_l')} IS NOT NULL GROUP BY system",
    "not_applicable": f"SELECT mode_used, count(*) AS n, count(*) FILTER (WHERE mode_used = 'T') AS n_na, round(avg(CASE WHEN mode_used <> 'T' THEN {_N('ehr_contradiction')} END), 6) AS mean FROM per_question_results WHERE mode_used IS NOT NULL GROUP BY mode_used",
    "split_assign": f"""WITH i AS (SELECT DISTINCT subject_id FROM diagnoses WHERE subject_id IS NOT NULL), r AS (SELECT subject_id, row_number() OVER (ORDER BY {_MD5.format(42, 'subject_id')}, subject_id) AS r, count(*) OVER () AS n FROM i),
s AS (SELECT *, n - CAST(floor(n * 0.1 + 1e-9) + floor(n * 0.05 + 1e-9) + floor(n * 0.15 + 1e-9) AS BIGINT) AS a, CAST(floor(n * 0.1 + 1e-9) AS BIGINT) AS b, CAST(floor(n * 0.05 + 1e-9) AS BIGINT) AS c FROM r)
SELECT CASE WHEN r <= a THEN 'finetune' WHEN r <= a + b THEN 'router_train' WHEN r <= a + b + c THEN 'router_val' ELSE 'eval' END AS split, count(*) AS n, min(subject_id) AS low FROM s GROUP BY 1""",
    "hash_split": f"SELECT CASE WHEN {_UNIT.format(42, 'qa_id')} / 4294967296.0 < 0.96 THEN 'train' ELSE 'held_out' END AS split, count(*) AS n, CAST(sum(qa_id) AS BIGINT) AS ids FROM ehrqa_finetune GROUP BY 1",
    "stratified_sample": f"SELECT result_id, system, CAST(rn AS INTEGER) AS rn FROM (SELECT result_id, system, row_number() OVER (PARTITION BY system ORDER BY {_MD5.format(7, 'result_id')}, result_id) AS rn FROM per_question_results) WHERE rn <= CASE system WHEN 'T' THEN 12 WHEN 'T+E' THEN 12 WHEN 'T+E+K' THEN 12 WHEN 'Router' THEN 12 WHEN 'Random' THEN 11 WHEN 'StaticQType' THEN 11 ELSE 0 END",
}
