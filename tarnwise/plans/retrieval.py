"""Named queries on the graph and on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.operators import graph, vectors
from tarnwise.sources.catalog import table as T


def _edges(s: SparkSession, d: str) -> DataFrame:
    """Edges of the co-occurrence export, and indications taken from its commonest pairs."""
    e = T(s, d, "cooccurrence_edges").filter("length(trim(disease)) > 0 and length(trim(lab_test)) > 0 and total_admissions > 0 and n_admissions_with_lab is not null")
    e = e.groupBy(F.trim("disease").alias("src"), F.trim("lab_test").alias("dst")).agg(F.max(F.col("n_admissions_with_lab") / F.col("total_admissions")).alias("frequency"))
    return graph.merge_edges(
        e.select("src", F.lit("CO_OCCURS_WITH_LAB").alias("edge_type"), "dst", F.lit("LabTest").alias("dst_type"), "frequency"),
        e.filter("frequency > 0.8").select("src", F.lit("INDICATES_LAB").alias("edge_type"), "dst", F.lit("LabTest").alias("dst_type")),
    )


def graph_stats(s: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(_edges(s, d))


def graph_one_hop(s: SparkSession, d: str) -> DataFrame:
    return graph.one_hop(_edges(s, d)).select("src", "edge_type", "rn", "dst")


def graph_facts(s: SparkSession, d: str) -> DataFrame:
    return graph.facts(_edges(s, d))


def node_match(s: SparkSession, d: str) -> DataFrame:
    """Seed diseases each evaluation question names, its diagnoses first."""
    q = T(s, d, "ehrqa_eval").select(F.col("qa_id").alias("q"), F.concat(F.split(F.coalesce("diagnoses", F.lit("")), r"\s*\|\s*"), F.array(F.coalesce("question", F.lit("")))).alias("t"))
    texts = q.select("q", F.posexplode("t").alias("pos", "text"))
    seeds = T(s, d, "seed_diseases").filter("name is not null").select("name", F.col("icd9_prefix").cast("long").alias("ord"))
    return graph.match_nodes(texts, seeds)


def _queries(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))


def knn_exact_topk(s: SparkSession, d: str) -> DataFrame:
    """Five nearest vectors of each query vector, all vectors searched."""
    return vectors.knn_exact(_queries(s, d), T(s, d, "embeddings")).select("q_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def knn_label_filtered(s: SparkSession, d: str) -> DataFrame:
    """The same among vectors of label 3."""
    return vectors.knn_exact(_queries(s, d), T(s, d, "embeddings").filter("label = 3")).select("q_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def knn_ivf(s: SparkSession, d: str) -> DataFrame:
    """Approximate search by inverted lists."""
    return vectors.knn_ivf(_queries(s, d), T(s, d, "embeddings")).select("q_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def text_embedding(s: SparkSession, d: str) -> DataFrame:
    """Hashed unit vectors of all documents, questions of both sets and seed diseases' names; empty and null texts have norm 0."""
    out = None
    for kind, name, key, text in (("document", "documents", "doc_id", "text"), ("eval", "ehrqa_eval", "qa_id", "question"), ("finetune", "ehrqa_finetune", "qa_id", "question"), ("disease", "seed_diseases", "name", "name")):
        e = vectors.embed_text(T(s, d, name), key, text, 64).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "embedding", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))
        out = e if out is None else out.unionByName(e)
    return out


QUERIES = {f.__name__: f for f in (graph_stats, graph_one_hop, graph_facts, node_match, knn_exact_topk, knn_label_filtered, knn_ivf, text_embedding)}
_E = """
WITH e AS (SELECT trim(disease) AS src, trim(lab_test) AS dst, max(n_admissions_with_lab / total_admissions) AS f FROM cooccurrence_edges
  WHERE length(trim(disease)) > 0 AND length(trim(lab_test)) > 0 AND total_admissions > 0 AND n_admissions_with_lab IS NOT NULL GROUP BY ALL),
g AS (SELECT src, 'CO_OCCURS_WITH_LAB' AS edge_type, dst, f FROM e UNION ALL SELECT src, 'INDICATES_LAB', dst, NULL FROM e WHERE f > 0.8),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY src, edge_type ORDER BY f DESC NULLS LAST, dst) AS INTEGER) AS rn FROM g)
"""
_KNN = """
SELECT q_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 4) AS score FROM (
  SELECT q.vec_id AS q_id, b.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank
  FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0 {0}) WHERE rank <= 5"""
_STOP = ", ".join(f"'{w}'" for w in graph.STOPWORDS)
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains([" + _STOP + "], x)))"
SQL = {
    "graph_stats": _E + "SELECT 'node:Disease' AS part, count(DISTINCT src) AS n FROM e UNION ALL SELECT 'node:LabTest', count(DISTINCT dst) FROM e UNION ALL SELECT 'edge:' || edge_type, count(*) FROM g GROUP BY edge_type",
    "graph_one_hop": _E + "SELECT src, edge_type, rn, dst FROM h WHERE rn <= 3",
    "graph_facts": _E + """
SELECT src, CAST(CASE edge_type WHEN 'INDICATES_LAB' THEN 1000 ELSE 4000 END AS INTEGER) AS ord,
  CASE edge_type WHEN 'INDICATES_LAB' THEN 'Relevant lab tests for ' || src || ': ' ELSE 'Labs frequently ordered with ' || src || ' in practice: ' END
  || string_agg(CASE edge_type WHEN 'INDICATES_LAB' THEN dst ELSE dst || ' (' || CAST(floor(f * 100 + 0.5) AS BIGINT) || '% of admissions)' END, ', ' ORDER BY rn) || '.' AS fact
FROM h WHERE rn <= 3 GROUP BY src, edge_type""",
    "node_match": f"""
WITH t AS (SELECT qa_id AS q, unnest(list_append(string_split_regex(coalesce(diagnoses, ''), '\\s*\\|\\s*'), coalesce(question, ''))) AS text, generate_subscripts(list_append(string_split_regex(coalesce(diagnoses, ''), '\\s*\\|\\s*'), coalesce(question, '')), 1) AS pos FROM ehrqa_eval),
w AS (SELECT q, pos, {_TERMS.format("text")} AS tw FROM t),
n AS (SELECT name, CAST(icd9_prefix AS BIGINT) AS ord, {_TERMS.format("name")} AS nw FROM seed_diseases WHERE name IS NOT NULL),
s AS (SELECT q, pos, name, len(list_intersect(tw, nw)) / len(nw) AS share, ord FROM w, n WHERE len(nw) > 0),
b AS (SELECT q, pos, name FROM s WHERE share > 0 QUALIFY row_number() OVER (PARTITION BY q, pos ORDER BY share DESC, ord) = 1 AND share >= 0.6),
f AS (SELECT q, name, min(pos) AS pos FROM b GROUP BY ALL)
SELECT q, CAST(rank AS INTEGER) AS rank, name FROM (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY pos, name) AS rank FROM f) WHERE rank <= 3""",
    "knn_exact_topk": _KNN.format(""),
    "knn_label_filtered": _KNN.format("AND b.label = 3"),
}
