"""Named queries on entities, snapshots, cohorts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwise.operators import chunks, entity
from tarnwise.operators import relational as R
from tarnwise.sources.catalog import table as T


def sparsity_score(s: SparkSession, d: str) -> DataFrame:
    """Record sparsity of every admission with a question."""
    cohort = T(s, d, "ehrqa_eval").select("hadm_id").unionByName(T(s, d, "ehrqa_finetune").select("hadm_id"))
    return entity.sparsity(cohort, T(s, d, "labs"), T(s, d, "diagnoses"), T(s, d, "documents"), T(s, d, "labs"))


def entity_snapshot_labs(s: SparkSession, d: str) -> DataFrame:
    return entity.snapshot_labs(T(s, d, "labs"), T(s, d, "d_labitems"))


def entity_snapshot_vitals(s: SparkSession, d: str) -> DataFrame:
    return entity.snapshot_vitals(T(s, d, "vitals"), T(s, d, "d_vitalitems"))


def entity_snapshot_diagnoses(s: SparkSession, d: str) -> DataFrame:
    return entity.snapshot_diagnoses(T(s, d, "diagnoses"))


def entity_snapshot_meds(s: SparkSession, d: str) -> DataFrame:
    """Eight distinct parts of each order in order of first shipping, as its medications."""
    x = T(s, d, "lineitem").join(T(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").filter(F.length(F.trim("p_name")) > 0)
    x = x.groupBy("l_orderkey", "p_name").agg(F.min("l_shipdate").alias("ts"))
    w = Window.partitionBy("l_orderkey").orderBy(F.col("ts").asc_nulls_last(), "p_name")
    return x.withColumn("rn", F.row_number().over(w)).filter("rn <= 8").select("l_orderkey", "rn", "p_name")


def snapshot_text(s: SparkSession, d: str) -> DataFrame:
    return entity.snapshot_text(entity_snapshot_labs(s, d).filter("rn <= 3"), entity_snapshot_vitals(s, d).filter("rn <= 3"), entity_snapshot_diagnoses(s, d), sparsity_score(s, d))


def cooccurrence_edges_built(s: SparkSession, d: str) -> DataFrame:
    """Lab tests of each seed disease's admissions, above 5 percent, the 15 commonest."""
    seeds = T(s, d, "seed_diseases").select("name", F.explode(F.array("icd9_prefix", "icd10_prefix")).alias("prefix"))
    cohorts = R.prefix_cohort(T(s, d, "diagnoses").filter("hadm_id is not null"), seeds, "hadm_id", "icd_code")
    items = T(s, d, "d_labitems").select("itemid", F.col("label").alias("item")).filter("item is not null")
    labs = T(s, d, "labs").filter("hadm_id is not null").select(F.col("hadm_id").alias("entity"), "itemid").join(items, "itemid").select("entity", "item")
    return entity.item_frequency(cohorts, labs).withColumn("frequency", F.round("frequency", 6))


def chunk_words(s: SparkSession, d: str) -> DataFrame:
    """256-word windows, 32 shared."""
    return chunks.chunk_words(T(s, d, "documents"), "doc_id").select("doc_id", "pos", "n_words", F.md5("chunk").alias("h"))


def chunk_words_min25(s: SparkSession, d: str) -> DataFrame:
    """220-word windows, 40 shared, none below 25 words."""
    return chunks.chunk_words(T(s, d, "documents"), "doc_id", size=220, overlap=40, most_words=None, least_words=25).select("doc_id", "pos", "n_words", F.md5("chunk").alias("h"))


QUERIES = {f.__name__: f for f in (sparsity_score, entity_snapshot_labs, entity_snapshot_vitals, entity_snapshot_diagnoses, entity_snapshot_meds, snapshot_text, cooccurrence_edges_built, chunk_words, chunk_words_min25)}

_SPARSITY = """
sp AS (SELECT q.hadm_id, coalesce(nl, 0) AS n_labs, coalesce(nd, 0) AS n_diag,
    CAST(CASE WHEN note IS NULL THEN 999 ELSE coalesce(greatest(datediff('day', CAST(note AS DATE), CAST(fin AS DATE)), 0), 999) END AS INTEGER) AS d_note
  FROM (SELECT hadm_id FROM ehrqa_eval WHERE hadm_id IS NOT NULL UNION SELECT hadm_id FROM ehrqa_finetune WHERE hadm_id IS NOT NULL) q
  LEFT JOIN (SELECT hadm_id, count(DISTINCT itemid) AS nl, max(charttime) AS fin FROM labs GROUP BY 1) l USING (hadm_id)
  LEFT JOIN (SELECT hadm_id, count(DISTINCT icd_code) AS nd FROM diagnoses GROUP BY 1) x USING (hadm_id)
  LEFT JOIN (SELECT hadm_id, max(charttime) AS note FROM documents GROUP BY 1) n USING (hadm_id)),
spf AS (SELECT *, CASE WHEN n_labs < 5 THEN 1 ELSE 0 END AS sparse_labs, CASE WHEN n_diag < 3 THEN 1 ELSE 0 END AS sparse_diag, CASE WHEN d_note > 7 THEN 1 ELSE 0 END AS sparse_note FROM sp),
sps AS (SELECT *, CAST(sparse_labs + sparse_diag + sparse_note AS DOUBLE) AS sparsity_score, CASE WHEN sparse_labs + sparse_diag + sparse_note >= 2 THEN 'high' WHEN sparse_labs + sparse_diag + sparse_note >= 1 THEN 'medium' ELSE 'low' END AS sparsity_bucket FROM spf)
"""
_LABS = """
lab1 AS (SELECT l.hadm_id, i.name, l.valuenum, trim(l.valueuom) AS unit, l.charttime, CASE WHEN l.flag = 'abnormal' THEN 0 ELSE 1 END AS a,
    row_number() OVER (PARTITION BY l.hadm_id, i.name ORDER BY CASE WHEN l.flag = 'abnormal' THEN 0 ELSE 1 END, charttime DESC NULLS LAST, labevent_id) AS r
  FROM labs l JOIN (SELECT DISTINCT itemid, trim(label) AS name FROM d_labitems WHERE length(trim(label)) > 0) i USING (itemid) WHERE l.hadm_id IS NOT NULL AND l.valuenum IS NOT NULL AND NOT isnan(l.valuenum)),
slab AS (SELECT hadm_id, CAST(rn AS INTEGER) AS rn, name, valuenum AS value, unit, CASE WHEN a = 0 THEN 'abnormal' ELSE 'normal' END AS flag FROM (
  SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY a, charttime DESC NULLS LAST, name) AS rn FROM lab1 WHERE r = 1) WHERE rn <= 10)
"""
_VITALS = """
vit1 AS (SELECT v.hadm_id, v.itemid, d.label AS name, v.valuenum, d.unit, v.charttime, row_number() OVER (PARTITION BY v.hadm_id, v.itemid ORDER BY charttime DESC NULLS LAST, vital_id) AS r
  FROM vitals v JOIN d_vitalitems d USING (itemid) WHERE v.hadm_id IS NOT NULL AND v.valuenum IS NOT NULL AND NOT isnan(v.valuenum)),
svit AS (SELECT hadm_id, CAST(rn AS INTEGER) AS rn, name, valuenum AS value, unit FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime DESC NULLS LAST, itemid) AS rn FROM vit1 WHERE r = 1) WHERE rn <= 5)
"""
_DX = """
dx1 AS (SELECT hadm_id, upper(trim(icd_code)) AS code, icd_version, min(seq_num) AS seq FROM diagnoses WHERE hadm_id IS NOT NULL AND icd_code IS NOT NULL GROUP BY ALL),
sdx AS (SELECT hadm_id, CAST(rn AS INTEGER) AS rn, code, icd_version FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY seq NULLS LAST, code, icd_version) AS rn FROM dx1) WHERE rn <= 5)
"""


def _chunk_sql(size: int, step: int, bound: str, least: int) -> str:
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''){bound} AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((n - {size}) / {step})) AS BIGINT) + 1)) AS pos FROM n),
c AS (SELECT doc_id, pos, w[pos * {step} + 1 : pos * {step} + {size}] AS c FROM p)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(len(c) AS INTEGER) AS n_words, md5(array_to_string(c, ' ')) AS h FROM c WHERE len(c) >= {least}"""


SQL = {
    "sparsity_score": f"WITH {_SPARSITY} SELECT hadm_id, n_labs, n_diag, d_note, sparse_labs, sparse_diag, sparse_note, sparsity_score, sparsity_bucket FROM sps",
    "entity_snapshot_labs": f"WITH {_LABS} SELECT * FROM slab",
    "entity_snapshot_vitals": f"WITH {_VITALS} SELECT * FROM svit",
    "entity_snapshot_diagnoses": f"WITH {_DX} SELECT * FROM sdx",
    "entity_snapshot_meds": """
SELECT l_orderkey, CAST(rn AS INTEGER) AS rn, p_name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ts NULLS LAST, p_name) AS rn FROM (
  SELECT l_orderkey, p_name, min(l_shipdate) AS ts FROM lineitem JOIN part ON l_partkey = p_partkey WHERE length(trim(p_name)) > 0 GROUP BY ALL)) WHERE rn <= 8""",
    "snapshot_text": f"""WITH {_SPARSITY}, {_LABS}, {_VITALS}, {_DX},
a AS (SELECT hadm_id, 'Diagnoses: ' || string_agg(code, '; ' ORDER BY rn) || '.' AS t FROM sdx GROUP BY 1),
b AS (SELECT hadm_id, 'Labs: ' || string_agg(name || ' ' || printf('%.4f', value) || coalesce(unit, '') || CASE WHEN flag = 'abnormal' THEN ' [ABNORMAL]' ELSE '' END, '; ' ORDER BY rn) || '.' AS t FROM slab WHERE rn <= 3 GROUP BY 1),
c AS (SELECT hadm_id, 'Vitals: ' || string_agg(name || ' ' || printf('%.4f', value) || coalesce(unit, ''), '; ' ORDER BY rn) || '.' AS t FROM svit WHERE rn <= 3 GROUP BY 1),
e AS (SELECT hadm_id, '[EHR Sparsity: ' || sparsity_bucket || ']' AS t FROM sps)
SELECT hadm_id, concat_ws(chr(10), a.t, b.t, c.t, e.t) AS snapshot_text FROM a FULL JOIN b USING (hadm_id) FULL JOIN c USING (hadm_id) FULL JOIN e USING (hadm_id)""",
    "cooccurrence_edges_built": """
WITH c AS (SELECT DISTINCT name, hadm_id FROM diagnoses JOIN (SELECT name, icd9_prefix AS p FROM seed_diseases UNION ALL SELECT name, icd10_prefix FROM seed_diseases) ON starts_with(icd_code, p) WHERE hadm_id IS NOT NULL),
n AS (SELECT name, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT name, d.label AS lab, count(DISTINCT c.hadm_id) AS k FROM c JOIN labs l ON c.hadm_id = l.hadm_id JOIN d_labitems d ON d.itemid = l.itemid WHERE d.label IS NOT NULL GROUP BY ALL)
SELECT disease, lab_test, k AS n_admissions_with_lab, n AS total_admissions, round(k / n, 6) AS frequency FROM (
  SELECT name AS disease, lab AS lab_test, k, n, row_number() OVER (PARTITION BY name ORDER BY k DESC, lab) AS r FROM x JOIN n USING (name) WHERE k / n > 0.05) WHERE r <= 15""",
    "chunk_words": _chunk_sql(256, 224, "[1:2000]", 1),
    "chunk_words_min25": _chunk_sql(220, 180, "", 25),
}
