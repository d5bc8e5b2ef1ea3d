import numpy as np
from pyspark.sql import functions as F

from tarnwise.operators import chunks, contexts, graph, vectors


def test_knn(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None)], "vec_id long, embedding array<float>")
    q = base.filter("vec_id % 50 = 0 and embedding is not null").toDF("q_id", "q")
    exact = vectors.knn_exact(q, base)
    top = {(r["q_id"], r["rank"]): r["vec_id"] for r in exact.collect()}
    want = {i: np.argsort(-(x @ x[i]), kind="stable")[:5] for i in range(0, 400, 50)}
    assert all(top[i, k + 1] == w for i, ws in want.items() for k, w in enumerate(ws))
    assert exact.exceptAll(vectors.knn_exact(q, base.repartition(7), block_rows=3)).count() == 0
    assert vectors.recall(vectors.knn_ivf(q, base), exact) >= 0.9
    assert vectors.knn_exact(q, base.limit(0)).count() == 0


def test_embedding(spark):
    e = vectors.embed_text(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k long, t string"), "k", "t", 8)
    n = {r["k"]: r["n"] for r in e.select("k", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("n")).collect()}
    assert n == {1: 1.0, 2: 0.0, 3: 0.0}


def test_chunks(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 256, 257, 480, 481, 2001)] + [(-1, None)], "d long, text string")
    got = {}
    for r in chunks.chunk_words(docs, "d").collect():
        got.setdefault(r["d"], []).append((r["pos"], r["n_words"], r["chunk"]))
    assert {k: len(v) for k, v in got.items()} == {1: 1, 256: 1, 257: 2, 480: 2, 481: 3, 2001: 9}
    two = sorted(got[257])
    assert two[0][2].split()[224:] == two[1][2].split()[:32]
    assert chunks.chunk_words(docs, "d", size=220, overlap=40, most_words=None, least_words=25).filter("d = 1").count() == 0
    assert chunks.whole_notes(chunks.chunk_words(docs, "d"), "d", 3).select("d").distinct().count() == 3


def test_nodes_and_facts(spark):
    nodes = spark.createDataFrame([("Essential Hypertension", 1), ("Renal Hypertension", 2), ("Chronic Disease", 3)], "name string, ord long")
    texts = spark.createDataFrame([(1, 0, "hypertension"), (2, 0, "essential hypertension?"), (3, 0, "of the"), (4, 0, None), (5, 0, "x"), (5, 1, "renal hypertension."), (5, 2, "Essential, hypertension")], "q long, pos int, text string")
    got = {(r["q"], r["rank"]): r["name"] for r in graph.match_nodes(texts, nodes).collect()}
    assert got == {(2, 1): "Essential Hypertension", (5, 1): "Renal Hypertension", (5, 2): "Essential Hypertension"}
    e = spark.createDataFrame([("D", "HAS_SYMPTOM", f"s{i}", "Symptom", None, i) for i in range(5)] + [("D", "CONTRAINDICATED_WITH", f"c{i}", "Drug", "if old" if i else None, i) for i in range(4)] + [("D", "HAS_SYMPTOM", "s0", "Symptom", None, 9)], "src string, edge_type string, dst string, dst_type string, notes string, ord long")
    facts = [r["fact"] for r in graph.facts(graph.merge_edges(e)).orderBy("ord").collect()]
    assert facts[0] == "D commonly presents with: s0, s1, s2." and len(facts) == 5
    assert facts[1] == "CAUTION: c0 is contraindicated in D." and facts[2].endswith("(if old).")


def test_budgets(spark):
    q = spark.createDataFrame([(1, ["a b c", "d e", "f"], "r1 r2 r3", ["x y", "z"]), (2, ["one two three four five six"], "", []), (3, [], None, None)], "q long, passages array<string>, record string, facts array<string>")
    small = {"passages": 5, "record": 2, "facts": 2}
    once = contexts.budgeted(contexts.by_mode(q), small)
    got = {(r["q"], r["mode"]): r for r in once.collect()}
    assert got[1, "T"]["passages"] == ["a b c", "d e"] and got[1, "T"]["record"] is None and got[1, "T+E+K"]["record"] == "r1 r2"
    assert got[2, "T"]["passages"] == ["one two three four five"] and got[3, "T"]["passages"] == []
    assert contexts.budgeted(once, small).exceptAll(once).count() == 0
    text = {(r["q"], r["mode"]): r["context"] for r in contexts.assemble(once).collect()}
    assert text[3, "T+E+K"] == contexts.EMPTY and contexts.KNOWLEDGE in text[1, "T+E+K"] and contexts.RECORD not in text[1, "T"]
