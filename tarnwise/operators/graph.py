"""A small property graph as node and edge frames; everything is one hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwise.session import broadcast_if_small

# Words too general to match a node by.
STOPWORDS = ["chronic", "disease", "acute", "unspecified", "stage", "with", "without", "mention", "other", "and", "the", "of", "in", "type", "disorder"]
# Edge types in the order their facts are told, the most facts of each (None: all), and the sentence.
FACTS = [
    ("HAS_SYMPTOM", 3, "{s} commonly presents with: {list}."),
    ("INDICATES_LAB", 3, "Relevant lab tests for {s}: {list}."),
    ("FIRST_LINE_TREATMENT", 3, "First-line treatment options for {s}: {list}."),
    ("CONTRAINDICATED_WITH", None, "CAUTION: {item} is contraindicated in {s}."),
    ("CO_OCCURS_WITH_LAB", 3, "Labs frequently ordered with {s} in practice: {list}."),
]


def merge_edges(*families: DataFrame) -> DataFrame:
    """One frame of src, edge_type, dst, dst_type, notes, frequency, ord; repeats of an edge merge into the one of least ord."""
    cols = ["src", "edge_type", "dst", "dst_type", "notes", "frequency", "ord"]
    out = None
    for f in families:
        have = set(f.columns)
        types = {"notes": "string", "frequency": "double", "ord": "long"}
        f = f.select(*[F.col(c) if c in have else F.lit(None).cast(types[c]).alias(c) for c in cols])
        out = f if out is None else out.unionByName(f)
    keep = F.min_by(F.struct("dst_type", "notes", "frequency", "ord"), F.coalesce("ord", F.lit(1 << 60)))
    return out.filter("src is not null and dst is not null").groupBy("src", "edge_type", "dst").agg(keep.alias("e")).select("src", "edge_type", "dst", "e.*")


def nodes_of(edges: DataFrame, src_label: str = "Disease") -> DataFrame:
    """Distinct (label, name) of both ends."""
    return edges.select(F.lit(src_label).alias("label"), F.col("src").alias("name")).unionByName(edges.select(F.col("dst_type").alias("label"), F.col("dst").alias("name"))).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    """Counts by node label and by edge type."""
    a = nodes_of(edges).groupBy(F.concat(F.lit("node:"), "label").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges.groupBy(F.concat(F.lit("edge:"), "edge_type").alias("part")).agg(F.count(F.lit(1)).alias("n")))


def significant_terms(text: Column) -> Column:
    """Distinct lower-case words and numbers of three characters or more, without the stopwords."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS)))


def match_nodes(texts: DataFrame, nodes: DataFrame, least: float = 0.6, most: int = 3) -> DataFrame:
    """(q, rank, name): up to `most` distinct nodes of each q, in order of its texts.

    texts: q, pos, text; nodes: name, ord. A text takes the node of which it holds the
    largest share of words, the first in order on ties, if that is at least `least`.
    Words are joined to words, so texts are never paired with nodes that share none.
    """
    words = broadcast_if_small(nodes.select("name", "ord", significant_terms(F.col("name")).alias("w")).filter(F.size("w") > 0).select("name", "ord", F.size("w").alias("n"), F.explode("w").alias("t")))
    asked = texts.select("q", "pos", F.explode(significant_terms(F.col("text"))).alias("t"))
    score = asked.join(words, "t").groupBy("q", "pos", "name", "ord", "n").agg(F.count(F.lit(1)).alias("hit")).withColumn("share", F.col("hit") / F.col("n"))
    best = score.groupBy("q", "pos").agg(F.max_by(F.struct("name", "share"), F.struct("share", -F.col("ord"))).alias("b")).select("q", "pos", "b.*").filter(F.col("share") >= least)
    first = best.groupBy("q", "name").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("pos", "name"))).filter(F.col("rank") <= most).select("q", "rank", "name")


def one_hop(edges: DataFrame) -> DataFrame:
    """Edges kept for facts, with their place `rn` within source and type: by frequency, then by order."""
    limits = F.create_map(*[x for t, n, _ in FACTS for x in (F.lit(t), F.lit(n if n is not None else 1 << 30))])
    w = Window.partitionBy("src", "edge_type").orderBy(F.col("frequency").desc_nulls_last(), F.col("ord").asc_nulls_last(), "dst")
    return edges.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.try_element_at(limits, F.col("edge_type")))


def facts(edges: DataFrame) -> DataFrame:
    """(src, ord, fact): sentences of each source, one an edge type, or one an edge for cautions."""
    kept = one_hop(edges)
    item = F.when(F.col("edge_type") == "CO_OCCURS_WITH_LAB", F.format_string("%s (%d%% of admissions)", "dst", F.floor(F.col("frequency") * 100 + 0.5))).otherwise(F.col("dst"))
    lists = kept.filter("edge_type <> 'CONTRAINDICATED_WITH'").groupBy("src", "edge_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("t")))), lambda x: x["t"]), ", ").alias("items"))
    out = None
    for i, (edge_type, _, sentence) in enumerate(FACTS):
        if "{item}" in sentence:
            rows = kept.filter(F.col("edge_type") == edge_type)
            text = F.concat(F.lit("CAUTION: "), "dst", F.lit(" is contraindicated in "), "src", F.when(F.length("notes") > 0, F.concat(F.lit(" ("), "notes", F.lit(")"))).otherwise(""), F.lit("."))
            part = rows.select("src", (F.lit(i * 1000) + F.col("rn")).alias("ord"), text.alias("fact"))
        else:
            rows = lists.filter(F.col("edge_type") == edge_type)
            head, tail = sentence.split("{list}")
            a, b = head.split("{s}")
            part = rows.select("src", F.lit(i * 1000).alias("ord"), F.concat(F.lit(a), "src", F.lit(b), "items", F.lit(tail)).alias("fact"))
        out = part if out is None else out.unionByName(part)
    return out
