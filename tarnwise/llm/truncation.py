"""Text cut off by field limits or in transfer.

Every text is split into units (lines, and sentences within them). A text whose last
unit ends with a closing mark is whole. An open last unit is looked for among the
beginnings of all longer units, and an open text among the beginnings of all longer
texts, by an equi-join on hashes of prefixes: one that longer copies go on from, and that
hardly ever stands whole, is cut. What has no longer copy is judged by how units that
begin alike close: those that nearly always do are prose, so an open one is cut. All of
this is counted over distinct texts, and each verdict holds for every copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwise.session import cut_lineage

#: Padding that may follow a cut: blanks, line ends, control and zero-width characters.
PADDING = "".join(map(chr, [*range(0, 33), *range(127, 161), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
BLANKS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
CLOSED = r"[.!?。！？]['\"”’»)\]*_`]*$"
#: Units that a beginning of one word, and of two, must have before they outweigh what is known without them.
WEIGHT_ONE, WEIGHT_TWO = 2, 5


def strip_padding(text: Column) -> Column:
    """Text without padding at its ends."""
    return F.trim(text, F.lit(PADDING))


def units_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, mask, closed, last, inner: the units of each text, in lower case with numbers as 9.

    `inner` units follow a sentence in their line. Texts without content have no units.
    """
    lines = F.split(strip_padding(F.col(text)), r"[\r\n  \u0085]+")
    parts = F.transform(lines, lambda x: F.transform(F.split(strip_padding(x), r"(?<=[.!?])\s+(?=\S)"), lambda s, i: F.struct(s.alias("unit"), (i > 0).alias("inner"))))
    units = F.filter(F.flatten(parts), lambda u: F.length(strip_padding(u["unit"])) > 0)
    # The array is a column of its own before it is exploded, else it would be made again for each unit.
    whole = docs.select("doc_id", "source", units.alias("units"))
    rows = whole.select("doc_id", "source", F.posexplode("units").alias("pos", "u"), F.size("units").alias("n")).select("doc_id", "source", "pos", "n", "u.unit", "u.inner")
    mask = F.regexp_replace(F.regexp_replace(F.lower("unit"), r"\d+", "9"), BLANKS, " ")
    closed = F.col("unit").rlike(CLOSED) & ~F.when(F.contains("unit", F.lit("...")) | F.contains("unit", F.lit("…")), F.col("unit").rlike(r"(?:\.\.\.|…)\W*$")).otherwise(False)
    return rows.select("doc_id", "source", mask.alias("mask"), closed.alias("closed"), (F.col("pos") == F.col("n") - 1).alias("last"), "inner")


def _heads(mask: Column) -> tuple[Column, Column]:
    """First two words and first word of a unit, without the punctuation around them; a bullet is a word."""
    words = F.split(mask, " ")
    bare = F.transform(words, lambda w: F.when(F.regexp_replace(w, r"[^\p{L}\p{N}]", "") == "", w).otherwise(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.concat_ws(" ", F.slice(bare, 1, 2)), bare[0]


def longer_copies(some: DataFrame, values: DataFrame) -> DataFrame:
    """(value, longer): how many of `values` (value, n) each value of `some` is a strict prefix of; those of none are left out.

    `values` are hashed at the lengths that `some` has, and the hashes counted map-side
    before they meet: no text is shuffled and no two values are paired.
    """
    lengths = sorted(r[0] for r in some.select(F.length("value")).distinct().collect() if r[0])  # whole numbers up to the longest value
    if not lengths:
        return some.select("value", F.lit(0).cast("long").alias("longer")).limit(0)
    at = F.filter(F.lit(lengths), lambda p: p < F.length("value"))
    head = lambda c, n: F.xxhash64(n, F.substring(c, F.lit(1), n))
    met = values.select(F.explode(F.transform(at, lambda p: head(F.col("value"), p))).alias("h"), "n").groupBy("h").agg(F.sum("n").alias("longer"))
    return some.select("value", head(F.col("value"), F.length("value")).alias("h")).join(met, "h").select("value", "longer")


def find_cut(docs: DataFrame, text: str = "text", prose: float = 0.5, ratio: float = 4.0) -> DataFrame:
    """doc_id, source, evidence of each cut text.

    `docs`: doc_id, source, text. Null, empty and blank texts are not cut. `evidence` is
    `prefix` (strict prefix of longer units or texts, more than `ratio` times as many as
    stand whole), `prose` (open unit that begins like closed ones) or `broken` (ends in a
    comma, an opening mark or a replacement character), in this order. The share of
    closed units under a beginning of two words is drawn to that of its first word, and
    that to 1 for units of five words or more and to 0 for others, so a rare beginning is
    judged by the next wider one. An open unit that follows a sentence in its line is prose.
    """
    texts = docs.select(strip_padding(F.col(text)).alias("text")).filter(F.length("text") > 0).distinct().select(F.md5("text").alias("doc_id"), F.lit("").alias("source"), "text")
    # Texts are split once; everything that is counted is counted on distinct units.
    units = cut_lineage(units_of(texts).select("doc_id", "mask", "closed", "last", "inner"))
    h2, h1 = _heads(F.col("mask"))
    distinct = cut_lineage(units.groupBy("mask", "closed", "inner").agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last")).withColumn("h2", h2).withColumn("h1", h1))
    two = distinct.groupBy("h1", "h2").agg(F.sum("n").alias("n2"), F.sum(F.when(F.col("closed"), F.col("n")).otherwise(0)).alias("c2"))
    one = two.groupBy("h1").agg(F.sum("n2").alias("n1"), F.sum("c2").alias("c1"))
    open_ = distinct.filter(~F.col("closed"))
    n_words = F.size(F.split("mask", " "))
    single = open_.filter((n_words == 1) & F.col("last")).select(F.col("h1").alias("value")).distinct()
    begun = longer_copies(single, one.select(F.col("h1").alias("value"), F.col("n1").alias("n"))).toDF("h1", "longer1")
    judged = open_.join(two, ["h1", "h2"]).join(one, "h1").join(begun, "h1", "left")
    long = (n_words >= 5) & ~F.col("mask").rlike(r"^.{1,40}:")
    rate1 = (F.col("c1") + WEIGHT_ONE * long.cast("int")) / (F.col("n1") + WEIGHT_ONE)
    rate2 = (F.col("c2") + WEIGHT_TWO * rate1) / (F.col("n2") + WEIGHT_TWO)
    # Under a first word that mostly closes, cut pieces make many rare beginnings of two words; a closing line is a common one.
    common = F.col("n2") - F.col("c2") >= 0.2 * (F.col("n1") - F.col("c1"))
    rate = F.when((rate1 >= prose) & ~common, rate1).otherwise(rate2)
    # A single word that others begin with, far more often, is itself cut short.
    piece = (n_words == 1) & (F.coalesce("longer1", F.lit(0)) > ratio * F.col("n1"))
    is_prose = (rate >= prose) | F.col("inner") | piece
    judged = judged.withColumn("prose", is_prose).withColumn("broken", F.col("mask").rlike(r"[,;(\[{\x{FFFD}]$"))
    judged = cut_lineage(judged.select("mask", "inner", "h1", "n", "last", "prose", "broken"))

    # Values that are looked for among longer ones: whole units, and entries of closing lines under the line's first word.
    field = ~F.col("prose") & ~F.col("broken")
    entries = F.split("mask", r"\s*[,;]\s*")
    values = F.transform(entries, lambda e, i: F.when(i == 0, e).otherwise(F.concat_ws("|", F.col("h1"), e)))
    stated = judged.filter(field).select("mask", "inner", "n", "last", values.alias("values"))
    counts = stated.select(F.explode("values").alias("value"), "n").filter(F.length("value") > 0).groupBy("value").agg(F.sum("n").alias("n"))
    ends = stated.filter("last").select("mask", "inner", F.element_at("values", -1).alias("value")).filter(F.length("value") > 0)
    whole = counts.withColumnRenamed("n", "whole")
    cut_fields = ends.join(longer_copies(ends.select("value").distinct(), counts), "value").join(whole, "value").filter(F.col("longer") > ratio * (F.col("whole") - 1)).select("mask", "inner")
    sure = judged.filter(~field & F.col("last")).select("mask", "inner", "n", "prose")
    every = distinct.groupBy(F.col("mask").alias("value")).agg(F.sum("n").alias("n"))
    copied = sure.join(longer_copies(sure.select(F.col("mask").alias("value")).distinct(), every).withColumnRenamed("value", "mask"), "mask", "left")
    standing = F.coalesce(F.col("longer") > ratio * (F.col("n") - 1), F.lit(False))
    verdict = copied.select("mask", "inner", F.when(standing, "prefix").when(F.col("prose"), "prose").otherwise("broken").alias("evidence"))
    verdict = verdict.unionByName(cut_fields.withColumn("evidence", F.lit("prefix")))

    open_last = units.filter("last and not closed").select("doc_id", "mask", "inner")
    by_unit = open_last.join(verdict, ["mask", "inner"]).select("doc_id", "evidence")
    by_text = _continued(texts.join(open_last.select("doc_id"), "doc_id", "left_semi"), texts).withColumn("evidence", F.lit("prefix"))
    order = F.min(F.struct((F.col("evidence") != "prefix").alias("_o"), "evidence"))
    found = by_unit.unionByName(by_text).groupBy(F.col("doc_id").alias("_k")).agg(order.alias("_e")).select("_k", "_e.evidence")
    return docs.select("doc_id", "source", F.md5(strip_padding(F.col(text))).alias("_k")).join(found, "_k").select("doc_id", "source", "evidence")


def _continued(some: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id of those of `some` (doc_id, text) that a longer one of `texts` begins with and goes on from within the line and list entry.

    An equi-join on the beginnings of lengths 1, 2, 3, 4, 5, 6, 8, 10 and so on, by a
    third of an octave: a text meets those that share its longest such beginning, and
    these are compared in full.
    """
    lengths = F.expr("filter(array_distinct(transform(sequence(0, 3 * cast(log2(length(text)) as int) + 3), i -> cast(floor(pow(2, i / 3.0D)) as int))), p -> p <= length(text))")
    head = lambda n: F.xxhash64(n, F.substring(F.col("text"), F.lit(1), n))
    a = some.withColumn("_n", F.array_max(lengths)).select(F.col("doc_id").alias("a"), F.col("text").alias("short"), head(F.col("_n")).alias("h"))
    b = texts.withColumn("_n", F.explode(lengths)).select(F.col("doc_id").alias("b"), head(F.col("_n")).alias("h"), F.length("text").alias("chars"))
    met = a.join(b, "h").filter(F.col("chars") > F.length("short")).select("a", "short", "b")
    rest = F.expr("substring(text, length(short) + 1)")
    on = F.startswith(F.col("text"), F.col("short")) & ~rest.rlike(r"^[^\S\r\n]*[\r\n\x{85}\x{2028}\x{2029},;]")
    return met.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").filter(on).select(F.col("a").alias("doc_id")).distinct()


def rates(docs: DataFrame, cut: DataFrame, text: str = "text") -> DataFrame:
    """Per source: texts with content, cut ones, their rate, how many each evidence shows, and the commonest length of a cut text (a field limit, if many share it)."""
    content = docs.filter(F.length(strip_padding(F.col(text))) > 0).select("doc_id", "source", F.length(text).alias("chars"))
    marked = content.join(cut.select("doc_id", F.lit(1).alias("cut"), "evidence"), "doc_id", "left")
    return marked.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count(F.lit(1)), 6).alias("rate"),
        *[F.count_if(F.col("evidence") == e).alias(f"n_{e}") for e in ("prefix", "prose", "broken")],
        F.mode(F.when(F.col("cut") == 1, F.col("chars")), True).alias("usual_length"),
    )
