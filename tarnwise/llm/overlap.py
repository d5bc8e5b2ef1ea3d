"""Records of one split that stand, alike or nearly so, in another.

Texts are brought to a canonical writing: case, white space, punctuation, abbreviations
and set phrases are taken out. All pairs come from an edit-distance segment join of these
writings, in order and with their items sorted: evaluation strings are cut into k + 1
segments, training substrings at allowed positions are matched, and candidates are
verified by banded dynamic programming. What is within k edits is then judged item by
item: numbers, their units and words the corpus knows are facts and must agree, and a
word may only stand for another that it is a slip of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwise.session import cut_lineage

# Abbreviations (regular expression on folded text, replacement).
ABBREVIATIONS = [
    (r"\by/o\b|\byo\b|\byrs?/o\b", "year old"),
    (r"\bw/", "with "),
    (r"\bdx\b", "diagnosis"),
    (r"\badm\b", "admitted"),
    (r"\bcont\b", "continue"),
    (r"\bmeds?\b", "medication"),
    (r"\bhl\b", "highlights"),
    (r"\bpt\b", "patient"),
    (r"\bhx\b", "history"),
    (r"\btx\b", "treatment"),
    (r"\bf/u\b", "follow up"),
    (r"\bs/p\b", "status post"),
    (r"\bc/o\b", "complains of"),
]
# Phrases that may stand before or after a text without changing it.
LEADS = ["q", "question", "eval", "please tell me", "answer", "a", "according to the record", "per the chart", "from the chart", "based on the record", "in short"]
TAILS = ["see notes", "source chart", "end of answer", "per the chart", "see chart"]
UNITS = r"(?:[a-zµμ]+/[a-zµμ]+|%|mg|mcg|g|sec|ml|units?)"

#: Edits allowed between canonical texts of one pair.
EDITS = 6
#: Times that a word must be commoner than its slip, by distinct texts; and those that are enough for a word of five letters or more.
RATIO, LONG_RATIO = 8, 2


def fold_tokens(text: Column) -> Column:
    """Lower-case word, number and unit tokens of a text; null gives an empty array."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " ")
    x = F.regexp_replace(x, r"[‐-―−]", "-")
    return F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?|[\p{L}\p{M}%/]+)"), 1)


def expand(tokens: Column) -> Column:
    """Blank-separated tokens with abbreviations written out (days cut to d), 'and' and set phrases taken off."""
    text = F.regexp_replace(F.array_join(F.array_remove(tokens, "and"), " "), r"\bday (?=\d)", "d ")
    full = text
    for pattern, word in ABBREVIATIONS:
        full = F.regexp_replace(full, pattern, word)
    # Few texts hold an abbreviation, so one look saves the others the thirteen.
    text = F.when(text.rlike("|".join(p for p, _ in ABBREVIATIONS)), F.trim(F.regexp_replace(full, r"\s+", " "))).otherwise(text)
    text = F.regexp_replace(text, r"^(?:(?:" + "|".join(sorted(LEADS, key=len, reverse=True)) + r") )+", "")
    return F.regexp_replace(text, r"(?: (?:" + "|".join(TAILS) + r"))+$", "")


def bound(text: Column) -> Column:
    """Numbers bound to the word before and the unit after them, as one item."""
    return F.regexp_replace(text, r"(?:(\S+) )?\b(\d+(?:\.\d+)?)(?: (" + UNITS + r"))?(?= |$)", "$1_$2_$3")


def folded(records: DataFrame) -> DataFrame:
    """`records` (side, id, a, b) with the tokens of both texts as `ta` and `tb`."""
    return records.select("side", "id", fold_tokens(F.col("a")).alias("ta"), fold_tokens(F.col("b")).alias("tb"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(token, n): distinct texts of `rows` (side, id, ta, tb) that hold each word, copies counted once."""
    words = rows.select("ta", "tb").distinct().select(F.explode(F.array_distinct(F.concat("ta", "tb"))).alias("token"))
    return words.filter(F.col("token").rlike(r"^\p{L}+$")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def canonical(rows: DataFrame) -> DataFrame:
    """`rows` (side, id, ta, tb) with `text` in order, `sorted_text` in canonical item order and `facts`: the numbers, and the items of either half."""
    text = rows.select("side", "id", *[expand(F.col(c)).alias(q) for c, q in (("ta", "qa"), ("tb", "qb"))])
    items = text.select("side", "id", F.concat_ws(" | ", "qa", "qb").alias("text"), *[F.array_sort(F.split(bound(F.col(q)), " ")).alias(q) for q in ("qa", "qb")])
    numbers = F.array_join(F.array_sort(F.regexp_extract_all("text", F.lit(r"(?<!\S)(\d+(?:\.\d+)?)(?!\S)"), 1)), " ")
    return items.select(
        "side", "id", "text", F.concat_ws(" | ", F.array_join("qa", " "), F.array_join("qb", " ")).alias("sorted_text"),
        # A slip makes no item of two and none of nothing.
        F.concat_ws("|", numbers, F.size("qa"), F.size("qb")).alias("facts"),
    )


def segment_join(cut: DataFrame, slide: DataFrame, k: int = EDITS) -> DataFrame:
    """Pairs (cut_id, slide_id) of equal `facts` and at most `k` edits between their `s`.

    `cut` and `slide`: id, facts, s. Strings of `cut` are cut into k + 1 segments; one of
    them must stand unchanged in any string within k edits, shifted by no more than the
    edits before it and after it allow. Substrings of `slide` at those places, for the
    lengths that strings of `cut` with its facts have, are matched by an equi-join on a
    hash of the facts, the length, the segment's number and its text; the strings
    themselves are fetched for candidates only.
    """
    m = k + 1
    bits = lambda c: f"transform(sequence(0, {k}), i -> xxhash64(facts, length({c}), i, substring({c}, cast(i * length({c}) div {m} as int) + 1, cast((i + 1) * length({c}) div {m} - i * length({c}) div {m} as int))))"
    left = cut.select(F.col("id").alias("cut_id"), F.explode(F.expr(bits("s"))).alias("h"))
    lens = slide.select(F.col("id").alias("slide_id"), "facts", F.col("s").alias("ss"), F.explode(F.expr(f"sequence(greatest(0, length(s) - {k}), length(s) + {k})")).alias("len"))
    lens = lens.join(cut.select("facts", F.length("s").alias("len")).distinct(), ["facts", "len"], "left_semi")
    parts = lens.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k))))
    at, size, delta = f"cast(i * len div {m} as int)", f"cast((i + 1) * len div {m} - i * len div {m} as int)", "(length(ss) - len)"
    low = f"greatest(0, {at} - i, {at} + {delta} - ({k} - i))"
    high = f"least(length(ss) - {size}, {at} + i, {at} + {delta} + ({k} - i))"
    right = (
        parts.withColumn("_low", F.expr(low)).withColumn("_high", F.expr(high)).filter("_high >= _low")
        .withColumn("pos", F.explode(F.sequence("_low", "_high")))
        .select("slide_id", F.xxhash64("facts", "len", "i", F.expr(f"substring(ss, pos + 1, {size})")).alias("h"))
    )
    pairs = left.join(right, "h").select("cut_id", "slide_id").distinct()
    strings = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("facts").alias(f"{p}_facts"), F.col("s").alias(f"{p}_s"))
    candidates = pairs.join(strings(cut, "cut"), "cut_id").join(strings(slide, "slide"), "slide_id").filter("cut_facts = slide_facts")
    near = F.levenshtein("cut_s", "slide_s", k)
    return candidates.filter(near.between(0, k)).select("cut_id", "slide_id")


def same_but_slips(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Those `pairs` (e, t, es, ts; the texts in canonical item order) whose texts differ in slips only, as (e, t).

    Items, numbers bound to them included, are compared with the times they occur. Each
    that the other text lacks must face one of the same half, number and unit whose word
    is a slip of its own, or the other way round: one edit or swap from a word RATIO times
    as common by distinct texts (`counts`: token, n), or a word of five letters or more
    that stands in one text only or faces one LONG_RATIO times as common. A word that only stands for an
    abbreviation is known. Units are no slips. Texts alike in all items are kept.
    """
    spread = lambda c: f"flatten(transform(split({c}, ' \\\\| '), (p, h) -> transform(split(p, ' '), w -> concat(h, ' ', w))))"
    numbered = lambda c: F.expr(f"transform({c}, (x, i) -> concat(x, ' ', size(filter(slice({c}, 1, i + 1), y -> y = x))))")
    alike = pairs.filter("es = ts").select("e", "t")
    x = pairs.filter("es <> ts").select("e", "t", F.expr(spread("es")).alias("_e"), F.expr(spread("ts")).alias("_t")).select("e", "t", numbered("_e").alias("_e"), numbered("_t").alias("_t"))
    x = x.select("e", "t", F.array_except("_e", "_t").alias("x"), F.array_except("_t", "_e").alias("y")).filter(F.size("x") == F.size("y"))
    x = x.filter(F.size("x").between(1, EDITS)).withColumn("size", F.size("x"))
    part = lambda c: F.split(c, " ")
    faced = x.withColumn("x", F.explode("x")).withColumn("y", F.explode("y")).withColumn("xi", part("x")[1]).withColumn("yi", part("y")[1])
    faced = faced.withColumn("u", F.substring_index("xi", "_", 1)).withColumn("v", F.substring_index("yi", "_", 1))
    faced = faced.filter((part("x")[0] == part("y")[0]) & (F.expr("substring(xi, length(u) + 1) = substring(yi, length(v) + 1)")) & (F.col("u") != F.col("v")))
    known = counts.select(F.col("token").alias("u"), F.col("n").alias("nu")), counts.select(F.col("token").alias("v"), F.col("n").alias("nv"))
    faced = faced.join(known[0], "u", "left").join(known[1], "v", "left")
    nu, nv = F.coalesce("nu", F.greatest("nv", F.lit(1)) * RATIO), F.coalesce("nv", F.greatest("nu", F.lit(1)) * RATIO)
    rarer, commoner = F.least(nu, nv), F.greatest(nu, nv)
    edits = F.levenshtein("u", "v")
    one = (edits == 1) | ((edits == 2) & (F.length("u") == F.length("v")) & (F.array_sort(F.split("u", "")) == F.array_sort(F.split("v", ""))))
    words = F.col("u").rlike(r"^\p{L}+$") & F.col("v").rlike(r"^\p{L}+$") & ~F.col("u").rlike(f"^{UNITS}$") & ~F.col("v").rlike(f"^{UNITS}$")
    # Two words of one length and two letters or fewer share too little to be one.
    short = F.greatest(F.length("u"), F.length("v")) < 3
    by_ratio = (commoner >= RATIO * rarer) & one & ~(short & (edits == 1))
    slip = F.when(nu <= nv, F.length("u")).otherwise(F.length("v"))
    faced = faced.filter(words & (by_ratio | (((commoner >= LONG_RATIO * rarer) | (rarer == 1)) & (slip >= 5))))
    met = faced.groupBy("e", "t").agg(F.first("size").alias("size"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"))
    return alike.unionByName(met.filter("nx = size and ny = size").select("e", "t"))


def find_overlaps(evals: DataFrame, trains: DataFrame) -> DataFrame:
    """Every pair (eval_id, train_id) of rows that agree up to writing.

    Inputs: id, a, b (for instance question and answer). Nulls count as empty; two
    records without any token are no pair. Rows of equal items are one class; the segment
    join runs between the writings of the two sides, equal ones included, and the links of
    their classes are expanded to rows last. No input row is dropped; pairs come out once.
    """
    records = evals.select(F.lit("e").alias("side"), "id", "a", "b").unionByName(trains.select(F.lit("t").alias("side"), "id", "a", "b"))
    # Written once: the counts and both sides of every join start from here.
    tokens = cut_lineage(folded(records))
    counts = word_counts(tokens)
    rows = cut_lineage(canonical(tokens).withColumn("cls", F.xxhash64("sorted_text")))
    # Behind the checkpoint: before it the filter would make every canonical text a second time.
    rows = rows.filter(F.length(F.regexp_replace("sorted_text", r"[ |]", "")) > 0)
    # Every writing of a class, since a slip may stand in an item order that only one member has.
    reps = rows.select("side", "cls", F.xxhash64("sorted_text", "text").alias("id"), "text", "sorted_text", "facts").distinct()
    # Texts whose numbers no text of the other side has can have no partner.
    both = reps.groupBy("facts").agg(F.countDistinct("side").alias("_n")).filter("_n = 2").select("facts")
    reps = cut_lineage(reps.join(both, "facts", "left_semi"))
    ereps, treps = reps.filter("side = 'e'"), reps.filter("side = 't'")
    links = None
    for s in ("text", "sorted_text"):
        pairs = segment_join(ereps.select("id", "facts", F.col(s).alias("s")), treps.select("id", "facts", F.col(s).alias("s"))).toDF("e", "t")
        links = pairs if links is None else links.unionByName(pairs)
    named = lambda df, p: df.select(F.col("id").alias(p), F.col("cls").alias(f"{p}cls"), F.col("sorted_text").alias(f"{p}s"))
    links = links.distinct().join(named(ereps, "e"), "e").join(named(treps, "t"), "t").select(F.col("ecls").alias("e"), F.col("tcls").alias("t"), "es", "ts").distinct()
    good = same_but_slips(cut_lineage(links), counts).toDF("ecls", "tcls")
    of = lambda side, name, cls: rows.filter(F.col("side") == side).select(F.col("id").alias(name), F.col("cls").alias(cls))
    return good.join(of("e", "eval_id", "ecls"), "ecls").join(of("t", "train_id", "tcls"), "tcls").select("eval_id", "train_id").distinct()
