"""Contexts for the three retrieval modes, with budgets a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section headings, the text of an empty context, modes from cheap to dear, and tokens a section may take.
PASSAGES, RECORD, KNOWLEDGE = "## Retrieved Clinical Passages", "## Patient EHR Snapshot", "## Relevant Medical Knowledge"
EMPTY = "No context available."
MODES = ["T", "T+E", "T+E+K"]
BUDGETS = {"passages": 600, "record": 350, "facts": 350}


def words_of(text: Column) -> Column:
    """White-space tokens, the default measure of budgets."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4)


def by_mode(questions: DataFrame, modes: list[str] = MODES) -> DataFrame:
    """One row a question and mode; the record is masked but in T+E and T+E+K, the facts but in T+E+K.

    questions: q, passages array<string>, record string, facts array<string>. The modes
    are a literal array that is exploded, so nothing is joined.
    """
    x = questions.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    return x.withColumn("record", F.when(F.col("mode") != "T", F.col("record"))).withColumn("facts", F.when(F.col("mode") == "T+E+K", F.col("facts")))


# Words that tell a paragraph of facts has none.
NO_FACTS = "No relevant"


def split_facts(paragraph: Column) -> Column:
    """Single facts of a paragraph: its parts between full stops, each closed by one; none where it is null, blank or says so."""
    parts = F.transform(F.split(paragraph, r"\."), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    facts = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(p, F.lit(".")))
    return F.when(paragraph.isNull() | F.contains(paragraph, F.lit(NO_FACTS)), F.array().cast("array<string>")).otherwise(facts)


def served_mode(mode: Column, entity: Column) -> Column:
    """The mode a question is served by: text alone where the entity that its record and facts hang on is missing."""
    return F.when(entity.isNull() & mode.isin(MODES[1:]), F.lit(MODES[0])).otherwise(mode)


def fit_passages(passages: Column, budget: int) -> Column:
    """Leading passages whose tokens together stay within `budget`; the first is cut to it rather than dropped."""
    size = lambda p: F.size(words_of(p))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, p: Column) -> Column:
        fits = ~acc["full"] & (acc["n"] + size(p) <= budget)
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(p))).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["n"] + size(p)).otherwise(acc["n"]).alias("n"), (acc["full"] | ~fits).alias("full"))

    kept = F.aggregate(passages, start, step)["kept"]
    return F.when((F.size(kept) == 0) & (F.size(passages) > 0), F.array(cut_words(passages[0], budget))).otherwise(kept)


def cut_words(text: Column, budget: int) -> Column:
    """Text as it is within the budget, else its first `budget` tokens."""
    w = words_of(text)
    return F.when(F.size(w) <= budget, text).otherwise(F.array_join(F.slice(w, 1, budget), " "))


def budgeted(contexts: DataFrame, budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """Sections brought within their budgets; absent sections stay absent, present ones stay present. Doing it twice changes nothing."""
    facts = F.filter(F.split(cut_words(F.array_join("facts", "\n"), budgets["facts"]), "\n"), lambda f: f != "")
    return contexts.withColumn("passages", fit_passages(F.col("passages"), budgets["passages"])).withColumn("record", cut_words(F.col("record"), budgets["record"])).withColumn("facts", F.when(F.col("facts").isNotNull(), facts))


def assemble(contexts: DataFrame) -> DataFrame:
    """Adds `context`: the sections a row has under their headings, and `token_estimate`."""
    shown = F.transform("passages", lambda p, i: F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit("]\n"), p))
    section = lambda head, body, there: F.when(there, F.concat(F.lit(head + "\n"), body))
    text = F.concat_ws(
        "\n\n",
        section(PASSAGES, F.array_join(shown, "\n\n"), F.size("passages") > 0),
        section(RECORD, F.col("record"), F.length("record") > 0),
        section(KNOWLEDGE, F.concat(F.lit("- "), F.array_join("facts", "\n- ")), F.size("facts") > 0),
    )
    out = contexts.withColumn("context", F.when(text == "", EMPTY).otherwise(text))
    return out.withColumn("token_estimate", approx_tokens(F.col("context")))


def sections_of(df: DataFrame, context: str) -> DataFrame:
    """Adds s_passages, s_record and s_facts: the bodies parsed back from an assembled context; absent ones are empty."""
    c = F.coalesce(F.col(context), F.lit(""))

    def body(head: str, *later: str) -> Column:
        rest = F.when(F.contains(c, F.lit(head)), F.substring_index(c, head, -1)).otherwise("")
        for h in later:
            rest = F.substring_index(rest, h, 1)
        return F.trim(rest, F.lit(" \n"))

    plain = F.when(~F.contains(c, F.lit(PASSAGES)), F.trim(F.substring_index(F.substring_index(c, RECORD, 1), KNOWLEDGE, 1), F.lit(" \n"))).otherwise(body(PASSAGES, RECORD, KNOWLEDGE))
    return df.withColumn("s_passages", plain).withColumn("s_record", body(RECORD, KNOWLEDGE)).withColumn("s_facts", body(KNOWLEDGE))


def prompt(context: Column, question: Column) -> Column:
    """The prompt a generator is given."""
    return F.format_string("Context:\n%s\n\nQuestion: %s\nAnswer:", context, question)
