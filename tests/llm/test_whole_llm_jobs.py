"""Jobs of the training-data operators that once were cut: each test failed before the cut was taken out."""

from tarnwise.llm import cooccurrence
from tarnwise.llm import overlap as O
from tarnwise.llm import truncation as T

SCHEMA = "id long, a string, b string"


def _pairs(spark, evals, trains):
    return {(r["eval_id"], r["train_id"]) for r in O.find_overlaps(spark.createDataFrame(evals, SCHEMA), spark.createDataFrame(trains, SCHEMA)).collect()}


def test_slips_in_short_words_and_in_copied_rows(spark):
    text = "The iron level was {} when the nurse came, and teslinine was given."
    base = [(i, "What was given?", text.format(i)) for i in range(20)]
    slips = [(100, "What was given?", text.format(3).replace("when", "whne")), (101, "What was given?", text.format(4).replace("iron", "irn"))]
    # A slip in a rare word that stands in more rows than four, all of one text.
    rare = [(50, "Which drug?", "Vinzolinine of old.")]
    copies = [(200 + i, "Which drug?", "Vinzolnine of old.") for i in range(9)]
    facts = [(300, "What was given?", text.format(5).replace("iron", "zinc")), (301, "What was given?", "The iron level was 7 mg when the nurse came, and teslinine was given.")]
    facts += [(302, "Dose?", "Iron 5 mg, zinc 6 mg."), (303, "Dose?", "Iron 5 mcg, zinc 6 mcg.")]
    got = _pairs(spark, base + rare + [(60, "Dose?", "Iron 6 mg, zinc 5 mg.")], slips + copies + facts)
    assert got == {(3, 100), (4, 101)} | {(50, 200 + i) for i in range(9)}


def test_slip_that_moves_an_item_of_a_class_with_two_orders(spark):
    evals = [(1, "Which drugs?", "Corproazole 5 mg, vinzolinine 40 mg."), (2, "Which drugs?", "Vinzolinine 40 mg, corproazole 5 mg.")]
    assert _pairs(spark, evals, [(9, "Which drugs?", "Vinzolinine 40 mg, zorproazole 5 mg.")]) == {(1, 9), (2, 9)}


def _cut(spark, texts):
    return {r["doc_id"] for r in T.find_cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source")).collect()}


def test_copies_of_a_cut_text_do_not_make_it_whole(spark):
    whole = [f"The patient {v} on day {i}.\nThe heart is fine on film {i}." for i, v in enumerate(["slept well", "ate little"] * 15)]
    assert _cut(spark, whole + ["Seen today.\nThe heart size is normal"] * 60) == set(range(30, 90))


def test_cut_text_that_a_longer_one_goes_on_from(spark):
    lines = [f"Seen on day {i}.\nDiet: low salt" for i in range(40)]
    longer = ["Seen by all.\nDiet: low salt and soft food", "Seen by us.\nDiet: low salt\nWeight: same"]
    assert _cut(spark, lines + longer + ["Seen by all.\nDiet: low salt and", "Seen by us.\nDiet: low salt", "Seen by all.\nDiet: low salt"]) == {42, 44}


def test_seed_prefixes_of_any_length(spark):
    dx = spark.createDataFrame([(1, "A" * 70 + "5", 10), (2, "A" * 69, 10), (3, "25000", 9)], "hadm_id long, icd_code string, icd_version int")
    seeds = spark.createDataFrame([("long", "250", "A" * 70)], "name string, icd9_prefix string, icd10_prefix string")
    assert {r["basket"] for r in cooccurrence.disease_baskets(dx, seeds).collect()} == {1, 3}
    assert cooccurrence.disease_baskets(dx, seeds.limit(0)).count() == 0
