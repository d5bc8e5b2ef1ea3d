import pytest
from pyspark.sql import functions as F

from tarnwise.operators import metrics as M


def _negation(spark, cases):
    df = spark.createDataFrame([(i, a, r) for i, (a, r) in enumerate(cases)], "id long, a string, r string")
    return [r["negation"] for r in M.negation_score(df, "id", "a", "r").orderBy("id").collect()]


def test_negation(spark):
    record = "Diagnoses: diabetes, residual myelopathy\nNote: fine"
    got = _negation(spark, [
        ("The patient has no diabetes.", record),  # negates what is asserted
        ("without residual findings", "Diagnoses: without residual myelopathy"),  # the record negates it too
        ("There is no diabetes.", "Diagnoses: without diabetes"),
        ("The patient has diabetes.", record),
        ("", record), ("no diabetes", ""), (None, record), ("no diabetes", None),
        ("The patient does not have diabetes.", record),  # a known miss: the cue is not next to the term
        ("no diabetes, no myelopathy", record),
        ("no diabetes", "Diagnoses: no fever. diabetes"),  # the scope ends with the clause
        ("no fine", "Note: fine"),
    ])
    assert got == [0.2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.4, 0.2, 0.0]


def test_contraindications(spark):
    answers = [
        (1, "Yes, aspirin is recommended."), (2, "No, aspirin is contraindicated here."), (3, "Aspirin should be avoided."), (4, "TSH, aspirin levels."), (5, "Ibuprofen is safe."), (6, "Take aspirin."), (7, ""), (8, None),
        (9, "Aspirin is safe. Aspirin should be avoided."), (10, "Yes. Give aspirin."),
    ]
    df = spark.createDataFrame(answers, "key long, answer string")
    bad = spark.createDataFrame([(k, "Aspirin") for k, _ in answers if k != 5] + [(5, "other")], "key long, drug string")
    drugs = spark.createDataFrame([("aspirin",), ("ibuprofen",), (None,)], "drug string")
    got = {r["key"]: r["verdict"] for r in M.contraindication_verdicts(df, bad, drugs).collect()}
    assert got == {1: "violation", 2: "compliant", 3: "compliant", 4: "not_applicable", 5: "not_applicable", 6: "abstain", 7: "not_applicable", 8: "not_applicable", 9: "violation", 10: "violation"}


def test_overlap_scores(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("", "a"), (None, "a"), ("a b", "c d"), ("the cat sat", "the cat ran off")], "a string, r string")
    got = df.select(M.bleu("a", "r"), M.rouge_l_nostem("a", "r"), M.exact_match(F.col("a"), F.col("r")), M.unigram_precision(F.col("a"), F.col("r"))).collect()
    assert got[0][0] == pytest.approx(1.0) and got[0][1] == 1.0 and got[0][2] == 1 and got[0][3] == 1.0
    assert got[1][0] == 0.0 and got[2][0] == 0.0 and got[3][0] == 0.0
    assert got[4][1] == pytest.approx(2 * 2 / 7) and got[4][3] == pytest.approx(2 / 3)


def test_unsupported_echo_and_flags(spark):
    long = "word " * 40
    df = spark.createDataFrame([("the fever rose", "fever was seen"), ("", "x"), ("x", None), ("is the", "x"), ("## Retrieved", "c"), (long, long), ("labs are normal, 5 mg", "abnormal value"), ("no medications", "medication list")], "a string, c string")
    got = df.select(M.unsupported(F.col("a"), F.col("c")), M.context_echo(F.col("a"), F.col("c")), M.hallucination_flags(F.col("a"), F.col("c"))).collect()
    assert [round(r[0], 3) for r in got][:4] == [0.5, 0.0, 0.0, 0.0]
    assert [r[1] for r in got][4:6] == [True, True] and not got[0][1]
    assert got[6][2] == ["H1", "H6"] and got[7][2] == ["H2"] and got[1][2] == []


def test_grounding_excess(spark):
    rows = [(i, f"alpha{i} beta{i}", f"alpha{i} beta{i} gamma delta") for i in range(40)]
    got = M.grounding_excess(spark.createDataFrame(rows, "id long, a string, c string"), "id", "a", "c").collect()
    assert len(got) == 40 and all(r["real"] == 0.0 and r["excess"] == 1.0 for r in got)
