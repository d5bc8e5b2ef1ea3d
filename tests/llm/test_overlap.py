import random

from tarnwise.llm import overlap as O

DRUGS = ["teslinine", "corproazole", "vinzolinine", "helprovopril", "rasumegalol"]
SCHEMA = "id long, a string, b string"


def _records(n=60):
    out = []
    for i in range(n):
        d, e = DRUGS[i % 5], DRUGS[(i + 2) % 5]
        out.append((i, f"What medication did this {30 + i}-year-old woman receive by day {i + 1}?", f"By day {i + 1} the chart lists {d} {5 * i + 5} mg and {e} 80 mg. Labs at that time were Sodium {130 + i}.5 mEq/L and Iron {60 + i}.1 ug/dL."))
    return out


def _pairs(spark, evals, trains):
    return {(r["eval_id"], r["train_id"]) for r in O.find_overlaps(spark.createDataFrame(evals, SCHEMA), spark.createDataFrame(trains, SCHEMA)).collect()}


def test_writings_and_facts(spark):
    base = _records()
    q, a = base[7][1:]
    same = [
        (1, q, a), (2, q.upper(), a.lower()), (3, "Please tell me: " + q.rstrip("?"), "Answer: " + a.replace(" ", " ")), (4, q.replace("year-old", "y/o").replace("by day 8", "by d 8").replace("medication", "med"), a + " (see notes)"),
        (5, q, a.replace("vinzolinine 40 mg and rasumegalol 80 mg", "rasumegalol 80 mg and vinzolinine 40 mg")),
        (6, q.replace("medication", "mediaction").replace("receive", "recieve"), a.replace("vinzolinine", "vinzolnine")),
    ]
    other = [(11, q, a.replace("137.5", "137.6")), (12, q, a.replace("vinzolinine", "teslinine")), (13, q.replace("woman", "man"), a), (14, q, a.replace("Sodium", "Iron")), (15, "", ""), (16, None, None)]
    got = _pairs(spark, base, [(1000 + i, b, c) for i, b, c in same + other] + [(2000 + i, b, c) for i, b, c in _records() if i != 7])
    mine = {t - 1000 for e, t in got if e == 7}
    assert mine == {1, 2, 3, 4, 5, 6}
    assert {(i, 2000 + i) for i in range(60) if i != 7} <= got and len(got) == 59 + 6


def test_segment_join_finds_all_within_k(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14))) for _ in range(120)]

    def edit(w):
        w = list(w)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(w))
            w[at : at + rnd.randint(0, 1)] = [rnd.choice("abcd")] * rnd.randint(0, 1)
        return "".join(w)

    a = [(i, "", w) for i, w in enumerate(words)]
    b = [(i, "", edit(w)) for i, w in enumerate(words)]
    got = {(r[0], r[1]) for r in O.segment_join(spark.createDataFrame(a, "id long, facts string, s string"), spark.createDataFrame(b, "id long, facts string, s string"), 2).collect()}

    def dist(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
        return row[-1]

    assert got == {(i, j) for i, _, x in a for j, _, y in b if dist(x, y) <= 2}


def test_empty(spark):
    assert _pairs(spark, _records(3), []) == set()


def test_all_pairs_come_from_the_segment_join(spark, monkeypatch):
    evals, trains = _records(6), [(100 + i, a, b) for i, a, b in _records(6)]
    assert len(_pairs(spark, evals, trains)) == 6
    monkeypatch.setattr(O, "segment_join", lambda cut, slide, k=O.EDITS: cut.crossJoin(slide.limit(0).select("facts")).selectExpr("id as cut_id", "id as slide_id").limit(0))
    assert _pairs(spark, evals, trains) == set()


def test_slips_in_words_of_any_length(spark):
    long = "ab" * 40
    rows = [(i, "Which test?", f"The {long} test was {i + 1} mg.") for i in range(3)]
    got = _pairs(spark, rows, [(10, "Which test?", f"The {long[:30]}x{long[30:]} test was 1 mg."), (11, "Which test?", f"The {long} test was 2 mg.")])
    assert got == {(0, 10), (1, 11)}
