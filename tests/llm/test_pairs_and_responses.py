import itertools
import random

import numpy as np

from tarnwise.llm import cooccurrence, responses
from tarnwise.llm.crf import Crf


def test_pair_counts_against_brute_force(spark):
    rnd = random.Random(3)
    left = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice("abc")) for _ in range(60)] + [(1, None)]
    right = [(rnd.choice([1, 1, 2, 3, 5]), rnd.choice("xyz")) for _ in range(60)]
    baskets = [(b,) for b in (1, 2, 3, 4, 6, None)]
    S = "basket long, item string"
    got = {(r["left_item"], r["right_item"]): (r["both"], r["n_left"], r["n_right"], r["n_baskets"]) for r in cooccurrence.pair_counts(spark.createDataFrame(left, S), spark.createDataFrame(right, S), spark.createDataFrame(baskets, "basket long")).collect()}
    ok = {1, 2, 3, 4, 6}
    sets = lambda rows, i: {b for b, x in rows if x == i and b in ok}
    want = {(a, b): (len(sets(left, a) & sets(right, b)), len(sets(left, a)), len(sets(right, b)), 5) for a, b in itertools.product("abc", "xyz") if sets(left, a) & sets(right, b)}
    assert got == want


def test_crf_learns_moves():
    rng = np.random.default_rng(1)
    y = np.zeros((200, 6), int)
    for i in range(1, 6):
        y[:, i] = np.where(rng.random(200) < 0.9, 1 - y[:, i - 1], y[:, i - 1])
    x = np.ones((200, 6, 1))
    model = Crf(1, 2).fit(x, y, np.ones((200, 6), bool))
    assert model.move[0, 1] > model.move[0, 0] and model.move[1, 0] > model.move[1, 1]
    p = model.posteriors(x[:2], np.ones((2, 6), bool))
    assert np.allclose(p.sum(2), 1)


def test_defects(spark):
    rnd = random.Random(5)
    drugs = ["teslinine", "corproazole", "rasumegalol", "linrasol"]
    rows = []
    for i in range(160):
        d, e = rnd.sample(drugs, 2)
        rows.append((i, f"What did the {40 + i % 50}-year-old woman receive on day {i}?", f"On day {i} the woman was given {d} {i} mg and {e} 20 mg for the fever. The dose of {e} was not changed.", None))
    for i in range(160, 200):
        rows.append((i, f"¿Qué recibió la paciente en el día {i}?", f"La paciente recibió {drugs[i % 4]} {i} mg por la fiebre y se mantuvo el tratamiento durante el ingreso.", None))
    q, r = rows[0][1:3]
    cases = {
        1000: (None, "empty"), 1001: ("  \n", "empty"), 1002: ("<answer></answer>", "empty"), 1003: ("…", "empty"), 1004: (r, None), 1005: (r[:40], "truncated"), 1006: (r + " The dose of the", "truncated"), 1007: (q, "question_copy"),
        1008: ("You asked: " + q, "question_copy"), 1009: (q + " " + r, None), 1010: ("I'm sorry, but I can't help with that request.", "refusal"), 1011: ("The patient declined linrasol on day 2 and signed the form, so it was not given.", None),
        1012: (rows[170][2], "wrong_language"), 1013: ("Not documented in the record.", None), 1014: ("linrasol", None), 1015: ("- linrasol\n- teslinine", None),
    }
    rows = [(i, q0, r0, r0) for i, q0, r0, _ in rows] + [(k, q, r, a) for k, (a, _) in cases.items()] + [(2000, None, None, "A plain answer was given to the patient."), (2001, None, None, None)]
    got = {x["id"]: x["defect"] for x in responses.find_defects(spark.createDataFrame(rows, "id long, question string, reference string, answer string")).collect()}
    assert {k: got.get(k) for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert got.get(2001) == "empty" and 2000 not in got and not [i for i in got if i < 1000]
    assert responses.find_defects(spark.createDataFrame([], "id long, question string, reference string, answer string")).count() == 0
