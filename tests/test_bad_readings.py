import datetime as dt
import random

from tarnwise.operators import bad_readings as B

SCHEMA = "source string, row_id long, entity long, item long, ts timestamp, value double, unit string, reason string"
T0 = dt.datetime(2022, 1, 1)


def _series(rnd, entity, n, level, sd, item=1, start=0):
    return [("v", start + i, entity, item, T0 + dt.timedelta(hours=i), round(level + rnd.gauss(0, sd), 1), "bpm", None) for i in range(n)]


def _base(seed=1, entities=60, n=40):
    rnd, rows = random.Random(seed), []
    for e in range(entities):
        rows += _series(rnd, e, n, 80 + rnd.gauss(0, 8), 3, start=e * 1000)
    return rnd, rows


def _change(rows, row_id, value):
    return [(*r[:5], value, *r[6:]) if r[1] == row_id else r for r in rows]


def _run(spark, rows, **how):
    got = [(r["row_id"], r["reason"]) for r in B.bad_readings(spark.createDataFrame(rows, SCHEMA), **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spike_shift_stuck_and_impossible(spark):
    rnd, rows = _base()
    rows = _change(rows, 1010, 160.0)  # back at once
    for i in range(20, 40):
        rows = _change(rows, 2000 + i, round(140 + rnd.gauss(0, 3), 1))  # a lasting change
    for i in range(10, 25):
        rows = _change(rows, 3000 + i, 81.3)  # stuck
    rows = _change(rows, 4005, -3.0)
    rows = _change(rows, 5005, 9999.0)
    rows.append(("v", 77, None, None, None, -1.0, None, None))
    rows += [("v", 78, 1, 1, T0, None, "bpm", None), ("v", 79, 1, 1, T0, float("nan"), "bpm", None)]
    rows.append(("v", 1910, 1, 1, T0 + dt.timedelta(hours=10), 160.0, "bpm", None))  # the spike sent twice
    got = _run(spark, rows)
    assert {(1010, "spike"), (1910, "spike"), (4005, "impossible"), (5005, "impossible"), (77, "impossible")} <= got
    assert {(3000 + i, "stuck") for i in range(10, 25)} <= got
    assert len(got) == 5 + 15


def test_items_that_repeat_by_nature_are_not_stuck(spark):
    rnd = random.Random(3)
    rows = []
    for e in range(50):
        v = 40.0
        for i in range(60):
            v = rnd.choice([30.0, 40.0, 50.0, 60.0]) if rnd.random() < 0.1 else v
            rows.append(("v", e * 1000 + i, e, 9, T0 + dt.timedelta(hours=i), v, "%", None))
    assert not {r for r in _run(spark, rows) if r[1] == "stuck"}


def test_long_series_in_blocks_give_the_same(spark):
    rnd, rows = _base(entities=5, n=600)
    rows = _change(_change(rows, 1300, 170.0), 2100, 30.0)
    for i in range(195, 215):
        rows = _change(rows, 3000 + i, 81.3)  # stuck across a chunk's edge
    rows += [("v", 100_000 + i, 9, 1, T0 + dt.timedelta(hours=i), round(80 + rnd.gauss(0, 3), 1), "bpm", None) for i in range(3000)]
    rows = _change(rows, 101_500, 170.0)
    whole = _run(spark, rows)
    assert _run(spark, rows, layout=B.Layout(chunk_rows=100, halo_rows=40, held_rows=500)) == whole and {r for r, _ in whole} >= {1300, 2100, 101_500, *range(3195, 3215)}
    assert _run(spark, rows, layout=B.Layout(chunk_rows=50, halo_rows=40, held_rows=300, hot_sample=1, hot_part=0.1)) == whole


def test_lone_readings_are_judged_by_their_item(spark):
    rnd, rows = _base()
    rows += [("v", 90_000, 900, 1, T0, 161.0, "bpm", None), ("v", 90_001, 901, 1, T0, 84.0, "bpm", None), ("v", 90_002, 902, None, T0, 161.0, None, None)]
    assert {r for r, _ in _run(spark, rows)} == {90_000}


def test_innovation_variance_vanishes_over_a_window():
    import numpy as np

    u, group = np.array([1.0, 2, 2, 2, 3, 3, 3, 3, 3]), np.array([0, 0, 0, 0, 0, 0, 1, 1, 1])
    assert B._still(u, group, np.full(9, 3.0)).tolist() == [False, True, True, True, False, False, True, True, True]
    assert not B._still(u, group, np.full(9, 4.0)).any() and not B._still(u, group, np.full(9, np.nan)).any()


def test_empty(spark):
    assert B.bad_readings(spark.createDataFrame([], SCHEMA)).count() == 0
