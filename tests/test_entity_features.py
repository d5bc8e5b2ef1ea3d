import datetime as dt

from pyspark.sql import functions as F

from tarnwise.operators import entity_features as E

SCHEMA = "entity long, event_type string, ts timestamp, value double, k string, cum_n string"
D = lambda day, h=0: dt.datetime(2024, 1, day, h)


def _events(spark):
    return spark.createDataFrame([
        (1, "a", D(1), 2.0, "x", None), (1, "a", D(1), 2.0, "x", None), (1, "a", D(1, 5), None, "x", None), (1, "a", D(9), 4.0, "x", None), (1, "b", None, 1.0, "y", None),
        (2, "a", D(3), float("nan"), None, None), (None, "a", D(3), 1.0, None, None), (2, None, D(3), 1.0, None, None),
    ], SCHEMA)


def test_windows_are_differences_of_the_store(spark):
    store = E.cumulative_store(_events(spark), distinct_on=["ts", "value", "k"])
    got = {(r["entity"], r["event_type"]): r for r in E.cells_as_of(store, None, windows=(7,)).collect()}
    assert got[1, "a"]["n_events"] == 3 and got[1, "a"]["total"] == 6.0 and got[1, "a"]["n_7d"] == 1 and got[1, "a"]["total_7d"] == 4.0 and got[1, "a"]["seconds_since"] == 0
    assert got[1, "b"]["n_events"] == 1 and got[1, "b"]["seconds_since"] is None
    assert got[2, "a"]["n_events"] == 1 and got[2, "a"]["total"] is None
    assert len(got) == 3


def test_as_of_leaves_later_days_out(spark):
    store = E.cumulative_store(_events(spark))
    got = {(r["entity"], r["event_type"]): r["n_events"] for r in E.cells_as_of(store, F.lit(D(2))).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 1}


def test_rows_and_columns(spark):
    cells = E.cells_as_of(E.cumulative_store(_events(spark)))
    rows = {r["entity"]: r for r in E.feature_rows(cells).collect()}
    assert rows[1]["n_types"] == 2 and rows[1]["features"]["a"]["n_events"] == 4
    wide = {r["entity"]: r for r in E.feature_columns(cells, ["a", "zz"]).collect()}
    assert wide[1]["a__n_events"] == 4 and wide[1]["zz__n_events"] is None
    assert E.feature_rows(E.cells_as_of(E.cumulative_store(_events(spark).limit(0)))).count() == 0
