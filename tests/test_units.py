from tarnwise.operators import units

ITEMS = "itemid long, label string"
UNITS = "label string, unit_code string, factor_to_common double, is_common boolean"
LABS = "id long, itemid long, label string, valuenum double, valueuom string, unit_code string"


def _dims(spark):
    items = spark.createDataFrame([(1, "Glucose "), (2, ""), (3, None)], ITEMS)
    table = spark.createDataFrame([("Glucose", "mg/dL", 1.0, True), ("Glucose", "mmol/L", 18.0, False)], UNITS)
    return items, table


def _run(spark, rows):
    items, table = _dims(spark)
    out = units.to_common_units(spark.createDataFrame(rows, LABS), items, table)
    return {r["id"]: (r["unit_code"], r["unit_from"], r["value_common"]) for r in out.collect()}


def test_field_text_and_default(spark):
    got = _run(spark, [
        (1, 1, "Glucose", 5.0, "mmol per litre", "x"), (2, 1, "GLUCOSE  mM", 5.0, "UNK", None), (3, 1, "Glucose (mg%)", 90.0, "mmol/l", None), (4, 1, "glucose", 90.0, None, None),
        (5, 2, "Glucose mmol/L", 5.0, "mmol/L", None), (6, None, None, None, None, None), (7, 1, "mmol / L Glucose", float("nan"), "", None), (8, 1, "Glucose - result MMOL/L", 2.0, "mmHg", None),
    ])
    assert got[1] == ("mmol/L", "field", 90.0)
    assert got[2] == ("mmol/L", "text", 90.0)
    assert got[3] == ("mmol/L", "field", 1620.0)
    assert got[4] == ("mg/dL", "default", 90.0)
    assert got[5] == (None, "none", 5.0)
    assert got[6] == (None, "none", None)
    assert got[7] == ("mmol/L", "text", None)
    assert got[8] == ("mmol/L", "text", 36.0)


def test_dictionary_and_row_paths_agree(spark, monkeypatch):
    rows = [(i, 1, "Glucose" if i % 2 else "Glucose [mg/dl]", float(i), ["mM", "", "mg%"][i % 3], None) for i in range(30)]
    a = _run(spark, rows)
    monkeypatch.setattr(units, "TRIPLES", 0)
    assert _run(spark, rows) == a


def test_empty_and_quantity(spark):
    items, table = _dims(spark)
    assert units.to_common_units(spark.createDataFrame([], LABS), items, table).count() == 0
    df = spark.createDataFrame([("5,2 mmol/L",), ("no number",), (None,), ("12",)], "t string")
    got = [r["q"] and (r["q"]["number"], r["q"]["unit"]) for r in df.select(units.parse_quantity(df.t).alias("q")).collect()]
    assert got[0] == (5.2, "mmol/L") and got[3] == (12.0, None) and got[1][0] is None and got[2][0] is None
