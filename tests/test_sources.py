import pytest
from pyspark.sql import types as T

from tarnwise.sources import catalog
from tarnwise.streaming import events


def test_ingest_counts_bad_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nx,3\n4,5\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    assert catalog.ingest_csv(spark, str(tmp_path / "x.csv"), str(tmp_path / "out.parquet"), schema, ["b"]) == {"rows": 2, "malformed": 1}
    assert spark.read.parquet(str(tmp_path / "out.parquet")).columns == ["b"]


def test_catalog(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert catalog.register(spark, str(tmp_path), ["t"], ["gone"]) == {"t": True, "gone": False}
    with pytest.raises(FileNotFoundError):
        catalog.register(spark, str(tmp_path), ["gone"])
    df = spark.range(1).withColumnRenamed("id", "HADM_ID")
    assert catalog.pick_name(df, ["hadmid", "hadm_id"]) == "HADM_ID" and catalog.pick_name(df, ["x"]) is None
    path = str(tmp_path / "store.parquet")
    catalog.append_new(spark.range(3), path, ["id"])
    assert catalog.append_new(spark.range(5), path, ["id"]).count() == 5
    catalog.write_json({"a": 1}, str(tmp_path / "m/x.json"))
    catalog.write_both(spark.range(2), str(tmp_path / "both"))
    assert catalog.read_any(spark, str(tmp_path / "both.csv")).count() == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select id as event_id, timestamp_ntz'2024-01-01 10:00:00' as ts, id as user_id, 'a' as event_type, 1.0D as value, '' as props from range(6)").write.parquet(str(src))
    events.run_once(events.windowed(events.read(spark, str(src))), "tw", str(tmp_path / "ck"))
    assert [(r["n"], r["total"]) for r in spark.table("tw").collect()] == [(6, 6.0)]
