import datetime as dt

from pyspark.sql import types as T

from gridlens.types import conform, schema_from_dict, table_schema, type_name


def test_schema_from_dict():
    st = schema_from_dict({"i": int, "f": float, "s": str, "b": bool, "t": dt.datetime, "d": "date"})
    assert [f.dataType for f in st.fields] == [T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(),
                                               T.TimestampType(), T.DateType()]


def test_type_names():
    assert type_name(T.IntegerType()) == "integer" and type_name(T.FloatType()) == "float"
    assert type_name(T.TimestampNTZType()) == "datetime"


def test_conform_casts(spark):
    raw = spark.createDataFrame(
        [("null", "TRUE", "1.5", "2024-01-31", "x"), ("undefined", "abc", "abc", "nope", "y"),
         ("7", "false", None, "2024-01-31 10:00:00", "z")],
        "i string, b string, f string, t string, extra string")
    out = conform(raw, {"i": "integer", "b": "boolean", "f": "float", "t": "datetime", "missing": "string"})
    assert out.columns == ["i", "b", "f", "t", "missing"]
    rows = out.collect()
    assert [r.i for r in rows] == [None, None, 7]
    assert [r.b for r in rows] == [True, False, False]
    assert [r.f for r in rows] == [1.5, None, None]
    assert rows[0].t == dt.datetime(2024, 1, 31) and rows[1].t is None
    assert all(r.missing is None for r in rows)
    assert table_schema(out)["b"] == "boolean"
