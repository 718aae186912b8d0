import datetime as dt
import os

import pyarrow as pa

from gridlens import View
from gridlens.plans.view import query_columns
from gridlens.sources.export import json_rows, write_arrow_files
from gridlens.sources.json_stream import (
    empty_table, table_from_arrow, table_from_columns, table_from_csv, table_from_csv_text, table_from_rows,
)


def test_table_inputs(spark, tmp_path):
    rows = table_from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2}], {"a": "integer", "b": "string"})
    assert [tuple(r) for r in rows.collect()] == [(1, "x"), (2, None)]
    cols = table_from_columns(spark, {"a": [1, 2], "c": [0.5, 1.5]})
    assert cols.count() == 2 and cols.columns == ["a", "c"]
    empty = empty_table(spark, {"t": "datetime", "f": float})
    assert empty.count() == 0 and [f.dataType.typeName() for f in empty.schema.fields] == ["timestamp", "double"]
    csv = table_from_csv_text(spark, ",a,b\n1,2,x\n3,4,y")
    assert csv.columns == ["_", "a", "b"] and csv.count() == 2
    p = tmp_path / "f.csv"
    p.write_text(",a\n1,2\n")
    assert table_from_csv(spark, str(p)).columns[0] == "_"
    arrow = pa.table({"a": [1, 2], "t": [dt.datetime(2024, 1, 1), None]})
    assert table_from_arrow(spark, arrow).count() == 2
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrow.schema) as w:
        w.write_table(arrow)
    assert table_from_arrow(spark, sink.getvalue().to_pybytes()).count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, None, dt.datetime(2024, 1, 1, 0, 0, 0, 123456))],
                               "a long, b string, t timestamp_ntz")
    assert json_rows(df).first().json == '{"a":1,"t":"2024-01-01T00:00:00.123456"}'
    assert json_rows(df, ignore_null_fields=False).first().json.count("null") == 1
    v = View(df, {"columns": ["a", "b"]})
    v.to_csv(str(tmp_path / "csv"))
    assert any(n.endswith(".csv") for n in os.listdir(tmp_path / "csv"))
    assert v.to_arrow().num_rows == 1
    assert v.to_json().count() == 1
    write_arrow_files(v.to_df(), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 1


def test_query_columns(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(10)], "a long, b long")
    out = query_columns(df, {"sort": [["a", "desc"]]}, start_row=1, end_row=3)
    assert out == {"a": [8, 7], "b": [16, 14]}
    assert View(df, {"columns": ["b"]}).to_records(0, 2) == [{"b": 0}, {"b": 2}]
