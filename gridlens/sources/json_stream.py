"""JSON-lines streams (S1, F9) and table inputs."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.types import to_struct

CORRUPT = "_corrupt_record"


def parse_json_lines(raw: DataFrame, schema, *, value_col: str = "value",
                     corrupt_col: str | None = None, keep_raw: bool = False,
                     options: dict | None = None) -> DataFrame:
    """One JSON object per ``value`` line -> typed columns.

    Works the same on a batch or a streaming DataFrame, whatever produced the
    lines (file, Kafka, socket).  A malformed line gives an all-null row;
    with ``corrupt_col`` the raw text of such lines is kept in that column.
    ``keep_raw`` keeps the line as ``_raw`` (a live table then tells an absent
    field from an explicit null).
    """
    st = to_struct(schema)
    v = F.col(value_col).cast("string")
    parsed = raw.select(F.from_json(v, st, options or {}).alias("_d"), v.alias("_raw"))
    cols = [F.col(f"_d.`{f.name}`").alias(f.name) for f in st.fields]
    if corrupt_col:
        ok = F.try_parse_json(F.col("_raw")).isNotNull() & F.startswith(F.trim(F.col("_raw")), F.lit("{"))
        cols.append(F.when(~ok | F.col("_raw").isNull(), F.col("_raw")).alias(corrupt_col))
    if keep_raw:
        cols.append(F.col("_raw"))
    return parsed.select(*cols)


def json_stream(spark: SparkSession, schema, *, source: str = "text", path: str | None = None,
                options: dict | None = None, value_col: str = "value",
                corrupt_col: str | None = None, keep_raw: bool = False) -> DataFrame:
    """Streaming DataFrame of parsed JSON lines from any line source.

    ``source="text"`` reads new files under ``path``; ``"socket"`` and
    ``"kafka"`` take their usual options (Kafka's ``value`` is binary and is
    cast to string).
    """
    reader = spark.readStream.format(source)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    raw = reader.load(path) if path else reader.load()
    return parse_json_lines(raw, schema, value_col=value_col, corrupt_col=corrupt_col, keep_raw=keep_raw)


def table_from_rows(spark: SparkSession, rows: list[dict], schema=None) -> DataFrame:
    """S3: a small table from a list of row dicts (missing keys are nulls)."""
    if schema is not None:
        st = to_struct(schema)
        return spark.createDataFrame([tuple(r.get(f.name) for f in st.fields) for r in rows], st)
    return spark.createDataFrame(rows)


def table_from_columns(spark: SparkSession, columns: dict, schema=None) -> DataFrame:
    """A small table from ``{column: [values]}``."""
    import pandas as pd

    pdf = pd.DataFrame(columns)
    return spark.createDataFrame(pdf, to_struct(schema) if schema is not None else None)


def empty_table(spark: SparkSession, schema) -> DataFrame:
    """An empty table with a fixed schema."""
    return spark.createDataFrame([], to_struct(schema))


def table_from_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV files with a header; a blank first header becomes ``_``."""
    r = spark.read.option("header", True)
    r = r.schema(to_struct(schema)) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    first = df.columns[0] if df.columns else None
    if first is not None and (first.strip() == "" or first.startswith("_c0")):
        df = df.withColumnRenamed(first, "_")
    return df


def table_from_csv_text(spark: SparkSession, text: str) -> DataFrame:
    """S6 for a small in-memory CSV string (a header starting ``,`` names ``_``)."""
    import pandas as pd

    if text.startswith(","):
        text = "_" + text
    return spark.createDataFrame(pd.read_csv(io.StringIO(text)))


def table_from_arrow(spark: SparkSession, data) -> DataFrame:
    """Arrow table or IPC stream bytes -> DataFrame."""
    import pyarrow as pa

    if isinstance(data, (bytes, bytearray, memoryview)):
        data = pa.ipc.open_stream(io.BytesIO(bytes(data))).read_all()
    return spark.createDataFrame(data)

