"""The seven column types of a live table and their Spark counterparts.

S2 (schema dict -> StructType), M1 (table schema as type names) and T11
(write conformance: a batch is cast to the table's columns).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names of the table model.
TYPE_NAMES = ("integer", "float", "string", "boolean", "datetime", "date", "object")

_PY_TYPES = {
    bool: "boolean",
    int: "integer",
    float: "float",
    str: "string",
    _dt.datetime: "datetime",
    _dt.date: "date",
}

_SPARK_TYPES = {
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampType(),
    "date": T.DateType(),
}


def type_name(dt: T.DataType) -> str:
    """Spark type -> one of the table type names."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, T.StringType):
        return "string"
    return "object"


def spark_type(t) -> T.DataType:
    """A type given as name, Python type or Spark type -> Spark type."""
    if isinstance(t, T.DataType):
        return t
    if isinstance(t, type):
        if t not in _PY_TYPES:
            raise TypeError(f"unsupported column type {t!r}")
        t = _PY_TYPES[t]
    if t not in _SPARK_TYPES:
        raise TypeError(f"unsupported column type {t!r}")
    return _SPARK_TYPES[t]


def schema_from_dict(schema: dict) -> T.StructType:
    """``{column: type}`` -> ``StructType``."""
    return T.StructType([T.StructField(k, spark_type(v), True) for k, v in schema.items()])


def to_struct(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else schema_from_dict(schema)


def table_schema(df: DataFrame) -> dict[str, str]:
    """``{column: type name}`` of a table or view (M1 / M2)."""
    return {f.name: type_name(f.dataType) for f in df.schema.fields}


def _cast_cell(c: Column, src: T.DataType, dst: T.DataType) -> Column:
    if isinstance(src, T.StringType):
        # The text "null" is a null cell; so is "undefined" (absent).
        c = F.when(F.lower(F.trim(c)).isin("null", "undefined"), F.lit(None).cast("string")).otherwise(c)
        if isinstance(dst, T.BooleanType):
            return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(F.trim(c)) == F.lit("true"))
        if isinstance(dst, T.StringType):
            return c
        return F.trim(c).try_cast(dst)
    if isinstance(dst, T.StringType) or src == dst:
        return c.cast(dst)
    return c.try_cast(dst)


def conform(df: DataFrame, schema) -> DataFrame:
    """Cast a batch to a table's schema.

    Only the table's columns are kept (extra fields drop), a missing column
    is a null column, bad numbers become null (``try_cast``), and boolean
    text is true exactly when it reads ``true`` in any case.
    """
    st = to_struct(schema)
    src = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in st.fields:
        if f.name in src:
            cols.append(_cast_cell(F.col(f"`{f.name}`"), src[f.name], f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
