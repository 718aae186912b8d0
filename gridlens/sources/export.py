"""View outputs: JSON rows, CSV, Arrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Timestamps keep their microseconds in JSON text.
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def json_rows(df: DataFrame, *, ignore_null_fields: bool = True, name: str = "json") -> DataFrame:
    """Each row as one JSON object string.

    ``ignore_null_fields`` is explicit: with True a null cell is left out of
    the object (it then reads as absent downstream), with False it is written
    as ``null``.
    """
    opts = dict(JSON_OPTIONS, ignoreNullFields=str(ignore_null_fields).lower())
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), opts).alias(name))


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """CSV with a header, written by the executors."""
    df.write.mode(mode).option("header", True).csv(path)


def write_arrow_files(df: DataFrame, path: str, *, compression: str = "lz4", mode: str = "overwrite") -> None:
    """T17 at scale: Arrow-compatible columnar files (Parquet, LZ4)."""
    df.write.mode(mode).option("compression", compression).parquet(path)
