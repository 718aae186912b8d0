"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.session import cut_lineage, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_LONG = (1 << 63) - 1
#: Spark's setting by which an execution removes its shuffle files when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII only take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def crc32_of_id(c: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def hash63(*cols: Column) -> Column:
    """A uniform non-negative 63-bit hash."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(MAX_LONG))


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, so that added columns can't clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_broadcast(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` are within ``limit``;
    beyond it Spark joins by shuffle and splits hot partitions."""
    return F.broadcast(small) if rows <= limit else small


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: lineage ends there, columns that a
    reader doesn't ask for aren't read, and both sides of a later join are plain scans. The shuffle files of the write
    go with its end, so that those of a job's steps don't add up on the disks."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lower the bytes of an Arrow batch of this session to ``most``, if they are more: texts of any length then reach the
    Python workers in pieces whose buffers stay small beside an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    now = int(number) << 10 * " kmgtp".find(unit or " ") if unit != "b" else int(number)
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def written_order(df: DataFrame) -> list[Column] | None:
    """Columns that sort the rows of a scan of Parquet files as they were written: by the files' part numbers, then by
    the row's place in its file. None if ``df`` is no such scan, as then its rows have no order."""
    meta = F.col("_metadata")
    try:
        df.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return None
    part = F.regexp_extract(meta.getField("file_name"), r"part-(\d+)", 1).try_cast("long")
    return [part, meta.getField("file_name"), meta.getField("row_index")]


def prefix_sums(df: DataFrame, group: str, key: str, value: str, out: str, n_rows: int,
                cell_rows: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that sort before the row by ``key``.

    ``key`` is a uniform 63-bit hash (:func:`hash63`); rows of equal key follow one another in the order of ``value``.
    The groups are cut into cells by the leading bits of the key, about ``cell_rows`` rows each at the most (by
    default the root of ``n_rows``, so that cells and rows in a cell grow alike, 1000 at least): a group with a third
    of all rows spreads over many tasks, and only one row per cell meets in the group's own window. ``group`` must
    not be null.
    """
    cell_rows = cell_rows or max(1000, math.isqrt(n_rows))
    bits = max(0, (max(1, n_rows // cell_rows) - 1).bit_length())
    cell, offset = f"{out}__cell", f"{out}__offset"
    cells = df.withColumn(cell, F.shiftright(F.col(key), 63 - bits).cast("int") if bits else F.lit(0))
    before = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cells.groupBy(group, cell).agg(F.sum(value).alias(offset))
               .select(group, cell, F.coalesce(F.sum(offset).over(before), F.lit(0)).alias(offset)))
    within = (Window.partitionBy(group, cell).orderBy(key, value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (cells.join(offsets, [group, cell])
            .withColumn(out, F.col(offset) + F.coalesce(F.sum(value).over(within), F.lit(0)))
            .drop(cell, offset))


def document(text: Column, own: Column) -> Column:
    """A document's place in the order of documents: by id, null last, then by the hash of the text."""
    return F.struct(own.isNull().alias("none"), own.alias("id"), F.xxhash64(text).alias("key"))


def attach_marks(docs: DataFrame, seen: DataFrame, marks: DataFrame, text: str, id_col: str) -> DataFrame:
    """(row, m): the columns of ``docs`` in ``row`` and its mark, null where it has none.

    ``seen`` (doc, rid) lists the rows of ``docs`` as :func:`document` and a number, ``marks`` (doc, rid, m) the marks of
    some. Rows that repeat id and text are interchangeable, and the second and later of them have the same marks,
    so one row here takes the marks of the first there and the others those of the second. The texts are
    shuffled once, at every size, by the document.
    """
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("rid"))
    two = seen.withColumn("nth", nth).where("nth <= 2").join(marks, ["doc", "rid"])
    per = two.groupBy("doc").agg(F.max(F.when(F.col("nth") == 1, F.col("m"))).alias("first"),
                                 F.max(F.when(F.col("nth") == 2, F.col("m"))).alias("later"))
    row, per = F.col("row"), stored(per, "marks")
    # of the very type of the written marks, so that join and window agree on one partitioning
    doc = document(row.getField(text), row.getField(id_col)).cast(per.schema["doc"].dataType)
    out = packed(docs).withColumn("doc", doc).join(per.hint("merge"), "doc", "left")
    here = F.row_number().over(Window.partitionBy("doc").orderBy(F.lit(1)))
    return out.withColumn("nth", here).select(
        "row", F.when(F.col("nth") == 1, F.col("first")).otherwise(F.col("later")).alias("m"))


def text_table(docs: DataFrame, *cols: str) -> DataFrame:
    """Columns of ``docs`` by name, whatever else the table holds."""
    return docs.select(*[docs[f"`{c}`"] for c in cols])


__all__ = ["ascii_lower", "attach_marks", "crc32_of_id", "cut_lineage", "document", "hash63", "packed", "prefix_sums", "shuffle_partitions",
           "sized_broadcast", "small_batches", "stored", "text_table", "written_order"]
