"""A sorted copy of a table or view with the row offset of every file, for reading slices by position.

The rows are range-sorted once and written as Parquet files of at most ``rows_per_file`` rows, whose names are in row
order. The index has a row per file: its first position and its number of rows. A slice looks up the files it overlaps and
reads these only, whether it lies at the top or deep inside, and however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.operators.sorting import orderable
from gridlens.session import scratch_path

ROWS_PER_FILE = 1_000_000


class SortedRows:
    """The sorted rows stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = spark.read.schema("file string, first long, n long").parquet(f"{self.path}/index")
        self.schema = spark.read.parquet(f"{self.path}/rows").schema

    @classmethod
    def write(cls, df: DataFrame, order: list[Column], path: str | None = None, *,
              rows_per_file: int = ROWS_PER_FILE) -> SortedRows:
        """Sort ``df`` by ``order``, then by its other columns, and store it under ``path`` (by default in the scratch
        folder). An empty table has an empty index."""
        spark = df.sparkSession
        path = (path or scratch_path(spark, "sorted")).rstrip("/")
        ties = [F.col(f"`{f.name}`").asc_nulls_first() for f in df.schema.fields if orderable(f.dataType)]
        df.orderBy(*order, *ties).write.option("maxRecordsPerFile", int(rows_per_file)).parquet(f"{path}/rows")
        # counts come from the files' footers; the names tell the task and its file
        files = spark.read.schema(df.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.count(F.lit(1)).alias("n"))
        task, nth = (F.regexp_extract("file", p, 1).cast("long") for p in (r"^part-(\d+)-", r"-c(\d+)\."))
        before = Window.orderBy(task, nth).rowsBetween(Window.unboundedPreceding, -1)  # a row per file
        index = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")
        index.coalesce(1).write.parquet(f"{path}/index")
        return cls(spark, path)

    def num_rows(self) -> int:
        """M4: the number of rows, from the index."""
        return self.index.agg(F.coalesce(F.max(F.col("first") + F.col("n")), F.lit(0))).first()[0]

    def files(self, start: int, end: int | None) -> list[tuple[str, int]]:
        """(name, first position) of the files that hold rows [start, end)."""
        hit = F.col("first") + F.col("n") > int(start)
        if end is not None:
            hit = hit & (F.col("first") < int(end))
        return [(r["file"], r["first"]) for r in self.index.where(hit).orderBy("first").collect()]

    def slice(self, start: int = 0, end: int | None = None, name: str = "_rank") -> DataFrame:
        """Rows [start, end) with their position from 1 in ``name``, in order."""
        start = max(0, int(start or 0))
        found = self.files(start, end) if end is None or end > start else []
        if not found:
            return self.spark.createDataFrame([], self.schema).withColumn(name, F.lit(0).cast("long"))
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{f}" for f, _ in found])
        names = self.spark.createDataFrame(found, "_file string, _first long")
        own = [F.col(f"`{f.name}`") for f in self.schema.fields]
        at = rows.select(*own, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        if end is not None:  # few files, so their first positions are few
            first = F.element_at(F.create_map(*[F.lit(x) for pair in found for x in pair]), F.col("_file"))
            placed = at.withColumn("_at", first.cast("long") + F.col("_at"))
        else:
            placed = at.join(names, "_file").withColumn("_at", F.col("_first") + F.col("_at"))
        inside = F.col("_at") >= start
        if end is not None:
            inside = inside & (F.col("_at") < int(end))
        return placed.where(inside).select(*own, (F.col("_at") + 1).alias(name)).orderBy(name)


def indexed(view, path: str | None = None, *, rows_per_file: int = ROWS_PER_FILE) -> SortedRows:
    """The rows of a :class:`~gridlens.plans.view.View` in its order, without its viewport, stored for slicing."""
    df, order, keep = view.ordered()
    out = SortedRows.write(df, order, path, rows_per_file=rows_per_file)
    out.schema = type(out.schema)([out.schema[c] for c in keep])
    return out


__all__ = ["ROWS_PER_FILE", "SortedRows", "indexed"]
