"""Sort clauses, global ranks and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from gridlens.session import checkpoint_root

_MASK33 = (1 << 33) - 1

def sort_column(c: Column, direction: str) -> Column | None:
    """One sort clause -> ordering Column (``None`` for ``none``).

    Nulls: first when ascending, last when descending (Spark's defaults,
    stated explicitly so every engine agrees).
    """
    d = direction.replace("col ", "")
    if d == "none":
        return None
    if d.endswith(" abs"):
        c, d = F.abs(c), d[:-4]
    return c.asc_nulls_first() if d == "asc" else c.desc_nulls_last()


def row_sorts(sort) -> list:
    """Clauses that order rows (``col …`` clauses order pivot columns instead)."""
    return [(c, d) for c, d in sort if d != "none" and not d.startswith("col ")]


def column_sorts(sort) -> list:
    return [(c, d) for c, d in sort if d.startswith("col ")]


def orderable(kind: DataType) -> bool:
    """Whether Spark can sort by a column of this type."""
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def global_rank(df: DataFrame, order: list[Column], name: str = "_rank") -> DataFrame:
    """Attach a dense 1-based position in ``order`` without a one-task window.

    The data is range-sorted across all tasks, checkpointed to the shared
    checkpoint folder (fixing partition layout, surviving executor loss),
    then each row gets offset-of-its-partition + position-in-partition.  Only
    per-partition counts (one row per partition) are broadcast.
    """
    checkpoint_root(df.sparkSession)
    cols = df.columns
    s = df.orderBy(*order).checkpoint(eager=True)
    s = s.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_mid", 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = s.join(F.broadcast(offsets), "_pid")
    return out.select(*[F.col(f"`{c}`") for c in cols],
                      (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_MASK33)) + 1).alias(name))


def slice_rows(df: DataFrame, order: list[Column], start: int = 0, end: int | None = None) -> DataFrame:
    """Rows ``[start, end)`` of the ordering (O7); top-k is ``start=0``.

    ``orderBy().offset().limit()`` plans as TakeOrderedAndProject: each task
    keeps only its best ``end`` rows.  A slice without an end is cut from the
    distributed global rank, so no task sees all rows.  To scroll through a
    large result, store it once (:class:`~gridlens.sources.sorted_index.SortedRows`)
    and read slices of that.
    """
    start = max(0, int(start or 0))
    if end is None and not start:
        return df.orderBy(*order) if order else df
    if end is None:
        return ranked_slice(df, order, start, end, "_slice_pos").orderBy("_slice_pos").drop("_slice_pos")
    out = df.orderBy(*order) if order else df
    return out.offset(start).limit(max(0, int(end) - start))


def ranked_slice(df: DataFrame, order: list[Column], start: int = 0, end: int | None = None,
                 name: str = "_rank") -> DataFrame:
    """A slice with its positions; of a bounded slice, the window only sees its rows."""
    if end is None:
        return global_rank(df, order, name).where(F.col(name) > start)
    sl = slice_rows(df, order, start, end)
    return sl.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + F.lit(start)).cast("long"))


def viewport_bounds(viewport: dict | None, n_cols: int | None = None) -> tuple:
    """``{top, left, width, height}`` -> ``(start_row, end_row, start_col, end_col)`` (V8)."""
    vp = viewport or {}
    top, left = int(vp.get("top", 0) or 0), int(vp.get("left", 0) or 0)
    h, w = vp.get("height"), vp.get("width")
    end_row = top + int(h) if h is not None else None
    end_col = left + int(w) if w is not None else n_cols
    if n_cols is not None and end_col is not None:
        end_col = min(end_col, n_cols)
    return top, end_row, left, end_col
