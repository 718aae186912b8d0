"""Change operators: deltas between view versions, change direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def view_delta(old: DataFrame, new: DataFrame, *, removed: bool = False) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks (``removed=True``: the reverse).

    A multiset difference (``EXCEPT ALL``): both sides are shuffled by the
    whole row, so the work spreads evenly whatever the keys look like.
    """
    return old.exceptAll(new) if removed else new.exceptAll(old)


def remove_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Drop rows whose key is in ``keys`` (anti join, broadcast when checked small)."""
    from gridlens.operators.filters import semi_filter

    return semi_filter(df, keys, on, anti=True)


def previous_value_ranked(df: DataFrame, key, order: list[str], value: str, *,
                          name: str = "prev_value") -> DataFrame:
    """Exact ``lag(value)`` per key in ``order``, whatever the skew.

    Rows are range-sorted on (key, order) - the range partitioner splits even
    a key holding a third of all rows across many tasks - and get their global
    position (:func:`global_rank`).  Each row's predecessor is the row at
    position p - 1, found by an equi-join on the position (unique, evenly
    spread); it counts only when it has the same key.
    """
    from gridlens.operators.sorting import global_rank

    keys = [key] if isinstance(key, str) else list(key)
    sort = [_q(k).asc_nulls_first() for k in keys] + [_q(c).asc_nulls_first() for c in order]
    ranked = global_rank(df, sort, "_p")
    prev = ranked.select((F.col("_p") + 1).alias("_p"), *[_q(k).alias(f"_pk{i}") for i, k in enumerate(keys)],
                         _q(value).alias("_pv"))
    out = ranked.join(prev, "_p", "left")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & _q(k).eqNullSafe(F.col(f"_pk{i}"))
    out = out.withColumn(name, F.when(same, F.col("_pv")))
    return out.drop("_p", "_pv", *[f"_pk{i}" for i in range(len(keys))])


def previous_value(df: DataFrame, key, order: list[str], value: str, *, bucket: Column | None = None,
                   name: str = "prev_value") -> DataFrame:
    """``lag(value)`` per key in ``order`` without putting a whole key in one task.

    Without ``bucket`` this is :func:`previous_value_ranked` (exact under any
    skew).  With a ``bucket``:
    Rows are windowed per (key, bucket) - ``bucket`` is a coarse function of
    the order (e.g. the day of a timestamp) - so a key holding a third of
    all rows is still spread over many tasks.  The first row of a bucket
    takes the last value of the key's previous non-empty bucket, found from
    one summary row per (key, bucket) - cheaper, but a key concentrated in
    one bucket stays in one task.
    """
    if bucket is None:
        return previous_value_ranked(df, key, order, value, name=name)
    keys = [key] if isinstance(key, str) else list(key)
    ordc = F.struct(*[_q(c) for c in order])
    b = df.withColumn("_b", bucket)
    w = Window.partitionBy(*[_q(k) for k in keys], F.col("_b")).orderBy(*[_q(c) for c in order])
    within = (b.withColumn(name, F.lag(_q(value)).over(w))
              .withColumn("_first", F.row_number().over(w) == 1))
    summary = b.groupBy(*[_q(k) for k in keys], F.col("_b")).agg(F.max_by(_q(value), ordc).alias("_last"))
    wb = Window.partitionBy(*[_q(k) for k in keys]).orderBy("_b")
    summary = summary.select(*[_q(k) for k in keys], "_b", F.lag("_last").over(wb).alias("_prev_last"))
    out = within.join(summary, keys + ["_b"], "left")
    out = out.withColumn(name, F.when(F.col("_first"), F.col("_prev_last")).otherwise(F.col(name)))
    return out.drop("_b", "_first", "_prev_last")


def change_direction(df: DataFrame, key, order: list[str], value: str, *, bucket: Column | None = None,
                     name: str = "direction") -> DataFrame:
    """+1 / -1 / 0 against the key's previous value (null for a first value)."""
    out = previous_value(df, key, order, value, bucket=bucket, name=f"prev_{value}")
    return out.withColumn(name, F.signum(_q(value) - F.col(f"prev_{value}")).cast("int"))
