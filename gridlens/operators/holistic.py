"""Holistic aggregates computed without per-group value buffers.

Spark's ``median``, ``mode`` and ``collect_set`` keep a group's distinct values in one
aggregation buffer, so a group holding a third of the rows would be merged
inside a single task.  Here all start from the number of rows per (level,
group, value), counted with map-side partial aggregation, so a value that half
the rows hold is one row per task:

* median: the counts are dealt out by ranges of (level, group, value), in
  more partitions the more there are; the totals per group and range tell
  which range holds a group's middle positions, and only the rows of that
  are sorted and added up.
* distinct count, join: the (level, group, value) rows are counted, or
  collected once each (the list is the output).
* dominant: the smallest value among the highest counts per group.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.operators.grouping import DEPTH, q
from gridlens.session import cut_lineage


def _gcol(i: int) -> str:
    return f"_g{i}"


def value_counts(df: DataFrame, group_by: list[str], value: Column, *, levels, keys=()) -> DataFrame:
    """``_g0.._gN, _depth``, keys, ``_v``, ``_n``: rows per grouping level, group and non-null value."""
    each = _on_levels(_leaf_counts(df, group_by, value, keys), df, group_by, levels, keys)
    return each.groupBy(*_group_cols(group_by, keys), "_v").agg(F.sum("_n").alias("_n"))


def _leaf_counts(df: DataFrame, group_by: list[str], value: Column, keys) -> DataFrame:
    return (df.select(*[q(g).alias(_gcol(i)) for i, g in enumerate(group_by)], *[q(k) for k in keys], value.alias("_v"))
            .where(F.col("_v").isNotNull())
            .groupBy(*[_gcol(i) for i in range(len(group_by))], *keys, "_v").agg(F.count(F.lit(1)).alias("_n")))


def _on_levels(leaf: DataFrame, df: DataFrame, group_by: list[str], levels, keys, *more: str) -> DataFrame:
    """The leaf groups' counts once for each level, as parts of that level's groups."""
    types = dict(df.dtypes)
    structs = []
    for d in levels:
        fields = [(F.col(_gcol(i)) if i < d else F.lit(None).cast(types[g])).alias(_gcol(i)) for i, g in enumerate(group_by)]
        structs.append(F.struct(*fields, F.lit(int(d)).alias(DEPTH)))
    return leaf.select(*keys, "_v", "_n", *more, F.explode(F.array(*structs)).alias("_lv")).select("_lv.*", *keys, "_v", "_n", *more)


def _group_cols(group_by, keys) -> list[str]:
    return [_gcol(i) for i in range(len(group_by))] + [DEPTH] + list(keys)


def median_by_level(df: DataFrame, group_by: list[str], value: Column, *, levels, keys=()) -> DataFrame:
    """Exact median (mean of the two middle values) per group and level."""
    leaf = cut_lineage(_leaf_counts(df, group_by, value, keys))
    rows = leaf.count() * len(levels)
    # equal values of different leaf groups stay apart, so that no range has to hold them all
    leaf = leaf.withColumn("_tie", F.xxhash64(*[_gcol(i) for i in range(len(group_by))]) if group_by else F.lit(0).cast("long"))
    each = _on_levels(leaf, df, group_by, levels, keys, "_tie")
    return median_of_counts(each, _group_cols(group_by, keys), tie=["_tie"], rows=rows)


#: Rows of a range of the median. Up to MOST ranges a task that deals out rows keeps none of them in memory.
RANGE_ROWS, MOST = 500_000, 200


def median_of_counts(counts: DataFrame, grp: list[str], tie: list[str] = (), rows: int = 0) -> DataFrame:
    """``grp`` and ``_agg``, the exact median of each group's values ``_v``, each of which occurs ``_n`` times. A value may
    have several rows, told apart by ``tie``; ``rows`` is their number, where known."""
    session = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(session, min(MOST, rows // RANGE_ROWS))
    dealt = counts.repartitionByRange(n, *grp, "_v", *tie).select(*grp, "_v", "_n", F.spark_partition_id().alias("_pid"))
    s = cut_lineage(dealt)
    # a group's rows in a range, and those in its ranges before: a few rows per range, none per value
    parts = s.groupBy(*grp, "_pid").agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*grp).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ranged = parts.select(*grp, "_pid", "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_off"),
                          F.sum("_in").over(Window.partitionBy(*grp)).alias("_all"))
    low = F.floor((F.col("_all") - 1) / 2)
    high = F.ceil((F.col("_all") - 1) / 2)
    holds = lambda p: (F.col("_off") <= p) & (p < F.col("_off") + F.col("_in"))
    middle = ranged.where(holds(low) | holds(high)).select(
        *[F.col(c).alias(f"_s{c}") for c in grp], F.col("_pid").alias("_spid"), "_off", "_all")
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in grp], F.col("_pid") == F.col("_spid"))
    near = s.join(middle, same).select(*grp, "_pid", "_v", "_n", "_off", "_all")
    inside = Window.partitionBy(*grp, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("_from", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    covers = lambda p: (F.col("_from") <= p) & (p < F.col("_from") + F.col("_n"))
    v = F.col("_v").cast("double")
    return placed.where(covers(low) | covers(high)).groupBy(*grp).agg(
        ((F.max(F.when(covers(low), v)) + F.max(F.when(covers(high), v))) / 2).alias("_agg"))


def dominant_by_level(df: DataFrame, group_by: list[str], value: Column, *, levels, keys=()) -> DataFrame:
    """Most frequent value per group and level; ties go to the smallest value."""
    grp = _group_cols(group_by, keys)
    counts = value_counts(df, group_by, value, levels=levels, keys=keys)
    best = counts.groupBy(*grp).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias("_b"))
    return best.select(*grp, F.col("_b.v").alias("_agg"))


def distinct_by_level(df: DataFrame, group_by: list[str], value: Column, *, levels, keys=()) -> DataFrame:
    """Number of distinct values per group and level; a group without any has no row."""
    counts = value_counts(df, group_by, value, levels=levels, keys=keys)
    return counts.groupBy(*_group_cols(group_by, keys)).agg(F.count(F.lit(1)).alias("_agg"))


def join_by_level(df: DataFrame, group_by: list[str], value: Column, *, levels, keys=()) -> DataFrame:
    """The sorted distinct values per group and level, joined by ``, ``; each value is collected once."""
    counts = value_counts(df, group_by, value, levels=levels, keys=keys)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_v")), lambda x: x.cast("string")), ", ")
    return counts.groupBy(*_group_cols(group_by, keys)).agg(text.alias("_agg"))


HOLISTIC = {"median": median_by_level, "dominant": dominant_by_level, "distinct count": distinct_by_level,
            "join": join_by_level}


def attach(rolled: DataFrame, group_by: list[str], keys, res: DataFrame, names: dict[str, str]) -> DataFrame:
    """Left-join columns of ``res`` (named as in ``names``) onto rollup rows, null-safe on level, group and ``keys``.

    ``res`` calls the group columns ``_g0.._gN``."""
    pairs = [(g, f"_r{i}", _gcol(i)) for i, g in enumerate(group_by)] + [(DEPTH, "_rd", DEPTH)]
    pairs += [(k, f"_rk{i}", k) for i, k in enumerate(keys)]
    right = res.select(*[F.col(c).alias(r) for _, r, c in pairs], *[q(c).alias(f"_new_{n}") for c, n in names.items()])
    on = functools.reduce(operator.and_, [q(left).eqNullSafe(F.col(r)) for left, r, _ in pairs])
    return rolled.join(right, on, "left").select(
        *[q(c) for c in rolled.columns], *[q(f"_new_{n}").alias(n) for n in names.values()])
