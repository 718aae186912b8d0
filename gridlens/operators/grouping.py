"""Grouping with subtotals, depth, row paths, expansion and pivots.

Where all aggregates have mergeable states, the rows are folded once, into
a state per leaf group, and the subtotals from those (:func:`leaf_first`);
otherwise subtotal rows come from ``rollup`` (one Expand + one partial/final
hash aggregate).  Either way hot groups are pre-aggregated before the shuffle.
A row's depth is ``levels - bit_count(grouping_id())``; null group values and
rolled-up subtotal cells are told apart by depth, never by null tests.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.aggregates import State

DEPTH = "_depth"
ROW_PATH = "__ROW_PATH__"


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def grouped_aggregate(df: DataFrame, group_by: list[str], aggs: list[Column], *,
                      leaves_only: bool = False) -> DataFrame:
    """Aggregate with one row per group prefix (rollup) plus ``_depth``."""
    n = len(group_by)
    if leaves_only:
        return df.groupBy(*[q(c) for c in group_by]).agg(*aggs).withColumn(DEPTH, F.lit(n))
    depth = (F.lit(n) - F.bit_count(F.grouping_id())).cast("int").alias(DEPTH)
    return df.rollup(*[q(c) for c in group_by]).agg(*aggs, depth)


def row_path(group_by: list[str], depth: Column | None = None) -> Column:
    """Group values root to leaf, as strings, shorter for subtotal rows."""
    if not group_by:
        return F.array().cast("array<string>")
    arr = F.array(*[q(c).cast("string") for c in group_by])
    return F.slice(arr, 1, depth if depth is not None else F.col(DEPTH))


def path_key(group_by: list[str], length: Column | int) -> Column:
    """Canonical text of the first ``length`` group values (nulls kept apart)."""
    if not group_by:
        return F.lit("[]")
    arr = F.array(*[q(c).cast("string") for c in group_by])
    ln = F.lit(length) if isinstance(length, int) else length
    return F.to_json(F.slice(arr, 1, F.greatest(ln, F.lit(0))))


def filter_expanded(rolled: DataFrame, group_by: list[str], open_paths: DataFrame) -> DataFrame:
    """Keep rows whose every proper prefix is open.

    ``open_paths`` holds a column ``path`` (array<string>) of expanded rows.
    The closure (open paths all of whose prefixes are open) keeps rows by a
    left-semi join on their parent's path; Spark picks the join by the sizes it
    sees at run time.  The root is always open.
    """
    opened = open_paths.select(F.col("path").cast("array<string>").alias("path")).distinct()
    # closure: a path counts only when every prefix of it is open as well
    op = opened.select(F.to_json("path").alias("_k"), F.size("path").alias("_len"), "path")
    prefixes = op.select("_k", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_len") - 1, F.lit(1)))).alias("_p"),
                         "_len", "path")
    prefixes = prefixes.where(F.col("_len") > 1).select(
        "_k", F.to_json(F.slice("path", 1, F.col("_p"))).alias("_pk"))
    missing = prefixes.join(op.select(F.col("_k").alias("_pk")), "_pk", "left_anti").select("_k").distinct()
    closed = op.join(missing, "_k", "left_anti").select(F.col("_k").alias("_parent"))
    keyed = rolled.withColumn("_parent", path_key(group_by, F.col(DEPTH) - 1))
    root = F.col(DEPTH) <= 1  # the root row and its children
    rest = keyed.where(~root).join(closed, "_parent", "left_semi")
    return keyed.where(root).unionByName(rest).drop("_parent")


def split_columns(split_by: list[str]) -> list[str]:
    """Internal names of the split columns (a column may be grouped by as well)."""
    return [f"_split{i}" for i in range(len(split_by))]


def split_levels(df: DataFrame, group_by: list[str], keys: list[str], levels: list[int], aggs: list[Column]) -> DataFrame:
    """Aggregate per group level and split tuple ``keys``: one pass of grouping sets, plus ``_depth``."""
    sets = [[q(c) for c in group_by[:d] + keys] for d in levels]
    depth = functools.reduce(operator.add, [F.lit(1) - F.grouping(q(c)).cast("int") for c in group_by], F.lit(0))
    return df.groupingSets(sets, *[q(c) for c in group_by + keys]).agg(*aggs, depth.cast("int").alias(DEPTH))


def leaf_first(df: DataFrame, group_by: list[str], keys: list[str], levels: list[int],
               states: dict[str, State]) -> DataFrame:
    """Aggregate per group level and ``keys`` from mergeable states: ``group_by``, ``keys``, the values, ``_depth``.

    Each row is folded once, into the state of its leaf group; the levels above are folded from the leaf groups' states.
    Both read the same shuffled states, which Spark writes once.
    """
    n, by = len(group_by), group_by + keys
    parts, folds, values = [], [], []
    for i, (name, state) in enumerate(states.items()):
        cols = [f"__state{i}_{j}" for j in range(len(state.parts))]
        parts += [part.alias(c) for c, (part, _) in zip(cols, state.parts)]
        folds += [fold(F.col(c)).alias(c) for c, (_, fold) in zip(cols, state.parts)]
        values.append(state.value(*[F.col(c) for c in cols]).alias(name))
    leaves = df.groupBy(*[q(c) for c in by]).agg(*parts, F.count(F.lit(1)).alias("__rows"))
    leaves = leaves.where("__rows > 0")  # both parts need the same columns, else Spark would shuffle the rows twice
    out = leaves.select(*[q(c) for c in by], *values, F.lit(n).alias(DEPTH)) if n in levels else None
    upper = [d for d in levels if d < n]
    if not upper:
        return out
    top = group_by[:max(upper)]
    folds.append(F.sum("__rows").alias("__rows"))
    if top + keys:
        merged = split_levels(leaves, top, keys, upper, folds)
    else:
        merged = leaves.agg(*folds).where("__rows > 0").withColumn(DEPTH, F.lit(0))  # no total of an empty table
    absent = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in group_by[len(top):]]
    merged = merged.select(*[q(c) for c in top], *absent, *[q(c) for c in keys], *values, F.col(DEPTH))
    return merged if out is None else out.union(merged)


def value_text(v) -> str:
    return "null" if v is None else str(v)


def column_path(values: tuple, column: str, sep: str = "|") -> str:
    """Pivot column name: split values and the value column joined by ``|``."""
    return sep.join([value_text(v) for v in values] + [column])


def unique_labels(names: list[str]) -> list[str]:
    """``names`` made different: the second and later of equal names are numbered, ``x``, ``x (2)``, …, and a numbered name
    that is among ``names`` itself is passed over."""
    given, last = set(names), {}
    out = []
    for n in names:
        if n not in last:
            last[n] = 1
            out.append(n)
            continue
        last[n] += 1
        while f"{n} ({last[n]})" in given:
            last[n] += 1
        out.append(f"{n} ({last[n]})")
    return out


def numbered_labels(df: DataFrame, name: str, order: Column) -> DataFrame:
    """:func:`unique_labels` of the column ``name`` in ``order``, by Spark."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    counted = df.withColumn("_nth", nth)
    again = counted.where("_nth = 2").select(F.col(name).alias("_base"))
    number = F.regexp_extract(name, r"(?s)^(.*) \(([1-9][0-9]*)\)$", 2)
    taken = df.select(F.regexp_extract(name, r"(?s)^(.*) \(([1-9][0-9]*)\)$", 1).alias("_base"), number.try_cast("long").alias("_n"))
    taken = (taken.where("_n >= 2").distinct().join(again, "_base", "left_semi")
             .groupBy("_base").agg(F.array_sort(F.collect_list("_n")).alias("_taken")))
    joined = counted.join(taken, F.col(name) == F.col("_base"), "left")
    # the nth free number from 2 on
    free = F.aggregate(F.coalesce("_taken", F.expr("cast(array() as array<bigint>)")), F.col("_nth").cast("long"),
                       lambda at, t: F.when(t <= at, at + 1).otherwise(at))
    label = F.when(F.col("_nth") > 1, F.concat(F.col(name), F.lit(" ("), free.cast("string"), F.lit(")"))).otherwise(F.col(name))
    return joined.withColumn(name, label).drop("_nth", "_base", "_taken")
