"""The 27 named aggregates as Spark aggregate expressions.

Every aggregate here is an algebraic / declarative Spark aggregate, so it
gets map-side partial aggregation: a group holding a third of all rows is
folded per task before the shuffle and never lands whole in one task.
(``median`` and ``join`` keep per-group value buffers; see README.)

Order-dependent aggregates (any, first/last, last minus first) read an
explicit ordering struct (the table's sequence columns, then its key): rows
have no arrival order once distributed.  Rows whose value is null are
ignored by every aggregate, including the ordered ones.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.config import ALL_AGGREGATES

# Aggregates whose final value needs the rolled-up result (post-processing).
PCT_PARENT = "pct sum parent"
PCT_TOTAL = "pct sum grand total"
DISTINCT_LEAF = "distinct leaf"


@dataclasses.dataclass(frozen=True)
class AggSpec:
    column: str   # source column
    name: str     # aggregate name
    alias: str    # output column name


def _ordering(order: list[str]) -> Column:
    if not order:
        raise ValueError("this aggregate needs an ordering (the table's seq / key columns)")
    return F.struct(*[F.col(f"`{c}`") for c in order])


def aggregate_column(name: str, column: str | Column, *, order: list[str] | None = None,
                     index: list[str] | None = None, cond: Column | None = None,
                     approx: bool = False) -> Column:
    """Aggregate ``name`` of ``column``; ``cond`` restricts the rows (pivots)."""
    if name not in ALL_AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    if cond is not None:
        c = F.when(cond, c)
    present = c.isNotNull()

    def ordered(cols):
        # rows with equal ordering values are settled by the value itself
        return F.when(present, F.struct(_ordering(cols).alias("o"), c.alias("v")))

    if name == "any":
        return F.min_by(c, ordered(order or index))
    if name in ("avg", "mean"):
        return F.avg(c)
    if name == "abs sum":
        return F.abs(F.sum(c))
    if name == "count":
        return F.count(c)
    if name == "distinct count":
        return F.approx_count_distinct(c) if approx else F.count_distinct(c)
    if name in ("unique", DISTINCT_LEAF):
        return F.when(F.min(c) == F.max(c), F.min(c))
    if name == "dominant":
        return F.mode(c, True)
    if name == "first by index":
        return F.min_by(c, ordered(index or order))
    if name == "last by index":
        return F.max_by(c, ordered(index or order))
    if name == "last minus first":
        o = ordered(order or index)
        return F.max_by(c, o) - F.min_by(c, o)
    if name == "last":
        return F.max_by(c, ordered(order or index))
    if name in ("high", "max"):
        return F.max(c)
    if name in ("low", "min"):
        return F.min(c)
    if name == "high minus low":
        return F.max(c) - F.min(c)
    if name == "join":
        vals = F.array_sort(F.collect_set(c))
        return F.when(F.size(vals) > 0, F.array_join(F.transform(vals, lambda x: x.cast("string")), ", "))
    if name == "median":
        return F.percentile_approx(c, 0.5, 10000) if approx else F.median(c)
    if name in ("sum", "sum not null", PCT_PARENT, PCT_TOTAL):
        return F.sum(c)
    if name == "stddev":
        return F.stddev_pop(c)
    if name == "sum abs":
        return F.sum(F.abs(c))
    if name == "var":
        return F.var_pop(c)
    raise AssertionError(name)


@dataclasses.dataclass(frozen=True)
class State:
    """An aggregate that can be folded in steps: per part its fold over rows and the fold of such parts; ``value`` reads
    the aggregate from the parts."""
    parts: tuple[tuple[Column, Callable[[Column], Column]], ...]
    value: Callable[..., Column]


def mergeable_state(name: str, column: str, kind: T.DataType, *, order: list[str] | None = None,
                    index: list[str] | None = None, approx: bool = False) -> State | None:
    """Aggregate ``name`` of ``column`` (of type ``kind``) as a :class:`State` of bounded size with the value that
    :func:`aggregate_column` gives, or ``None`` where there is none.

    The approximate distinct count and median are sketches (HyperLogLog, KLL), so they differ from
    :func:`aggregate_column` within the error of either.
    """
    c = F.col(f"`{column}`")
    present = c.isNotNull()
    decimal = isinstance(kind, T.DecimalType)

    def one(part, fold, value=lambda v: v):
        return State(((part, fold),), value)

    def row(cols):
        return F.when(present, F.struct(_ordering(cols).alias("o"), c.alias("v")))

    def at_end(cols, fold):
        return one(fold(row(cols)), fold, lambda v: v["v"])

    def total(x):
        # the sum of sums of decimals would be wider than the sum of the rows
        width = T.DecimalType(min(38, kind.precision + 10), kind.scale) if decimal else None
        return one(F.sum(x), F.sum, lambda v: v.cast(width) if width else v)

    if name in ("any", "first by index"):
        return at_end((order or index) if name == "any" else (index or order), F.min)
    if name in ("last", "last by index"):
        return at_end((order or index) if name == "last" else (index or order), F.max)
    if name == "last minus first":
        r = row(order or index)
        return State(((F.max(r), F.max), (F.min(r), F.min)), lambda last, first: last["v"] - first["v"])
    if name in ("avg", "mean") and isinstance(kind, T.NumericType) and not decimal:
        return State(((F.sum(c.cast("double")), F.sum), (F.count(c), F.sum)), F.try_divide)
    if name in ("sum", "sum not null", PCT_PARENT, PCT_TOTAL):
        return total(c)
    if name == "abs sum":
        sums = total(c)
        return State(sums.parts, lambda v: F.abs(sums.value(v)))
    if name == "sum abs":
        return total(F.abs(c))
    if name == "count":
        return one(F.count(c), F.sum)
    if name in ("high", "max"):
        return one(F.max(c), F.max)
    if name in ("low", "min"):
        return one(F.min(c), F.min)
    if name == "high minus low":
        return State(((F.max(c), F.max), (F.min(c), F.min)), lambda high, low: high - low)
    if name in ("unique", DISTINCT_LEAF):
        return State(((F.max(c), F.max), (F.min(c), F.min)), lambda high, low: F.when(low == high, low))
    if approx and name == "distinct count":
        return one(F.hll_sketch_agg(F.when(present, F.xxhash64(c))), F.hll_union_agg, F.hll_sketch_estimate)
    if approx and name == "median" and isinstance(kind, T.NumericType):
        half = F.lit(0.5)
        return State(((F.kll_sketch_agg_double(c.cast("double")), F.kll_merge_agg_double), (F.count(c), F.sum)),
                     lambda sketch, n: F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, half)))
    return None
