"""A view: one declarative configuration compiled to one DataFrame plan.

filter -> computed columns -> group (rollup) / split (pivot) -> aggregate ->
sort -> slice.  Nothing is collected on the data path; the only driver-side
values are the distinct split values, which name the pivot's columns.
"""

from __future__ import annotations

import copy
import datetime
import functools
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.config import (
    ConfigError, ViewConfig, default_aggregate, normalize_config, validate,
)
from gridlens.functions.aggregates import (
    DISTINCT_LEAF, PCT_PARENT, PCT_TOTAL, aggregate_column, mergeable_state,
)
from gridlens.functions.expressions import add_expressions
from gridlens.operators.filters import build_predicate
from gridlens.operators.holistic import HOLISTIC, attach
from gridlens.operators.grouping import (
    DEPTH, ROW_PATH, column_path, filter_expanded, grouped_aggregate, leaf_first, numbered_labels, path_key, q,
    row_path, split_columns, split_levels, unique_labels,
)
from gridlens.operators.sorting import (
    column_sorts, global_rank, orderable, ranked_slice, row_sorts, slice_rows, sort_column, viewport_bounds,
)
from gridlens.session import cut_lineage
from gridlens.types import table_schema

SPLIT_KEY = "_split_key"  # canonical text of a row's split values
SLICE = "_slice"  # number of a slice of data columns


def _of_type(v, kind: T.DataType):
    """A Python value as the kind of a column takes it."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(v))
    if isinstance(kind, T.TimestampType) and type(v) is datetime.date:
        return datetime.datetime(v.year, v.month, v.day)
    if isinstance(kind, T.DateType) and isinstance(v, datetime.datetime):
        return v.date()
    return int(v) if isinstance(kind, T.IntegralType) else v


def _copy_config(cfg: ViewConfig) -> ViewConfig:
    """Deep copy, keeping a DataFrame of open paths by reference."""
    exp = cfg.expanded
    cfg.expanded = None
    try:
        out = copy.deepcopy(cfg)
    finally:
        cfg.expanded = exp
    out.expanded = exp if isinstance(exp, DataFrame) else copy.deepcopy(exp)
    return out


def _picked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``; thousands of them aren't spelled out where leaving the others out does the same."""
    if df.columns == names:
        return df
    wanted = set(names)
    if len(wanted) == len(names) and [c for c in df.columns if c in wanted] == names:
        return df.drop(*[c for c in df.columns if c not in wanted])
    return df.select(*[q(c) for c in names])


class View:
    """``View(table, config, index=[key], order=[seq])``.

    ``index`` is the table's key (used by first/last by index), ``order`` its
    arrival sequence (used by any/last/last minus first); both are column
    names of ``table``.
    """

    def __init__(self, table: DataFrame, config: dict | ViewConfig | None = None, *,
                 index=None, order=None, max_split_values: int | None = None,
                 approx: bool = False):
        self.table = table
        self.cfg = _copy_config(normalize_config(config))
        self.index = [index] if isinstance(index, str) else list(index or [])
        order = order if order is not None else self.cfg.order_by
        self.order = [order] if isinstance(order, str) else list(order or [])
        self.max_split_values = max_split_values
        self.approx = approx
        self._prepare()

    # ------------------------------------------------------------------ setup
    def _prepare(self) -> None:
        cfg = self.cfg
        df = add_expressions(self.table, cfg.expressions)
        schema = table_schema(df)
        validate(cfg, schema)
        pred = build_predicate(cfg.filter, cfg.filter_op, schema)
        self.base = df if pred is None else df.where(pred)
        self.input_schema = schema
        names = list(self.table.columns) + [a for a in cfg.expressions if a not in self.table.columns]
        self.columns = list(cfg.columns) if cfg.columns is not None else names
        gb = list(cfg.group_by)
        if cfg.group_by_depth is not None:
            gb = gb[: max(0, int(cfg.group_by_depth))]
        sb = list(cfg.split_by)
        if cfg.split_by_depth is not None:
            sb = sb[: max(0, int(cfg.split_by_depth))]
        self.group_by, self.split_by = gb, sb
        self.sorts = row_sorts(cfg.sort)
        self.col_sorts = column_sorts(cfg.sort)
        self.hidden = [c for c, _ in self.sorts if c not in self.columns]
        self.ord_cols = self.order + [c for c in self.index if c not in self.order]
        self.context = 2 if sb else (1 if gb else 0)

    def aggregate_name(self, col: str) -> str:
        agg = self.cfg.aggregates.get(col)
        if isinstance(agg, (list, tuple)):
            agg = agg[0]
        return agg or default_aggregate(self.input_schema[col])

    def _agg(self, col: str, cond: Column | None = None) -> Column:
        return aggregate_column(self.aggregate_name(col), col, order=self.ord_cols or None,
                                index=self.index or self.ord_cols or None, cond=cond,
                                approx=self.approx)

    def _out_name(self, col: str) -> str:
        return f"{col} ({self.aggregate_name(col)})" if col in self.group_by else col

    # --------------------------------------------------------------- pivots
    def _split_table(self) -> DataFrame:
        """One row per distinct split tuple: its values, its key, and the ``col …`` sort values."""
        aggs = [self._agg(c).alias(f"_cs{i}") for i, (c, _) in enumerate(self.col_sorts)]
        g = self.base.groupBy(*[q(c) for c in self.split_by])
        sv = g.agg(*aggs) if aggs else g.agg(F.count(F.lit(1)).alias("_n"))
        return sv.withColumn(SPLIT_KEY, path_key(self.split_by, len(self.split_by)))

    def _split_order(self) -> list[Column]:
        order = [sort_column(F.col(f"_cs{i}"), d) for i, (_, d) in enumerate(self.col_sorts)]
        return [o for o in order if o is not None] + [q(c).asc_nulls_first() for c in self.split_by]

    def split_values(self) -> list[tuple]:
        """Distinct split tuples, ordered by value or by a ``col …`` sort.

        Each tuple is a column of the result; a caller who wants to refuse
        wide results sets ``max_split_values``, and :meth:`long_df` needs no
        columns at all.
        """
        if not hasattr(self, "_split_values"):
            rows = self._split_table().orderBy(*self._split_order())
            most = self.max_split_values
            rows = (rows if most is None else rows.limit(most + 1)).collect()
            if most is not None and len(rows) > most:
                raise ConfigError(f"split_by {self.split_by} has more than {most} distinct values")
            self._split_values = [tuple(r[i] for i in range(len(self.split_by))) for r in rows]
            self._split_keys = [r[SPLIT_KEY] for r in rows]
        return self._split_values

    def _split_labels(self) -> list[list[str]]:
        """Per split tuple, the output names of the value columns; all names differ."""
        names = unique_labels([column_path(v, c) for v in self.split_values() for c in self.columns])
        k = len(self.columns)
        return [names[i * k:(i + 1) * k] for i in range(len(self.split_values()))]

    def column_paths(self) -> list[str]:
        """M3: the view's data columns in order (pivot paths when split)."""
        if self.context == 2:
            return [name for names in self._split_labels() for name in names]
        return [self._out_name(c) for c in self.columns]

    def column_paths_df(self) -> DataFrame:
        """M3 as a DataFrame ``(position, column_path)``, computed by Spark.

        Split values come from a distributed ``distinct``, their order from
        the distributed global rank; a name that occurs again (null beside the
        text "null", say) is numbered.
        """
        if self.context != 2:
            return self.table.sparkSession.createDataFrame(
                [(i, c) for i, c in enumerate(self.column_paths())], "position int, column_path string")
        return self._labels_df().select("position", "column_path")

    def _labels_df(self) -> DataFrame:
        """(position, column_path, split key, place among the value columns) of every data column of a split view, ranked
        and numbered once."""
        if not hasattr(self, "_labels"):
            self._labels = cut_lineage(self._ranked_labels())
        return self._labels

    def _ranked_labels(self) -> DataFrame:
        cols = self.columns
        ranked = global_rank(self._split_table(), self._split_order(), "_v")
        names = F.array(*[F.lit(c) for c in cols])
        exploded = ranked.select("_v", SPLIT_KEY, *[q(c) for c in self.split_by], F.posexplode(names).alias("_ci", "_col"))
        text = [F.coalesce(q(c).cast("string"), F.lit("null")) for c in self.split_by]
        named = exploded.select(((F.col("_v") - 1) * F.lit(len(cols)) + F.col("_ci")).cast("int").alias("position"),
                                F.concat_ws("|", *text, F.col("_col")).alias("column_path"), SPLIT_KEY, "_ci")
        return numbered_labels(named, "column_path", F.col("position"))

    def _window_labels(self, start: int, end: int | None) -> list[tuple[str, int, str]]:
        """(split key, place of the value column, output name) of the data columns [start, end) of a split view; a bounded
        window brings only its own names to the driver."""
        if end is None or hasattr(self, "_split_values"):
            k = len(self.columns)
            names = [nm for names in self._split_labels() for nm in names]
            return [(self._split_keys[i // k], i % k, names[i]) for i in range(len(names))[start:end]]
        rows = self._labels_df().where((F.col("position") >= start) & (F.col("position") < end)).collect()
        return [(r[SPLIT_KEY], r["_ci"], r["column_path"]) for r in sorted(rows, key=lambda r: r["position"])]

    def dimensions_df(self) -> DataFrame:
        """M4 as a one-row DataFrame; both counts run on the executors."""
        view_rows = self._whole().to_df().agg(F.count(F.lit(1)).alias("n"))
        return self.table.agg(F.count(F.lit(1)).alias("num_table_rows")).select(
            view_rows.scalar().alias("num_view_rows"),
            F.lit(self.num_columns()).cast("int").alias("num_view_columns"),
            F.col("num_table_rows"),
            F.lit(len(self.table.columns)).cast("int").alias("num_table_columns"))

    # ----------------------------------------------------------------- build
    def _sort_name(self, col: str) -> str:
        if col in self.columns and self.context == 1:
            return self._out_name(col)
        return f"_sort_{col}"

    def _flat(self, window: list[tuple[str, int, str]] | None = None) -> DataFrame:
        """The rows; of a split view, each with its cells in the columns of ``window`` that are its own."""
        base = self.base
        if window is None:
            cols = [q(c).alias(self._out_name(c)) for c in self.columns]
        else:
            split = split_columns(self.split_by)
            plain = {f.name: f.dataType for f in base.schema.fields}
            # a negative zero is the zero that the split values have
            base = base.withColumns({k: F.when(q(c) == 0, F.lit(0).cast(plain[c])).otherwise(q(c))
                                     if isinstance(plain[c], (T.DoubleType, T.FloatType)) else q(c)
                                     for k, c in zip(split, self.split_by)})
            base = base.withColumn(SPLIT_KEY, path_key(split, len(split)))
            cols = [F.when(F.col(SPLIT_KEY) == F.lit(key), q(self.columns[i])).alias(name) for key, i, name in window]
        extra = dict.fromkeys(c for c, _ in self.sorts if self._flat_sort_col(c) != c)
        cols += [q(c).alias(self._flat_sort_col(c)) for c in extra]
        return base.select(*cols)

    def _flat_order(self) -> list[Column]:
        order = [sort_column(F.col(f"`{self._flat_sort_col(c)}`"), d) for c, d in self.sorts]
        return [o for o in order if o is not None]

    def _flat_sort_col(self, c: str) -> str:
        return c if (c in self.columns and self.context == 0) else f"_sort_{c}"

    def _grouped(self, window: list[tuple[str, int, str]] | None = None) -> DataFrame:
        """The rollup rows with all value (of a split view, those of ``window``) and sort columns."""
        gb, n = self.group_by, len(self.group_by)
        if window is not None:
            kinds = {name: self.aggregate_name(self.columns[i]) for _, i, name in window}
        else:
            kinds = {self._out_name(c): self.aggregate_name(c) for c in self.columns}
        percent = {PCT_TOTAL, PCT_PARENT} & set(kinds.values())
        leaves_only = self.cfg.leaves_only and not percent
        rolled = self._pivoted(leaves_only, window) if window is not None else self._rolled(leaves_only)
        # distinct leaf: only leaf rows carry a value
        for name, k in kinds.items():
            if k == DISTINCT_LEAF:
                rolled = rolled.withColumn(name, F.when(F.col(DEPTH) == n, F.col(f"`{name}`")))
        if percent:
            rolled = self._percent(cut_lineage(rolled), kinds)
        if self.cfg.leaves_only:
            rolled = rolled.where(F.col(DEPTH) == n)
        if self.cfg.expanded is not None and not self.cfg.leaves_only:
            rolled = filter_expanded(rolled, gb, self._open_paths())
        return rolled

    def _outputs(self) -> dict[str, str]:
        """Output name -> source column, value columns first, then hidden sort columns."""
        out = {self._out_name(c): c for c in self.columns} if self.context != 2 else {}
        for c, _ in self.sorts:
            out.setdefault(self._sort_name(c), c)
        return out

    def _is_holistic(self, col: str) -> bool:
        return not self.approx and self.aggregate_name(col) in HOLISTIC

    def _aggregated(self, df: DataFrame, outputs: dict[str, str], aggregate, levels: list[int], keys=()) -> DataFrame:
        """The ordinary outputs, by merging states where all have one and there are subtotals, else by
        ``aggregate(columns)``; holistic ones are joined on."""
        plain = {nm: c for nm, c in outputs.items() if not self._is_holistic(c)}
        kinds = dict(zip(df.columns, df.schema.fields))
        states = {nm: mergeable_state(self.aggregate_name(c), c, kinds[c].dataType, order=self.ord_cols or None,
                                      index=self.index or self.ord_cols or None, approx=self.approx)
                  for nm, c in plain.items()}
        if min(levels) < len(self.group_by) and None not in states.values():
            out = leaf_first(df, self.group_by, list(keys), levels, states)
        else:
            out = aggregate([self._agg(c).alias(nm) for nm, c in plain.items()])
        done = {}
        for nm, c in outputs.items():
            if self._is_holistic(c):
                name = self.aggregate_name(c)
                if c not in done:
                    done[c] = HOLISTIC[name](df, self.group_by, q(c), levels=levels, keys=keys)
                out = attach(out, self.group_by, keys, done[c], {"_agg": nm})
                if name == "distinct count":  # a group without values
                    out = out.withColumn(nm, F.coalesce(q(nm), F.lit(0).cast("long")))
        return out

    def _levels(self, leaves_only: bool) -> list[int]:
        return [len(self.group_by)] if leaves_only else list(range(len(self.group_by) + 1))

    def _rolled(self, leaves_only: bool) -> DataFrame:
        return self._aggregated(self.base, self._outputs(), lambda aggs: grouped_aggregate(
            self.base, self.group_by, aggs, leaves_only=leaves_only), self._levels(leaves_only))

    def _long(self, leaves_only: bool) -> DataFrame:
        keys, levels = split_columns(self.split_by), self._levels(leaves_only)
        df = self.base.withColumns({k: q(c) for k, c in zip(keys, self.split_by)})
        return self._aggregated(df, {f"_v{i}": c for i, c in enumerate(self.columns)}, lambda aggs: split_levels(
            df, self.group_by, keys, levels, aggs), levels, keys)

    def long_df(self, *, leaves_only: bool = False) -> DataFrame:
        """A grouped split view in long form: group columns, ``_depth``, split columns (``c (split)`` if also grouped
        by), one column per value column.

        One pass of grouping sets (each group level with the split columns);
        no limit on the number of split values, and nothing on the driver.
        """
        names = [f"{c} (split)" if c in self.group_by else c for c in self.split_by]
        values = [F.col(f"_v{i}").alias(f"{c} (value)" if c in self.group_by + names else c)
                  for i, c in enumerate(self.columns)]
        return self._long(leaves_only).select(
            *[q(c) for c in self.group_by], F.col(DEPTH),
            *[F.col(k).alias(nm) for k, nm in zip(split_columns(self.split_by), names)], *values)

    def slices(self, width: int = 256) -> DataFrame:
        """B3 for any number of split values: a grouped split view in slices of ``width`` split tuples: group columns,
        ``_depth``, ``_slice`` and ``_cell{n}_{i}``, value column i of split tuple n of the slice; its name is that of the
        position ``(_slice * width + n) * (number of value columns) + i`` in :meth:`column_paths_df`.

        The plan is as wide as a slice, however many columns the view has, and no name reaches the driver. A row without
        any split tuple of a slice isn't there. Rows come in no order; sorts, open paths and the viewport are left to
        :meth:`to_df`, and shares of totals, which need all slices of other rows, are refused.
        """
        if self.context != 2 or not self.group_by:
            raise ConfigError("slices of columns need group_by and split_by")
        kinds = [self.aggregate_name(c) for c in self.columns]
        if {PCT_TOTAL, PCT_PARENT} & set(kinds):
            raise ConfigError("slices of columns have no shares of totals")
        gb, keys, k = self.group_by, split_columns(self.split_by), len(self.columns)
        long = self._long(self.cfg.leaves_only).withColumn(SPLIT_KEY, path_key(keys, len(keys)))
        for i, kind in enumerate(kinds):
            if kind == DISTINCT_LEAF:
                long = long.withColumn(f"_v{i}", F.when(F.col(DEPTH) == len(gb), F.col(f"_v{i}")))
        nth = F.floor(F.col("position") / k)
        places = self._labels_df().where("_ci = 0").select(SPLIT_KEY, F.floor(nth / width).cast("int").alias(SLICE),
                                                           (nth % width).cast("int").alias("_at"))
        values = [F.first(f"_v{i}", ignorenulls=True).alias(f"_v{i}") for i in range(k)]
        wide = (long.join(places, SPLIT_KEY).groupBy(*[q(c) for c in gb], DEPTH, SLICE)
                .pivot("_at", list(range(width))).agg(*values))
        return wide.toDF(*gb, DEPTH, SLICE, *[f"_cell{n}_{i}" for n in range(width) for i in range(k)])

    def _pivoted(self, leaves_only: bool, window: list[tuple[str, int, str]]) -> DataFrame:
        """Aggregate per group level and split tuple first, then turn the columns of ``window`` out of that small result:
        the cells of other columns aren't planned, and rows without a cell in the window stay."""
        gb = self.group_by
        if not window:
            return self._rolled(leaves_only)
        split_keys = list(dict.fromkeys(key for key, _, _ in window))
        wanted = sorted({i for _, i, _ in window})
        place = {key: n for n, key in enumerate(split_keys)}
        groups, keys = [q(c) for c in gb] + [F.col(DEPTH)], split_columns(self.split_by)
        marked = self._long(leaves_only).withColumn(SPLIT_KEY, path_key(keys, len(keys)))
        values = [F.first(f"_v{i}", ignorenulls=True).alias(f"_v{i}") for i in wanted]
        wide = marked.groupBy(*groups).pivot(SPLIT_KEY, split_keys).agg(*values)
        cells = [f"_c{n}_{i}" for n in range(len(split_keys)) for i in wanted]
        shown = [f"_c{place[key]}_{i}" for key, i, _ in window]
        wide = _picked(wide.toDF(*gb, DEPTH, *cells), [*gb, DEPTH, *shown]).toDF(*gb, DEPTH, *[name for _, _, name in window])
        hidden = self._outputs()
        if not hidden:
            return wide
        totals = self._rolled(leaves_only)  # sorts look at the group as a whole
        totals = totals.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(gb)})
        return attach(wide, gb, (), totals, {nm: nm for nm in hidden})

    def _percent(self, rolled: DataFrame, kinds: dict[str, str]) -> DataFrame:
        """100 * value / the grand total's (depth-0 row) or the parent's value; null where that is 0.

        ``rolled`` is written down, so the rollup runs once however often it is joined.
        """
        names = [nm for nm, k in kinds.items() if k in (PCT_TOTAL, PCT_PARENT)]
        gb, cols = self.group_by, rolled.columns
        top = rolled.where(F.col(DEPTH) == 0).select(
            *[F.col(f"`{nm}`").alias(f"_pt{i}") for i, nm in enumerate(names)])
        parents = rolled.where(F.col(DEPTH) >= 1).select(
            path_key(gb, F.col(DEPTH)).alias("_pk"), (F.col(DEPTH) + 1).alias("_pd"),
            *[F.col(f"`{nm}`").alias(f"_pp{i}") for i, nm in enumerate(names)])
        df = rolled.crossJoin(F.broadcast(top))  # one row
        if PCT_PARENT in kinds.values():
            keyed = df.withColumn("_pk", path_key(gb, F.col(DEPTH) - 1)).withColumn("_pd", F.col(DEPTH))
            df = keyed.join(parents, ["_pk", "_pd"], "left")
        out = {}
        for i, nm in enumerate(names):
            of = F.col(f"_pt{i}")
            if kinds[nm] == PCT_PARENT:
                of = F.when(F.col(DEPTH) <= 1, of).otherwise(F.col(f"_pp{i}"))
            out[nm] = F.try_divide(F.lit(100.0) * F.col(f"`{nm}`"), of)
            if kinds[nm] == PCT_PARENT:
                out[nm] = F.when(F.col(DEPTH) == 0, F.when(F.col(f"`{nm}`").isNotNull(), F.lit(100.0))).otherwise(out[nm])
        return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in cols])

    def _open_paths(self) -> DataFrame:
        """Open paths as text. A value that isn't text gets the group column's type and Spark's own text for it, so that
        it meets the paths that Spark makes; text is taken as it stands in a row's path."""
        exp, spark = self.cfg.expanded, self.table.sparkSession
        if isinstance(exp, DataFrame):
            return exp
        n = len(self.group_by)
        kinds = [self.base.schema[c].dataType for c in self.group_by]
        fields, rows = [T.StructField("len", T.IntegerType())], []
        for i, kind in enumerate(kinds):
            fields += [T.StructField(f"t{i}", T.StringType()), T.StructField(f"v{i}", kind)]
        for p in exp:
            row: list = [len(p)]
            for v, kind in zip([*p, *[None] * (n - len(p))], kinds):
                typed = v is not None and not isinstance(v, str) and not isinstance(kind, T.StringType)
                row += [None if v is None or typed else str(v), _of_type(v, kind) if typed else None]
            rows.append(tuple(row[:1 + 2 * n]))
        typed = spark.createDataFrame(rows, T.StructType(fields))
        texts = [F.coalesce(F.col(f"t{i}"), F.col(f"v{i}").cast("string")) for i in range(n)]
        return typed.select(F.slice(F.array(*texts), 1, F.col("len")).alias("path"))

    def _tree_order(self, rolled: DataFrame) -> tuple[DataFrame, list[Column]]:
        """Parents before children, siblings ordered by the sort values.

        Each level k contributes (has level k, ancestor-k sort values, g_k);
        the ancestor's sort values come from an equi-join on its path key.
        """
        gb, n = self.group_by, len(self.group_by)
        sort_names = [(self._sort_name(c), d) for c, d in self.sorts if d != "none"]
        order: list[Column] = []
        if sort_names and n > 1:
            rolled = cut_lineage(rolled)  # the rollup runs once, its rows are joined per level
        df = rolled
        for k in range(1, n + 1):
            order.append((F.col(DEPTH) >= k).asc())
            if sort_names:
                if k < n:
                    anc = rolled.where(F.col(DEPTH) == k).select(
                        path_key(gb, k).alias(f"__anc_key{k}"),
                        *[F.col(f"`{s}`").alias(f"__anc{k}_{j}") for j, (s, _) in enumerate(sort_names)])
                    df = df.withColumn(f"__anc_key{k}", F.when(F.col(DEPTH) >= k, path_key(gb, k)))
                    df = df.join(anc, f"__anc_key{k}", "left").drop(f"__anc_key{k}")
                    for j, (s, d) in enumerate(sort_names):
                        order.append(sort_column(F.col(f"__anc{k}_{j}"), d))
                else:
                    for s, d in sort_names:
                        order.append(sort_column(F.when(F.col(DEPTH) >= k, F.col(f"`{s}`")), d))
            order.append(F.when(F.col(DEPTH) >= k, q(gb[k - 1])).asc_nulls_first())
        return df, order

    def to_df(self, *, rank: bool = False, path: bool = False, start_row: int | None = None,
              end_row: int | None = None, start_col: int | None = None,
              end_col: int | None = None) -> DataFrame:
        """The view as a DataFrame.

        ``rank=True`` adds ``_rank`` (1-based position in view order, computed
        without a one-task window); ``path=True`` adds ``__ROW_PATH__``.  Row
        and column bounds default to the config's viewport.
        """
        vp = viewport_bounds(self.cfg.viewport)
        start_row = vp[0] if start_row is None else start_row
        end_row = vp[1] if end_row is None else end_row
        start_col = vp[2] if start_col is None else start_col
        end_col = vp[3] if end_col is None else end_col
        df, order, keep = self.ordered(path=path, start_col=start_col, end_col=end_col)
        sliced = bool(start_row) or end_row is not None
        if not self.group_by and (order or rank or sliced):
            # equal sort values are told apart by the other columns, so they spread over tasks; a grouped view's depth
            # and group values tell its rows apart already
            order = order + [F.col(f"`{f.name}`").asc_nulls_first() for f in df.schema.fields
                             if f.name != DEPTH and not f.name.startswith("__anc") and orderable(f.dataType)]
        if rank:
            df = ranked_slice(df, order, start_row or 0, end_row) if sliced else global_rank(df, order)
            return _picked(df, [*keep, "_rank"])
        if sliced:
            return _picked(slice_rows(df, order, start_row or 0, end_row), keep)
        return _picked(df.orderBy(*order) if order else df, keep)

    def ordered(self, *, path: bool = False, start_col: int | None = None,
                end_col: int | None = None) -> tuple[DataFrame, list[Column], list[str]]:
        """(rows with hidden sort columns, view order, names of the columns that are shown)."""
        window = self._window_labels(start_col or 0, end_col) if self.context == 2 else None
        if window is not None:
            names = [name for _, _, name in window]
        else:
            names = [self._out_name(c) for c in self.columns][start_col or 0: end_col]
        if not self.group_by:
            return self._flat(window), self._flat_order(), names
        df, order = self._tree_order(self._grouped(window))
        keep = [*self.group_by, DEPTH]
        if path:
            df = df.withColumn(ROW_PATH, row_path(self.group_by))
            keep.append(ROW_PATH)
        return df, order, keep + names

    # -------------------------------------------------------------- metadata
    def schema(self) -> dict[str, str]:
        """M2: result column types after aggregation (internal columns excluded)."""
        s = table_schema(self._whole().to_df())
        s.pop(DEPTH, None)
        return s

    def expression_schema(self) -> dict[str, str]:
        s = table_schema(self.base)
        return {a: s[a] for a in self.cfg.expressions}

    def _whole(self) -> "View":
        """This view without a viewport: metadata speaks of the view, not of the window on it."""
        return self._with(viewport=None) if self.cfg.viewport else self

    def num_rows(self) -> int:
        return self._whole().to_df().count()

    def num_columns(self) -> int:
        return len(self.column_paths())

    def dimensions(self) -> dict:
        """M4: view and table sizes (hidden sort columns are not counted)."""
        return {
            "num_view_rows": self.num_rows(), "num_view_columns": self.num_columns(),
            "num_table_rows": self.table.count(), "num_table_columns": len(self.table.columns),
        }

    def min_max(self, column: str) -> DataFrame:
        """M5: min and max of a view column over leaf rows, whatever is open or in the viewport."""
        df = self._with(viewport=None, expanded=None, sort=[]).to_df()
        if DEPTH in df.columns:
            df = df.where(F.col(DEPTH) == len(self.group_by))
        return df.agg(F.min(q(column)).alias("min"), F.max(q(column)).alias("max"))

    def get_min_max(self, column: str) -> tuple:
        r = self.min_max(column).first()
        return r["min"], r["max"]

    def indexed(self, path: str | None = None, **kw):
        """The view's rows sorted once and stored, for slices by position; see
        :class:`~gridlens.sources.sorted_index.SortedRows`."""
        from gridlens.sources.sorted_index import indexed
        return indexed(self._whole(), path, **kw)

    # ------------------------------------------------------- tree navigation
    def _with(self, **changes) -> "View":
        cfg = _copy_config(self.cfg)
        for k, v in changes.items():
            setattr(cfg, k, v)
        return View(self.table, cfg, index=self.index, order=self.order,
                    max_split_values=self.max_split_values, approx=self.approx)

    def set_depth(self, depth: int) -> "View":
        """Show group levels up to ``depth``."""
        return self._with(group_by_depth=depth)

    def expand(self, *paths) -> "View":
        """Open rows (given by their row paths); other rows stay collapsed."""
        cur = self.cfg.expanded
        if isinstance(cur, DataFrame):
            raise ConfigError("expand() on a view whose open paths are a DataFrame")
        cur = list(cur or [])
        return self._with(expanded=cur + [tuple(p) for p in paths if tuple(p) not in cur])

    def collapse(self, *paths) -> "View":
        cur = list(self.cfg.expanded or [])
        drop = {tuple(p) for p in paths}
        return self._with(expanded=[p for p in cur if tuple(p) not in drop])

    def get_row_expanded(self, p) -> bool:
        if self.cfg.expanded is None:
            return True
        return tuple(p) in {tuple(x) for x in self.cfg.expanded}

    # ---------------------------------------------------------------- export
    def to_json(self, **kw) -> DataFrame:
        """Rows as JSON strings (one column ``json``)."""
        from gridlens.sources.export import json_rows
        return json_rows(self.to_df(**kw))

    def to_csv(self, path: str, **kw) -> None:
        from gridlens.sources.export import write_csv
        write_csv(self.to_df(**kw), path)

    def to_columns(self, start_row: int | None = None, end_row: int | None = None, **kw) -> dict[str, list]:
        """``{column: [values]}`` of the view (its viewport, or the rows ``start_row`` to ``end_row`` if given)."""
        table = self.to_arrow(start_row, end_row, **kw)
        return {c: table.column(i).to_pylist() for i, c in enumerate(table.column_names)}

    def iter_records(self, start_row: int | None = None, end_row: int | None = None, **kw):
        """The rows one after another as dicts; the driver holds a partition at a time."""
        for r in self.to_df(start_row=start_row, end_row=end_row, **kw).toLocalIterator():
            yield r.asDict()

    def to_records(self, start_row: int | None = None, end_row: int | None = None, **kw) -> list[dict]:
        """:meth:`iter_records` as a list."""
        return list(self.iter_records(start_row, end_row, **kw))

    def to_arrow(self, start_row: int | None = None, end_row: int | None = None, **kw):
        """The view (or the slice asked for) as an Arrow table; for large views ``write_arrow_files``."""
        return self.to_df(start_row=start_row, end_row=end_row, **kw).toArrow()


def view(table: DataFrame, config=None, **kw) -> View:
    return View(table, config, **kw)


def query_columns(table: DataFrame, config=None, *, start_row: int | None = None, end_row: int | None = None,
                  **kw) -> dict:
    """A one-shot view returned as columns, whole unless bounds are given."""
    return View(table, config, **kw).to_columns(start_row=start_row, end_row=end_row)
