"""Streams into live tables: ``foreachBatch`` sinks, routing, deltas.

Each micro-batch is written by the executors into the table's change log
as ``log/batch=<batch_id>`` in overwrite mode: a replayed batch id rewrites
the same folder, so a restart from the checkpoint cannot double-apply it.
Errors are not swallowed; the stream fails and restarts from its checkpoint.
"""

from __future__ import annotations

import functools
import operator
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlens.session import cut_lineage
from gridlens.sources.tables import DELETE, LOG_ORDER, OP, UPSERT, LiveTable
from gridlens.types import conform


class TableRegistry:
    """Named live tables under one root folder.

    A hosted table's description is stored with it, so another session (or this
    one, later) finds it by name.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, LiveTable] = {}

    def host_table(self, name: str, schema, **kw) -> LiveTable:
        t = LiveTable(self.spark, f"{self.root}/{name}", schema, **kw)
        t.save_description()
        self.tables[name] = t
        return t

    def open_table(self, name: str) -> LiveTable:
        if name not in self.tables:
            if name not in self.get_hosted_table_names():
                raise KeyError(name)
            self.tables[name] = LiveTable.open(self.spark, f"{self.root}/{name}")
        return self.tables[name]

    def get_hosted_table_names(self) -> list[str]:
        probe = LiveTable(self.spark, self.root, {})
        stored = [n for n in probe._folders(self.root, "") if probe._exists(f"{self.root}/{n}/table/_SUCCESS")]
        return sorted({*self.tables, *stored})

    def sink(self, name: str, **kw) -> "LiveSink":
        """The ``foreachBatch`` sink that routes a stream into table ``name``."""
        return LiveSink(self.open_table(name), **kw)

    def register_views(self) -> None:
        """Expose every table's current snapshot as a temp view of its name."""
        for name in self.get_hosted_table_names():
            self.open_table(name).snapshot().createOrReplaceTempView(name)


class Listener:
    """A view callback ``fn(batch_id, delta_df)``; mode ``none`` passes no rows."""

    def __init__(self, fn: Callable, delta: Callable[[DataFrame, int], DataFrame] | None, mode: str):
        if mode not in ("none", "row"):
            raise ValueError(f'on_update mode must be "none" or "row", not {mode!r}')
        self.fn, self.delta, self.mode = fn, delta, mode


def _touched(table: LiveTable, batch: DataFrame, batch_id: int, group_cols: list[str], expressions=None) -> DataFrame:
    """The groups of a batch's rows and of the rows their keys held before (an upsert can move a key)."""
    from gridlens.functions.expressions import add_expressions

    cur = conform(batch, table.schema)
    touched = add_expressions(cur, expressions or {}).select(*group_cols)
    if table.keys:
        keys = cur.select(*table.keys).distinct()
        prev = _on_keys(table.snapshot(before=batch_id), keys, table.keys, "left_semi")
        touched = touched.unionByName(add_expressions(prev, expressions or {}).select(*group_cols))
    return touched.distinct()


def _on_keys(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """``rows`` that have (``left_semi``) or lack (``left_anti``) their key among ``keys``; a null key is a key like any other."""
    other = keys.select(*[F.col(f"`{c}`").alias(f"_key_{c}") for c in names])
    same = functools.reduce(operator.and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_key_{c}`")) for c in names])
    return rows.join(other, same, how)


def _gone(touched: DataFrame, now: DataFrame, group_cols: list[str]) -> DataFrame:
    """Touched groups that have no row any more."""
    return _on_keys(touched, now, group_cols, "left_anti")


def keyed_view_delta(table: LiveTable, view_fn: Callable[[DataFrame], DataFrame],
                     group_cols: list[str]) -> Callable[[DataFrame, int], DataFrame]:
    """Delta of a grouped view over ``table``: the groups a batch touched, recomputed.

    Touched groups are found from the batch rows *and* the rows those keys
    held before.  Only rows of touched groups are re-aggregated (semi join on
    the group columns).  The result has a column ``_op``: ``upsert``, or
    ``delete`` for a group that the batch emptied.
    """
    def delta(batch: DataFrame, batch_id: int) -> DataFrame:
        snap = table.snapshot(with_meta=True).drop("_port")  # keeps batch / _pos for arrival order
        touched = _touched(table, batch, batch_id, group_cols)
        rows = snap.join(touched, [snap[c].eqNullSafe(touched[c]) for c in group_cols], "left_semi")
        now = view_fn(rows)
        if not table.keys:
            return now.withColumn(OP, F.lit(UPSERT))  # an append table empties no group
        now = cut_lineage(now)
        gone = _gone(touched, now, group_cols).withColumn(OP, F.lit(DELETE))
        return now.withColumn(OP, F.lit(UPSERT)).unionByName(gone, allowMissingColumns=True)
    return delta


def row_delta(table: LiveTable) -> Callable[[DataFrame, int], DataFrame]:
    """X8 for a flat keyed view: the current rows of the keys a batch touched.

    Keys that are gone are absent from the result; :func:`removed_keys` has them.
    """
    if not table.keys:
        raise ValueError("row deltas need an indexed table; append tables deliver the batch itself")

    def delta(batch: DataFrame, batch_id: int) -> DataFrame:
        keys = batch.select(*table.keys).distinct()
        return _on_keys(table.snapshot(), keys, table.keys, "left_semi")
    return delta


def removed_keys(table: LiveTable) -> Callable[[DataFrame, int], DataFrame]:
    """Keys present before a batch and absent after it."""
    def delta(batch: DataFrame, batch_id: int) -> DataFrame:
        keys = batch.select(*table.keys).distinct()
        before = _on_keys(table.snapshot(before=batch_id), keys, table.keys, "left_semi").select(*table.keys)
        return _on_keys(before, table.snapshot(), table.keys, "left_anti")
    return delta


def grouped_view_delta(table: LiveTable, cfg) -> Callable[[DataFrame, int], DataFrame]:
    """X8 for a grouped (rollup) view: every row whose group a batch touched.

    A leaf group is touched when a batch row - or the row its key held before
    (an upsert can move a key) - falls in it; each ancestor of a touched group
    is touched too and is recomputed over *all* its rows (the grand total over
    the whole table), level by level.  A group that the batch emptied comes
    with ``_op`` ``delete``, its path and no values.  Split views recompute the
    whole view.
    """
    import copy as _copy

    from gridlens.functions.expressions import add_expressions
    from gridlens.plans.view import View

    order = table.seq + LOG_ORDER
    gb = list(cfg.group_by)
    if cfg.group_by_depth is not None:
        gb = gb[: max(0, int(cfg.group_by_depth))]
    levels = [len(gb)] if cfg.leaves_only else list(range(len(gb) + 1))

    def delta(batch: DataFrame, batch_id: int) -> DataFrame:
        snap = table.snapshot(with_meta=True).drop("_port")
        if cfg.split_by:
            return View(snap, cfg, index=table.index, order=order).to_df()
        touched = _touched(table, batch, batch_id, gb, cfg.expressions)
        parts = []
        for d in levels:
            prefix = gb[:d]
            rows = snap
            if prefix:
                tp = touched.select(*prefix).distinct()
                base = add_expressions(snap, cfg.expressions)
                cond = [base[f"`{c}`"].eqNullSafe(tp[f"`{c}`"]) for c in prefix]
                rows = base.join(tp, cond, "left_semi")
            sub = _copy.copy(cfg)
            sub.sort, sub.viewport, sub.expanded, sub.group_by_depth = [], None, None, None
            if d == 0:  # the grand total: a one-level rollup's depth-0 row
                sub.group_by, sub.leaves_only = gb[:1], False
                out = View(rows, sub, index=table.index, order=order).to_df().where(F.col("_depth") == 0)
            else:
                sub.group_by, sub.leaves_only = prefix, True
                out = View(rows, sub, index=table.index, order=order).to_df()
            types = dict(add_expressions(snap.limit(0), cfg.expressions).dtypes)
            for c in gb[max(d, 1) if d == 0 else d:]:
                out = out.withColumn(c, F.lit(None).cast(types[c]))
            out = out.withColumn(OP, F.lit(UPSERT))
            if prefix and table.keys:
                out = cut_lineage(out)
                gone = _gone(touched.select(*prefix).distinct(), out, prefix).withColumn("_depth", F.lit(d).cast("int"))
                out = out.unionByName(gone.withColumn(OP, F.lit(DELETE)), allowMissingColumns=True)
            parts.append(out)
        result = parts[0]
        for p in parts[1:]:
            result = result.unionByName(p)
        return result
    return delta


# Aggregates whose value for (old rows + new rows) follows from the two values.
MERGEABLE = {
    "sum": lambda o, n: F.when(o.isNull(), n).when(n.isNull(), o).otherwise(o + n),
    "sum not null": lambda o, n: F.when(o.isNull(), n).when(n.isNull(), o).otherwise(o + n),
    "count": lambda o, n: F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0)),
    "min": lambda o, n: F.least(o, n), "low": lambda o, n: F.least(o, n),
    "max": lambda o, n: F.greatest(o, n), "high": lambda o, n: F.greatest(o, n),
}


def incremental_view_delta(downstream: LiveTable, group_by: list[str],
                           aggregates: dict[str, tuple[str, str]]) -> Callable[[DataFrame, int], DataFrame]:
    """S8 for an append-only upstream and mergeable aggregates.

    ``aggregates``: ``{output column: (aggregate name, source column)}``.  Each
    batch is pre-aggregated per group (partial aggregation before the
    shuffle), then merged with the downstream rows of the touched groups *as
    of before this batch*, so a replayed batch id gives the same rows.  The
    work per batch grows with the batch and the touched groups only.
    """
    for name, _ in aggregates.values():
        if name not in MERGEABLE:
            raise ValueError(f"{name!r} is not mergeable; use keyed_view_delta (recompute)")
    from gridlens.functions.aggregates import aggregate_column

    def delta(batch: DataFrame, batch_id: int) -> DataFrame:
        part = batch.groupBy(*[F.col(f"`{g}`") for g in group_by]).agg(
            *[aggregate_column(name, src).alias(f"_n_{out}") for out, (name, src) in aggregates.items()])
        old = downstream.snapshot(before=batch_id)
        old = old.select(*[F.col(f"`{g}`").alias(f"_old_{g}") for g in group_by],
                         *[F.col(f"`{o}`").alias(f"_o_{o}") for o in aggregates])
        same = functools.reduce(operator.and_, [F.col(f"`{g}`").eqNullSafe(F.col(f"`_old_{g}`")) for g in group_by])
        merged = part.join(old, same, "left")
        return merged.select(*group_by, *[
            MERGEABLE[name](F.col(f"_o_{out}"), F.col(f"_n_{out}")).alias(out)
            for out, (name, _) in aggregates.items()])
    return delta


class LiveSink:
    """``foreachBatch`` writer of a stream into a :class:`LiveTable`."""

    def __init__(self, table: LiveTable, *, port_id: int = 0, compact_every: int | None = None,
                 skip_empty: bool = True, writer: str | None = None):
        self.table, self.port_id, self.writer = table, port_id, writer
        self.compact_every = compact_every
        self.skip_empty = skip_empty
        self.listeners: list[Listener] = []

    def on_update(self, fn: Callable, *, mode: str = "none",
                  delta: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
        self.listeners.append(Listener(fn, delta, mode))

    def on_view_update(self, config, fn: Callable, *, mode: str = "row") -> None:
        """X8 in the reference's shape: ``fn(batch_id, delta)`` after each batch,
        where the delta is the view's rows that changed - touched groups
        recomputed for a grouped view, the batch's keys for a flat keyed view.
        ``mode="none"`` only notifies."""
        cfg = self.table.view_config(config)
        if mode == "none":
            self.on_update(fn, mode="none")
            return
        if cfg.group_by:
            self.on_update(fn, mode="row", delta=grouped_view_delta(self.table, cfg))
        else:
            self.on_update(fn, mode="row", delta=row_delta(self.table))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.skip_empty and batch.isEmpty():
            return  # an empty micro-batch changes nothing and notifies nobody
        name = self.table.update(batch, batch_id, port_id=self.port_id, writer=self.writer)
        # from here on the batch is what the log holds: the source isn't parsed again
        batch = self.table.batch_rows(batch_id, name)
        # a delta is computed only when a listener wants rows, and once per
        # batch however many listeners share it (persisted while they run)
        wanted = [ls.delta for ls in self.listeners if ls.mode == "row" and ls.delta is not None]
        shared = {id(d) for d in wanted if sum(1 for x in wanted if x is d) > 1}
        deltas: dict[int, DataFrame] = {}
        try:
            for ls in self.listeners:
                if ls.mode == "none" or ls.delta is None:
                    ls.fn(batch_id, None)
                    continue
                key = id(ls.delta)
                if key not in deltas:
                    d = ls.delta(batch, batch_id)
                    deltas[key] = d.persist() if key in shared else d
                ls.fn(batch_id, deltas[key])
        finally:
            for key in shared & set(deltas):
                deltas[key].unpersist()
        maybe_compact(self.table, batch_id, self.compact_every)


def start_stream(stream: DataFrame, sink: LiveSink | Callable, *, checkpoint: str,
                 name: str | None = None, available_now: bool = False,
                 processing_time: str | None = None) -> StreamingQuery:
    """One named streaming query with its own checkpoint.

    The query's name is the sink's writer unless it has one, so that two
    streams into one table keep their batches apart.
    """
    if isinstance(sink, LiveSink) and sink.writer is None:
        sink.writer = name
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def maybe_compact(table: LiveTable, batch_id: int, every: int | None) -> None:
    """Every ``every`` batches fold the log through the *previous* batch, so
    reads stay proportional to the table, and a replay of the newest batch can
    still see the state before it; batches that the last two snapshots hold go."""
    if every and batch_id > 0 and batch_id % every == 0:
        table.compact(through=batch_id - 1)
        table.vacuum(keep=2)


def chain_into(target: LiveTable, *, compact_every: int | None = None) -> Callable:
    """A listener that applies each view delta to another keyed table: upserts, and removals of groups that are
    gone (rows whose ``_op`` is ``delete``)."""
    def fn(batch_id: int, delta: DataFrame | None) -> None:
        if delta is not None and OP in delta.columns:
            delta = cut_lineage(delta)
            target.update(delta.where(F.col(OP) != DELETE).drop(OP), batch_id)
            gone = delta.where(F.col(OP) == DELETE).select(*target.keys)
            if not gone.isEmpty():
                target.remove(gone, batch_id)
        elif delta is not None:
            target.update(delta, batch_id)
        maybe_compact(target, batch_id, compact_every)
    return fn
