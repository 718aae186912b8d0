"""End-to-end live pipelines: JSON lines -> stream -> live table.

A landing folder of JSON-line files stands in for the feed; the stream is
read with the file source and run with ``availableNow`` (tests) or a
processing-time trigger (service), each query with its own checkpoint.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import scratch_path
from gridlens.sources.export import JSON_OPTIONS
from gridlens.sources.json_stream import json_stream
from gridlens.sources.tables import LiveTable
from gridlens.streaming.sink import (
    LiveSink, chain_into, incremental_view_delta, keyed_view_delta, start_stream,
)


def land_json_lines(df: DataFrame, path: str, part: F.Column) -> str:
    """Write ``df`` as JSON-line text files, one folder per ``part`` value."""
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON_OPTIONS).alias("value"),
                      part.alias("part"))
    lines.write.mode("overwrite").partitionBy("part").text(path)
    return path


def stream_into_table(spark: SparkSession, landing: str, schema, table: LiveTable, *,
                      files_per_batch: int | None = None, name: str | None = None,
                      listeners: list[tuple[Callable, Callable | None]] | None = None,
                      checkpoint: str | None = None, compact_every: int | None = None) -> LiveTable:
    """Run the landing folder through a stream into ``table`` until caught up; ``files_per_batch`` is the caller's
    choice of how much one micro-batch takes (default: all there is)."""
    stream = json_stream(spark, schema, source="text", path=landing,
                         options={"maxFilesPerTrigger": files_per_batch} if files_per_batch else {})
    sink = LiveSink(table, compact_every=compact_every)
    for fn, delta in listeners or []:
        sink.on_update(fn, mode="row" if delta else "none", delta=delta)
    q = start_stream(stream, sink, checkpoint=checkpoint or scratch_path(spark, "stream-ckpt"),
                     name=name, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return table


def stream_batches(spark: SparkSession, events: DataFrame, run: Callable[[DataFrame, int], None], *, part: F.Column,
                   files_per_batch: int | None = None) -> None:
    """Land ``events`` as JSON lines, a folder per ``part``, and run their stream through ``run`` batch by batch."""
    root = scratch_path(spark, "batches")
    landing = land_json_lines(events, f"{root}/landing", part)
    stream = json_stream(spark, events.schema, source="text", path=landing,
                         options={"maxFilesPerTrigger": files_per_batch} if files_per_batch else {})
    q = start_stream(stream, run, checkpoint=f"{root}/ckpt", available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_keyed(spark: SparkSession, events: DataFrame, *, key: str, seq: list[str],
                 part: F.Column, files_per_batch: int | None = None) -> DataFrame:
    """A keyed running table fed by a stream; returns its snapshot."""
    root = scratch_path(spark, "live")
    landing = land_json_lines(events, f"{root}/landing", part)
    table = LiveTable(spark, f"{root}/table", events.schema, index=key, seq=seq, nulls="overwrite")
    stream_into_table(spark, landing, events.schema, table, files_per_batch=files_per_batch)
    return table.snapshot()


def stream_stateful(spark: SparkSession, events: DataFrame, *, key: str, seq: list[str],
                    files_per_batch: int | None = None) -> DataFrame:
    """The newest row of every key, kept in Spark's state store; its changes fill a table, whose snapshot is returned.

    The stream is stopped half way and started again from its checkpoint."""
    from gridlens.streaming.stateful import newest_by_key

    root = scratch_path(spark, "stateful")
    table = LiveTable(spark, f"{root}/table", events.schema, index=key, nulls="overwrite")
    half = F.xxhash64(*[F.col(f"`{c}`") for c in seq]) % 2 == 0
    for rows in (events.where(half), events.where(~half)):
        lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), JSON_OPTIONS).alias("value"))
        lines.write.mode("append").text(f"{root}/landing")
        stream = json_stream(spark, events.schema, source="text", path=f"{root}/landing",
                             options={"maxFilesPerTrigger": files_per_batch} if files_per_batch else {})
        stream = stream.select(*[F.col(f"`{c}`") for c in events.columns])
        newest = newest_by_key(stream, key, seq)
        q = (newest.writeStream.outputMode("update").foreachBatch(lambda batch, i: table.update(batch, i) and None)
             .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return table.snapshot()


def stream_chained(spark: SparkSession, events: DataFrame, *, group_by: list[str],
                   view_fn: Callable[[DataFrame], DataFrame], out_schema, part: F.Column,
                   files_per_batch: int | None = None, index=None, seq=None) -> DataFrame:
    """A table, keyed by the group columns, kept live from another table's view deltas; with ``index`` the other
    table is keyed, and groups that its updates empty go."""
    root = scratch_path(spark, "chain")
    landing = land_json_lines(events, f"{root}/landing", part)
    upstream = LiveTable(spark, f"{root}/upstream", events.schema, index=index, seq=seq, nulls="overwrite" if index else "keep")
    downstream = LiveTable(spark, f"{root}/downstream", out_schema, index=group_by, nulls="overwrite")
    delta = keyed_view_delta(upstream, view_fn, group_by)
    stream_into_table(spark, landing, events.schema, upstream, files_per_batch=files_per_batch,
                      listeners=[(chain_into(downstream, compact_every=4), delta)], compact_every=4)
    return downstream.snapshot()


def stream_rollup_table(spark: SparkSession, events: DataFrame, *, group_by: list[str],
                        aggregates: dict[str, tuple[str, str]], out_schema, part: F.Column,
                        files_per_batch: int | None = None) -> DataFrame:
    """S8, incremental: a keyed table of per-group aggregates kept live from a
    stream by merging each batch's partial aggregates (no upstream re-read)."""
    root = scratch_path(spark, "rollup")
    landing = land_json_lines(events, f"{root}/landing", part)
    upstream = LiveTable(spark, f"{root}/upstream", events.schema)
    downstream = LiveTable(spark, f"{root}/downstream", out_schema, index=group_by, nulls="overwrite")
    delta = incremental_view_delta(downstream, group_by, aggregates)
    stream_into_table(spark, landing, events.schema, upstream, files_per_batch=files_per_batch,
                      listeners=[(chain_into(downstream, compact_every=4), delta)], compact_every=4)
    return downstream.snapshot()
