"""A keyed running table whose rows live in Spark's state store.

Each key's newest row is the state of a grouped operator, kept with the query's checkpoint: a restart goes on from it, and
nothing is read back from a table. A row whose sequence is not newer than the state's changes nothing, however late it
comes. Rows are folded inside every task before the shuffle, so a key that holds a third of a batch is a row per Arrow
batch there. With ``ttl`` a key that the watermark leaves so far behind is dropped from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridlens.sources.export import JSON_OPTIONS

#: Columns beside the key while rows pass through the state: their order as text, all their columns as JSON, event time.
_ORDER, _ROW, _TIME = "_order", "_row", "_time"


def _ordered_text(c: Column, kind: T.DataType) -> Column:
    """Text that sorts as the column does, null first."""
    if isinstance(kind, T.TimestampNTZType):
        c, kind = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), T.StringType()
    if isinstance(kind, T.TimestampType):
        c, kind = F.unix_micros(c), T.LongType()
    if isinstance(kind, T.DateType):
        c, kind = F.unix_date(c), T.LongType()
    if isinstance(kind, T.IntegralType):
        # 20 digits above the least long
        c = F.lpad((c.cast("decimal(20,0)") + F.expr("cast(9223372036854775808 as decimal(20,0))")).cast("string"), 20, "0")
    elif not isinstance(kind, T.StringType):
        raise ValueError(f"a sequence column is an integer, a date, a time or text, not {kind.simpleString()}")
    return F.coalesce(F.concat(F.lit("1"), c), F.lit("0"))


def newest_by_key(stream: DataFrame, key, seq, *, event_time: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The rows of a streaming ``stream`` that are the newest of their key when they come, in update mode.

    ``key`` and ``seq`` are column names; equal sequences are told apart by the row's JSON, the greater wins. ``event_time``
    (a timestamp that has a watermark on ``stream``) and ``ttl_ms`` bound the state: rows behind the watermark are dropped
    by Spark, and a key whose newest event time lies ``ttl_ms`` behind the watermark is forgotten. A null key is a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    seqs = [seq] if isinstance(seq, str) else list(seq)
    if (event_time is None) != (ttl_ms is None):
        raise ValueError("event_time and ttl_ms go together")
    schema = stream.schema
    order = F.concat_ws("\x01", *[_ordered_text(F.col(f"`{c}`"), schema[c].dataType) for c in seqs])
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), JSON_OPTIONS)
    at = [F.col(f"`{event_time}`").alias(_TIME)] if event_time else []
    plain = stream.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], order.alias(_ORDER), row.alias(_ROW), *at)
    names = [f"_k{i}" for i in range(len(keys))]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            yield b.sort_values([_ORDER, _ROW], kind="stable").drop_duplicates(names, keep="last")

    def newest(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else ("", "", 0)
        best, last = tuple(held[:2]), held[2]
        for b in frames:
            top = b.sort_values([_ORDER, _ROW], kind="stable").iloc[-1]
            best = max(best, (top[_ORDER], top[_ROW]))
            if ttl_ms is not None:
                last = max(last, int(b[_TIME].max().timestamp() * 1000))
        if best != tuple(held[:2]):
            yield pd.DataFrame({_ROW: [best[1]]})
        state.update((*best, last))
        if ttl_ms is not None:
            state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))

    if event_time is None:  # with a watermark, rows must reach the state as Spark marked them
        plain = plain.mapInPandas(fold, plain.schema)
    out = plain.groupBy(*names).applyInPandasWithState(
        newest, f"{_ROW} string", f"{_ORDER} string, {_ROW} string, last long", "update",
        GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json(_ROW, schema).alias("r")).select("r.*")


__all__ = ["newest_by_key"]
