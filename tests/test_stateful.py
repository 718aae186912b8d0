import datetime

import pytest
from pyspark.sql import functions as F

from gridlens.session import scratch_path
from gridlens.streaming.stateful import newest_by_key

DDL = "k long, s long, t timestamp, v string"
NOON = datetime.datetime(2024, 1, 31, 12, 0)


def run(spark, root, batches, **kw):
    """Feed batches one after another, a restart between them; the rows that each changed."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(DDL).parquet(f"{root}/in")
        if kw:
            stream = stream.withWatermark("t", "1 hour")
        seen = []
        q = (newest_by_key(stream, "k", ["s"], **kw).writeStream.outputMode("update")
             .foreachBatch(lambda b, _, seen=seen: seen.extend(tuple(r) for r in b.select("k", "s", "v").collect()) and None)
             .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
        out.append(sorted(seen, key=str))
    return out


def test_late_rows_ties_nulls_and_restarts(spark):
    got = run(spark, scratch_path(spark, "state"), [
        [(1, 5, NOON, "a"), (1, 4, NOON, "older"), (2, -7, NOON, "b"), (None, 1, None, "null key"), (3, None, NOON, "no order")],
        [(1, 4, NOON, "late"), (2, -3, NOON, "newer"), (None, 2, NOON, None), (3, 0, NOON, "ordered")],
        [(1, 5, NOON, "a"), (2, -3, NOON, "newer"), (1, 5, NOON, "z")]])
    assert got == [[(1, 5, "a"), (2, -7, "b"), (3, None, "no order"), (None, 1, "null key")],
                   [(2, -3, "newer"), (3, 0, "ordered"), (None, 2, None)], [(1, 5, "z")]]


def test_a_key_that_the_watermark_left_behind_is_forgotten(spark):
    day = datetime.timedelta(days=1)
    got = run(spark, scratch_path(spark, "ttl"), [
        [(1, 5, NOON, "a"), (2, 1, NOON, "b")], [(2, 2, NOON + 3 * day, "c")], [(2, 3, NOON + 3 * day, "d")],
        [(1, 1, NOON + 3 * day, "anew"), (2, 1, NOON + 3 * day, "late")]], event_time="t", ttl_ms=86_400_000)
    assert got == [[(1, 5, "a"), (2, 1, "b")], [(2, 2, "c")], [(2, 3, "d")], [(1, 1, "anew")]]


def test_arguments(spark):
    df = spark.createDataFrame([], "k long, x double")
    with pytest.raises(ValueError, match="sequence column"):
        newest_by_key(df, "k", "x")
    with pytest.raises(ValueError, match="go together"):
        newest_by_key(df.withColumn("t", F.current_timestamp()), "k", "k", event_time="t")
