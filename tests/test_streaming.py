import pytest
import json
import os

from pyspark.sql import functions as F

from gridlens.sources.json_stream import json_stream, parse_json_lines
from gridlens.sources.tables import LiveTable
from gridlens.streaming.sink import LiveSink, TableRegistry, chain_into, keyed_view_delta, start_stream

SCHEMA = {"k": "string", "v": "integer", "ts": "integer"}


def write_lines(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")


def run(spark, landing, table, ckpt, **kw):
    stream = json_stream(spark, table.schema, source="text", path=landing, options={"maxFilesPerTrigger": 1})
    sink = LiveSink(table)
    for fn, delta in kw.get("listeners", []):
        sink.on_update(fn, mode="row", delta=delta)
    q = start_stream(stream, sink, checkpoint=ckpt, name=kw.get("name"), available_now=True)
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_stream_restart_and_replay(spark, tmp_path):
    landing, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    write_lines(landing, "a.json", [{"k": "x", "v": 1, "ts": 1}, {"k": "y", "v": 2, "ts": 1}])
    write_lines(landing, "b.json", [{"k": "x", "v": 3, "ts": 2}])
    t = LiveTable(spark, str(tmp_path / "t"), SCHEMA, index="k", seq="ts", nulls="overwrite")
    q = run(spark, landing, t, ckpt)
    assert q.lastProgress is not None
    assert {r.k: r.v for r in t.snapshot().collect()} == {"x": 3, "y": 2}
    batches = sorted(os.listdir(str(tmp_path / "t" / "log")))
    assert len([b for b in batches if b.startswith("batch=")]) == 2
    # restart from the checkpoint: only the new file is read
    write_lines(landing, "c.json", [{"k": "y", "v": 9, "ts": 5}, {"k": "x", "v": 0, "ts": 0}])
    run(spark, landing, t, ckpt)
    assert {r.k: r.v for r in t.snapshot().collect()} == {"x": 3, "y": 9}
    # a replayed batch id rewrites the same folder: no change
    sink = LiveSink(t)
    replay = spark.createDataFrame([("y", 9, 5), ("x", 0, 0)], "k string, v long, ts long")
    sink(replay, 2)
    sink(replay, 2)
    assert {r.k: r.v for r in t.snapshot().collect()} == {"x": 3, "y": 9}
    assert t.log().count() == 5


def test_malformed_lines(spark):
    raw = spark.createDataFrame([('{"k": "x", "v": 1}',), ("not json",), ('{"k": "y", "v": "abc"}',),
                                 ('{"k": "z", "v": 2, "extra": 1}',), ("",)], "value string")
    out = parse_json_lines(raw, SCHEMA, corrupt_col="_corrupt_record").collect()
    assert [r.k for r in out] == ["x", None, "y", "z", None]
    assert out[2].v is None and out[3].v == 2
    assert [r._corrupt_record is not None for r in out] == [False, True, False, False, True]


def test_view_delta_listener_and_chain(spark, tmp_path):
    from gridlens import View

    landing = str(tmp_path / "in")
    write_lines(landing, "a.json", [{"k": "x", "v": 1, "ts": 1}, {"k": "y", "v": 2, "ts": 1}])
    write_lines(landing, "b.json", [{"k": "x", "v": 3, "ts": 2}])
    up = LiveTable(spark, str(tmp_path / "up"), SCHEMA)
    down = LiveTable(spark, str(tmp_path / "down"), {"k": "string", "v": "integer"}, index="k", nulls="overwrite")
    seen = []

    def view_fn(rows):
        return View(rows, {"group_by": ["k"], "columns": ["v"], "leaves_only": True}).to_df().select("k", "v")

    delta = keyed_view_delta(up, view_fn, ["k"])

    def record(batch_id, d):
        seen.append((batch_id, sorted((r.k, r.v) for r in d.collect())))

    run(spark, landing, up, str(tmp_path / "ck"), listeners=[(record, delta), (chain_into(down), delta)])
    assert seen == [(0, [("x", 1), ("y", 2)]), (1, [("x", 4)])]
    assert {r.k: r.v for r in down.snapshot().collect()} == {"x": 4, "y": 2}


def test_parallel_named_streams(spark, tmp_path):
    reg = TableRegistry(spark, str(tmp_path / "tables"))
    queries = []
    for name in ("machines", "usage"):
        landing = str(tmp_path / name)
        write_lines(landing, "a.json", [{"k": name, "v": 1, "ts": 1}])
        t = reg.host_table(name, SCHEMA, index="k")
        stream = json_stream(spark, t.schema, source="text", path=landing)
        queries.append(start_stream(stream, LiveSink(t), checkpoint=str(tmp_path / f"ck-{name}"),
                                    name=f"feed_{name}", available_now=True))
    for q in queries:
        q.awaitTermination()
    assert reg.get_hosted_table_names() == ["machines", "usage"]
    reg.register_views()
    assert spark.sql("SELECT k FROM usage").first().k == "usage"
    assert {q.name for q in queries} == {"feed_machines", "feed_usage"}


def test_update_mode_streaming_aggregate(spark, tmp_path):
    """X8 for a plain streaming aggregate: update mode emits changed groups only."""
    landing = str(tmp_path / "in")
    write_lines(landing, "a.json", [{"k": "x", "v": 1, "ts": 1}, {"k": "y", "v": 2, "ts": 1}])
    write_lines(landing, "b.json", [{"k": "x", "v": 3, "ts": 2}])
    stream = json_stream(spark, SCHEMA, source="text", path=landing, options={"maxFilesPerTrigger": 1})
    agg = stream.groupBy("k").agg(F.max_by("v", "ts").alias("v"))
    out = []
    q = (agg.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck"))
         .foreachBatch(lambda df, bid: out.append((bid, sorted(tuple(r) for r in df.collect()))))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert out == [(0, [("x", 1), ("y", 2)]), (1, [("x", 3)])]


def test_incremental_rollup_is_replay_safe(spark, tmp_path):
    from gridlens.streaming.sink import incremental_view_delta

    down = LiveTable(spark, str(tmp_path / "down"), {"k": "string", "n": "integer", "s": "integer"},
                     index="k", nulls="overwrite")
    delta = incremental_view_delta(down, ["k"], {"n": ("count", "v"), "s": ("sum", "v")})
    b0 = spark.createDataFrame([("x", 1), ("x", 2), ("y", None)], "k string, v long")
    b1 = spark.createDataFrame([("x", 5), ("z", 1)], "k string, v long")
    for bid, b in ((0, b0), (1, b1), (1, b1)):  # batch 1 is replayed
        down.update(delta(b, bid), bid)
    got = {r.k: (r.n, r.s) for r in down.snapshot().collect()}
    assert got == {"x": (3, 8), "y": (0, None), "z": (1, 1)}


def test_dashboard_feeds_end_to_end(spark, tmp_path):
    from gridlens.streaming.dashboard import Feed, dashboard_views, start_feeds

    status_schema = {"machine_id": "string", "status": "string", "last_update": "datetime"}
    jobs_schema = {"machine_id": "string", "job_id": "string", "name": "string", "units": "float",
                   "start_time": "datetime", "end_time": "datetime"}
    write_lines(str(tmp_path / "status"), "a.json", [
        {"machine_id": "m1", "status": "idle", "last_update": "2024-01-01T00:00:00"},
        {"machine_id": "m2", "status": "busy", "last_update": "2024-01-01T00:00:01"},
        {"machine_id": "m1", "status": "busy", "last_update": "2024-01-01T00:00:05"}])
    write_lines(str(tmp_path / "jobs"), "a.json", [
        {"machine_id": "m1", "job_id": "j1", "name": "a", "units": 1.5, "start_time": "2024-01-01T00:00:00"},
        {"machine_id": "m1", "job_id": "j2", "name": "b", "units": 2.0, "start_time": "2024-01-01T00:00:03"}])
    reg = TableRegistry(spark, str(tmp_path / "tables"))
    feeds = {"status": Feed(status_schema, path=str(tmp_path / "status"), index="machine_id", seq=["last_update"]),
             "jobs": Feed(jobs_schema, path=str(tmp_path / "jobs"))}
    qs = start_feeds(spark, reg, feeds, checkpoint_root=str(tmp_path / "ck"), available_now=True)
    for q in qs.values():
        q.awaitTermination()
    views = dashboard_views(reg)
    status = {(r.status, r._depth): r.machine_id for r in views["Status"].to_df().collect()}
    assert status == {(None, 0): 2, ("busy", 1): 2}
    jobs = [r for r in views["Jobs"].to_df().collect() if r._depth == 1][0]
    assert (jobs.job_id, jobs.name, jobs.units) == (2, "b", 3.5)


def test_row_delta_and_removed_keys(spark, tmp_path):
    from gridlens.streaming.sink import removed_keys, row_delta

    t = LiveTable(spark, str(tmp_path / "t"), SCHEMA, index="k", nulls="overwrite")
    t.update(spark.createDataFrame([("x", 1, 1), ("y", 2, 1)], "k string, v long, ts long"), 0)
    b1 = spark.createDataFrame([("x", 5, 2)], "k string, v long, ts long")
    t.update(b1, 1)
    assert [tuple(r) for r in row_delta(t)(b1, 1).collect()] == [("x", 5, 2)]
    gone = spark.createDataFrame([("y",)], "k string")
    t.remove(gone, 2)
    assert [r.k for r in removed_keys(t)(gone, 2).collect()] == ["y"]


def test_compaction_keeps_replays_safe(spark, tmp_path):
    from gridlens.streaming.sink import chain_into, incremental_view_delta

    down = LiveTable(spark, str(tmp_path / "down"), {"k": "string", "n": "integer"}, index="k", nulls="overwrite")
    delta = incremental_view_delta(down, ["k"], {"n": ("count", "v")})
    write = chain_into(down, compact_every=2)
    batches = [spark.createDataFrame([("x", i), ("y", i)], "k string, v long") for i in range(5)]
    for bid, b in enumerate(batches):
        write(bid, delta(b, bid))
    write(4, delta(batches[4], 4))  # the newest batch replayed after compaction through batch 3
    assert sorted(os.listdir(str(tmp_path / "down" / "snapshot")))[-1] == "through=3"
    assert {r.k: r.n for r in down.snapshot().collect()} == {"x": 5, "y": 5}


def test_touched_groups_include_the_group_a_key_left(spark, tmp_path):
    from gridlens import View

    up = LiveTable(spark, str(tmp_path / "up"), {"k": "string", "g": "string", "v": "integer"},
                   index="k", nulls="overwrite")

    def view_fn(rows):
        return View(rows, {"group_by": ["g"], "columns": ["v"], "leaves_only": True}).to_df().select("g", "v")

    delta = keyed_view_delta(up, view_fn, ["g"])
    seen = []
    sink = LiveSink(up)
    sink.on_update(lambda bid, d: seen.append(sorted(tuple(r) for r in d.collect())), mode="row", delta=delta)
    sink.on_update(lambda bid, d: seen.append(d.count()), mode="row", delta=delta)  # shares the delta
    sink(spark.createDataFrame([("x", "g1", 1), ("y", "g1", 2)], "k string, g string, v long"), 0)
    sink(spark.createDataFrame([("x", "g2", 5)], "k string, g string, v long"), 1)
    sink(spark.createDataFrame([("y", "g2", 1)], "k string, g string, v long"), 2)  # g1 is empty now
    assert seen == [[("g1", 3, "upsert")], 1, [("g1", 2, "upsert"), ("g2", 5, "upsert")], 2,
                    [("g1", None, "delete"), ("g2", 6, "upsert")], 2]


def test_registry_sink_and_empty_batches(spark, tmp_path):
    reg = TableRegistry(spark, str(tmp_path / "reg"))
    reg.host_table("status", SCHEMA, index="k")
    sink = reg.sink("status")
    calls = []
    sink.on_update(lambda bid, d: calls.append(bid))
    sink(spark.createDataFrame([], "k string, v long, ts long"), 0)
    assert calls == [] and not os.path.exists(str(tmp_path / "reg" / "status" / "log"))
    sink(spark.createDataFrame([("x", 1, 1)], "k string, v long, ts long"), 1)
    assert calls == [1] and reg.open_table("status").snapshot().count() == 1


def test_table_view_and_on_view_update(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "t"), {"k": "string", "g": "string", "v": "integer"},
                  index="k", nulls="overwrite")
    sink = LiveSink(t)
    grouped, flat = [], []
    sink.on_view_update({"group_by": ["g"], "columns": ["v"], "aggregates": {"v": "last"}},
                        lambda bid, d: grouped.append(sorted((r.g or "", r._depth, r.v) for r in d.collect())))
    sink.on_view_update({}, lambda bid, d: flat.append(sorted(tuple(r) for r in d.collect())))
    sink(spark.createDataFrame([("x", "a", 1), ("y", "b", 2)], "k string, g string, v long"), 0)
    sink(spark.createDataFrame([("y", "a", 7)], "k string, g string, v long"), 1)
    assert flat == [[("x", "a", 1), ("y", "b", 2)], [("y", "a", 7)]]
    assert grouped[0] == [("", 0, 2), ("a", 1, 1), ("b", 1, 2)]
    # batch 1 moves y from b to a: a and the root are recomputed, and b is reported as gone
    assert grouped[1] == [("", 0, 7), ("a", 1, 7), ("b", 1, None)]
    v = t.view({"group_by": ["g"]})
    assert v.columns == ["k", "g", "v"]
    assert {(r.g, r._depth): r.v for r in v.to_df().collect()} == {(None, 0): 8, ("a", 1): 8}


def test_chained_table_drops_emptied_groups_and_keeps_all_group_columns(spark, tmp_path):
    up = LiveTable(spark, str(tmp_path / "up"), {"k": "string", "g": "string", "h": "integer", "v": "integer"},
                   index="k", nulls="overwrite")
    down = LiveTable(spark, str(tmp_path / "down"), {"g": "string", "h": "integer", "v": "integer"}, index=["g", "h"],
                     nulls="overwrite")

    def view_fn(rows):
        return rows.groupBy("g", "h").agg({"v": "sum"}).toDF("g", "h", "v")

    sink = LiveSink(up)
    sink.on_update(chain_into(down), mode="row", delta=keyed_view_delta(up, view_fn, ["g", "h"]))
    schema = "k string, g string, h long, v long"
    sink(spark.createDataFrame([("x", "a", 1, 1), ("y", "a", 2, 2), ("z", None, 1, 4)], schema), 0)
    assert sorted(map(str, down.snapshot().collect())) == sorted(map(str, view_fn(up.snapshot()).collect()))
    sink(spark.createDataFrame([("x", "b", 1, 8), ("z", "b", 1, 16)], schema), 1)
    got = {(r.g, r.h): r.v for r in down.snapshot().collect()}
    assert got == {("a", 2): 2, ("b", 1): 24}


def test_hosted_tables_survive_the_session(spark, tmp_path):
    reg = TableRegistry(spark, str(tmp_path / "root"))
    t = reg.host_table("status", {"k": "string", "v": "integer", "ts": "datetime"}, index="k", seq="ts", nulls="overwrite")
    p = t.make_port()
    again = TableRegistry(spark, str(tmp_path / "root"))
    assert again.get_hosted_table_names() == ["status"]
    o = again.open_table("status")
    assert (o.keys, o.seq, o.nulls, o.schema) == (t.keys, t.seq, t.nulls, t.schema) and o.make_port() == p + 1
    with pytest.raises(KeyError):
        again.open_table("other")


def test_two_streams_into_one_table(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "t"), {"k": "string", "v": "integer"}, index="k", nulls="overwrite")
    LiveSink(t, writer="one-")(spark.createDataFrame([("x", 1)], "k string, v long"), 0)
    LiveSink(t, writer="two-")(spark.createDataFrame([("y", 2)], "k string, v long"), 0)
    assert {r.k: r.v for r in t.snapshot().collect()} == {"x": 1, "y": 2}
