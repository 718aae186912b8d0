import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridlens.sources.tables import LiveTable, latest_per_key, newest_rows, patch_by_row_id

KEYED = "k string, a long, b double, flag boolean, t timestamp, seq long"
T0 = dt.datetime(2024, 1, 1)


def as_dict(df, key="k"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_latest_overwrite_out_of_order(spark):
    log = spark.createDataFrame([("x", 2, 2.0, True, T0, 2), ("x", 1, 1.0, False, T0, 1), ("y", 5, None, None, None, 1)],
                                KEYED)
    out = as_dict(latest_per_key(log, "k", "seq"))
    assert out["x"]["a"] == 2 and out["x"]["flag"] is True
    assert out["y"]["b"] is None


def test_latest_keep_null_is_absent(spark):
    log = spark.createDataFrame([("x", 1, 1.0, True, T0, 1), ("x", None, 2.0, None, None, 2),
                                 ("x", None, None, None, None, 3)], KEYED)
    out = as_dict(latest_per_key(log, "k", "seq", nulls="keep"))
    assert (out["x"]["a"], out["x"]["b"], out["x"]["flag"], out["x"]["t"]) == (1, 2.0, True, T0)
    over = as_dict(latest_per_key(log, "k", "seq", nulls="overwrite"))
    assert over["x"]["a"] is None and over["x"]["b"] is None


def test_delete_then_reinsert(spark):
    rows = [("x", 1, 1.0, True, T0, 1, "upsert"), ("x", None, None, None, None, 2, "delete"),
            ("x", 3, None, None, None, 3, "upsert"), ("y", 1, 1.0, None, None, 1, "upsert"),
            ("y", None, None, None, None, 2, "delete")]
    log = spark.createDataFrame(rows, KEYED + ", op string")
    keep = as_dict(latest_per_key(log, "k", "seq", nulls="keep", op_col="op"))
    assert set(keep) == {"x"}
    assert keep["x"]["a"] == 3 and keep["x"]["b"] is None and keep["x"]["flag"] is None
    over = as_dict(latest_per_key(log, "k", "seq", op_col="op"))
    assert set(over) == {"x"} and over["x"]["a"] == 3


def test_newest_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "seq long")
    assert sorted(r.seq for r in newest_rows(df, "seq", 3).collect()) == [7, 8, 9]


def test_patch_by_row_id(spark):
    base = spark.createDataFrame([(1, "a", 1.0, 0), (2, "b", 2.0, 0)], "_row_id long, s string, v double, _pos int")
    patches = spark.createDataFrame([(2, None, 9.0, 1)], "_row_id long, s string, v double, _pos int")
    out = {r._row_id: (r.s, r.v) for r in patch_by_row_id(base, patches).collect()}
    assert out == {1: ("a", 1.0), 2: ("b", 9.0)}


SCHEMA = {"k": "string", "a": "integer", "b": "float"}


def test_live_table_lifecycle(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "kt"), SCHEMA, index="k", nulls="keep")
    assert t.snapshot().count() == 0
    t.update(spark.createDataFrame([("x", 1, 1.0), ("y", 2, 2.0)], "k string, a long, b double"), 0)
    t.update(spark.createDataFrame([("x", None, 5.0)], "k string, a long, b double"), 1)
    t.update(spark.createDataFrame([], "k string, a long, b double"), 2)  # empty batch
    t.update(spark.createDataFrame([("x", None, 5.0)], "k string, a long, b double"), 1)  # replay
    assert as_dict(t.snapshot()) == {"x": {"k": "x", "a": 1, "b": 5.0}, "y": {"k": "y", "a": 2, "b": 2.0}}
    t.remove(spark.createDataFrame([("y",)], "k string"), 3)
    assert set(as_dict(t.snapshot())) == {"x"}
    t.update(spark.createDataFrame([("y", 7, None)], "k string, a long, b double"), 4)
    assert as_dict(t.snapshot())["y"] == {"k": "y", "a": 7, "b": None}
    t.replace(spark.createDataFrame([("z", 1, 1.0)], "k string, a long, b double"), 5)
    assert set(as_dict(t.snapshot())) == {"z"}
    t.clear(6)
    assert t.snapshot().count() == 0
    with pytest.raises(ValueError):
        LiveTable(spark, str(tmp_path / "bad"), SCHEMA, index="k", limit=3)


def test_late_rows_do_not_overwrite(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "late"), {"k": "string", "v": "integer", "ts": "integer"},
                  index="k", seq="ts", nulls="overwrite")
    t.update(spark.createDataFrame([("x", 2, 20)], "k string, v long, ts long"), 0)
    t.update(spark.createDataFrame([("x", 1, 10)], "k string, v long, ts long"), 1)  # arrives late
    assert as_dict(t.snapshot())["x"]["v"] == 2


def test_append_capped_patch_ports(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "ap"), SCHEMA, limit=2)
    p = t.make_port()
    t.update(spark.createDataFrame([("x", 1, 1.0), ("y", 2, 2.0)], "k string, a long, b double"), 0)
    t.update(spark.createDataFrame([("z", 3, 3.0)], "k string, a long, b double"), 1, port_id=p)
    snap = t.snapshot(with_meta=True)
    assert sorted(r.k for r in snap.collect()) == ["y", "z"]
    assert {r.k: r._port for r in snap.collect()}["z"] == p
    a = LiveTable(spark, str(tmp_path / "ap2"), SCHEMA)
    a.update(spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "k string, a long, b double"), 0)
    rows = a.snapshot(with_meta=True).collect()
    target = [r._row_id for r in rows if r.a == 2][0]
    a.patch_rows(spark.createDataFrame([(target, 9.5)], "_row_id struct<b:long,p:long>, b double"), 1)
    assert sorted((r.a, r.b) for r in a.snapshot().collect()) == [(1, 1.0), (2, 9.5)]
    assert a.compact().endswith("through=0")  # patches live in patch/, the log ends at batch 0
    assert sorted((r.a, r.b) for r in a.snapshot().collect()) == [(1, 1.0), (2, 9.5)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=12),
       st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_any_batch_split_equals_one_shot(spark, tmp_path_factory, rows, cuts):
    """Property: writing the log in any batch split gives the one-shot fold."""
    seqd = [(k, v, i) for i, (k, v) in enumerate(rows)]
    t = LiveTable(spark, str(tmp_path_factory.mktemp("prop")), {"k": "string", "v": "integer", "s": "integer"},
                  index="k", seq="s", nulls="keep")
    i, b = 0, 0
    while i < len(seqd):
        n = cuts[b % len(cuts)]
        t.update(spark.createDataFrame(seqd[i:i + n], "k string, v long, s long"), b)
        i, b = i + n, b + 1
    one_shot = latest_per_key(spark.createDataFrame(seqd, "k string, v long, s long"), "k", "s", nulls="keep")
    assert as_dict(t.snapshot()) == {k: {"k": k, "v": d["v"], "s": d["s"]} for k, d in as_dict(one_shot).items()}


def test_overwrite_with_presence(spark, tmp_path):
    """Absent JSON fields keep their value; explicit nulls overwrite (T4, nulls="overwrite")."""
    from gridlens.sources.json_stream import parse_json_lines

    t = LiveTable(spark, str(tmp_path / "pres"), SCHEMA, index="k", nulls="overwrite")
    lines = spark.createDataFrame([('{"k": "x", "a": 1, "b": 1.5}',)], "value string")
    t.update(parse_json_lines(lines, t.schema, keep_raw=True), 0)
    lines = spark.createDataFrame([('{"k": "x", "b": null}',)], "value string")
    t.update(parse_json_lines(lines, t.schema, keep_raw=True), 1)
    assert as_dict(t.snapshot())["x"] == {"k": "x", "a": 1, "b": None}
    # a DataFrame batch carries exactly its own columns
    t.update(spark.createDataFrame([("x", 5)], "k string, a long"), 2)
    assert as_dict(t.snapshot())["x"] == {"k": "x", "a": 5, "b": None}
    keep = LiveTable(spark, str(tmp_path / "keep"), SCHEMA, index="k", nulls="keep")
    keep.update(spark.createDataFrame([("x", 1, 1.5)], "k string, a long, b double"), 0)
    keep.update(spark.createDataFrame([("x", None, None)], "k string, a long, b double"), 1)
    assert as_dict(keep.snapshot())["x"] == {"k": "x", "a": 1, "b": 1.5}


def test_compaction_then_more_batches(spark, tmp_path):
    for nulls in ("keep", "overwrite"):
        t = LiveTable(spark, str(tmp_path / f"c-{nulls}"), SCHEMA, index="k", nulls=nulls)
        t.update(spark.createDataFrame([("x", 1, 1.0), ("y", 2, 2.0)], "k string, a long, b double"), 0)
        t.update(spark.createDataFrame([("x", None, 5.0)], "k string, a long, b double"), 1)
        before = as_dict(t.snapshot())
        assert t.compact().endswith("through=1")
        assert as_dict(t.snapshot()) == before
        t.update(spark.createDataFrame([("y", 9, None)], "k string, a long, b double"), 2)
        t.remove(spark.createDataFrame([("x",)], "k string"), 3)
        got = as_dict(t.snapshot())
        assert set(got) == {"y"}
        assert got["y"]["a"] == 9 and got["y"]["b"] == (2.0 if nulls == "keep" else None)
        t.compact()
        assert as_dict(t.snapshot()) == got
        t.clear(4)
        t.update(spark.createDataFrame([("z", 1, 1.0)], "k string, a long, b double"), 4)
        assert set(as_dict(t.snapshot())) == {"z"}


def test_reserved_column_names(spark, tmp_path):
    with pytest.raises(ValueError):
        LiveTable(spark, str(tmp_path / "r"), {"k": "string", "batch": "integer"}, index="k")


def test_table_metadata(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "m"), {"k": "string", "a": "integer", "t": "datetime"}, index="k")
    assert t.schema_names() == {"k": "string", "a": "integer", "t": "datetime"}
    assert t.columns() == ["k", "a", "t"] and t.size() == 0
    t.update(spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "k string, a long"), 0)
    assert t.size() == 2


def rows(spark, data, cols="k string, v long, s long"):
    return spark.createDataFrame(data, cols)


def test_removal_on_a_table_with_seq(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "t"), {"k": "string", "v": "integer", "s": "integer"}, index="k", seq="s")
    t.update(rows(spark, [("x", 1, 10), ("y", 2, 10)]), 0)
    t.remove(rows(spark, [("x",)], "k string"), 1)
    assert set(as_dict(t.snapshot())) == {"y"}
    t.update(rows(spark, [("x", 9, 5)]), 2)  # older than what was removed: stays dead
    assert set(as_dict(t.snapshot())) == {"y"}
    t.update(rows(spark, [("x", 7, 20)]), 3)
    assert as_dict(t.snapshot())["x"]["v"] == 7


def test_writers_of_one_batch_id_do_not_meet(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "t"), {"k": "string", "v": "integer", "s": "integer"}, index="k")
    p = t.make_port()
    t.update(rows(spark, [("x", 1, 1), ("z", 1, 1)]), 0)
    t.update(rows(spark, [("y", 2, 1)]), 0, port_id=p)
    t.remove(rows(spark, [("z",)], "k string"), 0)
    assert {k: r["v"] for k, r in as_dict(t.snapshot()).items()} == {"x": 1, "y": 2}


def test_compaction_keeps_the_order_of_cells(spark, tmp_path):
    schema = {"k": "string", "x": "integer", "y": "integer", "s": "integer"}
    t = LiveTable(spark, str(tmp_path / "t"), schema, index="k", seq="s")
    t.update(rows(spark, [("a", 50, None, 10), ("a", None, 1, 30)], "k string, x long, y long, s long"), 0)
    t.compact()
    t.update(rows(spark, [("a", 70, None, 20)], "k string, x long, y long, s long"), 1)  # newer than x, older than y
    assert as_dict(t.snapshot())["a"] == {"k": "a", "x": 70, "y": 1, "s": 30}


def test_patches_neither_reorder_nor_invent_rows(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "t"), {"k": "string", "v": "integer"}, limit=2)
    for b, k in enumerate(["r1", "r2", "r3"]):
        t.update(rows(spark, [(k, b)], "k string, v long"), b)
    whole = LiveTable(spark, t.path, t.schema)
    ids = {r.k: r._row_id for r in whole.snapshot(with_meta=True).collect()}
    patch = [(ids["r1"], 100), (ids["r2"], 200), ((77, 77), 300)]
    t.patch_rows(spark.createDataFrame(patch, "_row_id struct<b:long,p:long>, v long"), 9)
    assert sorted((r.k, r.v) for r in t.snapshot().collect()) == [("r2", 200), ("r3", 2)]
    t.compact()
    assert sorted((r.k, r.v) for r in t.snapshot().collect()) == [("r2", 200), ("r3", 2)]


def test_state_before_a_replace(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "t"), {"k": "string", "v": "integer"}, index="k")
    t.update(rows(spark, [("x", 1)], "k string, v long"), 0)
    t.replace(rows(spark, [("y", 2)], "k string, v long"), 1)
    assert set(as_dict(t.snapshot())) == {"y"} and set(as_dict(t.snapshot(before=1))) == {"x"}


def test_late_writers_and_vacuum(spark, tmp_path):
    t = LiveTable(spark, str(tmp_path / "t"), {"k": "string", "v": "integer"}, index="k")
    for b in range(5):
        t.update(rows(spark, [(f"k{b}", b)], "k string, v long"), b)
    t.compact(through=2)
    t.update(rows(spark, [("late", 9)], "k string, v long"), 0, writer="other-")  # counts from 0 like the first
    t.compact(through=3)
    assert t.vacuum(keep=2) == 3
    assert set(as_dict(t.snapshot())) == {"k0", "k1", "k2", "k3", "k4", "late"}
    with pytest.raises(ValueError):
        t.snapshot(before=1)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["up", "up", "up", "del", "compact"]), st.sampled_from("ab"),
                          st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.integers(0, 9)),
                          st.integers(0, 5)), min_size=3, max_size=9))
def test_any_interleaving_reads_the_same_with_and_without_compaction(spark, tmp_path_factory, steps):
    schema = {"k": "string", "x": "integer", "y": "integer", "s": "integer"}
    root = tmp_path_factory.mktemp("inter")
    plain = LiveTable(spark, str(root / "plain"), schema, index="k", seq="s")
    packed = LiveTable(spark, str(root / "packed"), schema, index="k", seq="s")
    for b, (what, k, x, y, s) in enumerate(steps):
        if what == "compact":
            packed.compact()
            continue
        for t in (plain, packed):
            if what == "up":
                t.update(rows(spark, [(k, x, y, s)], "k string, x long, y long, s long"), b)
            else:
                t.remove(rows(spark, [(k,)], "k string"), b)
    assert as_dict(packed.snapshot()) == as_dict(plain.snapshot())
