import datetime as dt
import random

import pytest
from gridlens.plans.view import View

from pyspark.sql import functions as F

from gridlens.operators.changes import change_direction, previous_value, view_delta
from gridlens.config import ConfigError
from gridlens.operators.crossfilter import (
    drill_through, global_filter, linked_filter, merge_filters, selection_filters,
)
from gridlens.operators.filters import semi_filter


def test_selection_and_drill_through():
    cfg = {"group_by": ["a", "b"], "split_by": ["c"], "filter": [["x", ">", 1], ["a", "==", "old"]]}
    assert selection_filters(cfg, ("p", None), "q|x") == [["a", "==", "p"], ["b", "is null"], ["c", "==", "q"]]
    assert drill_through(cfg, ("p",)) == {"filter": [["x", ">", 1], ["a", "==", "p"]], "filter_op": "and"}


def test_merge_rule():
    target = [["a", "==", 1], ["z", ">", 0], ["z", "<", 9]]
    assert merge_filters(target, [["a", "==", 2]], ["a"]) == [["a", "==", 2], ["z", ">", 0]]


def test_global_and_linked():
    targets = {"m": ([], ["a"]), "t1": ([["b", "==", 1]], ["a", "b"]), "t2": ([], ["b"]), "t3": ([], ["a"])}
    new = global_filter(targets, "m", [["a", "==", 5]])
    assert new == {"m": [], "t1": [["a", "==", 5], ["b", "==", 1]], "t2": [], "t3": [["a", "==", 5]]}
    linked = linked_filter(targets, "m", [["a", "==", 5]], {"t1"})
    assert linked["t3"] == [] and linked["t1"][0] == ["a", "==", 5]


def test_semi_and_anti(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k long")
    sel = spark.createDataFrame([(2,), (3,), (3,)], "k long")
    assert sorted(r.k for r in semi_filter(df, sel, "k").collect()) == [2, 3]
    assert len(semi_filter(df, sel, "k", anti=True).collect()) == 8


def test_view_delta(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n long")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "g string, n long")
    assert sorted(tuple(r) for r in view_delta(old, new).collect()) == [("b", 3), ("c", 1)]
    assert [tuple(r) for r in view_delta(old, new, removed=True).collect()] == [("b", 2)]


@pytest.mark.parametrize("bucketed", [False, True])
def test_previous_value_matches_lag_with_a_hot_key(spark, bucketed):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        key = 0 if i % 3 else rnd.randint(1, 5)  # key 0 holds two thirds of the rows
        rows.append((i, key, t0 + dt.timedelta(hours=rnd.randint(0, 24 * 20)), rnd.choice([None, 1.0, 2.0, 3.0])))
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp, v double")
    got = {r.id: (r.prev_v, r.direction) for r in
           change_direction(df, "k", ["ts", "id"], "v", bucket=F.date_trunc("DAY", "ts") if bucketed else None,
                            name="direction")
           .collect()}
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(r[1], []).append(r)
    for seq in by_key.values():
        prev = None
        for j, r in enumerate(seq):
            exp_prev = seq[j - 1][3] if j else None
            exp_dir = None if exp_prev is None or r[3] is None else (r[3] > exp_prev) - (r[3] < exp_prev)
            assert got[r[0]] == (exp_prev, exp_dir), r
    assert previous_value(df, "k", ["ts", "id"], "v", bucket=F.date_trunc("DAY", "ts")).count() == 400


def test_deselect_and_shallower_selection_clear(spark):
    from gridlens.operators.crossfilter import controlled_columns

    cfg = {"group_by": ["region", "zone"], "filter": [["kind", "==", "x"]]}
    controls = controlled_columns(cfg)
    assert controls == ["region", "zone", "kind"]
    columns = ["region", "zone", "cpu"]
    state = [["cpu", ">", 1]]
    deep = global_filter({"t": (state, columns)}, "m", [["region", "==", "EU"], ["zone", "==", "z1"]], controls)["t"]
    assert deep == [["region", "==", "EU"], ["zone", "==", "z1"], ["cpu", ">", 1]]
    up = global_filter({"t": (deep, columns)}, "m", [["region", "==", "EU"]], controls)["t"]
    assert up == [["region", "==", "EU"], ["cpu", ">", 1]]
    assert global_filter({"t": (up, columns)}, "m", [], controls)["t"] == state
    assert linked_filter({"t": (up, columns), "u": (up, columns)}, "m", [], {"t"}, controls) == {"t": state, "u": up}


def test_drill_through_keeps_or_expressions_and_typed_values(spark):
    df = spark.createDataFrame([(1, "p|q"), (2, "p|q"), (3, "r"), (4, None), (5, "null")], "a long, s string")
    cfg = {"group_by": ["b"], "split_by": ["s"], "columns": ["a"], "expressions": {"b": '"a" % 2'},
           "filter": [["a", "==", 1], ["a", "==", 2], ["s", "==", "r"]], "filter_op": "or"}
    rows = View(df, drill_through(cfg, (1,), ("p|q",))).to_df().collect()
    assert [r.a for r in rows] == [1]
    plain = {"split_by": ["s"], "columns": ["a"]}
    assert selection_filters(plain, (), (None,)) == [["s", "is null"]]
    assert selection_filters(plain, (), ("null",)) == [["s", "==", "null"]]
    with pytest.raises(ConfigError):
        drill_through(plain, (), "p|q|a")


def test_semi_filter_keeps_the_order_of_columns(spark):
    from gridlens.operators.filters import semi_filter

    df = spark.createDataFrame([(1, 2), (3, 4)], "k long, a long").select("a", "k")
    assert semi_filter(df, df.where("k = 1"), "k").columns == ["a", "k"]
