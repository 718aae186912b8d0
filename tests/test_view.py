import pytest
from pyspark.sql import functions as F

from gridlens import View
from gridlens.config import ConfigError
from tests.test_aggregates import ROWS, SCHEMA


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_flat_projection_filter_sort(grouped):
    v = View(grouped, {"columns": ["g1", "x"], "filter": [["x", ">", 0]], "sort": [["x", "desc"]]})
    assert [tuple(r) for r in v.to_df().collect()] == [("b", 7), ("a", 5), (None, 4), ("a", 2), ("a", 1)]


def test_filter_or_and_null(grouped):
    v = View(grouped, {"columns": ["seq"], "filter": [["x", "is null"], ["g1", "==", "b"]], "filter_op": "or"})
    assert sorted(r.seq for r in v.to_df().collect()) == [3, 5, 6, 8]


def test_hidden_sort_and_rank(grouped):
    v = View(grouped, {"columns": ["s"], "sort": [["seq", "desc"]]})
    df = v.to_df(rank=True)
    assert df.columns == ["s", "_rank"]
    assert [r.s for r in df.orderBy("_rank").collect()] == [None, None, "a", "z", "n", "m", "n", "m"]


def test_abs_sort(grouped):
    v = View(grouped, {"columns": ["y"], "filter": [["y", "is not null"]], "sort": [["y", "desc abs"]]})
    assert [r.y for r in v.to_df().collect()][:2] == [4.0, -2.5]


def test_tree_sort_orders_siblings_under_parent(grouped):
    v = View(grouped, {"group_by": ["g1", "g2"], "columns": ["x"], "sort": [["x", "desc"]]})
    rows = [(r.g1, r.g2, r._depth, r.x) for r in v.to_df(rank=True).orderBy("_rank").collect()]
    assert rows[0][2] == 0
    tops = [r for r in rows if r[2] == 1]
    assert [t[3] for t in tops] == sorted([t[3] for t in tops if t[3] is not None], reverse=True) + \
        [t[3] for t in tops if t[3] is None]
    # every child directly follows its parent block
    pos = {(r[0], r[2]): i for i, r in enumerate(rows) if r[2] == 1}
    for i, r in enumerate(rows):
        if r[2] == 2:
            assert pos[(r[0], 1)] < i


def test_leaves_only_and_depth(grouped):
    v = View(grouped, {"group_by": ["g1", "g2"], "columns": ["x"], "leaves_only": True})
    assert {r._depth for r in v.to_df().collect()} == {2}
    d1 = v.set_depth(1).to_df().collect()
    assert {r._depth for r in d1} == {1} and len(d1) == 4
    v2 = View(grouped, {"group_by": ["g1", "g2"], "columns": ["x"], "group_by_depth": 1})
    assert {r._depth for r in v2.to_df().collect()} == {0, 1}


def test_expand_collapse(grouped):
    v = View(grouped, {"group_by": ["g1", "g2"], "columns": ["x"]}).expand(("a",))
    rows = v.to_df().collect()
    assert {r.g1 for r in rows if r._depth == 2} == {"a"}
    assert v.get_row_expanded(("a",)) and not v.get_row_expanded(("b",))
    none_open = v.collapse(("a",)).to_df().collect()
    assert max(r._depth for r in none_open) == 1


def test_row_path(grouped):
    v = View(grouped, {"group_by": ["g1", "g2"], "columns": ["x"]})
    paths = {tuple(r["__ROW_PATH__"]) for r in v.to_df(path=True).collect()}
    assert () in paths and ("a",) in paths and ("a", "u") in paths and (None, "w") in paths


def test_pivot_with_pipe_values_and_missing_cells(grouped):
    v = View(grouped, {"group_by": ["g1"], "split_by": ["p"], "columns": ["x"]})
    assert v.column_paths() == ["p2|x", "p|1|x"]
    rows = {(r.g1, r._depth): (r["p2|x"], r["p|1|x"]) for r in v.to_df().collect()}
    assert rows[("b", 1)] == (None, 4)
    assert rows[(None, 0)] == (11, 5)


def test_split_only_flat(grouped):
    v = View(grouped, {"split_by": ["p"], "columns": ["seq"]})
    rows = v.to_df().collect()
    assert len(rows) == len(ROWS)
    assert sum(1 for r in rows if r["p|1|seq"] is not None) == 4


def test_column_sort_orders_pivot_columns(grouped):
    v = View(grouped, {"group_by": ["g1"], "split_by": ["p"], "columns": ["x"], "sort": [["x", "col desc"]]})
    assert v.column_paths() == ["p2|x", "p|1|x"]  # 11 > 5
    v = View(grouped, {"group_by": ["g1"], "split_by": ["p"], "columns": ["x"], "sort": [["x", "col asc"]]})
    assert v.column_paths() == ["p|1|x", "p2|x"]
    assert [tuple(r) for r in v.column_paths_df().orderBy("position").collect()] == [(0, "p|1|x"), (1, "p2|x")]


def test_split_value_cap(grouped):
    v = View(grouped, {"group_by": ["g1"], "split_by": ["seq"], "columns": ["x"]}, max_split_values=3)
    with pytest.raises(ConfigError):
        v.to_df()


def test_viewport_slice(grouped):
    v = View(grouped, {"columns": ["seq", "x", "y"], "sort": [["seq", "asc"]],
                       "viewport": {"top": 2, "height": 3, "left": 1, "width": 1}})
    df = v.to_df()
    assert df.columns == ["x"]
    assert [r.x for r in df.collect()] == [None, 5, -3]


def test_metadata(grouped):
    v = View(grouped, {"group_by": ["g1"], "columns": ["x", "y"], "sort": [["seq", "desc"]]})
    dims = v.dimensions()
    assert dims == {"num_view_rows": 5, "num_view_columns": 2, "num_table_rows": 8, "num_table_columns": 7}
    assert v.get_min_max("x") == (4, 8)  # leaf sums: a=8, b=4, null group=4, c=null
    assert v.schema()["x"] == "integer"
    assert v.dimensions_df().first().num_view_rows == 5


def test_expressions_in_group_and_filter(grouped):
    v = View(grouped, {"expressions": {"xx": '"x" * 2'}, "group_by": ["g1"], "columns": ["xx"],
                       "filter": [["xx", ">", 2]]})
    root = [r for r in v.to_df().collect() if r._depth == 0][0]
    assert root.xx == 36
    assert v.expression_schema() == {"xx": "integer"}


def test_filter_pushdown_and_pruning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = View(df, {"columns": ["l_orderkey"], "filter": [["l_quantity", ">", 30]]}).to_df() \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_slices_and_their_positions(spark):
    from gridlens.operators import sorting

    df = spark.createDataFrame([(i,) for i in range(50)], "a long")
    out = sorting.slice_rows(df, [F.col("a").desc()], 3, 10)
    assert sorted(r.a for r in out.collect()) == list(range(40, 47))
    ranked = sorting.ranked_slice(df, [F.col("a").asc()], 0, 8)
    assert sorted((r._rank, r.a) for r in ranked.collect()) == [(i + 1, i) for i in range(8)]


def test_expanded_paths_as_a_dataframe(spark, grouped):
    opened = spark.createDataFrame([(["a"],), (["b"],)], "path array<string>")
    v = View(grouped, {"group_by": ["g1", "g2"], "columns": ["x"], "expanded": opened})
    rows = v.to_df().collect()
    assert {r.g1 for r in rows if r._depth == 2} == {"a", "b"}
    assert len([r for r in rows if r._depth == 1]) == 4
    assert v.set_depth(1).to_df().count() == 5


def test_open_paths_are_typed(spark):
    import datetime
    from decimal import Decimal

    when = datetime.datetime(2024, 1, 31, 12, 0)
    rows = [(True, 1e20, Decimal("0.50"), when, "x", 1), (False, 0.5, Decimal("1.25"), None, "y", 2), (True, 1e20, Decimal("2"), when, "z", 3)]
    df = spark.createDataFrame(rows, "b boolean, f double, d decimal(10,6), t timestamp, s string, x long")
    for col, opened in (("b", True), ("f", 1e20), ("d", Decimal("0.5")), ("t", when), ("b", "true"), ("f", "1.0E20"), ("t", None)):
        v = View(df, {"group_by": [col, "s"], "columns": ["x"]}).expand((opened,))
        deep = {r.s for r in v.to_df().where("_depth = 2").collect()}
        text = {"true": True, "1.0E20": 1e20}.get(opened, opened) if isinstance(opened, str) else opened
        assert deep == {r[4] for r in rows if r["bfdt".index(col)] == text}, (col, opened)
    both = View(df, {"group_by": ["b", "f", "s"], "columns": ["x"]}).expand((True,), (True, 1e20))
    assert both.to_df().where("_depth = 3").count() == 2 and both.to_df().where("_depth = 2").count() == 1


def test_labels_never_meet(spark):
    from gridlens.operators.grouping import unique_labels

    assert unique_labels(["x", "x", "x (2)"]) == ["x", "x (3)", "x (2)"]
    assert unique_labels(["a", "a", "a", "a (3)", "a (3)"]) == ["a", "a (2)", "a (4)", "a (3)", "a (3) (2)"]
    df = spark.createDataFrame([("g", None, 1), ("g", "null", 2), ("g", "null|x (2)", 3), ("g", "b", 4)], "g string, s string, x long")
    v = View(df.withColumn("x (2)", F.col("x")), {"group_by": ["g"], "split_by": ["s"], "columns": ["x", "x (2)"]})
    names = v.column_paths()
    assert len(set(names)) == len(names) == 8
    assert [r.column_path for r in v.column_paths_df().orderBy("position").collect()] == names
    whole = v.to_df().collect()[0]
    part = View(v.table, v.cfg).to_df(start_col=2, end_col=5)
    assert part.columns == ["g", "_depth", *names[2:5]] and list(part.collect()[0]) == [whole[c] for c in part.columns]


def test_in_lists_have_one_meaning_at_any_length(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else f"v{i % 7}") for i in range(60)], "i long, s string")
    short, many = ["v0", "v1", None], ["v0", "v1", None] + [f"w{i}" for i in range(2000)]
    for op, keep in (("in", lambda s: s in ("v0", "v1")), ("not in", lambda s: s is not None and s not in ("v0", "v1"))):
        want = sorted(r.i for r in df.collect() if keep(r.s))
        for values in (short, many):
            assert sorted(r.i for r in View(df, {"filter": [["s", op, values]]}).to_df().collect()) == want
    either = {"filter": [["s", "in", many], ["i", ">", 57]], "filter_op": "or"}
    assert View(df, either).to_df().count() == sum(r.s in ("v0", "v1") or r.i > 57 for r in df.collect())


def test_exports_are_whole_or_as_the_viewport_says(spark):
    df = spark.range(2500).withColumnRenamed("id", "a")
    v = View(df, {"sort": [["a", "asc"]]})
    assert len(v.to_records()) == len(v.to_columns()["a"]) == v.to_arrow().num_rows == 2500
    assert next(v.iter_records()) == {"a": 0}
    w = View(df, {"sort": [["a", "asc"]], "viewport": {"top": 10, "height": 20}})
    assert [r["a"] for r in w.to_records()] == list(range(10, 30)) and w.to_arrow().num_rows == 20
    assert len(w.to_records(start_row=0, end_row=5)) == 5
    assert w.num_rows() == w.dimensions()["num_view_rows"] == 2500 and w.get_min_max("a") == (0, 2499)


def test_metadata_of_a_collapsed_view(grouped):
    v = View(grouped, {"group_by": ["g1"], "columns": ["x", "y"], "expanded": [], "viewport": {"width": 1}})
    assert set(v.schema()) >= {"x", "y"}
    whole = View(grouped, {"group_by": ["g1"], "columns": ["x", "y"]})
    assert v.get_min_max("x") == whole.get_min_max("x")


def test_open_ended_slices(spark):
    df = spark.range(100).withColumnRenamed("id", "a")
    out = View(df, {"sort": [["a", "desc"]]}).to_df(start_row=95)
    assert [r.a for r in out.collect()] == [4, 3, 2, 1, 0]
    assert "CollectLimit" not in out._jdf.queryExecution().executedPlan().toString()


def test_split_names_are_unique(spark):
    rows = [("g", None, "x", 1), ("g", "null", "x", 2), ("g", "a|b", "c", 4), ("g", "a", "b|c", 8)]
    df = spark.createDataFrame(rows, "g string, s string, t string, v long")
    one = View(df, {"group_by": ["g"], "split_by": ["s"], "columns": ["v"]})
    assert len(set(one.column_paths())) == 4
    root = [r for r in one.to_df().collect() if r._depth == 0][0]
    assert [root[c] for c, v in zip(one.column_paths(), one.split_values())] == \
        [{None: 1, "null": 2, "a|b": 4, "a": 8}[v[0]] for v in one.split_values()]
    two = View(df, {"group_by": ["g"], "split_by": ["s", "t"], "columns": ["v"]})
    assert len(set(two.to_df().columns)) == len(two.to_df().columns) == 6
    paths = sorted((r.position, r.column_path) for r in two.column_paths_df().collect())
    assert [p for _, p in paths] == two.column_paths()
    flat = View(df, {"split_by": ["s"], "columns": ["v"]})
    assert flat.to_df().columns == flat.column_paths()


def test_long_form_of_a_split(spark):
    df = spark.createDataFrame([(i % 3, i % 50, i) for i in range(600)], "g long, s long, v long")
    out = View(df, {"group_by": ["g"], "split_by": ["s"], "columns": ["v"]}).long_df()
    assert out.columns == ["g", "_depth", "s", "v"] and out.count() == 50 + 150
    wide = View(df, {"group_by": ["g"], "split_by": ["s"], "columns": ["v"], "sort": [["v", "desc"]]}).to_df().collect()
    got = {(r.g, r._depth, r.s): r.v for r in out.collect()}
    assert all(r[f"{s}|v"] == got[r.g, r._depth, s] for r in wide for s in range(50))
    assert [r.g for r in wide] == [None, 2, 1, 0]
    same = View(df, {"group_by": ["g", "s"], "split_by": ["s"], "columns": ["v"]})
    assert same.to_df().count() == 1 + 3 + 150


def test_time_literals_do_not_depend_on_the_host(spark, monkeypatch):
    import datetime as dt
    import time

    df = spark.sql("select timestamp_ntz'1998-01-01 02:00:00' as t union all select timestamp_ntz'1997-12-31 23:00:00'")
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        for value in ("1998-01-01", dt.datetime(1998, 1, 1), "1998-01-01T00:00:00Z"):
            assert View(df, {"filter": [["t", ">=", value]]}).to_df().count() == 1
    finally:
        monkeypatch.undo()
        time.tzset()


def test_group_column_also_shown(grouped):
    v = View(grouped, {"group_by": ["g1"], "columns": ["g1", "x"]})
    df = v.to_df()
    assert df.columns == ["g1", "_depth", "g1 (count)", "x"]
    root = [r for r in df.collect() if r["_depth"] == 0][0]
    assert root["g1 (count)"] == 7 and v.column_paths() == ["g1 (count)", "x"]


def test_split_by_depth(grouped):
    v = View(grouped, {"group_by": ["g1"], "split_by": ["p", "g2"], "columns": ["x"], "split_by_depth": 1})
    assert v.column_paths() == ["p2|x", "p|1|x"]
    full = View(grouped, {"group_by": ["g1"], "split_by": ["p", "g2"], "columns": ["x"]})
    assert all(path.count("|") >= 2 for path in full.column_paths())


def test_slices_of_columns_are_as_wide_for_any_number_of_split_values(spark):
    rows = [(g, s, float(i), f"t{i}") for i, (g, s) in enumerate((g, s) for g in ("a", "b", None) for s in [*range(23), None]
                                                                   if (g, s) != ("b", 7))]
    table = spark.createDataFrame(rows + [("a", 3, 100.0, "t100")], "g string, s int, x double, t string")
    cfg = {"group_by": ["g"], "split_by": ["s"], "columns": ["x", "t"], "aggregates": {"t": "join"}}
    v = View(table, cfg)
    slices = v.slices(5)
    assert slices.columns == View(table.where("s < 2"), cfg).slices(5).columns and dict(slices.dtypes)["_cell0_1"] == "string"
    names = {r["position"]: r["column_path"] for r in v.column_paths_df().collect()}
    got = {}
    for r in slices.collect():
        for n in range(5):
            for i in range(2):
                if r[f"_cell{n}_{i}"] is not None:
                    got[r["g"], r["_depth"], names[(r["_slice"] * 5 + n) * 2 + i]] = r[f"_cell{n}_{i}"]
    wide = {(r["g"], r["_depth"], c): r[c] for r in View(table, cfg).to_df().collect() for c in names.values() if r[c] is not None}
    assert got == wide and len(wide) == 2 * (24 * 4 - 1)
    with pytest.raises(ConfigError):
        View(table, {"group_by": ["g"], "split_by": ["s"], "columns": ["x"], "aggregates": {"x": "pct sum parent"}}).slices()
