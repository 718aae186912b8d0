"""Every named aggregate against a brute-force Python fold, at every rollup level."""

import math
import statistics

import pytest

from gridlens import View
from gridlens.config import NUMBER_AGGREGATES, TEXT_AGGREGATES

# (g1, g2, p, x, y, s, seq)
ROWS = [
    ("a", "u", "p|1", 1, 1.5, "m", 1),
    ("a", "u", "p2", 2, -2.5, "n", 2),
    ("a", "v", "p|1", None, 4.0, "m", 3),
    ("a", None, "p2", 5, None, "n", 4),
    ("b", "u", "p|1", -3, 2.0, "z", 5),
    ("b", "u", "p|1", 7, 2.0, "a", 6),
    (None, "w", "p2", 4, 0.5, None, 7),
    ("c", "x", "p2", None, None, None, 8),
]
SCHEMA = "g1 string, g2 string, p string, x long, y double, s string, seq long"


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def fold(name, vals):
    """vals: list of (value, seq) for one group, nulls included."""
    nn = [(v, o) for v, o in vals if v is not None]
    xs = [v for v, _ in nn]
    if name == "count":
        return len(xs)
    if name == "distinct count":
        return len(set(xs))
    if not xs:
        return None
    by_seq = sorted(nn, key=lambda t: t[1])
    if name in ("any", "first by index"):
        return by_seq[0][0]
    if name in ("last", "last by index"):
        return by_seq[-1][0]
    if name == "last minus first":
        return by_seq[-1][0] - by_seq[0][0]
    if name in ("sum", "sum not null", "pct sum parent", "pct sum grand total"):
        return sum(xs)
    if name == "abs sum":
        return abs(sum(xs))
    if name == "sum abs":
        return sum(abs(v) for v in xs)
    if name in ("avg", "mean"):
        return sum(xs) / len(xs)
    if name in ("high", "max"):
        return max(xs)
    if name in ("low", "min"):
        return min(xs)
    if name == "high minus low":
        return max(xs) - min(xs)
    if name == "median":
        return statistics.median(xs)
    if name == "stddev":
        return statistics.pstdev(xs)
    if name == "var":
        return statistics.pvariance(xs)
    if name in ("unique", "distinct leaf"):
        return xs[0] if len(set(xs)) == 1 else None
    if name == "dominant":
        counts = {}
        for v in xs:
            counts[v] = counts.get(v, 0) + 1
        best = max(counts.values())
        return min(v for v, c in counts.items() if c == best)
    if name == "join":
        return ", ".join(str(v) for v in sorted(set(xs)))
    raise AssertionError(name)


def expected(col, name, levels):
    idx = {"x": 3, "y": 4, "s": 5}[col]
    out = {}
    for depth in range(len(levels) + 1):
        groups = {}
        for r in ROWS:
            key = tuple(r[i] for i in range(depth))
            groups.setdefault(key, []).append((r[idx], r[6]))
        for key, vals in groups.items():
            out[(key + (None,) * (len(levels) - depth), depth)] = fold(name, vals)
    return out


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


NUMERIC = [n for n in NUMBER_AGGREGATES if not n.startswith("pct")]


@pytest.mark.parametrize("name", NUMERIC)
@pytest.mark.parametrize("col", ["x", "y"])
def test_number_aggregates(grouped, name, col):
    v = View(grouped, {"group_by": ["g1", "g2"], "columns": [col], "aggregates": {col: name}},
             index="seq", order=["seq"])
    got = {((r.g1, r.g2), r._depth): r[col] for r in v.to_df().collect()}
    exp = expected(col, name, ["g1", "g2"])
    assert set(got) == set(exp)
    for k in exp:
        assert close(got[k], exp[k]), (name, col, k, got[k], exp[k])


@pytest.mark.parametrize("name", list(TEXT_AGGREGATES))
def test_text_aggregates(grouped, name):
    v = View(grouped, {"group_by": ["g1", "g2"], "columns": ["s"], "aggregates": {"s": name}},
             index="seq", order=["seq"])
    got = {((r.g1, r.g2), r._depth): r.s for r in v.to_df().collect()}
    exp = expected("s", name, ["g1", "g2"])
    if name == "distinct leaf":
        exp = {k: (val if k[1] == 2 else None) for k, val in exp.items()}
    assert got == exp


def test_null_group_is_not_a_subtotal(grouped):
    rows = View(grouped, {"group_by": ["g1"], "columns": ["x"]}).to_df().collect()
    nulls = sorted((r._depth, r.x) for r in rows if r.g1 is None)
    assert nulls == [(0, 16), (1, 4)]


def test_pct_parent_children_sum_to_100(grouped):
    v = View(grouped, {"group_by": ["g1", "g2"], "columns": ["y"], "aggregates": {"y": "pct sum parent"}})
    rows = v.to_df().collect()
    root = [r.y for r in rows if r._depth == 0]
    assert root == [100.0]
    for g in ("a", "b"):
        kids = [r.y for r in rows if r._depth == 2 and r.g1 == g and r.y is not None]
        assert math.isclose(sum(kids), 100.0)
    top = [r.y for r in rows if r._depth == 1 and r.y is not None]
    assert math.isclose(sum(top), 100.0)


def test_pct_grand_total(grouped):
    v = View(grouped, {"group_by": ["g1"], "columns": ["y"], "aggregates": {"y": "pct sum grand total"}})
    rows = {(r.g1, r._depth): r.y for r in v.to_df().collect()}
    assert rows[(None, 0)] == 100.0
    assert math.isclose(rows[("a", 1)], 100.0 * 3.0 / 7.5)


def test_default_aggregates(grouped):
    v = View(grouped, {"group_by": ["g1"], "columns": ["x", "s"]})
    root = [r for r in v.to_df().collect() if r._depth == 0][0]
    assert root.x == 16 and root.s == 6


def test_median_under_pivot_and_leaves(grouped):
    base = grouped.toPandas()
    for leaves in (False, True):
        v = View(grouped, {"group_by": ["g1"], "split_by": ["p"], "columns": ["y"], "aggregates": {"y": "median"},
                           "leaves_only": leaves})
        got = {(r["g1"], r["_depth"]): r for r in v.to_df().collect()}
        assert len(got) == len(v.to_df().collect()) == (4 if leaves else 5)
        for (g, depth), r in got.items():
            for value, name in zip(v.split_values(), v.column_paths()):
                rows = base[base["p"].isna() if value[0] is None else base["p"] == value[0]]
                if depth:
                    rows = rows[rows["g1"].isna() if g is None else rows["g1"] == g]
                want = rows["y"].median()
                assert r[name] is None if math.isnan(want) else close(r[name], want)


def test_median_of_a_value_that_half_the_rows_hold(spark):
    df = spark.createDataFrame([(i % 2, 7.0 if i % 4 < 2 else float(i)) for i in range(1000)], "g long, x double")
    rows = View(df, {"group_by": ["g"], "columns": ["x"], "aggregates": {"x": "median"}}).to_df().collect()
    p = df.toPandas()
    assert {(r.g, r._depth): r.x for r in rows} == {
        (None, 0): p.x.median(), (0, 1): p[p.g == 0].x.median(), (1, 1): p[p.g == 1].x.median()}


def test_percent_of_a_zero_total_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", -1.0, 0.0), ("b", 2.0, 0.0)], "g string, x double, z double")
    for kind in ("pct sum grand total", "pct sum parent"):
        rows = View(df, {"group_by": ["g"], "columns": ["z"], "aggregates": {"z": kind}}).to_df().collect()
        assert all(r.z is None for r in rows if r._depth == 1)


def test_approx_mode(grouped):
    v = View(grouped, {"group_by": ["g1"], "columns": ["x", "s"], "aggregates": {"x": "median", "s": "distinct count"}},
             approx=True)
    root = [r for r in v.to_df().collect() if r._depth == 0][0]
    assert root.x in (2, 4) and root.s == 4  # percentile_approx picks an actual middle value


def expands(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Expand [")


def test_subtotals_are_merged_from_leaf_states(grouped):
    """No row of the table is expanded by level: above the Expand's input there is an aggregate by all group columns."""
    cfg = {"group_by": ["g1", "g2"], "columns": ["x", "y", "s"], "aggregates": {"x": "sum", "y": "avg", "s": "last"}}
    plan = View(grouped, cfg, index="seq", order=["seq"])._rolled(False)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Expand [" in line)
    assert any("Aggregate [" in line for line in lines[at + 1:]) and plan.count("Expand [") == 1
    one = View(grouped, {**cfg, "group_by": ["g1"]}, index="seq", order=["seq"])._rolled(False)
    assert expands(one) == 0
    # one aggregate without a state: the rollup of the rows as before
    assert expands(View(grouped, {**cfg, "aggregates": {"x": "stddev"}}, index="seq", order=["seq"])._rolled(False)) == 1


@pytest.mark.parametrize("levels", [["l_returnflag"], ["l_returnflag", "l_linestatus"]])
def test_leaf_states_are_shuffled_once(spark, levels):
    """The leaf rows and the levels above read one shuffle, so the table is scanned once."""
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    df = View(t, {"group_by": levels, "columns": ["l_quantity", "l_tax"], "aggregates": {"l_tax": "mean"}})._rolled(False)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1


def test_merged_states_keep_types_and_values_of_decimals(spark):
    from decimal import Decimal

    rows = [("a", "u", Decimal("1.10"), 2.5), ("a", "v", Decimal("-2.20"), None), (None, None, None, 1.0), ("b", "u", None, None)]
    t = spark.createDataFrame(rows, "g string, h string, d decimal(12,2), f double")
    for name in ("sum", "sum abs", "abs sum", "high", "high minus low", "mean"):
        v = View(t, {"group_by": ["g", "h"], "columns": ["d"], "aggregates": {"d": name}})
        plain = t.rollup("g", "h").agg(v._agg("d").alias("d"))
        out = v.to_df()
        assert out.schema["d"].dataType == plain.schema["d"].dataType, name
        assert sorted(map(str, (r.d for r in out.collect()))) == sorted(map(str, (r.d for r in plain.collect()))), name


def test_states_over_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "g string, h string, x long")
    for gb in (["g"], ["g", "h"]):
        assert View(empty, {"group_by": gb, "columns": ["x"]}).to_df().collect() == []
    odd = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, None)], "_g0 string, _v long, _agg long")
    v = View(odd, {"group_by": ["_g0"], "columns": ["_v", "_agg"], "aggregates": {"_v": "sum", "_agg": "distinct count"}})
    got = {(r._g0, r._depth): (r._v, r._agg) for r in v.to_df().collect()}
    assert got == {(None, 0): (4, 2), ("a", 1): (3, 2), ("b", 1): (1, 0)}


def test_distinct_count_and_join_beside_sums_on_a_split(grouped):
    """Distinct values are counted per level from one row per leaf and value, sums from states, in one view."""
    v = View(grouped, {"group_by": ["g1", "g2"], "split_by": ["p"], "columns": ["x", "y", "s"],
                       "aggregates": {"x": "sum", "y": "distinct count", "s": "join"}}, index="seq", order=["seq"])
    for r in v.long_df().collect():
        want = [w for w in ROWS if w[2] == r.p and w[:r._depth] == (r.g1, r.g2)[:r._depth]]
        xs, ys, ss = [{w[i] for w in want if w[i] is not None} for i in (3, 4, 5)]
        assert r.x == (sum(w[3] for w in want if w[3] is not None) if xs else None)
        assert (r.y, r.s) == (len(ys), ", ".join(sorted(ss)) if ss else None)


def test_approximate_states_merge_through_levels(spark):
    """Sketches of 20 000 distinct values: distinct counts within 5 %, medians within 5 % of the ranks, on both levels."""
    t = spark.range(40000).selectExpr("id % 3 as g", "id % 7 as h", "id % 20000 as x", "cast(id % 20000 as double) as y")
    v = View(t, {"group_by": ["g", "h"], "columns": ["x", "y"], "aggregates": {"x": "distinct count", "y": "median"}}, approx=True)
    rows = v.to_df().collect()
    assert len(rows) == 1 + 3 + 21
    for r in rows:
        n = {0: 20000, 1: 40000 / 3, 2: 40000 / 21}[r._depth]
        assert abs(r.x - n) < 0.05 * n and abs(r.y - 10000) < 1000


def test_median_dealt_out_by_ranges(spark, monkeypatch):
    """A session of one partition: the ranges grow with the rows, and equal values of many leaf groups are in several."""
    import random

    from pyspark.sql import functions as F

    from gridlens.operators import holistic

    monkeypatch.setattr(holistic, "RANGE_ROWS", 50)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i % 90, rng.choice([1.5, 1.5, rng.random() * 9, None])) for i in range(3000)]
    table = spark.createDataFrame(rows, "g string, h int, x double")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    ranges = []
    real = holistic.cut_lineage
    monkeypatch.setattr(holistic, "cut_lineage", lambda df: ranges.append(real(df)) or ranges[-1])
    try:
        got = {tuple(r)[:3]: r["_agg"] for r in holistic.median_by_level(table, ["g", "h"], F.col("x"), levels=[0, 1, 2]).collect()}
        each = [r["n"] for r in ranges[-1].groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = {}
    for g, h, x in rows:
        if x is not None:
            for key in ((None, None, 0), (g, None, 1), (g, h, 2)):
                want.setdefault(key, []).append(x)
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in want.items()}
    assert len(each) > 20 and max(each) < sum(each) / 5
