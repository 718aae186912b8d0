"""Physical-plan shapes the design relies on at scale."""

from pyspark.sql import functions as F

from gridlens import View
from gridlens.operators.filters import semi_filter
from gridlens.operators.sorting import slice_rows
from gridlens.sources.tables import latest_per_key

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyed_fold_is_pre_aggregated_before_the_shuffle(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    p = plan(latest_per_key(events, "user_id", ["ts", "event_id"]))
    assert "partial_max" in p  # map-side fold: a hot key is folded per task
    assert p.index("partial_max") > p.index("Exchange hashpartitioning(user_id")
    keep = plan(latest_per_key(events, "user_id", ["ts", "event_id"], nulls="keep"))
    assert "partial_max" in keep


def test_rollup_is_one_expand_and_partial_aggregate(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    v = View(orders, {"group_by": ["o_orderstatus", "o_orderpriority"], "columns": ["o_totalprice", "o_custkey"],
                      "aggregates": {"o_custkey": "distinct count"}})
    p = plan(v.to_df())
    assert "Expand" in p and "partial_sum" in p


def test_selection_is_joined_as_its_size_asks(spark):
    cust = spark.read.parquet(f"{SF}/customer.parquet")
    sel = spark.read.parquet(f"{SF}/supplier.parquet").select(F.col("s_nationkey").alias("c_nationkey"))
    assert "BroadcastHashJoin" in plan(semi_filter(cust, sel, "c_nationkey"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = plan(semi_filter(cust, sel, "c_nationkey"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in big and "LeftSemi" in big and "Limit" not in big


def test_top_k_is_take_ordered(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan(slice_rows(li, [F.col("l_extendedprice").desc()], 0, 10))
    assert "TakeOrderedAndProject" in p


def test_view_filter_reaches_the_scan(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    p = plan(View(o, {"columns": ["o_orderkey"], "filter": [["o_orderdate", ">=", "1998-01-01"]]}).to_df())
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_folds_read_only_what_a_view_needs(spark, tmp_path):
    from gridlens.plans.tables import Tables, status_table
    from gridlens.sources.tables import LiveTable

    p = plan(View(status_table(Tables(spark, SF), keep=["o_orderstatus"]),
                  {"group_by": ["o_orderstatus"], "columns": ["o_custkey"]}).to_df())
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in p
    t = LiveTable(spark, str(tmp_path / "t"), {"k": "string", "a": "integer", "b": "integer"}, index="k")
    t.update(spark.createDataFrame([("x", 1, 2)], "k string, a long, b long"), 0)
    v = t.view({"columns": ["a"]})
    assert "b:" not in plan(v.to_df()).split("ReadSchema")[1] and [r.a for r in v.to_df().collect()] == [1]


def test_no_probe_runs_while_a_plan_is_built(spark):
    """Neither the keyed fold nor a selection starts a job before its result is asked for."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    events = spark.read.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events.parquet")
    before = set(tracker.getJobIdsForGroup(None))
    semi_filter(latest_per_key(events, "user_id", ["ts", "event_id"]), events.where("event_id < 10"), "user_id")
    assert set(tracker.getJobIdsForGroup(None)) == before
