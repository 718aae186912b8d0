import pytest
from pyspark.sql import functions as F

from gridlens.plans.view import View
from gridlens.sources.sorted_index import SortedRows


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"), "id")
    return SortedRows.write(df, [F.col("g").desc(), F.col("x").asc_nulls_first()], rows_per_file=90)


def expected():
    rows = [(i % 7, i if i % 5 else None, i) for i in range(1000)]
    return sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2]))


@pytest.mark.parametrize("start,end", [(0, 3), (0, None), (500, 550), (89, 91), (990, 2000), (1000, 1010), (20, 20), (999, None)])
def test_slices_are_those_of_the_sorted_rows(stored, start, end):
    got = [tuple(r) for r in stored.slice(start, end).collect()]
    assert got == [(*r, start + i + 1) for i, r in enumerate(expected()[start:end])]


def test_a_deep_slice_reads_the_files_it_overlaps(stored):
    assert stored.num_rows() == 1000 and stored.index.agg(F.max("n")).first()[0] <= 90
    assert len(stored.files(600, 640)) <= 2 and len(stored.slice(600, 640).inputFiles()) <= 2
    plan = stored.slice(600, 640)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_views_in_their_order_and_empty_ones(spark):
    df = spark.range(40).select((F.col("id") % 4).alias("g"), (F.col("id") % 3).alias("h"), "id")
    v = View(df, {"group_by": ["g", "h"], "columns": ["id"], "sort": [["id", "desc"]]})
    rows, want = v.indexed(), v.to_df(rank=True).orderBy("_rank").collect()
    assert rows.slice(3, 9).collect() == want[3:9] and rows.num_rows() == len(want) == v.num_rows()
    hidden = View(df, {"columns": ["g"], "sort": [["id", "desc"]]}).indexed().slice(0, 5)
    assert [r["g"] for r in hidden.collect()] == [i % 4 for i in range(39, 34, -1)] and hidden.columns == ["g", "_rank"]
    none = SortedRows.write(df.where("id < 0"), [F.col("id")])
    assert none.num_rows() == 0 and none.slice(0, 5).collect() == [] and none.slice(0, 5).columns == ["g", "h", "id", "_rank"]
