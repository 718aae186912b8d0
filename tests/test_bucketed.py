import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql.types import StructType

from gridlens.session import scratch_path
from gridlens.sources.bucketed import SIGN, BucketedTable, CountedView, chain_counted

DDL = "k long, g string, v double, t long"


def ddl(text):
    return StructType.fromDDL(text)


def table(spark, **kw):
    return BucketedTable(spark, scratch_path(spark, "bt"), ddl(DDL), index="k", seq="t", **{"buckets": 5, **kw})


def rows(spark, data):
    return spark.createDataFrame(data, DDL)


def live(df):
    return sorted(map(tuple, df.collect()), key=str)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_late_rows_removals_revivals_and_null_keys(spark):
    t = table(spark)
    t.update(rows(spark, [(1, "a", 1.0, 5), (2, "a", 2.0, 5), (None, "a", 3.0, 5), (1, "b", 9.0, 4)]), 0)
    assert live(t.snapshot()) == [(1, "a", 1.0, 5), (2, "a", 2.0, 5), (None, "a", 3.0, 5)]
    changes = t.update(rows(spark, [(None, "b", 3.0, 6), (2, "c", 7.0, 3)]), 1)
    assert live(changes.select(SIGN, "k", "g")) == [(-1, None, "a"), (1, None, "b")]
    gone = t.remove(rows(spark, [(None, None, None, None), (7, None, None, None)]).select("k"), 1)
    assert live(gone.select(SIGN, "k", "g")) == [(-1, None, "b")]
    t.update(rows(spark, [(None, "late", 0.0, 5), (2, "d", 1.0, 8)]), 2)
    assert live(t.snapshot()) == [(1, "a", 1.0, 5), (2, "d", 1.0, 8)]
    t.update(rows(spark, [(None, "back", 0.0, 7)]), 3)
    assert live(t.snapshot()) == [(1, "a", 1.0, 5), (2, "d", 1.0, 8), (None, "back", 0.0, 7)]
    assert live(t.snapshot(before=1)) == [(1, "a", 1.0, 5), (2, "a", 2.0, 5), (None, "a", 3.0, 5)]
    assert live(t.lookup(rows(spark, [(None, "", 0.0, 0), (9, "", 0.0, 0)]))) == [(None, "back", 0.0, 7)]


def test_a_replayed_batch_changes_nothing(spark):
    t = table(spark)
    t.update(rows(spark, [(k, "a", 1.0, 1) for k in range(20)]), 0)
    one = [live(t.update(rows(spark, [(k, "b", 2.0, 2) for k in range(3)]), 1)), live(t.snapshot())]
    two = [live(t.update(rows(spark, [(k, "b", 2.0, 2) for k in range(3)]), 1)), live(t.snapshot())]
    assert one == two and len(one[0]) == 6


def test_reading_is_a_scan_and_a_batch_reads_its_buckets_only(spark):
    t = table(spark, buckets=16)
    for b in range(4):
        t.update(rows(spark, [(k, "a", 1.0, b) for k in range(200)]), b)
    assert "Exchange" not in scans(t.snapshot()) and t.snapshot().count() == 200
    some = rows(spark, [(3, "z", 0.0, 9)])
    held = t.state.read(only=t.state.touched(some))
    # one folder, whose rows are those of one bucket now, not of all batches
    assert len({f.rsplit("/", 1)[0] for f in held.inputFiles()}) == 1 and held.count() < 40
    assert t.state.vacuum(keep=1) > 0 and t.snapshot().count() == 200


def brute(state, group_values):
    out = {}
    for g in group_values:
        vs = [v for _, gg, v, _ in state.values() if gg == g]
        if vs:
            known = [v for v in vs if v is not None]
            n = Counter(known)
            out[g] = (median(known) if known else None, min((-c, v) for v, c in n.items())[1] if n else None, len(n), len(known),
                      round(sum(known), 6) if known else None, ", ".join(str(v) for v in sorted(n)) if n else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_counted_views_under_moves_and_removals(spark, seed):
    rng = random.Random(seed)
    source = table(spark, buckets=3)
    target = BucketedTable(spark, scratch_path(spark, "target"), ddl(
        "g string, mid double, top double, kinds long, n long, total double, all string"), index="g", buckets=3)
    view = CountedView(spark, scratch_path(spark, "counts"), ddl(DDL), ["g"], "v", {
        "mid": "median", "top": "dominant", "kinds": "distinct count", "n": "count", "total": "sum", "all": "join"}, buckets=3)
    run, state = chain_counted(source, target, view), {}
    for b in range(4):
        batch = []
        for _ in range(12):
            k = rng.choice([None, *range(8)])
            r = (k, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.5]), b * 100 + len(batch))
            batch.append(r)
            state[k] = r
        run(rows(spark, batch), b)
        got = {r[0]: (*r[1:5], None if r[5] is None else round(r[5], 6), r[6]) for r in target.snapshot().collect()}
        assert got == brute(state, ["a", "b", None])


def test_what_counts_cannot_say_is_refused(spark):
    with pytest.raises(ValueError, match="don't follow"):
        CountedView(spark, "x", ddl(DDL), ["g"], "v", {"o": "last"})
    with pytest.raises(ValueError, match="reserved"):
        BucketedTable(spark, "x", ddl("k long, bucket int"), index="k")
