import random
import re

import pytest
from pyspark.sql import functions as F

from gridlens.llm import common, mixing

from . import fixtures as fx

SCHEDULES = [[(0.0, 4.0), (1.0, 6.0)], [(0.0, 2.0)], [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)]]


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, share=1.5, most=2.0):
    """Targets by weight; those above their cap stop there and the excess is shared again."""
    budget, full = share * sum(sizes.values()), set()
    while True:
        left = [s for s in sizes if s not in full]
        w = sum(weights[s] for s in left)
        rest = budget - sum(most * sizes[s] for s in full)
        out = {s: most * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        over = {s for s in left if out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def test_schedules():
    assert [mixing.weight(s) for s in SCHEDULES] == [5.0, 2.0, 1.0]
    for bad in ([], [(0.0, -1.0)], [(0.0, 0.0), (1.0, 0.0)]):
        with pytest.raises(ValueError):
            mixing.pieces(bad)


def test_invert_is_the_inverse_of_the_integral(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("done"))
    for s in [*SCHEDULES, [(0.2, 0.0), (0.8, 3.0)]]:
        for done, t in df.select("done", mixing.invert(F.col("done"), s)).collect():
            area = sum(w0 * (x := max(0.0, min(t, t0 + own_len) - t0)) + slope * x * x / 2
                       for (t0, w0, slope, _, _), own_len in zip(mixing.pieces(s), _lengths(s)))
            assert area == pytest.approx(done * mixing.weight(s), abs=1e-9)


def _lengths(s):
    starts = [p[0] for p in mixing.pieces(s)] + [1.0]
    return [b - a for a, b in zip(starts, starts[1:])]


def test_prefix_sums_with_many_cells(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 11}", i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, v long").withColumn("k", common.hash63(F.col("id")))
    got = common.prefix_sums(df, "g", "k", "v", "before", 3000, cell_rows=50).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["k"]):
        assert r["before"] == seen.get(r["g"], 0)
        seen[r["g"]] = seen.get(r["g"], 0) + r["v"]


def test_words_taken_come_to_the_targets(spark):
    rng, words = random.Random(8), fx.vocabulary()
    rows = [(i, fx.sentence(rng, words, rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(400)]
    docs = fx.docs(spark, rows)
    got = mixing.mix_words(docs, SCHEDULES).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + n_words(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)})
    source, taken = {i: s for i, _, s in rows}, dict.fromkeys(sizes, 0)
    text = {i: t for i, t, _ in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == n_words(text[r["doc_id"]]) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix_words(docs.repartition(7), SCHEDULES).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_whole_documents_in_training_order(spark):
    rng, words = random.Random(8), fx.vocabulary()
    rows = [(i, fx.sentence(rng, words, 10), "ab"[i % 2]) for i in range(300)]
    docs = fx.docs(spark, rows)
    out = mixing.mix(docs, [[(0.0, 2.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 2.0)]], share=1.0)
    got = out.select("row.source", "position", "nth").collect()
    positions = [r["position"] for r in got]
    assert positions == sorted(positions) and len(got) == 300 and out.select("row.*").columns == docs.columns
    early = [r["source"] for r in got[:100]].count("a")
    assert early > 75 and [r["source"] for r in got[-100:]].count("a") < 25


def test_odd_rows_and_empty_table(spark):
    rows = fx.odd_rows()
    got = mixing.mix_words(fx.docs(spark, rows), SCHEDULES).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), n_words(t)) for i, t, _ in rows)
    empty = fx.docs(spark, [])
    assert mixing.mix_words(empty, SCHEDULES).count() == 0 and mixing.mix(empty, SCHEDULES).count() == 0
    none = fx.docs(spark, [(1, None, "a"), (2, "", None)])
    assert [r["taken"] for r in mixing.mix_words(none, SCHEDULES).collect()] == [0, 0]
