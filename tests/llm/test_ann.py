import numpy as np
from pyspark.sql import functions as F

from gridlens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, part int, rid long"


def table(spark, x, ids=None, extra=()):
    rows = [(int(i), [float(c) for c in v], 1, 2) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def exact(x, ids, q, k):
    s = x.astype(np.float32).astype(np.float64) @ x[q].astype(np.float32).astype(np.float64)
    order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
    return [int(ids[j]) for j in order], s[order]


def test_recall_on_clusters_and_on_noise(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(2000, 16))
    centres = rng.normal(size=(20, 16)) * 2
    groups = centres[rng.integers(0, 20, 2000)] + 0.5 * rng.normal(size=(2000, 16))
    for x in (noise, groups):
        ids = np.arange(2000)
        got = {}
        for r in ann.search(table(spark, x), F.col("id") % 20 == 0, k=10).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert sorted(got) == list(range(0, 2000, 20))
        hits = 0
        for q, found in got.items():
            want, _ = exact(x, ids, q, 10)
            assert sorted(found) == list(range(1, 11))
            listed = [found[k] for k in sorted(found)]
            assert listed == sorted(listed, key=lambda f: (-f[1], f[0])) and q not in [f[0] for f in listed]
            hits += len(set(want) & {f[0] for f in listed})
        assert hits >= 0.9 * 1000


def test_small_tables_are_searched_whole_ties_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile(rng.normal(size=(1, 4)), (60, 1)), rng.normal(size=(40, 4))])  # a hot vector
    ids = rng.permutation(100)
    nan, inf = float("nan"), float("inf")
    odd = [(200, None, 1, 2), (220, [0.0] * 4, 1, 2), (240, [1.0, None, 1.0, 1.0], 1, 2), (260, [1.0, nan, 1.0, 1.0], 1, 2),
           (280, [inf, 1.0, 1.0, 1.0], 1, 2), (300, [1.0, 2.0], 1, 2), (None, [1.0] * 4, 1, 2), (320, [], 1, 2)]
    out = ann.search(table(spark, x, ids, odd), F.col("id") % 20 == 0, k=20, parts=1).collect()
    for q in range(0, 100, 20):
        place = int(np.nonzero(ids == q)[0][0])
        want, scores = exact(x, ids, place, 20)
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == want
        assert np.allclose([r["score"] for r in mine], scores, rtol=1e-12)
    assert {r["query_id"] for r in out} == set(range(0, 100, 20))


def test_default_parts_on_small_tables_find_k_or_all(spark):
    rng = np.random.default_rng(9)
    for n in (40, 70, 127, 200):
        centres = rng.normal(size=(4, 8)) * 4
        x = centres[rng.integers(0, 4, n)] + 0.1 * rng.normal(size=(n, 8))
        got = ann.search(table(spark, x), F.col("id") % 4 == 0, k=20).groupBy("query_id").count().collect()
        assert {r["query_id"]: r["count"] for r in got} == dict.fromkeys(range(0, n, 4), 20)


def test_few_and_repeated_rows(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    got = ann.search(table(spark, x, [20, 20, 7]), F.col("id") % 20 == 0, k=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(20, 1, 20), (20, 1, 20), (20, 2, 7), (20, 2, 7)]
    none = ann.search(table(spark, x[:0]), F.col("id") % 20 == 0)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    part = ann.balanced_cut(*ann.neighbour_graph(x, 8), 16)
    assert np.bincount(part, minlength=16).min() >= 62 and np.bincount(part).max() <= 63
