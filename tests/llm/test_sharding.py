import random
import zlib

import pytest

from gridlens.llm import sharding

from . import fixtures as fx


def collect(df):
    return [r.asDict() for r in df.collect()]


def rows_of(n, hot=0):
    rng, words = random.Random(4), fx.vocabulary(300)
    copy = fx.sentence(rng, words, 30)
    return [(i, copy if i < hot else fx.sentence(rng, words, rng.randint(1, 60)), f"s{i % 7 if i % 3 else 0}") for i in range(n)]


def check(rows, got, shards):
    assert len(got) == len(rows)
    total, slots = {}, {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(total) <= set(range(shards))
    return total


def test_sizes_come_out_near_equal_and_copies_stay_together(spark):
    rows = rows_of(2000) + [(5000 + i, rows_of(2000)[i][1], "other") for i in range(0, 200, 2)]
    got = collect(sharding.kd_shards(fx.docs(spark, rows), n_shards=7))
    total = check(rows, got, 7)
    mean = sum(total.values()) / 7
    assert len(total) == 7 and max(abs(v - mean) for v in total.values()) < 0.03 * mean
    at = {}
    for r in got:
        assert r["text_crc32"] >= 0
        at.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in at.values())


def test_large_groups_stay_whole_up_to_a_shard(spark):
    rng, words = random.Random(8), fx.vocabulary(300)
    rows = rows_of(600)
    for k in range(40):
        same = fx.sentence(rng, words, 60)
        rows += [(9000 + 20 * k + j, same, f"long-common-name-{j % 3}") for j in range(rng.randint(2, 9))]
    got = collect(sharding.kd_shards(fx.docs(spark, rows), n_shards=12))
    total = check(rows, got, 12)
    at = {}
    for r in got:
        at.setdefault(r["text_crc32"], set()).add(r["shard"])
    mean = sum(total.values()) / 12
    assert all(len(s) == 1 for s in at.values()) and max(abs(v - mean) for v in total.values()) < 0.05 * mean


def test_text_dimensions_are_told_apart_beyond_their_beginning(spark):
    rows = [(i, f"{i:06d}" * 3, f"common-crawl-{i % 4}") for i in range(400)]
    got = collect(sharding.kd_shards(fx.docs(spark, rows), n_shards=4, dims=("source",)))
    sources = {}
    for r in got:
        sources.setdefault(r["shard"], set()).add(r["doc_id"] % 4)
    assert sorted(map(sorted, sources.values())) == [[0], [1], [2], [3]]


def test_a_group_of_a_third_is_split(spark):
    rows = rows_of(1500, hot=500)
    total = check(rows, collect(sharding.kd_shards(fx.docs(spark, rows), n_shards=24)), 24)
    mean = sum(total.values()) / 24
    assert len(total) == 24 and max(abs(v - mean) for v in total.values()) < 0.2 * mean


def test_odd_rows_reruns_and_target_bytes(spark):
    rows = fx.odd_rows()
    docs = fx.docs(spark, rows)
    got = collect(sharding.kd_shards(docs, n_shards=3))
    check(rows, got, 3)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    again = collect(sharding.kd_shards(docs.repartition(5), n_shards=3))
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted(again, key=key)
    out = sharding.with_shard(docs, target_bytes=4000)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(rows)
    assert out.select("shard").distinct().count() > 1


def test_empty_table_and_arguments(spark):
    docs = fx.docs(spark, [])
    assert sharding.kd_shards(docs, n_shards=4).count() == 0 and sharding.with_shard(docs, target_bytes=9).count() == 0
    with pytest.raises(ValueError):
        sharding.kd_shards(docs)
