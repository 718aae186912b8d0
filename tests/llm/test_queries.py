import re

import duckdb
import pytest

import corpus_pipeline
from gridlens.llm import queries
from gridlens.session import read_table

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs_over_its_whole_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    if name.startswith("op6_"):
        assert out.select("query_id").distinct().count() == 25 and out.count() == 500
    else:
        assert out.count() == read_table(spark, SF, "documents").count() == out.select("doc_id").distinct().count()


def test_pipeline(spark):
    docs, counts = read_table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        if name != "shard":
            assert docs.columns == columns
    assert 200 > counts[0] > counts[1] > counts[2] > 0 and counts[3] == counts[4] > 0
    assert docs.columns == [*columns, "shard", "slot"]
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, ran.collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.run(spark, SF).count() == counts[4]


def test_pipeline_keeps_the_training_order_inside_a_shard(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "SHARD_BYTES", 20_000)
    docs = read_table(spark, SF, "documents")
    placed = corpus_pipeline.mixing.mix(docs, corpus_pipeline.SCHEDULES, share=1.5, max_repeats=2.0)
    want = [r["doc_id"] for r in placed.select("row.doc_id").collect()]
    mixed = corpus_pipeline.stored(corpus_pipeline.mix_sources(spark, docs, SF), "mixed")
    assert len(want) == mixed.count() > len(set(want))
    got = corpus_pipeline.stored(corpus_pipeline.shard(spark, mixed, SF), "dealt")
    slots = {}
    for r in got.select("shard", "slot", "doc_id").collect():
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    assert all([n for n, _ in sorted(s)] == list(range(len(s))) for s in slots.values())
    rows = got.select("doc_id", "shard", *[c.alias(f"at{i}") for i, c in enumerate(corpus_pipeline.written_order(got))])
    rows = [(r["doc_id"], r["shard"]) for r in rows.orderBy("at0", "at1", "at2").collect()]
    shards = [s for _, s in rows]
    assert shards == sorted(shards) and len(set(shards)) > 3
    shard_of = {}
    for i, s in rows:
        shard_of.setdefault(i, set()).add(s)
    assert all(len(s) == 1 for s in shard_of.values())  # no text here outgrows its share of a shard
    for s in set(shards):
        in_order = [i for i in want if shard_of[i] == {s}]
        assert [i for i, k in rows if k == s] == in_order and [i for _, i in sorted(slots[s])] == in_order


ODD = [(1, None, "a"), (2, "", None), (None, "x y z", "b"), (None, None, None), (4, "word " * 30_000, "a"), (5, "twice", "a"),
       (5, "twice", "a"), (6, "Ünïcode ßtrange text", "c")]


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_on_odd_empty_and_clashing_tables(spark, tmp_path, rows):
    """Each stage takes nulls, empty and long texts, repeated rows, no rows, and columns named as its own."""
    from tests.llm import fixtures as fx

    table = fx.docs(spark, rows)
    columns, docs = table.columns, corpus_pipeline.stored(table, "odd")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"odd-{name}")
        after = docs.count()
        assert after <= before * (2 if name == "mix" else 1)
        if name != "shard":
            assert docs.columns == columns
        before = after
    assert set(docs.columns) == {*columns, "shard", "slot"}
    assert sorted(r["slot"] for r in docs.where("shard = 0").collect()) == list(range(docs.where("shard = 0").count()))


def test_stages_against_brute_force(spark):
    """Near copies, contaminated documents and the takes of the mix, each from the stage's own input."""
    import re

    from gridlens.llm import mixing

    docs = corpus_pipeline.stored(corpus_pipeline.keep_good(spark, read_table(spark, SF, "documents"), SF), "s0")
    score = corpus_pipeline.quality.score(read_table(spark, SF, "documents"), corpus_pipeline.quality.fit(
        read_table(spark, SF, "documents"), read_table(spark, SF, "labels"), allowed=queries.learnable()))
    assert {r["doc_id"] for r in docs.collect()} == {r["row"]["doc_id"] for r in score.where("score >= 0.5").collect()}
    groups = queries.simhash.near_dedup(docs, shingle=4, radius=4).collect()
    kept = corpus_pipeline.stored(corpus_pipeline.drop_near_copies(spark, docs, SF), "s1")
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in groups}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    runs = set()
    for r in read_table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        runs |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(r) for r in runs}
    clean = {r["doc_id"] for r in kept.collect()
             if not any(tuple(w[i:i + n]) in runs for w in [words(r["text"])] for n in sizes for i in range(len(w) - n + 1))}
    left = corpus_pipeline.stored(corpus_pipeline.decontaminate_benchmark(spark, kept, SF), "s2")
    assert {r["doc_id"] for r in left.collect()} == clean
    taken = corpus_pipeline.stored(corpus_pipeline.mix_sources(spark, left, SF), "s3").groupBy("doc_id").count().collect()
    size = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in left.collect()}
    target = {size[r["doc_id"]][0]: r["target"] for r in mixing.mix_words(left, queries.SCHEDULES, 1.5, 2.0).collect()}
    for s, want in target.items():
        own = [(r["count"], size[r["doc_id"]][1]) for r in taken if size[r["doc_id"]][0] == s]
        longest = max(n for source, n in size.values() if source == s)
        assert all(c <= 2 for c, _ in own) and abs(sum(c * n for c, n in own) - want) <= longest
