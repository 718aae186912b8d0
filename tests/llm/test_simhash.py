import random

import numpy as np
import xxhash

from gridlens.llm import simhash
from gridlens.llm.components import components

from . import fixtures as fx


def slow_fingerprint(text, k=4):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_a_slow_one():
    rng, words = random.Random(1), fx.vocabulary()
    for n in (0, 1, 2, 3, 4, 5, 37, 400):
        text = fx.sentence(rng, words, n).title()
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0
    assert simhash.fingerprint("É é") != simhash.fingerprint("é é")  # only A-Z change
    text = fx.sentence(rng, words, 300)
    assert simhash.fingerprint(text, block=7) == simhash.fingerprint(text)


def test_spark_hash_is_the_same_xxh64(spark):
    row = spark.sql("select xxhash64('abc é') as h").first()
    assert row["h"] == signed(xxhash.xxh64_intdigest("abc é".encode(), seed=42))


def test_tile_links_join_what_brute_force_joins():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    far = near ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, far])).view(np.int64)
    rng.shuffle(fps)
    for a, b, same in ((fps[:500], fps[500:], False), (fps[:700], fps[:700], True)):
        nodes = a if same else np.concatenate([a, b])
        place = {int(x): i for i, x in enumerate(nodes)}
        d = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= 4
        want = fx.union_find(len(nodes), [(int(i), int(j) + (0 if same else len(a))) for i, j in zip(*np.nonzero(d))])
        u, v = simhash.tile_links(a, b, same, 4)
        got = fx.union_find(len(nodes), [(place[int(x)], place[int(y)]) for x, y in zip(u, v)])
        assert got == want


def test_near_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)  # many tiles on few rows
    rng, words = random.Random(5), fx.vocabulary(400)
    rows = fx.odd_rows()
    for i in range(10, 60, 5):
        text = fx.sentence(rng, words, 150).split()
        for j in range(5):
            own = list(text)
            for _ in range(j):
                own[rng.randrange(150)] = rng.choice(words)
            rows.append((i + j, " ".join(own), "s"))
    docs = fx.docs(spark, rows)
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_dedup(docs).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    root = fx.union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    ids = {}
    for (i, _, _), r in zip(rows, root):
        ids[r] = min([x for x in (ids.get(r), i) if x is not None], default=None)
    assert got == sorted(((i, signed(f), ids[r]) for (i, _, _), f, r in zip(rows, fps, root)), key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(ids.values())


def test_empty_table(spark):
    docs = fx.docs(spark, [])
    assert simhash.near_dedup(docs).count() == 0 and simhash.keep_one(docs).columns == docs.columns


def test_components_against_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    names = sorted({x for a, b in links if a != b for x in (a, b)})
    place = {x: i for i, x in enumerate(names)}
    want = fx.union_find(len(names), [(place[a], place[b]) for a, b in links if a != b])
    assert got == {x: names[want[place[x]]] for x in names}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
