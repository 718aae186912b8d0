import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gridlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, `key` string, sizes int, name string, part string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "n", "p") for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + said[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in made.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def run(spark, rows, keys=prefix_trie.RUN):
    convs = prefix_trie.rebuilt(prefix_trie.conversations(turns(spark, rows)))
    out = prefix_trie.trie(convs, run=keys).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                   "saved_tokens", "ends_sha256").collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out)


def made_up(seed, n=220):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        texts = rng.choice([["hi", "é" * 3, ""], ["x"], list("abcdefgh")])
        rows += [(c, t, rng.choice(["u", "a"]), rng.choice(texts)) for t in range(rng.choice([1, 2, 4, 9]))]
    return rows


@pytest.mark.parametrize("keys", [1, 3, 40, 50_000])
def test_nodes_against_brute_force_whatever_the_runs(spark, keys):
    rows = made_up(keys)
    rng = random.Random(9)
    rng.shuffle(rows)
    assert run(spark, rows, keys) == brute(rows)


def test_hot_conversations_and_a_hot_first_turn(spark):
    rows = [(c, t, "u", f"same {t}") for c in range(0, 3000) for t in range(3)]
    rows += [(c, 3, "a", f"own {c}") for c in range(0, 3000, 3)]
    assert run(spark, rows, 500) == brute(rows)


def test_nulls_ties_empty_and_long(spark):
    rows = [(None, 1, "u", "lost"), (1, None, None, None), (1, None, "u", "x"), (1, 2, "u", "y"), (1, 2, "u", "y"), (1, 2, None, "y"),
            (205, 1, "a", ""), (200, 1, "", "a"), (200, 2, "a", ""), (-3, 1, "u", "q"), (-100, 7, "u", "q"), (7, 1, "u", "z" * 50_000)]
    rows += [(400, t, "u", str(t)) for t in range(700)] + [(401, t, "u", str(t)) for t in range(650)]
    got = run(spark, rows, 2)
    assert [r[:2] + r[3:] for r in got if r[0] not in (1, 7)] == [r[:2] + r[3:] for r in brute(rows) if r[0] not in (1, 7)]
    assert len(got) == len(brute(rows))
    assert run(spark, []) == []


def test_layouts_grow_and_paths_are_compressed():
    tree = prefix_trie.RadixTree()
    for b in range(200):
        tree.insert(bytes([b]) + b"x" * 15, b, [1])
        assert tree.root.layout == (4 if b < 4 else 16 if b < 16 else 48 if b < 48 else 256)
    tree.insert(b"\x05" + b"x" * 7 + b"y" * 8, 300, [1])
    assert tree.root.child(5).prefix == b"x" * 7 and len(list(tree.root.child(5).branches())) == 2
    assert [b for b, _ in tree.root.branches()] == list(range(200)) and tree.root.child(201) is None


def test_only_whole_turns_are_nodes():
    tree = prefix_trie.RadixTree()
    keys = sorted([b"a" * 16 + b"b" * 16, b"a" * 16 + b"b" * 15 + b"c", b"a" * 15 + b"d", b""])
    for i, k in enumerate(keys):
        tree.insert(k, i, [5, 7][:len(k) // 16])
    nodes = list(prefix_trie.trie_nodes(tree, keys[0], keys[-1]))
    assert sorted(x.depth for x in nodes) == [0, 1, 1, 2, 2]
    assert nodes[-1].depth == 0 and nodes[-1].n == 4
