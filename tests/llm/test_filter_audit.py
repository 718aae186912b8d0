import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from gridlens.llm import filter_audit
from gridlens.llm.queries import AUDITED
from tests.llm.fixtures import docs, odd_rows


def test_prefix_ranks_are_places_in_the_sorted_orders():
    for k in (1, 3, 4):
        every = list(permutations(range(k)))
        for s in range(k + 1):
            for prefix in permutations(range(k), s):
                assert filter_audit.prefix_rank(prefix, k) == min(i for i, o in enumerate(every) if o[:s] == prefix)


def test_intervals_say_what_happens_to_each_mask():
    k = 4
    got = defaultdict(set)
    for mask, s, what, lo, hi in filter_audit.intervals(k):
        assert 0 <= lo < hi <= factorial(k)
        for r in range(lo, hi):
            got[mask, r, s].add(what)
    for r, order in enumerate(permutations(range(k))):
        for mask in range(1 << k):
            for s in range(1, k + 1):
                earlier, own = any(mask >> f & 1 for f in order[:s - 1]), mask >> order[s - 1] & 1
                want = {"redundant" if earlier else "removed"} if own else set() if earlier else {"kept"}
                assert got.get((mask, r, s), set()) == want


def brute(rows, labels):
    """rows of (doc_id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    far = float("inf")
    marked = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": any((far if j is None else j) < (far if i is None else i) for j, u, _ in rows if (u or "") == t)}
        marked.append((part or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out, total = {}, Counter()
    for part in {m[0] for m in marked}:
        for order in permutations("ABCDE"):
            left = [m for m in marked if m[0] == part]
            gone = []
            for s, f in enumerate(order):
                lost = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                out[part, "".join(order), s + 1] = [len(left), len(lost), sum(f in m[1] for m in gone),
                                                    sum(m[1] == {f} for m in marked if m[0] == part),
                                                    sum(m[2] for m in lost), sum(m[3] for m in lost)]
                total[part, f] += len(lost)
                gone += lost
    return sorted((p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items())


def run(spark, table, labels):
    flags = {"good": labels["quality"] == 1, "toxic": labels["toxic"] == 1}
    out = filter_audit.audit(table, AUDITED, "E", F.coalesce(table["lang"], F.lit("")), flags, labels)
    return sorted(map(tuple, out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                        "good_lost", "toxic_lost", "shapley").collect()))


@pytest.mark.parametrize("repeat", [1, 3])
def test_every_order_against_brute_force(spark, repeat):
    rng = random.Random(5)
    rows = odd_rows() * repeat
    for i in range(20, 60):
        n = rng.choice([3, 120, 150])
        text = " ".join(rng.choice(["Ab", "cd", "EF", "gh$", *map(str, range(rng.choice([5, 400])))]) for _ in range(n))
        rows += [(i, text, "s"), *([(rng.choice([i + 100, None]), text, "t")] if rng.random() < 0.4 else [])]
    table = docs(spark, rows)
    marks = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in [*range(50), None, 5, 6]]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert run(spark, table, labels) == brute([(r["doc_id"], r["text"], r["lang"]) for r in table.collect()], marks)


def test_empty_tables_and_no_flags(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(spark, docs(spark, []), labels) == []
    table = docs(spark, [(1, "a b", "s"), (2, "a b", "s")])
    got = run(spark, table, labels)
    assert len(got) == 2 * 120 * 5 and all(r[7:9] == (0, 0) for r in got)
    bare = filter_audit.audit(table, {"A": "words.n < 1"}, "B", F.lit("x"))
    assert sorted(map(tuple, bare.collect())) == [("x", "AB", 1, 2, 0, 0, 0, 0), ("x", "AB", 2, 1, 1, 0, 1, 2),
                                                  ("x", "BA", 1, 1, 1, 0, 1, 2), ("x", "BA", 2, 1, 0, 0, 0, 0)]
    with pytest.raises(ValueError):
        filter_audit.audit(table, {"B": "true"}, "A", F.lit("x"))
