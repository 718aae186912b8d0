import random
import re

from gridlens.llm import line_dedup

from . import fixtures as fx


def key(i, t):
    return (i is None, i or 0)


def brute(rows, min_lines, min_words):
    """Per row: (id, lines left, number removed, longest run), documents in the order of id; equal ids hold equal texts."""
    docs = sorted(((i, t.split("\n") if t is not None else []) for i, t in rows), key=lambda r: key(*r))
    gone = [set() for _ in docs]
    for length in range(1, min_lines + 1):
        seen = set()
        for d, (_, lines) in enumerate(docs):
            for p in range(len(lines) - length + 1):
                run = tuple(lines[p:p + length])
                if length < min_lines and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) < min_words:
                    continue
                if run in seen:
                    gone[d] |= set(range(p, p + length))
                seen.add(run)
    out = []
    for (i, lines), g in zip(docs, gone):
        best = run = 0
        for p in range(len(lines)):
            run = run + 1 if p in g else 0
            best = max(best, run)
        out.append((str(i), "\n".join(x for p, x in enumerate(lines) if p not in g), len(lines), len(g), best))
    return sorted(out)


def result(df):
    return sorted((str(r["id"]), r["text"] or "", r["n_lines"], r["n_removed"], r["longest_run"]) for r in
                  df.selectExpr("row.doc_id as id", "text", "n_lines", "n_removed", "longest_run").collect())


def random_rows(seed, n=40):
    rng, pool = random.Random(seed), [f"line {k} of the pool" for k in range(12)]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randint(1, 14))]
        rows.append((i, "\n".join(lines)))
    block = "\n".join(pool[:6])
    rows += [(100, block + "\nx"), (101, "y\n" + block), (102, block), (102, block), (103, "\n".join(["same"] * 9))]
    return rows


def test_runs_against_brute_force(spark):
    for seed, min_lines, min_words in ((1, 3, 7), (2, 4, 9), (3, 2, 5), (4, 1, 1)):
        rows = random_rows(seed)
        got = line_dedup.dedup_lines(fx.docs(spark, [(i, t, "s") for i, t in rows]), min_lines, min_words)
        assert result(got) == brute(rows, min_lines, min_words)


def test_odd_rows(spark):
    rows = [(i, t, s) for i, t, s in fx.odd_rows() if not (i == 5 and s == "a" and len(t.split()) == 25)]
    docs = fx.docs(spark, rows)
    got = line_dedup.dedup_lines(docs, 3, 40)
    assert got.select("row.*").columns == docs.columns
    assert result(got) == brute([(i, t) for i, t, _ in rows], 3, 40)
    assert got.where("text is null").count() == sum(t is None for _, t, _ in rows)
    assert line_dedup.dedup_lines(fx.docs(spark, []), 3, 40).count() == 0


def test_ranks_are_those_of_a_suffix_array(spark):
    rows = random_rows(7)
    lines = line_dedup.line_table(fx.docs(spark, [(i, t, "s") for i, t in rows]))
    ids = {(r["doc"], r["pos"]): (r["h"], r["g"]) for r in lines.collect()}
    ladder = line_dedup.suffix_ranks(lines)
    assert len(ladder) == 4  # runs of 8 lines repeat ("same" nine times), runs of 16 don't
    for k, level in enumerate(ladder):
        ranked = {}
        for r in level.collect():
            ranked.setdefault(r["r"], set()).add(tuple(ids[r["doc"], r["pos"] + j] for j in range(1 << k)))
        assert all(len(s) == 1 for s in ranked.values())  # one rank, one run of 2**k lines
        order = [next(iter(ranked[r])) for r in sorted(ranked)]
        assert order == sorted(order)


def test_main_path_runs_no_python(spark):
    plan = line_dedup.dedup_lines(fx.docs(spark, random_rows_docs()), 3, 50)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def random_rows_docs():
    return [(i, t, "s") for i, t in random_rows(1, 5)]
