import hashlib
import random
import re

from pyspark.sql import functions as F

from gridlens.llm import decontaminate

from . import fixtures as fx

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(rows, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k:k + size]), set()).add("" if i is None else str(i))
    out = []
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((str(i), len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n"], ",".join(r["items"])) for r in df.select(
        "row.doc_id", "n_words", decontaminate.words_hit(F.col("hits")).alias("n"), "items").collect())


def test_exact_phrases_against_brute_force(spark, monkeypatch):
    rng, vocab = random.Random(6), fx.vocabulary(25)  # few words: lists are long and windows meet by chance
    items = [(i, fx.sentence(rng, vocab, rng.choice([2, 5, 6, 14]))) for i in range(12)]
    items += [(3, items[4][1]), (None, fx.sentence(rng, vocab, 8)), (50, ""), (51, None), (52, "!!"), (53, "zzz never")]
    rows = fx.odd_rows() + [(100 + i, fx.sentence(rng, vocab, 120), "s") for i in range(30)]
    for i in range(15):
        leak = (items[i % 12][1] or "").replace(" ", ", ").upper()
        rows.append((200 + i, fx.sentence(rng, vocab, 15) + " " + leak + " " + leak + fx.sentence(rng, vocab, 5), "s"))
    docs, bench = fx.docs(spark, rows), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, wid int")
    for size in (3, 5):
        assert result(decontaminate.find_phrases(docs, bench, size)) == brute(rows, items, size)
    monkeypatch.setattr(decontaminate, "BROADCAST_PLACES", 0)  # the way by shuffle
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 0)
    assert result(decontaminate.find_phrases(docs, bench, 5)) == brute(rows, items, 5)
    clean = decontaminate.clean(docs, bench, 5)
    assert clean.columns == docs.columns and clean.count() == sum(not n for *_, n, _ in brute(rows, items, 5))


def test_empty_tables(spark):
    docs, bench = fx.docs(spark, fx.odd_rows()), spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_phrases(docs, bench, 10).collect()
    assert len(got) == len(fx.odd_rows()) and all(r["hits"] == [] and r["items"] == [] for r in got)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_phrases(fx.docs(spark, []), some, 10).count() == 0


def test_proximity(spark):
    rows = [(1, "x one two three four y", "s"), (2, "one pad two four three", "s"), (3, "one a b c two three four", "s"),
            (4, "two three four", "s")]
    docs, bench = fx.docs(spark, rows), spark.createDataFrame([(9, "one two three four")], "item_id long, text string")
    near = decontaminate.find_near(docs, bench, 4, slack=2).select("key").distinct()
    keys = docs.select("doc_id", F.xxhash64("text").alias("key")).join(near, "key")
    assert sorted(r["doc_id"] for r in keys.collect()) == [1, 2]
    assert decontaminate.find_near(docs, bench, 4, slack=0).count() == 1


def test_main_path_runs_no_python(spark):
    docs, bench = fx.docs(spark, fx.odd_rows()), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    plan = decontaminate.find_phrases(docs, bench, 10)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_words_between_any_characters(spark):
    text = "".join(f"a{chr(c)}B" for c in range(1, 0x250)) + "\U0001f600 \u20ac\x00z"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(decontaminate.words(F.col("t"))).collect()
    assert [r[0] for r in got] == [words(text), []]
    assert "-" not in decontaminate.BETWEEN  # ranges are tried one after another for each character
