import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import quality, queries, toxicity
from gridlens.session import read_table

from . import fixtures as fx

SF = "/root/testdata/sf0.01"


def joined(spark, df, label):
    labels = read_table(spark, SF, "labels").select("doc_id", F.col(label).alias("y"))
    return df.join(labels, "doc_id").toPandas()


def test_quality_on_held_out_labels(spark):
    out = queries.op7_quality(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    got = joined(spark, out, "quality")
    held = got[got["held_out"]]
    assert len(held) > 80 and (held["predicted"] == held["y"]).mean() >= 0.97
    assert held[held["y"] == 1]["predicted"].mean() >= 0.98
    assert ((got["score"] >= 0) & (got["score"] <= 1) & ((got["score"] >= 0.5) == (got["predicted"] == 1))).all()


def test_toxicity_on_held_out_labels(spark):
    out = queries.op5_toxicity(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    got = joined(spark, out, "toxic")
    held = got[got["held_out"]]
    assert (held["predicted"] == held["y"]).mean() >= 0.93 and held[held["y"] == 0]["predicted"].mean() <= 0.02
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_bradley_terry_orders_by_the_planted_weights():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(500, 4)), np.array([2.0, -1.0, 0.5, 0.0])
    a, b = rng.integers(0, 500, 20_000), rng.integers(0, 500, 20_000)
    first = rng.random(20_000) < 1 / (1 + np.exp(-(x[a] - x[b]) @ w))
    diff = np.where(first[:, None], x[a] - x[b], x[b] - x[a])
    assert quality.bradley_terry(diff, ridge=1e-6) == pytest.approx(w, abs=0.1)


def test_threshold_is_a_quantile():
    s = np.array([0.1, 0.2, 0.3, 0.9, 1.0])
    assert quality.weighted_cut(s, np.ones(5), 0.6) == pytest.approx(0.6)
    assert quality.weighted_cut(s, np.ones(5), 0.0) == pytest.approx(0.15)
    assert quality.weighted_cut(s, np.ones(5), 1.0) == pytest.approx(0.95)


def test_label_model_outvotes_a_wrong_label():
    rng = np.random.default_rng(4)
    y = rng.random(2000) < 0.2
    votes = np.stack([np.where(y, rng.random(2000) < 0.6, rng.random(2000) < 0.005) for _ in range(8)], 1).astype(int)
    votes = np.hstack([votes, votes[:, :1]])  # the first voter twice: counts as one
    seen = np.where(rng.random(2000) < 0.05, ~y, y).astype(int)
    p = toxicity.label_model(votes, seen)
    assert ((p > 0.5) == y).mean() > 0.99 > (seen == y).mean()


def test_the_most_frequent_word_counts_in_texts_of_many_words():
    top = quality.FEATURES.index("top_word")
    words = [f"w{i}" for i in range(30)]
    assert quality.features("spam " * 70 + " ".join(words))[top] == pytest.approx(0.7)
    assert quality.features(" ".join(words))[top] == pytest.approx(1 / 30)
    assert quality.features("a a a b")[top] == pytest.approx(0.75)


def test_labels_that_may_not_be_learned_change_nothing(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    other = labels.select("doc_id", F.when(queries.learnable(), F.col("quality")).otherwise(1 - F.col("quality")).alias("quality"))
    a = quality.fit(docs, labels, allowed=queries.learnable())
    b = quality.fit(docs, other, allowed=queries.learnable())
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_odd_rows_and_missing_labels(spark):
    docs = fx.docs(spark, fx.odd_rows())
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 1), (6, 0, 1), (8, None, None), (None, 1, 1), (9, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for rows in (labels, labels.limit(0), labels.where(f"{label} = 1")):
            out = module.score(docs, module.fit(docs, rows))
            assert out.select("row.*").columns == docs.columns and out.count() == len(fx.odd_rows())
            assert out.where("score between 0 and 1").count() == len(fx.odd_rows())
        empty = docs.limit(0)
        assert module.score(empty, module.fit(empty, labels)).count() == 0
    kept = quality.keep_good(docs, None)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.features(None)[-1] == quality.features(" \n")[-1] == 1.0


def test_the_fit_takes_all_pairs_and_the_threshold_all_scores(spark):
    rng = np.random.default_rng(9)
    vocab = fx.vocabulary(400)
    rows, marks = [], []
    for i in range(130):
        good = i % 13 > 3
        words = list(rng.choice(vocab, int(rng.integers(40, 90))))
        if good != (i % 10 == 0):
            words = [w + ("." if rng.random() < 0.2 else "") for w in words]
        else:
            words = [w.upper() if rng.random() < 0.3 else w for w in words] + ["!!!"] * int(rng.integers(0, 6))
        rows.append((i, " ".join(words), "s"))
        marks.append((i, int(good)))
    model = quality.fit(fx.docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int"))
    x, y = np.stack([quality.features(t) for _, t, _ in rows]), np.array([m for _, m in marks])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    want = quality.bradley_terry((z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, x.shape[1]))
    assert model.mean == pytest.approx(mean, abs=1e-6) and model.weights == pytest.approx(want, abs=0.02)
    assert model.threshold == pytest.approx(quality.weighted_cut(model.raw(x), np.full(len(y), 1 / len(y)), (y == 0).mean()), abs=1e-9)


def test_threshold_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(quality, "CUTS", 4)
    rng = np.random.default_rng(3)
    for share in (0.05, 0.37, 0.8):
        s, y = np.round(rng.normal(size=200), 2), rng.integers(0, 2, 200)
        table = spark.createDataFrame([(int(b), float(a)) for a, b in zip(s, y)], "y int, s double")
        assert quality.weighted_cut_of(table, (1.0, 1.0), share) == pytest.approx(quality.weighted_cut(s, np.ones(200), share))
