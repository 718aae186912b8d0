"""Quality classifier by Bradley-Terry ranking.

A labelled good document is preferred to a labelled bad one. The score is linear in the features of the whole text;
its weights minimise the logistic loss on the feature differences of all pairs of a good and a bad labelled document.
The loss of a pair depends on its two scores, so the documents are counted and their features added up in narrow bins of
the score, and each Newton step takes the pairs of bins instead of those of documents: one pass over the features,
whatever the number of pairs. The threshold is the quantile of the scores of all labelled documents that leaves as large
a share below as the labels call bad.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import packed, small_batches, stored, text_table
from gridlens.llm.labelled import label_rows

FEATURES = ["log_words", "distinct", "repeats", "upper", "symbols", "exclaim", "bars", "digits", "mean_length",
            "punctuated", "line_copies", "log_line_words", "top_word", "decorated", "blank"]
#: Bins of the score in a Newton step, and the unit that standardised features are rounded to for it.
BINS, GRAIN = 512, 1 / 4096
#: Bins of the score in a step towards the threshold.
CUTS = 4096
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)


def features(text: str | None) -> np.ndarray:
    """Shares and logarithms in the order of FEATURES; an empty or null text has none but "blank"."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.array([0.0] * (len(FEATURES) - 1) + [1.0])
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    chars = max(1.0, count.sum() - count[[9, 10, 11, 12, 13, 32]].sum())
    letters = max(1.0, count[_UPPER].sum() + count[_LOWER].sum())
    plain = count[_UPPER].sum() + count[_LOWER].sum() + count[_DIGIT].sum() + count[128:].sum() + count[[44, 46]].sum()
    n, times = len(words), Counter(words)
    lines = raw.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    tails = [w[-1] for w in words]
    ends = np.bincount(np.array(tails, np.uint8), minlength=256)
    odd = ends[33:48].sum() + ends[58:65].sum() + ends[91:97].sum() + ends[123:127].sum() - ends[44] - ends[46]
    return np.array([
        np.log1p(n), len(times) / n, same / n, count[_UPPER].sum() / letters, 1 - plain / chars, count[33] / chars,
        count[124] / chars, count[_DIGIT].sum() / chars, min(20.0, chars / n), (ends[44] + ends[46]) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), max(times.values()) / n, odd / n, 0.0])


@dataclass
class Ranking:
    """Weights on standardised features; ``threshold`` is the raw score that counts as 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - self.raw(x), -60, 60)))


def bradley_terry(diff: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method on mean log(1 + exp(-diff @ w)) + ridge / 2 * |w|^2."""
    w = np.zeros(diff.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))
        grad = -(diff * p[:, None]).mean(0) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def weighted_cut(scores: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The score with ``share`` of the weight below it, half way between its neighbours."""
    order = np.argsort(scores, kind="stable")
    s, c = scores[order], np.cumsum(weights[order])
    k = int(np.searchsorted(c, share * c[-1] + 1e-9 * c[-1], side="right"))
    k = min(max(k, 1), len(s) - 1)
    return float((s[k - 1] + s[k]) / 2)


def binned_step(w: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's step of :func:`bradley_terry` at ``w`` over all pairs of a good and a bad row. ``sums`` (2, bins, 1 + f + f*f):
    per class (bad, good) and bin of the score the number of rows, their sum and the sum of their outer products."""
    f, n = len(w), sums[:, :, 0]
    x, xx = sums[:, :, 1:f + 1], sums[:, :, f + 1:]
    mean = x @ w / np.maximum(n, 1)  # the score of a bin
    p = 1 / (1 + np.exp(np.clip(mean[1][:, None] - mean[0][None, :], -60, 60)))
    h = p * (1 - p)
    total = n[0].sum() * n[1].sum()
    grad = ridge * w - ((p @ n[0]) @ x[1] - (n[1] @ p) @ x[0]) / total  # the weights of a bin meet the sum of its rows
    cross = x[1].T @ h @ x[0]
    hess = ((h @ n[0]) @ xx[1] + (n[1] @ h) @ xx[0]).reshape(f, f) - cross - cross.T
    return np.linalg.solve(hess / total + ridge * np.eye(f), grad)


def _bin_sums(table: DataFrame, model: Ranking) -> np.ndarray:
    """The ``sums`` of :func:`binned_step` over (y, x): each task adds up its rows, Spark the tasks' sums. Features are
    rounded to whole GRAINs, so that the sums are whole numbers and the same in any order."""
    f = len(FEATURES)
    # every score lies within the reach of the weights
    reach = 6 * np.abs(model.weights).sum() + 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2 * BINS, 1 + f + f * f), np.int64)
        for b in batches:
            if len(b):
                z = np.rint(model.standard(np.stack(b["x"].to_numpy())) / GRAIN)
                at = np.clip(((z @ model.weights * GRAIN / reach + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)
                z = z.astype(np.int64)
                np.add.at(sums, b["y"].to_numpy().astype(np.int64) * BINS + at,
                          np.hstack([np.ones((len(z), 1), np.int64), z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)]))
        seen = np.nonzero(sums[:, 0])[0]
        yield pd.DataFrame({"bin": seen, "s": list(sums[seen])})

    parts = table.mapInPandas(run, "bin long, s array<long>")
    added = parts.groupBy("bin").agg(F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(1 + f + f * f)]).alias("s"))
    out = np.zeros((2 * BINS, 1 + f + f * f))
    for r in added.toArrow().to_pylist():
        out[r["bin"]] = r["s"]
    out[:, 1:f + 1] *= GRAIN
    out[:, f + 1:] *= GRAIN * GRAIN
    return out.reshape(2, BINS, -1)


def weighted_cut_of(scores: DataFrame, weights: tuple[float, float], share: float) -> float:
    """:func:`weighted_cut` of the table (y, s) whose rows weigh ``weights[y]``. Bins of the score are counted, then those
    of the bin that holds the cut, until its values are told apart; the driver gets the bins' counts only."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    rows = scores.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(weights[r["y"]] * r["n"] for r in rows)
    below, want = 0.0, share * total + 1e-9 * total
    s, inside = F.col("s"), scores
    while True:
        bins = (F.floor((s - F.lit(low)) / F.lit((high - low) or 1.0) * F.lit(float(CUTS)))).cast("long").alias("bin")
        found = inside.groupBy(bins, "y").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).toPandas()
        found["w"] = found["n"] * np.where(found["y"] == 1, weights[1], weights[0])
        each = found.groupby("bin").agg(w=("w", "sum"), low=("low", "min"), high=("high", "max")).sort_index()
        c = below + each["w"].to_numpy().cumsum()
        k = min(int(np.searchsorted(c, want, side="right")), len(c) - 1)
        at = each.iloc[k]
        if at["low"] == at["high"] or len(each) == 1:
            break
        below, low, high = (c[k - 1] if k else below), float(at["low"]), float(at["high"])
        inside = scores.where(s.between(F.lit(low), F.lit(high)))
    cut = float(at["low"])
    # the cut is half way between the first value that goes beyond the share and the row before it
    equal = scores.where(s == F.lit(cut)).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    step = max(weights[r["y"]] for r in equal)
    start = c[k - 1] if k else below
    before = scores.where(s < F.lit(cut)).agg(F.max("s")).first()[0]
    if before is None:  # the share is none: between the two least rows
        rest = scores.where(s > F.lit(cut)).agg(F.min("s")).first()[0]
        return cut if sum(r["n"] for r in equal) > 1 or rest is None else (cut + rest) / 2
    return cut if want >= start + step else (before + cut) / 2


def feature_table(docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None, text: str, id_col: str) -> tuple[DataFrame, dict[int, int]]:
    """((y, x) of all labelled documents, labelled ids per class); one text is taken per id, that with the least hash. The
    texts stay where they are: only ids and features are shuffled."""
    rows = label_rows(labels, label, allowed, id_col)
    rows = stored(rows, "labelled")
    counts = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = text_table(docs, id_col, text).toDF("doc_id", "text")
    if allowed is not None:
        texts = texts.where(allowed)

    def of(column: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in column], pa.list_(pa.float64()))

    small_batches(docs.sparkSession)
    x = texts.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"), F.arrow_udf(of, "array<double>")("text").alias("x"))
    one = x.groupBy("doc_id").agg(F.min(F.struct("hash", "x")).alias("m"))
    return stored(one.join(rows, "doc_id").select("y", F.col("m.x").alias("x")), "features"), counts


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed: Column | None = None,
        text: str = "text", id_col: str = "doc_id", steps: int = 30) -> Ranking | None:
    """Fit on all labelled documents and all pairs of a good and a bad one. ``allowed`` is a condition on doc_id that labels
    must meet. None without both classes."""
    table, counts = feature_table(docs, labels, label, allowed, text, id_col)
    f = len(FEATURES)
    found = {int(r["y"]): r["n"] for r in table.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return None
    x = [F.get("x", F.lit(j)) for j in range(f)]
    moments = table.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    # rounded, as sums of fractions depend on their order
    model = Ranking(np.round(moments[:f], 9), np.maximum(np.round(moments[f:], 9), 1e-6), np.zeros(f), 0.0)
    for _ in range(steps):
        step = np.round(binned_step(model.weights, _bin_sums(table, model), 1e-3), 9)
        model.weights = model.weights - step
        if np.abs(step).max() < 1e-3:
            break

    def raw(column: pa.Array) -> pa.Array:
        return pa.array(model.raw(np.array(column.to_pylist()).reshape(len(column), f)), pa.float64())

    scores = stored(table.select("y", F.arrow_udf(raw, "double")("x").alias("s")), "scores")
    share = counts[0] / (counts[0] + counts[1])
    model.threshold = weighted_cut_of(scores, (share / found[0], (1 - share) / found[1]), share)
    return model


def score(docs: DataFrame, model: Ranking | None, text: str = "text") -> DataFrame:
    """(row, score): all columns of ``docs`` in ``row``, the score of the whole text from 0 to 1. Without a model
    every score is 0.5. Null and empty texts are scored by the feature "blank"; an empty table gives none."""
    rows = packed(docs)
    if model is None:
        return rows.withColumn("score", F.lit(0.5))

    def of(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts]).reshape(len(texts), len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    small_batches(docs.sparkSession)
    return rows.withColumn("score", F.arrow_udf(of, "double")(F.col("row").getField(text)))


def keep_good(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """``docs`` that score 0.5 or more, all columns as they are."""
    return score(docs, model).where("score >= 0.5").select("row.*")
