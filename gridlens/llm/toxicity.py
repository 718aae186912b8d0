"""Toxicity by weak supervision.

Many voters, each a word (lexicon) or the beginning of a word (pattern), fire on a document or stay silent; they are
the marks that labelled toxic documents of the sample hold far more often than clean ones. A generative label model
(expectation-maximisation over a hidden label) estimates how often each fires on toxic and on clean documents and how
the voters go together beyond what the label explains; voters that say the same count as one. The human label enters
as one more voter. A linear classifier on the marks of the whole text is trained on the posterior labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import cut_lineage, packed
from gridlens.llm.labelled import labelled_sample

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STEMS = (4, 5, 6, 7, 8)


def marks(text: str | None) -> set[str]:
    """Distinct lower-cased words, and beginnings of words of 4 to 8 letters written with a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


@dataclass
class Classifier:
    """``place``: mark to column; logistic weights on which marks a text holds, and on the sum and the largest of their
    log odds (``worth``)."""

    place: dict[str, int]
    worth: np.ndarray
    weights: np.ndarray
    bias: float

    def hits(self, text: str | None) -> list[int]:
        if not self.place:
            return []
        words, place = set(WORD.findall((text or "").lower())), self.place
        found = [place[w] for w in words if w in place]
        stems = {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}
        return found + [place[s] for s in stems if s in place]

    def row(self, hits: list[int]) -> np.ndarray:
        x = np.zeros(len(self.worth) + 2)
        x[hits] = 1.0
        if hits:
            x[-2:] = min(30.0, self.worth[hits].sum()) / 10, self.worth[hits].max() / 3
        return x

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.row(self.hits(text)) @ self.weights + self.bias, -60, 60))))


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 30, trust: float = 0.95) -> np.ndarray:
    """Posterior probability of the hidden label for each row of ``votes`` (0/1, a column per voter).

    ``y`` is the human label, a voter whose accuracy starts at ``trust`` and is estimated like the others. A voter's
    evidence is divided by one plus its positive correlations with the other voters inside the classes.
    """
    v, n = votes.astype(np.float64), len(votes)
    p = np.where(y == 1, trust, 1 - trust)
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-4, 1 - 1e-4)
        on = (v.T @ p + 0.5) / (p.sum() + 1.0)
        off = (v.T @ (1 - p) + 0.05) / ((1 - p).sum() + 1.0)
        rest = v - np.outer(p, on) - np.outer(1 - p, off)
        cov = rest.T @ rest / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        share = 1 / (1 + np.maximum(corr - 0.1, 0).sum(1) - np.maximum(np.diag(corr) - 0.1, 0))
        hit = np.clip((p @ (y == 1)) / max(p.sum(), 1e-9), 0.5, 0.999)
        clear = np.clip(((1 - p) @ (y == 0)) / max((1 - p).sum(), 1e-9), 0.5, 0.999)
        logit = np.log(prior / (1 - prior)) + v @ (share * np.log(on / off)) + (1 - v) @ (share * np.log((1 - on) / (1 - off)))
        logit += np.where(y == 1, np.log(hit / (1 - clear)), np.log((1 - hit) / clear))
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 0.02, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights, none below 0, and bias that minimise the cross entropy to the soft labels ``p``.

    Newton's method on the weights in use; those that come out negative are set to 0 and the rest fitted again,
    since a mark can only speak for toxicity. The bias is free.
    """
    a, use = np.hstack([x, np.ones((len(x), 1))]), np.ones(x.shape[1] + 1, bool)
    w = np.zeros(a.shape[1])
    while True:
        z, v = a[:, use], w[use]
        pull = np.full(len(v), ridge)
        pull[-1] *= 1e-3
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(z @ v, -40, 40)))
            hess = (z * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ z + np.diag(pull)
            step = np.linalg.solve(hess, z.T @ (q - p) + pull * v)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            v = v - step
            if np.abs(step).max() < 1e-7:
                break
        w[:] = 0
        w[use] = v
        below = (w < 0) & use
        below[-1] = False
        if not below.any():
            return w[:-1], float(w[-1])
        w[below], use = 0, use & ~below


def _voters(sample: DataFrame, n: dict[int, int], most: int) -> pd.DataFrame:
    """(mark, toxic, clean): the marks with the strongest evidence, at most ``most``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for y, t in zip(b["y"], b["text"]):
                seen[int(y)].update(marks(t))
            names = list(seen[0].keys() | seen[1].keys())
            if not names:  # Arrow can't make texts of an empty frame
                continue
            yield pd.DataFrame({"mark": names, "toxic": [seen[1][m] for m in names], "clean": [seen[0][m] for m in names]})

    counted = (sample.select("y", "text").mapInPandas(run, "mark string, toxic long, clean long")
               .groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    pt, pc = (F.col("toxic") + 0.5) / (n[1] + 1), (F.col("clean") + 1) / (n[0] + 1)
    odds = F.log(pt / pc)
    sure = (F.col("toxic") >= max(4, n[1] // 200)) & (odds > np.log(20.0))
    return (counted.where(sure).withColumn("odds", odds)
            .orderBy(F.desc(F.col("toxic") * F.col("odds")), "mark").limit(most).toArrow().to_pandas())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed: Column | None = None,
        per_class: int = 10_000, voters: int = 300, text: str = "text", id_col: str = "doc_id") -> Classifier | None:
    """Fit on at most ``per_class`` labelled documents of each class (a bounded sample by hash of the id) with at most
    ``voters`` marks. ``allowed`` is a condition on doc_id that labels must meet. None without both classes."""
    sample, counts = labelled_sample(docs, labels, label, per_class, allowed, text, id_col)
    sample = cut_lineage(sample)
    n = {0: 0, 1: 0} | {int(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n[0] or not n[1]:
        return None
    found = _voters(sample, n, voters)
    model = Classifier({m: i for i, m in enumerate(found["mark"])}, found["odds"].to_numpy(dtype=np.float64), None, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "y": b["y"], "hits": [model.hits(t) for t in b["text"]]})

    rows = sample.mapInPandas(run, "doc_id string, y int, hits array<int>").toArrow().to_pandas().sort_values("doc_id", kind="stable")
    x = np.stack([model.row(list(h)) for h in rows["hits"]])
    y = rows["y"].to_numpy()
    posterior = label_model(x[:, :-2], y) if len(found) else y.astype(np.float64)
    model.weights, model.bias = logistic(x, posterior)
    return model


def score(docs: DataFrame, model: Classifier | None, text: str = "text") -> DataFrame:
    """(row, score): all columns of ``docs`` in ``row``, the toxicity of the whole text from 0 to 1. Without a model every
    score is 0. Null and empty texts hold no mark; an empty table gives none."""
    rows = packed(docs)
    if model is None:
        return rows.withColumn("score", F.lit(0.0))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return rows.withColumn("score", of(F.col("row").getField(text)))
