"""Approximate nearest neighbours over learned partitions.

The neighbour graph of a bounded sample is cut into balanced partitions; a small classifier learns which partition a
vector belongs to, and files every vector under one. A second one learns where the neighbours of a vector are filed;
a query goes to its most probable partitions, as many as hold the wanted share of its neighbours, and is ranked there
by the exact inner product. So the partitions searched are few where the data has clusters and many where it has none. Partitions are held in blocks of bounded size, so one that
attracts a third of all vectors is many blocks, searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.llm.common import cut_lineage, stored

#: Vectors in a block of a partition, and queries in a block of queries.
BLOCK, QUERY_BLOCK = 4096, 1024


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, weights), n by k: the nearest rows of each row by inner product; weights fall with the rank."""
    ids = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        sim = x[s:s + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        ids[s:s + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1), 1)
    return ids, np.tile(1.0 / np.arange(1, k + 1), (len(x), 1))


def balanced_cut(ids: np.ndarray, weights: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Part of each node: the graph is halved again and again at the median of the second eigenvector of its random
    walk, found by power iteration, so parts differ by a node or so."""
    n, rng = len(ids), np.random.default_rng(seed)
    src, dst, w = np.repeat(np.arange(n), ids.shape[1]), ids.ravel(), weights.ravel()
    src, dst, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    part, count = np.zeros(n, np.int64), 1
    while count < parts:
        inside = part[src] == part[dst]
        s, d, e = src[inside], dst[inside], w[inside]
        degree = np.bincount(s, e, minlength=n) + 1e-9
        size = np.bincount(part, minlength=count)
        total = np.bincount(part, degree, minlength=count)
        v = rng.standard_normal(n)
        for _ in range(80):
            v -= (np.bincount(part, v * degree, minlength=count) / np.maximum(total, 1e-12))[part]
            v = (v + np.bincount(s, e * v[d], minlength=n) / degree) / 2
            norm = np.sqrt(np.bincount(part, v * v, minlength=count) / np.maximum(size, 1))
            v /= np.maximum(norm, 1e-12)[part]
        order = np.lexsort((v, part))
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        nth = np.empty(n, np.int64)
        nth[order] = np.arange(n) - first[part[order]]
        part = 2 * part + (nth >= (size[part] + 1) // 2)
        count *= 2
    return part


@dataclass
class Router:
    """A softmax over partitions, linear in the vector."""

    weights: np.ndarray
    bias: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        logit = x @ self.weights + self.bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def probable(self, x: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, partition): the fewest partitions that together have the probability ``mass``; 0 for just the first."""
        p = self.odds(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
        row, nth = np.nonzero((before < mass) | (np.arange(p.shape[1]) == 0))
        return row, order[row, nth]


def train_router(x: np.ndarray, target: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> Router:
    """Full-batch gradient descent with momentum on the cross entropy to the rows of ``target``, shares of partitions."""
    scale = max(1e-12, float(np.sqrt((x * x).sum(1).mean())))
    z, parts = x / scale * 8, target.shape[1]
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        p = (Router(w, b).odds(z) - target) / len(x)
        vw, vb = 0.9 * vw + z.T @ p + ridge * w, 0.9 * vb + p.sum(0)
        w, b = w - vw, b - vb
    return Router(w * 8 / scale, b)


def vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rid, id, v) of the vectors that take part: not null, no null or non-finite component, not zero, and of the
    length that most have. ``rid`` tells rows of one id apart."""
    rows = table.select(table[f"`{id_col}`"].cast("long").alias("id"), table[f"`{vector}`"].cast("array<float>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where("id is not null and v is not null").where(good & F.exists("v", lambda c: c != 0))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "v"), "vectors")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def fit(rows: DataFrame, parts: int = 32, sample: int = 8192, neighbours: int = 20) -> tuple[Router, Router] | None:
    """(filer, router) from at most ``sample`` vectors, a bounded sample by hash of the id."""
    found = rows.select("id", "rid", "v").orderBy(F.xxhash64("id"), "id", "rid").limit(sample).toArrow().to_pandas()
    if not len(found):
        return None
    x = np.stack(found["v"].to_numpy()).astype(np.float64)
    while parts > 1 and len(x) < 4 * parts:
        parts //= 2
    if parts == 1:
        one = Router(np.zeros((x.shape[1], 1)), np.zeros(1))
        return one, one
    ids, weights = neighbour_graph(x, min(neighbours, len(x) - 1))
    half = max(1, ids.shape[1] // 2)
    part = balanced_cut(ids[:, :half], weights[:, :half], parts)
    filer = train_router(x, np.eye(parts)[part])
    filed = filer.odds(x).argmax(1)
    near = np.stack([np.bincount(filed[i], minlength=parts) for i in ids]) / ids.shape[1]
    return filer, train_router(x, near)


def _routed(rows: DataFrame, router: Router, mass: float) -> DataFrame:
    """(part, rid, id, v), a row for each of a vector's most probable partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, part = router.probable(np.stack(b["v"].to_numpy()).astype(np.float64), mass)
                yield b.iloc[row].assign(part=part.astype(np.int32))[["part", "rid", "id", "v"]]

    return rows.mapInPandas(run, "part int, rid long, id long, v array<float>")


def _blocks(routed: DataFrame, rows: int, prefix: str) -> DataFrame:
    """(part, rids, ids, vs), at most about ``rows`` vectors in a row; the blocks of a partition are dealt by hash."""
    sizes = cut_lineage(routed.groupBy("part").agg(F.ceil(F.count("*") / rows).alias("pieces")))  # a row per partition
    cells = routed.join(F.broadcast(sizes), "part").withColumn("piece", F.pmod(F.xxhash64("rid"), F.col("pieces")))

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(b["v"].to_numpy()).astype(np.float32)
        return pd.DataFrame({"part": [key[0]], f"{prefix}rids": [b["rid"].to_numpy().tobytes()],
                             f"{prefix}ids": [b["id"].to_numpy().tobytes()], f"{prefix}vs": [v.tobytes()]})

    return (cells.select("part", "piece", "rid", "id", "v").groupBy("part", "piece")
            .applyInPandas(pack, f"part int, {prefix}rids binary, {prefix}ids binary, {prefix}vs binary"))


def _no_short(asked: DataFrame, queries: DataFrame, filed: DataFrame, k: int) -> DataFrame:
    """``asked``, but queries whose partitions hold at most ``k`` vectors (maybe their own) go to all partitions."""
    sizes = cut_lineage(filed.groupBy("part").agg(F.count("*").alias("n")))  # a row per partition
    reach = asked.select("part", "rid").join(F.broadcast(sizes), "part", "left").groupBy("rid").agg(F.sum("n").alias("n"))
    short = cut_lineage(reach.where(F.coalesce("n", F.lit(0)) <= k).select("rid"))
    if short.isEmpty():
        return asked
    everywhere = queries.join(short, "rid", "left_semi").crossJoin(F.broadcast(sizes.select("part")))
    return stored(asked.join(short, "rid", "left_anti").unionByName(everywhere.select(*asked.columns)), "asked-all")


def best_in_block(q: np.ndarray, qr: np.ndarray, x: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int):
    """For each query (its place, the places of the block's ``k`` best vectors but its own row, their scores), ties to
    the smaller id."""
    sim = q.astype(np.float64) @ x.astype(np.float64).T
    sim[qr[:, None] == r[None, :]] = -np.inf
    least = np.partition(sim, -k, axis=1)[:, -k] if k < len(r) else np.full(len(q), -np.inf)
    for i, s in enumerate(sim):
        at = np.nonzero((s >= least[i]) & (s > -np.inf))[0]
        at = at[np.lexsort((ids[at], -s[at]))][:k]
        yield i, at, s[at]


def search(table: DataFrame, is_query: Column, k: int = 20, parts: int = 32, mass: float = 0.95,
           sample: int = 8192, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, by inner product in double precision.

    ``is_query`` is a condition on ``id`` that picks the queries among the rows; candidates are all rows but the query's
    own. ``mass`` is the share of a query's neighbours that the partitions searched should hold; a query is searched in all where they can't
    hold ``k`` others, so it finds ``k`` or all candidates there are. ``rank`` counts from 1, ties go to the smaller id. Vectors that are null, zero, of odd length or hold a null or
    non-finite component take no part, nor do rows without an id; rows that repeat an id are rows of their own; an empty
    table gives none.
    """
    rows = vectors(table, id_col, vector)
    model = fit(rows, parts, sample)
    schema = "query_row long, query_id long, vec_id long, vec_row long, score double"
    if model is None:
        return (rows.sparkSession.createDataFrame([], schema)
                .select("query_id", F.lit(1).alias("rank"), "vec_id", "score"))
    filer, router = model
    filed = stored(_routed(rows, filer, 0.0), "filed")
    stock = _blocks(filed, BLOCK, "")
    queries = rows.where(is_query)
    asked = _blocks(_no_short(stored(_routed(queries, router, mass), "asked"), queries, filed, k), QUERY_BLOCK, "q")
    pairs = stored(asked, "queries").join(stored(stock, "stock"), "part")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                qr, qi = np.frombuffer(b.qrids, np.int64), np.frombuffer(b.qids, np.int64)
                r, ids = np.frombuffer(b.rids, np.int64), np.frombuffer(b.ids, np.int64)
                q = np.frombuffer(b.qvs, np.float32).reshape(len(qr), -1)
                x = np.frombuffer(b.vs, np.float32).reshape(len(r), -1)
                best = list(best_in_block(q, qr, x, r, ids, k))
                row = np.concatenate([np.full(len(at), i) for i, at, _ in best])
                at = np.concatenate([at for _, at, _ in best])
                yield pd.DataFrame({"query_row": qr[row], "query_id": qi[row], "vec_id": ids[at], "vec_row": r[at],
                                    "score": np.concatenate([s for _, _, s in best])})

    found = pairs.mapInPandas(compare, schema)
    nth = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return (found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
