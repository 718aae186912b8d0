"""K-d tree sharding: split at weighted medians along the widest metadata dimension until leaves hold their share.

The units that are dealt out are groups of equal texts, so copies share a shard; only a group that alone outgrows a shard
is cut into pieces by the hash of its ids. Units above a small share of a shard are dealt out first, the largest to the
emptiest shard, and the tree splits the others by the room that is left. Every unit has one 63-bit key per dimension: the float32
image of its coordinate, then a hash of the unit, so that a value held by a third of the rows (a hot source) can be
split as well. A node of the tree is an interval of shard numbers. Its median is found without sorting: weights are
summed in bins of the key's range, the bin with the median is binned again, until it holds next to nothing. The
driver sees one row per node, never rows of the table.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import accumulate
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from gridlens.llm.common import cut_lineage, hash63, prefix_sums
from gridlens.operators.sorting import global_rank

BINS = 1024
#: Units above this share of a shard are dealt out before the tree; there are at most n_shards / HEAVY_SHARE of them.
HEAVY_SHARE = 0.02
#: The search for a median ends where the bin that holds it has less than this share of a shard.
SLACK = 0.001


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the text ``column`` as a coordinate: the place of its value among the different ones, by code point;
    null is before them all."""
    held = f"{column}__value"
    ranks = global_rank(rows.select(F.col(column).alias(held)).where(F.col(held).isNotNull()).distinct(), [F.col(held)], "place")
    out = rows.join(ranks, F.col(column) == F.col(held), "left")
    return out.withColumn(column, F.coalesce(F.col("place"), F.lit(-1)).cast("double")).drop(held, "place")


def _key(coordinate: Column, unit: Column, low: float, high: float) -> Column:
    """31 bits of the coordinate's place between the least and greatest, then 32 bits of the unit's hash."""
    span = (high - low) or 1.0
    place = F.floor((coordinate - F.lit(low)) / F.lit(span) * F.lit(float((1 << 31) - 1))).cast("long")
    return F.shiftleft(place, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(unit), 32))


def _local(spark, rows: list[dict], types: dict) -> DataFrame:
    """A small driver-side table (one row per node of the tree), as a broadcast."""
    return F.broadcast(spark.createDataFrame(pa.table({c: pa.array([r[c] for r in rows], t) for c, t in types.items()})))


def _chosen(dims: int) -> Column:
    """The key of the node's own dimension."""
    return F.coalesce(*[F.when(F.col("d") == d, F.col(f"k{d}")) for d in range(dims)])


def _median_bins(open_rows: DataFrame) -> list:
    """For each node (lo), the bin of the range [a, b] that its target weight falls into.

    Columns of a row: lo; x, a struct of first and last (least and greatest key in the bin), before (weight left of
    the bin, from the node's start) and inside (weight of the bin)."""
    step = F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a") + 1) / BINS)).cast("long")
    binned = (open_rows.where(F.col("key").between(F.col("a"), F.col("b")))
              .withColumn("bin", F.floor((F.col("key") - F.col("a")) / step).cast("long"))
              .groupBy("lo", "bin", "base", "goal")
              .agg(F.sum("weight").alias("inside"), F.min("key").alias("first"), F.max("key").alias("last")))
    w = Window.partitionBy("lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cum = binned.withColumn("before", F.col("base") + F.coalesce(F.sum("inside").over(w), F.lit(0)))
    hit = cum.where(F.col("before") <= F.col("goal"))
    return hit.groupBy("lo").agg(F.max_by(F.struct("first", "last", "before", "inside"), "bin").alias("x")).collect()


def _deal(heavy: list, n_shards: int) -> tuple[list[int], list[int]]:
    """(shard of each of the ``heavy`` (weight, ...), weight dealt to each shard): the largest goes to the emptiest."""
    loads = [(0, i) for i in range(n_shards)]
    shards = [0] * len(heavy)
    for k in sorted(range(len(heavy)), key=lambda k: (-heavy[k][0], heavy[k])):
        load, i = heapq.heappop(loads)
        shards[k] = i
        heapq.heappush(loads, (load + heavy[k][0], i))
    return shards, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def _split(units: DataFrame, n_shards: int, total: int, dims: int, room: list[float]) -> DataFrame:
    """(unit, piece, shard) for ``units`` (unit, piece, weight, k0..k<dims-1>), shares of the shards as their ``room``."""
    spark = units.sparkSession
    upto = [0.0, *accumulate(room)]
    slack = max(1.0, SLACK * total / n_shards)
    placed = units.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(n_shards))
    while True:
        wide = placed.where(F.col("hi") - F.col("lo") > 1).groupBy("lo", "hi").agg(
            F.sum("weight").alias("w"), *[f(f"k{d}").alias(f"{n}{d}") for d in range(dims)
                                          for f, n in ((F.min, "a"), (F.max, "b"))])
        nodes = {}
        for r in wide.collect():  # one row per node, so at most one per shard
            d = max(range(dims), key=lambda d: (r[f"b{d}"] - r[f"a{d}"], -d))
            mid = r["lo"] + (r["hi"] - r["lo"]) // 2
            nodes[r["lo"]] = {"lo": r["lo"], "mid": mid, "d": d, "a": r[f"a{d}"], "b": r[f"b{d}"], "base": 0,
                              "goal": r["w"] * _share(upto, r["lo"], mid, r["hi"]), "cut": None}
        if not nodes:
            return placed.select("unit", "piece", F.col("lo").alias("shard"))
        while todo := [n for n in nodes.values() if n["cut"] is None]:
            small = _local(spark, todo, {"lo": pa.int32(), "d": pa.int32(), "a": pa.int64(), "b": pa.int64(),
                                         "base": pa.int64(), "goal": pa.float64()})
            for r in _median_bins(placed.join(small, "lo").withColumn("key", _chosen(dims))):
                n, x = nodes[r["lo"]], r["x"]
                if x["first"] == x["last"] or x["inside"] <= slack:  # cut on the nearer side of the bin
                    n["cut"] = x["first"] if n["goal"] - x["before"] <= x["inside"] / 2 else x["last"] + 1
                else:
                    n |= {"a": x["first"], "b": x["last"], "base": x["before"]}
        cuts = _local(spark, list(nodes.values()), {"lo": pa.int32(), "mid": pa.int32(), "d": pa.int32(), "cut": pa.int64()})
        right = _chosen(dims) >= F.col("cut")
        # written down, so that the passes over the next level don't go through all levels before it
        placed = cut_lineage(placed.join(cuts, "lo", "left").select(
            "unit", "piece", "weight", *[f"k{d}" for d in range(dims)],
            F.when(right, F.col("mid")).otherwise(F.col("lo")).alias("lo"),
            F.when(right | F.col("mid").isNull(), F.col("hi")).otherwise(F.col("mid")).alias("hi")))


def _share(upto: list[float], lo: int, mid: int, hi: int) -> float:
    """What the shards [lo, mid) have of the room of [lo, hi)."""
    whole = upto[hi] - upto[lo]
    return (upto[mid] - upto[lo]) / whole if whole > 0 else (mid - lo) / (hi - lo)


def _unit(text: Column) -> Column:
    return F.xxhash64(text)


def _piece(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(doc_id, F.lit(7)), F.col("pieces")), F.lit(0)).cast("long")


def _plan(docs: DataFrame, n_shards: int | None, target_bytes: int | None, dims: tuple[str, ...], overhead: int,
          text: str, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows with their unit and piece, heavy units with their pieces, shard of each unit and piece, number of rows)."""
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give either n_shards or target_bytes")
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    size = F.octet_length(body).cast("long") + overhead
    texts = [f"c{i}" for i, d in enumerate(dims) if d != "size" and not _numeric(docs, d)]
    coords = [F.log1p(size.cast("double")) if d == "size" else docs[f"`{d}`"].cast("string") if f"c{i}" in texts
              else F.coalesce(F.nanvl(docs[f"`{d}`"].cast("double"), F.lit(0.0)), F.lit(-1.0)) for i, d in enumerate(dims)]
    rows = cut_lineage(docs.select(
        docs[f"`{id_col}`"].alias("doc_id"), size.alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        _unit(docs[f"`{text}`"]).alias("unit"), *[c.alias(f"c{i}") for i, c in enumerate(coords)]))
    for c in texts:
        rows = _ranked(rows, c)
    rows = cut_lineage(rows) if texts else rows
    ranges = [f(f"c{i}").alias(f"{n}{i}") for i in range(len(dims)) for f, n in ((F.min, "l"), (F.max, "h"))]
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), *ranges).first()
    n_shards = n_shards or max(1, -(-facts["total"] // target_bytes))
    # groups above a shard: at most n_shards of them, so the broadcast is bounded by the parameter
    cap = max(1.0, facts["total"] / n_shards)
    heavy = cut_lineage(rows.groupBy("unit").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
                        .where((F.col("s") > cap) & (F.col("c") > 1))
                        .select("unit", F.least(F.col("c"), F.ceil(F.col("s") / cap)).cast("long").alias("pieces")))
    rows = rows.join(F.broadcast(heavy), "unit", "left").withColumn("piece", _piece(F.col("doc_id"))).drop("pieces")
    least = [F.min(f"c{i}").alias(f"c{i}") for i in range(len(dims))]
    units = rows.groupBy("unit", "piece").agg(F.sum("size").alias("weight"), *least)
    whole = F.struct("unit", "piece")
    keys = [_key(F.col(f"c{i}"), whole, facts[f"l{i}"] or 0.0, facts[f"h{i}"] or 0.0).alias(f"k{i}")
            for i in range(len(dims))]
    units = cut_lineage(units.select("unit", "piece", "weight", *keys))
    large = F.col("weight") > HEAVY_SHARE * cap
    dealt = [(r["weight"], r["unit"], r["piece"]) for r in units.where(large).select("weight", "unit", "piece").collect()]
    shards, loads = _deal(dealt, n_shards)
    tree = _split(units.where(~large), n_shards, facts["total"], len(dims), [max(0.0, cap - x) for x in loads])
    first = _local(units.sparkSession, [{"unit": u, "piece": p, "shard": k} for (_, u, p), k in zip(dealt, shards)],
                   {"unit": pa.int64(), "piece": pa.int64(), "shard": pa.int32()})
    return rows, heavy, cut_lineage(tree.union(first)), facts["n"]


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None,
              dims: tuple[str, ...] = ("size", "source", "lang"), overhead: int = 8, text: str = "text",
              id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``; shard sizes come out near equal. Give the
    number of shards, or the bytes a shard may hold. ``dims`` are columns of ``docs`` ("size" is the size above). ``slot``
    counts 0, 1, 2, ... inside a shard in the order of a hash of the id. Equal texts share a shard unless they
    outgrow one. Null ids, texts and metadata are values like any other; an empty table gives an
    empty result. Reruns agree.
    """
    rows, _, shards, n = _plan(docs, n_shards, target_bytes, dims, overhead, text, id_col)
    dealt = rows.join(shards, ["unit", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", hash63(F.col("doc_id"), F.col("unit")).alias("at"), F.lit(1).alias("one"))
    out = prefix_sums(dealt, "shard", "at", "one", "slot", n)
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def with_shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None,
               dims: tuple[str, ...] = ("size", "source", "lang"), overhead: int = 8, text: str = "text",
               id_col: str = "doc_id", order: list[Column] | None = None) -> DataFrame:
    """``docs`` with the column ``shard`` of :func:`kd_shards` (one of that name is replaced).

    With ``order``, columns over ``docs`` that tell its rows apart, there is also ``slot``: the row's place in its shard in
    that order, from 0 without gaps; the rows come sorted by both. Nulls, repeated rows and an empty table are as in
    :func:`kd_shards`. The texts are shuffled by ``order`` and by shard; places are found without them.
    """
    _, heavy, shards, _ = _plan(docs, n_shards, target_bytes, dims, overhead, text, id_col)
    keep = [c for c in docs.columns if c.lower() not in (("shard", "slot") if order else ("shard",))]
    row, at = F.col("row"), [f"at{i}" for i in range(len(order or []))]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), *[c.alias(name) for c, name in zip(order or [], at)])
    units = rows.withColumn("unit", _unit(row.getField(text))).join(F.broadcast(heavy), "unit", "left")
    units = units.withColumn("piece", _piece(row.getField(id_col))).drop("pieces")
    if not at:
        return units.join(shards, ["unit", "piece"]).select("row.*", "shard")
    placed = global_rank(units.select(*at, "unit", "piece").join(shards, ["unit", "piece"]).select("shard", *at),
                         [F.col("shard"), *map(F.col, at)], "place")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    slots = placed.join(first, "shard").select("shard", (F.col("place") - F.col("first")).alias("slot"),
                                               *[F.col(c).alias(f"own_{c}") for c in at])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in at])
    return rows.join(slots, same).orderBy("shard", "slot").select("row.*", "shard", "slot")


__all__ = ["kd_shards", "with_shard"]
