"""SimHash near-dedup: exact comparison of all fingerprints, tile against tile.

A document's fingerprint is the bit-wise majority of the XXH64 hashes of its word shingles. Distinct fingerprints
are sorted by population count (whole word first, then by octet) and cut into tiles. The population counts of two
fingerprints within ``radius`` bits differ by ``radius`` at the most, in total and summed over the octets, so a
pair of tiles (and inside a task, of sub-tiles) whose ranges of counts lie further apart is skipped unread. What is
left is compared with numpy exclusive-or and bit counts. A task keeps the links it finds as a union of labels and
returns one link per fingerprint, so a group of thousands of near copies gives thousands of rows, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import cut_lineage, packed, shuffle_partitions, text_table
from gridlens.llm.components import components

TILE, SUB = 8192, 256
OCTETS = [f"o{i}" for i in range(8)]


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash. A-Z lower-cased, words between ASCII white space, shingles counted as often as they
    occur; fewer words than a shingle: the whole sequence; no word (empty, blank or null text): 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    stop = ends[k - 1:].tolist()
    start = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for i in range(0, len(stop), block):  # a very long text takes bounded memory
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(start[i:i + block], stop[i:i + block])), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = votes * 2 > len(stop)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, fp): the hash of the whole text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "fp": fp})

    kind = dict(docs.dtypes)[id_col]
    narrow = text_table(docs, id_col, text).toDF("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    return narrow.mapInPandas(run, f"doc_id {kind}, text_key long, fp long")


def _octet_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8).reshape(-1, 8))


def _tiles(fps: DataFrame, n: int) -> DataFrame:
    """Rows (tile, fps, low/high total, low/high of each octet), at most TILE fingerprints a row."""
    x = F.col("fp")
    octets = [F.bit_count(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))) for i in range(8)]
    keyed = fps.select(x, F.bit_count(x).alias("p"), *[o.alias(c) for o, c in zip(octets, OCTETS)])
    parts = max(1, -(-n // TILE))
    dealt = keyed.repartitionByRange(parts, "p", *OCTETS, "fp").sortWithinPartitions("p", *OCTETS, "fp").select("fp")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = np.empty(0, np.int64)

        def row(t: np.ndarray) -> dict:
            o = _octet_counts(t)
            p = o.sum(1, dtype=np.int64)
            return {"fps": t.tobytes(), "lo": int(p.min()), "hi": int(p.max()),
                    "box": np.concatenate([o.min(0), o.max(0)]).astype(np.int32).tolist()}

        for b in batches:
            left = np.concatenate([left, b["fp"].to_numpy()])
            while len(left) >= TILE:
                yield pd.DataFrame([row(left[:TILE])])
                left = left[TILE:]
        if len(left):
            yield pd.DataFrame([row(left)])

    rows = dealt.mapInPandas(cut, "fps binary, lo int, hi int, box array<int>")
    return cut_lineage(rows.withColumn("tile", F.monotonically_increasing_id()))


def _box_gap(a: str, b: str):
    """Least difference that two boxes of octet counts allow."""
    gap = F.lit(0)
    for i in range(8):
        gap = gap + F.greatest(F.lit(0), F.expr(f"{a}[{i}] - {b}[{8 + i}]"), F.expr(f"{b}[{i}] - {a}[{8 + i}]"))
    return gap


class _Labels:
    """Union of labels over array positions; labels are positions."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            up = np.arange(len(self.of))
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(nxt := up[up], up):
                up = nxt
            self.of = up[self.of]


def _boxes(fps: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    at = list(range(0, len(fps), SUB))
    o = _octet_counts(fps).astype(np.int16)
    return at, np.minimum.reduceat(o, at, axis=0), np.maximum.reduceat(o, at, axis=0)


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, label) that join exactly what the links within ``radius`` bits between ``a`` and ``b``
    (or inside ``a``, if ``same``) join: one for each fingerprint that has any, but its label's own."""
    both = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    labels = _Labels(len(both))
    ia, la, ha = _boxes(a)
    ib, lb, hb = _boxes(b)
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    for k, s in enumerate(ia):
        gap = np.maximum(np.maximum(la[k] - hb, lb - ha[k]), 0).sum(1)
        for m in np.nonzero(gap <= radius)[0]:
            if same and m < k:
                continue
            t = ib[m]
            near = np.bitwise_count(ua[s:s + SUB, None] ^ ub[None, t:t + SUB]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                labels.link(i + s, j + t + shift)
    linked = labels.of != np.arange(len(both))
    return both[linked], both[labels.of[linked]]


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps.fp`` whose components are those of "within ``radius`` bits"."""
    spark = fps.sparkSession
    n = fps.count()
    tiles = _tiles(fps, n)
    head = tiles.select("tile", "lo", "hi", "box")
    left = head.select(F.col("tile").alias("a"), F.col("box").alias("abox"), F.explode(F.sequence("lo", "hi")).alias("p"))
    right = head.select(F.col("tile").alias("b"), F.col("box").alias("bbox"),
                        F.explode(F.sequence(F.col("lo") - radius, F.col("hi") + radius)).alias("p"))
    pairs = (left.join(right, "p").where(F.col("a") <= F.col("b")).where(_box_gap("abox", "bbox") <= radius)
             .select("a", "b").distinct())
    pairs = (pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a")
             .join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b"))
    pairs = pairs.repartition(max(shuffle_partitions(spark), -(-n // TILE)), "a", "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y, fx, fy in zip(batch["a"], batch["b"], batch["fa"], batch["fb"]):
                u, v = tile_links(np.frombuffer(fx, np.int64), np.frombuffer(fy, np.int64), x == y, radius)
                if len(u):
                    yield pd.DataFrame({"a": u, "b": v})

    return pairs.mapInPandas(compare, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int, text: str, id_col: str) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id), one row per document."""
    docs_fp = cut_lineage(with_fingerprint(docs, shingle, text, id_col))
    nodes = cut_lineage(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut_lineage(components(near_links(nodes.select("fp"), radius)))
    rooted = (nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(rooted.join(least, "root").select("fp", "root", "component_id"))
    return docs_fp.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4, text: str = "text",
               id_col: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, fp, component_id), repeated rows included.

    Documents link where their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest
    id reachable over links, the document itself included (null only where no document of the group has an id).
    Equal fingerprints are one node. Null, empty and blank texts have fingerprint 0 and link like any other. Columns
    other than the two named are not read. An empty table gives an empty result.
    """
    return _grouped(docs, shingle, radius, text, id_col).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, text: str = "text",
             id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns as they are.

    The document with the smallest id stays (documents without an id come last, equal ids by the hash of the text);
    of rows that repeat both its id and its text one stays.
    """
    groups = _grouped(docs, shingle, radius, text, id_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    keep = cut_lineage(groups.groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.text_key"))
    rows = packed(docs).withColumn("text_key", F.xxhash64(F.col("row").getField(text)))
    stay = rows.join(keep.toDF("keep_id", "keep_key"),
                     F.col("row").getField(id_col).eqNullSafe(F.col("keep_id"))
                     & (F.col("text_key") == F.col("keep_key")))
    return stay.dropDuplicates(["keep_id", "keep_key"]).select("row.*")
