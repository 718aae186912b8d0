"""Filter interaction audit: what every order of a set of filters keeps and removes, by Lehmer-rank difference arrays.

Filters are numbered; a document's mask says which of them it fails. The orders of k filters, sorted, have the ranks 0
to k! - 1 (their Lehmer codes read as numbers in the factorial base), and the orders that begin with the same s
filters are an interval of (k - s)! ranks. What happens to a mask at step s depends on the first s filters only: it
was removed before, is removed there, or passes. So each mask adds its count at the start of every such interval and
takes it off at the end, per step; running sums over the ranks then give the totals of all orders at once. A table
of any size enters as one row of counts per part and mask.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.llm.common import stored

#: What a filter's step does to a document, as columns of the difference arrays.
KEPT, REMOVED, REDUNDANT = "kept", "removed", "redundant"


def prefix_rank(prefix: tuple[int, ...], k: int) -> int:
    """The rank of the first of the orders of 0..k-1 that begin with ``prefix``: its Lehmer digits times factorials."""
    left, rank = list(range(k)), 0
    for s, f in enumerate(prefix):
        digit = left.index(f)
        rank += digit * math.factorial(k - 1 - s)
        left.pop(digit)
    return rank


def intervals(k: int) -> list[tuple[int, int, str, int, int]]:
    """(mask, step from 1, what, first rank, end rank) for all masks of ``k`` filters; intervals that touch are one."""
    found = defaultdict(list)
    for s in range(1, k + 1):
        for prefix in permutations(range(k), s):  # sorted, so the intervals of a mask come in order
            lo = prefix_rank(prefix, k)
            hi = lo + math.factorial(k - s)
            earlier, own = sum(1 << f for f in prefix[:-1]), 1 << prefix[-1]
            for mask in range(1 << k):
                what = (REDUNDANT if mask & earlier else REMOVED) if mask & own else KEPT if not mask & earlier else None
                spans = found[mask, s, what]
                if spans and spans[-1][1] == lo:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
    return [(mask, s, what, lo, hi) for (mask, s, what), spans in found.items() if what for lo, hi in spans]


def _small(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table that the number of filters alone decides, as a broadcast."""
    return F.broadcast(spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows)))))))


def failure_counts(docs: DataFrame, failures: list[str], part: Column, flags: dict[str, Column],
                   flag_rows: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, one count per flag): documents by the filters that they fail; bit i of ``mask`` is failures[i].

    ``failures`` are SQL conditions on the columns ``text`` (null texts as empty) and ``words`` (a struct of their number and
    that of the different ones). The last bit, after them, is set where a document's whole text is that of a row with
    a smaller id; a null id is greater than any other, rows of equal id and text are copies of none. ``flags`` are
    conditions on the columns of ``flag_rows``, which are joined by id: a document has a flag if any row of its id says
    so. Equality of texts is that of 128 bits of hash and the length.
    """
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), part.alias("part"), body.alias("text"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    rows = rows.withColumn("all_words", words)
    rows = rows.withColumn("words", F.struct(F.size("all_words").alias("n"),
                                             F.size(F.array_distinct("all_words")).alias("different")))
    mask = sum((F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures)), F.lit(0))
    narrow = rows.select("id", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text", F.char_length("text")).alias("h2"),
                         mask.alias("mask"))
    # rows without an id match no flag; a number deals them out evenly
    deal = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("h1", F.monotonically_increasing_id()), F.lit(1 << 20))).otherwise(F.lit(0))
    names = [f"f{i}" for i in range(len(flags))]
    if flag_rows is not None:
        known = (flag_rows.select(flag_rows[f"`{id_col}`"].alias("id"), *[c.alias(n) for n, c in zip(names, flags.values())])
                 .where(F.col("id").isNotNull()).groupBy("id")
                 .agg(*[F.max(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in names]).withColumn("deal", F.lit(0).cast("long")))
        narrow = narrow.withColumn("deal", deal.cast("long")).join(known, ["id", "deal"], "left").drop("deal")
    narrow = narrow.select("id", "part", "h1", "h2", "mask", *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names])
    # A text's rows that agree in everything but the id are a row each, with their smallest id and how often it occurs.
    # Equal ids are counted where the join above has put them together; hot texts then meet as partial counts.
    alike = ["h1", "h2", "part", "mask", *names]
    kinds = (narrow.groupBy("id", *alike).agg(F.count(F.lit(1)).alias("n"))
             .groupBy(*alike).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("at_first")))
    first = F.min("first").over(Window.partitionBy("h1", "h2"))
    kinds = kinds.withColumn("least", first).withColumn("originals", F.when(F.col("least").isNull(), F.col("n")).otherwise(
        F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(F.lit(0))))
    copy_bit = F.lit(1 << len(failures))
    sides = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
                              F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))))
    counted = kinds.select("part", *names, sides.alias("x")).select("part", *names, "x.*").where("n > 0")
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[
        F.sum(F.when(F.col(n), F.col("n")).otherwise(F.lit(0))).alias(own) for n, own in zip(names, flags)])


def orders(counts: DataFrame, letters: str, flags: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <flag>_lost, shapley) for every part, order and
    step, zeros included, from the ``counts`` (part, mask, n, flags) of :func:`failure_counts`.

    ``letters`` name the filters, bit 0 first; orders are sorted by them. ``kept`` documents are left after the step,
    ``removed`` go there, ``redundant`` fail its filter but went before, ``unique_fails`` fail no other; ``<flag>_lost``
    are the removed ones that have the flag; ``shapley`` are all that the step's filter removes in all orders.
    """
    spark, k = counts.sparkSession, len(letters)
    total = math.factorial(k)
    counts = stored(counts, "mask-counts")
    spans = _small(spark, intervals(k), ["mask", "step", "what", "lo", "hi"])
    singles = F.array(*[F.lit(1 << i) for i in range(k)])
    measures = {w: F.when(F.col("what") == w, F.col("n")) for w in (KEPT, REMOVED, REDUNDANT)}
    removed = F.col("what") == REMOVED
    measures["unique_fails"] = F.when(removed & F.array_contains(singles, F.col("mask")), F.col("n"))
    measures |= {f"{f}_lost": F.when(removed, F.col(f"`{f}`")) for f in flags}
    ends = F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")),
                             F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign"))))
    hits = counts.join(spans, "mask").select("part", "step", ends.alias("end"),
                                             *[F.coalesce(c, F.lit(0)).alias(m) for m, c in measures.items()])
    hits = hits.select("part", "step", "end.rank", *[(F.col(m) * F.col("end.sign")).alias(m) for m in measures])
    ranks = F.explode(F.expr(f"sequence(0L, {total - 1}L)")).alias("rank")
    steps = F.explode(F.expr(f"sequence(1L, {k}L)")).alias("step")
    places = (counts.select("part").distinct().select("part", steps)
              .select("part", "step", ranks, *[F.lit(0).cast("long").alias(m) for m in measures]))
    changes = places.unionByName(hits).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in measures])
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = changes.select("part", "step", "rank", *[F.sum(m).over(so_far).alias(m) for m in measures])
    named = _small(spark, [(r, "".join(letters[f] for f in p)) for r, p in enumerate(permutations(range(k)))],
                   ["rank", "filter_order"])
    out = sums.join(named, "rank")  # the end of the last interval has no order
    own = F.substring(F.col("filter_order"), F.col("step").cast("int"), F.lit(1))
    shapley = F.sum(REMOVED).over(Window.partitionBy("part", own))
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *measures, shapley.alias("shapley"))


def audit(docs: DataFrame, filters: dict[str, str], copies: str, part: Column, flags: dict[str, Column] | None = None,
          flag_rows: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The table of :func:`orders` for ``filters`` (one letter each, with its failure condition, see
    :func:`failure_counts`) and the filter ``copies`` (a letter) that removes copies of other documents.

    The letters are taken in their order in ``filters``, ``copies`` last. Null parts are a part of their own where ``part``
    doesn't name them; null texts are empty; repeated rows count as often as they occur; columns of ``docs`` that
    aren't asked for play no role; an empty table gives an empty result.
    """
    letters, flags = "".join(filters) + copies, flags or {}
    if len(set(letters)) != len(filters) + 1 or list(letters) != sorted(letters):
        raise ValueError("filters need different single letters in ascending order, the one of copies last")
    counts = failure_counts(docs, list(filters.values()), part, flags, flag_rows, text, id_col)
    return orders(counts, letters, list(flags))


__all__ = ["audit", "failure_counts", "intervals", "orders", "prefix_rank"]
