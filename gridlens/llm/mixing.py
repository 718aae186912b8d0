"""Mixing sources to target weights along a curriculum: weight schedules over training time become positions.

Every source has a schedule, points (time, weight) with time from 0 to 1, straight lines between them. Its integral
is the source's weight. The weights share the token budget; a source stops at ``max_repeats`` times its own size and
what it leaves is shared again by weight. The integral up to time t, scaled to the source's target, is its
cumulative token demand; a document's first token, counted in the source's own order, is looked up on the inverse
of that curve, which gives the document's training position. Documents are then range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import cut_lineage, hash63, prefix_sums, sized_broadcast, stored
from gridlens.operators.sorting import global_rank

#: Rows of the per-source table up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000

Schedule = list[tuple[float, float]]


def word_count(c: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(t0, w0, slope, area before t0, area of the piece) per straight piece; level before the first and after the
    last point."""
    pts = sorted(schedule)
    if not pts or any(w < 0 for _, w in pts) or not any(w > 0 for _, w in pts):
        raise ValueError("a schedule needs points with weights of 0 or more, not all 0")
    pts = [(0.0, pts[0][1]), *[p for p in pts if 0 < p[0] < 1], (1.0, pts[-1][1])]
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(pts, pts[1:]):
        if t1 > t0:
            own = (w0 + w1) / 2 * (t1 - t0)
            out.append((t0, float(w0), (w1 - w0) / (t1 - t0), before, own))
            before += own
    return out


def weight(schedule: Schedule) -> float:
    """The schedule's integral over the whole training."""
    return sum(p[4] for p in pieces(schedule))


def invert(done: Column, schedule: Schedule) -> Column:
    """The time at which the schedule's integral reaches the share ``done`` (0 to 1) of its whole."""
    want, time = done * F.lit(weight(schedule)), F.lit(1.0)
    for t0, w0, slope, before, own in reversed(pieces(schedule)):
        rest = F.greatest(want - F.lit(before), F.lit(0.0))
        # w0*x + slope*x*x/2 = rest, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        x = F.coalesce(F.try_divide(2 * rest, F.lit(w0) + root), F.lit(0.0))
        time = F.when(rest <= F.lit(own), F.lit(t0) + x).otherwise(time)
    return F.least(time, F.lit(1.0))


def targets(sizes: DataFrame, schedules: list[Schedule], share: float, max_repeats: float,
            assign: dict[str, int] | None = None) -> DataFrame:
    """(skey, source, source_size, sched, target) for ``sizes`` (skey, source, source_size).

    Sources take the schedules in turn, in order of code point, null last; ``assign`` names a schedule by source.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "nth")
    turn = ((F.col("nth") - 1) % len(schedules)).cast("int")
    for name, k in (assign or {}).items():
        turn = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(k)).otherwise(turn)
    w = F.coalesce(*[F.when(F.col("sched") == k, F.lit(weight(s))) for k, s in enumerate(schedules)])
    table = cut_lineage(ranked.withColumn("sched", turn).withColumn("w", w)
                        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))))
    # Level at which the weights share the budget: sources that reach their cap leave, the rest share what is left.
    level, budget = -1.0, share * (table.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        left = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("taken"),
                         F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("w"))).alias("w")).first()
        new = (budget - left["taken"]) / left["w"] if left["w"] else math.inf
        if not left["w"] or new <= level:
            break
        level = new
    target = F.least(F.col("cap"), F.lit(max(level, 0.0)) * F.col("w"))
    return cut_lineage(table.select("skey", "source", "source_size", "sched",
                                    F.coalesce(target, F.lit(0.0)).alias("target")))


def _rows(docs: DataFrame, keep: list[str], text: str, source: str, id_col: str) -> DataFrame:
    """(row, size, source, skey, at): the ``keep`` columns in ``row``, the words, the source and its key, the place in the
    source's own order."""
    src, own, body = docs[f"`{source}`"].cast("string"), docs[f"`{id_col}`"], docs[f"`{text}`"]
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), word_count(body).alias("size"),
                       src.alias("source"), F.coalesce(F.concat(F.lit("="), src), F.lit("")).alias("skey"),
                       hash63(own, body).alias("at"))


def demand(rows: DataFrame, schedules: list[Schedule], share: float = 1.5, max_repeats: float = 2.0,
           assign: dict[str, int] | None = None) -> DataFrame:
    """(row, size, source_size, sched, target, start) for ``rows`` of :func:`_rows`: ``start`` counts the words of the same
    source that come before the document in the source's own order, which is that of a hash of id and text."""
    sizes = rows.groupBy("skey").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"),
                                     F.count("*").alias("docs"))
    sizes = cut_lineage(sizes)
    known = sizes.agg(F.count("*").alias("sources"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
    table = targets(sizes.drop("docs"), schedules, share, max_repeats, assign).drop("source")
    ordered = prefix_sums(rows, "skey", "at", "size", "start", known["docs"])
    return (ordered.join(sized_broadcast(table, known["sources"], BROADCAST_SOURCES), "skey")
            .select("row", "size", "source_size", "sched", "target", "start"))


def _words_left(nth: Column) -> Column:
    """Words of the target that are left for a document when it comes up the ``nth`` time (from 0)."""
    return F.round("target").cast("long") - nth * F.col("source_size") - F.col("start")


def taken_in_pass(nth: Column, whole: bool) -> Column:
    """Words taken when the document comes up the ``nth`` time: its size, none, or where the target ends inside it
    the rest of the target (``whole``: all or none, whichever is nearer)."""
    left = _words_left(nth)
    if whole:
        return F.when(left > F.col("size") / 2, F.col("size")).otherwise(F.lit(0)).cast("long")
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")


def position_in_pass(nth: Column, schedules: list[Schedule]) -> Column:
    done = F.coalesce(F.try_divide(nth * F.col("source_size") + F.col("start"), F.col("target")), F.lit(0.0))
    return F.coalesce(*[F.when(F.col("sched") == k, invert(done, s)) for k, s in enumerate(schedules)])


def mix(docs: DataFrame, schedules: list[Schedule], share: float = 1.5, max_repeats: float = 2.0,
        assign: dict[str, int] | None = None, text: str = "text", source: str = "source",
        id_col: str = "doc_id") -> DataFrame:
    """(row, position, nth): the whole documents that training takes, a row for each time, range-sorted by position.

    ``row`` holds all columns of ``docs``. Documents are taken whole, so a source's words miss its target by half a
    document at the most. Null sources are a source of their own; documents without words take no part of any
    budget and come with the words that follow them; an empty table gives an empty result. Reruns agree.
    """
    times = F.explode(F.sequence(F.lit(0), F.lit(max(1, math.ceil(max_repeats)) - 1)))
    rows = _rows(docs, docs.columns, text, source, id_col)
    placed = demand(rows, schedules, share, max_repeats, assign).withColumn("nth", times)
    nth = F.col("nth")
    fits = F.when(F.col("size") > 0, taken_in_pass(nth, True) > 0).otherwise((_words_left(nth) > 0) & (nth == 0))
    placed = placed.where(fits).withColumn("position", position_in_pass(nth, schedules))
    spread = F.xxhash64(F.col("row").getField(id_col), "nth")
    return placed.select("row", "position", "nth", spread.alias("tie")).orderBy("position", "tie").drop("tie")


def mix_words(docs: DataFrame, schedules: list[Schedule], share: float = 1.5, max_repeats: float = 2.0,
              text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Per document: (doc_id, size, source_size, target, taken, position), sorted by position, those not taken last.

    ``taken`` are the words that the mix takes of it, repeats counted: the last document of a source is cut where
    the source's target ends. ``position`` is the training time (0 to 1) of its first word, null if not taken.
    """
    # the texts are read once; all that follows works on what is written here
    rows = stored(_rows(docs, [id_col], text, source, id_col), "mix-rows")
    full = demand(rows, schedules, share, max_repeats)
    taken = sum([taken_in_pass(F.lit(k), False) for k in range(1, math.ceil(max_repeats))],
                taken_in_pass(F.lit(0), False))
    out = full.select(F.col("row").getField(id_col).alias("doc_id"), "size", "source_size", "target",
                      taken.alias("taken"), position_in_pass(F.lit(0), schedules).alias("position"))
    return (out.withColumn("position", F.when(F.col("taken") > 0, F.col("position")))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))
