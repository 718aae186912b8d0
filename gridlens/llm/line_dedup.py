"""Line dedup: runs of lines that occurred before are deleted, found with a suffix array over line ids.

Lines get ids in the order of their hashes; positions (document, line) are ranked by the id sequence that starts
there, by prefix doubling: the rank over 2k lines is the rank of the pair (rank over k lines here, rank over k lines
k further on), by a distributed sort. Positions of one rank are an interval of the suffix array whose longest common
prefix is at least that many lines; one that is alone in its interval can't begin a longer repeated run and leaves,
so each round handles the positions inside repeated runs only. Of every interval deep enough to count as a repeated
run, all positions but the first in document order start a later copy, and the lines of later copies go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import attach_marks, document, stored
from gridlens.operators.sorting import global_rank

PLACE = ["doc", "pos"]


def _count_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+"))


def line_table(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, pos, h, g, n): a line's place, its two hashes and its words. ``doc`` orders the documents: by id, null
    last, then by the hash of the text; rows that repeat both are told apart by a row number."""
    body, own = docs[f"`{text}`"], docs[f"`{id_col}`"]
    numbered = docs.select(document(body, own).alias("doc"), F.monotonically_increasing_id().alias("rid"),
                           body.alias("body")).withColumn("doc", F.struct("doc.*", "rid"))  # numbered before lines multiply the rows
    each = numbered.select("doc", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    return stored(each.select("doc", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"),
                              _count_words(F.col("line")).alias("n")), "lines")


def _ranked(positions: DataFrame, by: list[str], keep: list[str], name: str) -> DataFrame:
    """Positions that share ``by`` with another, with the rank of their class ``r`` and its first place ``first``.

    The classes are counted with a map-side aggregate and ranked by a range sort, not in one task.
    """
    first = F.min(F.struct(*PLACE)).alias("first")
    classes = positions.groupBy(*by).agg(F.count("*").alias("copies"), first).where("copies > 1").drop("copies")
    ranks = stored(global_rank(classes, [F.col(c) for c in by], "rank"), f"{name}-ranks")
    return stored(positions.join(ranks, by).select(*PLACE, F.col("rank").alias("r"), "first", *keep), name)


def _shifted(ranks: DataFrame, by: int, *cols: str) -> DataFrame:
    """``ranks`` seen from ``by`` lines earlier, columns with 2 appended."""
    return ranks.select("doc", (F.col("pos") - by).alias("pos"), *[F.col(c).alias(f"{c}2") for c in cols])


def suffix_ranks(lines: DataFrame, to: int | None = None) -> list[DataFrame]:
    """The ladder of ranks over 1, 2, 4, ... lines, (doc, pos, r, first, n), repeated positions only; up to ``to``
    lines, or until no run is repeated."""
    ladder, k = [_ranked(lines, ["h", "g"], ["n"], "rank-1")], 1
    while to is None or 2 * k <= to:
        here = ladder[-1]
        pairs = here.join(_shifted(here, k, "r", "n"), PLACE).select(
            *PLACE, "r", "r2", (F.col("n") + F.col("n2")).alias("n"))
        deeper = _ranked(pairs.withColumnRenamed("r", "r1"), ["r1", "r2"], ["n"], f"rank-{2 * k}")
        if deeper.isEmpty():
            break
        ladder.append(deeper)
        k *= 2
    return ladder


def _later_copies(ladder: list[DataFrame], length: int, min_words: int | None) -> DataFrame:
    """(doc, pos) where a run of exactly ``length`` lines starts that started before, elsewhere or earlier."""
    level = length.bit_length() - 1
    if level >= len(ladder):
        return ladder[0].select(*PLACE, F.lit(length).alias("length")).limit(0)
    runs, rest = ladder[level], length - (1 << level)
    if rest:  # the interval of a depth between two powers is that of two overlapping runs
        pairs = runs.join(_shifted(runs, rest, "r"), PLACE).select(*PLACE, F.col("r").alias("r1"), "r2", "n")
        runs = _ranked(pairs, ["r1", "r2"], ["n"], f"runs-{length}")
    if min_words:
        runs = runs.where(F.col("n") >= min_words)
    return runs.where(F.col("first") != F.struct(*PLACE)).select(*PLACE, F.lit(length).alias("length"))


def repeated_lines(lines: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc, pos) of the lines inside later copies of runs of ``min_lines`` lines, or fewer with ``min_words`` words.

    Every longer repeated run is the union of its windows of ``min_lines``, so the maximal runs come out whole.
    """
    ladder = suffix_ranks(lines, min_lines)
    starts = _later_copies(ladder, min_lines, None)
    for length in range(1, min_lines):
        starts = starts.union(_later_copies(ladder, length, min_words))
    inside = F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("pos")
    return starts.select("doc", inside).distinct()


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50, text: str = "text",
                id_col: str = "doc_id") -> DataFrame:
    """(row, text, n_lines, n_removed, longest_run), one row per document.

    ``row`` holds all its columns, ``text`` the text without the lines of repeated runs: a run of ``min_lines`` lines
    or more, or of fewer with ``min_words`` words or more, that already started earlier (in a document of smaller id, or
    further up in the same one) is deleted line by line, also where copies overlap. ``longest_run`` is the largest
    number of neighbouring lines deleted. Null texts have no line and stay null; an empty text is one empty line; rows
    that repeat id and text count as documents of their own; an empty table gives an empty result.
    """
    lines = line_table(docs, text, id_col)
    gone = repeated_lines(lines, min_lines, min_words)
    marks = gone.groupBy("doc").agg(F.struct(F.array_sort(F.collect_list("pos")).alias("gone")).alias("m"))
    plain = F.struct("doc.none", "doc.id", "doc.key").alias("doc")
    row, rid = F.col("row"), F.col("doc.rid").alias("rid")
    joined = attach_marks(docs, lines.where("pos = 0").select(plain, rid), marks.select(plain, rid, "m"), text, id_col)
    joined = joined.select("row", "m.gone")
    parts = F.split(row.getField(text), "\n", -1)
    n = F.coalesce(F.size(parts), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda i: F.get(parts, i))
    edges = F.aggregate("gone", F.struct(F.lit(-2).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best")),
                        lambda a, p: F.struct(p.alias("at"), F.when(p == a["at"] + 1, a["run"] + 1).otherwise(1).alias("run"),
                                              F.greatest(a["best"], F.when(p == a["at"] + 1, a["run"] + 1).otherwise(1)).alias("best")))
    return joined.select(
        "row", F.when(F.col("gone").isNull(), row.getField(text)).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.greatest(n, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(edges["best"], F.lit(0)).cast("long").alias("longest_run"))
