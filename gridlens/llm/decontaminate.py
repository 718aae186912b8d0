"""Benchmark decontamination with a distributed positional inverted index.

Training documents are scanned once for the words of the benchmark; their places (document, position, term) are the
stored postings. Counting them orders the terms of every window (a run of consecutive words of a benchmark item)
from rare to common. The lists of a window's two rarest terms, shifted by the terms' offsets, are intersected; only
where both agree on a start is the rest of the phrase looked at, in the document itself. Windows with a term that no
document holds are gone before any list is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.llm.common import ascii_lower, cut_lineage, packed, sized_broadcast, stored

#: Rows of a benchmark-sized table (terms, anchors) up to which it is broadcast; beyond, Spark joins by shuffle.
BROADCAST_TERMS = 500_000
#: Candidate places up to which they are broadcast to the documents; beyond, documents are joined by shuffle.
BROADCAST_PLACES = 200_000
#: Lists that are intersected before the rest of a phrase is compared.
RAREST = 2
#: The characters between words, \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F, one by one: Java looks them up in one table, where
#: it tries ranges one after another for each character of a text.
BETWEEN = "".join(f"\\x{c:02X}" for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))


def words(text: Column) -> Column:
    """A-Z lower-cased; runs of 0-9, a-z and everything beyond ASCII. Null has no words."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(f"[^{BETWEEN}]+"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def windows(benchmark: DataFrame, size: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """(wid, phrase, len, items): the distinct windows of ``size`` words; a shorter item, unless empty, is one."""
    rows = benchmark.select(F.coalesce(benchmark[f"`{item}`"].cast("string"), F.lit("")).alias("item"),
                            words(benchmark[f"`{text}`"]).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    cut = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("part"))
    found = cut.groupBy(F.array_join("part", " ").alias("phrase")).agg(
        F.first(F.size("part")).alias("len"), F.array_sort(F.collect_set("item")).alias("items"))
    return cut_lineage(found.withColumn("wid", F.monotonically_increasing_id()))


class Index:
    """Positional postings of the benchmark's terms over the documents, in the shared folder."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text",
                 item: str = "item_id", benchmark_text: str = "text"):
        self.docs, self.text = docs, text
        self.windows = windows(benchmark, size, benchmark_text, item)
        self.terms = self.windows.select("wid", "len", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
        vocabulary = cut_lineage(self.terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
        n = vocabulary.count()
        self.terms = self.terms.join(sized_broadcast(vocabulary, n, BROADCAST_TERMS), "term")
        body = docs[f"`{text}`"]
        places = docs.select(F.xxhash64(body).alias("key"), F.posexplode(words(body)).alias("pos", "term"))
        self.postings = stored(places.join(sized_broadcast(vocabulary, n, BROADCAST_TERMS), "term")
                               .select("key", "pos", "tid"), "postings")

    def anchors(self, rarest: int) -> DataFrame:
        """(wid, offset, tid, nth, need): the ``rarest`` terms of each window whose terms all occur."""
        counts = cut_lineage(self.postings.groupBy("tid").agg(F.count("*").alias("n")))
        each = self.terms.join(counts, "tid", "left")
        per = Window.partitionBy("wid")
        nth = F.row_number().over(per.orderBy("n", "offset")) - 1
        ranked = each.withColumn("nth", nth).withColumn("held", F.count("n").over(per))
        return cut_lineage(ranked.where((F.col("held") == F.col("len")) & (F.col("nth") < rarest))
                           .select("wid", "offset", "tid", "nth", F.least("len", F.lit(rarest)).alias("need")))

    def starts(self, rarest: int = RAREST) -> DataFrame:
        """(key, wid, start) where the offset-adjusted lists of the window's rarest terms meet."""
        anchors = self.anchors(rarest)
        hits = (self.postings.join(sized_broadcast(anchors, anchors.count(), BROADCAST_TERMS), "tid")
                .select("key", "wid", (F.col("pos") - F.col("offset")).alias("start"), "nth", "need")
                .where(F.col("start") >= 0))
        met = hits.groupBy("key", "wid", "start", "need").agg(F.bit_or(F.expr("shiftleft(1, nth)")).alias("have"))
        return met.where(F.col("have") == F.expr("shiftleft(1, need) - 1")).select("key", "wid", "start")


def find_phrases(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text",
                 item: str = "item_id", benchmark_text: str = "text") -> DataFrame:
    """(row, n_words, hits, items), one row per document: ``row`` holds all its columns, ``hits`` the places (start, end)
    of windows found in it in order, ``items`` the ids of their items as sorted strings.

    Exact phrase matches: every word of a window in its place. Null texts have no words; items without words have
    no windows; a null item id is the empty string; repeated rows are found alike; empty tables give no hits.
    """
    index = Index(docs, benchmark, size, text, item, benchmark_text)
    places = cut_lineage(index.starts().join(index.windows.select("wid", "phrase", "len", "items"), "wid"))
    per_doc = cut_lineage(places.groupBy("key").agg(F.collect_list(F.struct("start", "len", "phrase", "items")).alias("c")))
    rows = packed(docs).withColumn("key", F.xxhash64(F.col("row").getField(text)))
    joined = rows.join(sized_broadcast(per_doc, places.count(), BROADCAST_PLACES), "key", "left")
    read = joined.select("row", words(F.col("row").getField(text)).alias("w"), "c")
    true = F.filter("c", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["len"]), " ") == c["phrase"])
    held = read.select("row", F.size("w").cast("long").alias("n_words"), true.alias("c"))
    spans = F.transform("c", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["len"]).alias("end")))
    items = F.array_distinct(F.flatten(F.transform("c", lambda c: c["items"])))
    return held.select("row", "n_words", F.array_sort(F.coalesce(spans, F.expr(NO_SPANS))).alias("hits"),
                       F.array_sort(F.coalesce(items, F.expr(NO_ITEMS))).alias("items"))


NO_SPANS = "cast(array() as array<struct<start:int,end:int>>)"
NO_ITEMS = "cast(array() as array<string>)"


def words_hit(hits: Column) -> Column:
    """Number of word positions inside at least one of the sorted spans."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(hits, begin, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("n")))["n"]


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    return find_phrases(docs, benchmark, size).where(F.size("hits") == 0).select("row.*")


def find_near(docs: DataFrame, benchmark: DataFrame, size: int = 10, slack: int = 2, text: str = "text",
              item: str = "item_id", benchmark_text: str = "text") -> DataFrame:
    """(key, wid, start, phrase, items): proximity matches; ``key`` is xxhash64 of the document's text.

    The window's rarest term stands at its place, and every other term of the window within ``slack`` words of its
    own; so the exact matches are among them, and words put in, left out between terms or swapped are forgiven.
    Positions are cut into blocks of 2 * slack + 1 words, so the lists of a term meet block by block.
    """
    index = Index(docs, benchmark, size, text, item, benchmark_text)
    block = 2 * slack + 1
    starts = index.starts(rarest=1)
    need = (starts.join(index.terms.select("wid", "offset", "tid", "len"), "wid")
            .withColumn("want", F.col("start") + F.col("offset"))
            .withColumn("block", F.explode(F.array_distinct(F.array(
                F.floor((F.col("want") - slack) / block), F.floor((F.col("want") + slack) / block))))))
    have = index.postings.withColumn("block", F.floor(F.col("pos") / block)).distinct()
    met = (need.join(have, ["key", "tid", "block"]).where(F.abs(F.col("pos") - F.col("want")) <= slack)
           .groupBy("key", "wid", "start", "len").agg(F.countDistinct("offset").alias("n")))
    return (met.where(F.col("n") == F.col("len")).drop("n", "len")
            .join(index.windows.select("wid", "phrase", "items"), "wid").select("key", "wid", "start", "phrase", "items"))
