"""A training corpus from ``documents`` in five stages, each written as Parquet and read again by the next.

Good documents only, one of each group of near copies, none that holds benchmark passages, taken as often and in the
order that the curriculum's source weights ask for, dealt out to shards, in which ``slot`` counts them in that order.

Every stage takes null ids and metadata as values like any other and null texts as texts without words; repeated rows are
documents of their own until the near copies go; columns that the stages don't know are carried along, and an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlens.llm import decontaminate, mixing, quality, sharding, simhash
from gridlens.llm.common import stored, written_order
from gridlens.llm.queries import SCHEDULES, learnable
from gridlens.session import read_table

#: Bytes of a shard, texts plus 8 bytes a document.
SHARD_BYTES = 16 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier, learned from the labelled ones among them, scores 0.5 or more."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels"), allowed=learnable()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group: 4-word shingles, 4 bits."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 10 words of a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), size=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of 1.5 times the words takes them (0 to 2), in training order."""
    return mixing.mix(docs, SCHEDULES, share=1.5, max_repeats=2.0).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the shard of the k-d tree and the slot in it: the place in training order, which is that of the rows of
    the mix as it was written. The rows come by shard and slot."""
    return sharding.with_shard(docs, target_bytes=SHARD_BYTES, order=written_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The classifier, the fingerprints and the tree are beyond SQL; tests hold the stages against brute force, one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after another."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
