"""The driver tables and the live tables they stand in for.

machines -> ``part``; usage -> ``lineitem`` (keyed by its four-column key);
status -> ``orders`` newest per customer; jobs -> ``events`` (append);
matrix -> ``lineitem`` flags.  Null cells come from a content rule on
``events`` (see :func:`events_with_nulls`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import read_table
from gridlens.sources.tables import latest_per_key

# Fixed keys and arrival orders of the stand-in tables.
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINEITEM_ORDER = ["l_shipdate"] + LINEITEM_KEY
ORDERS_ORDER = ["o_orderdate", "o_orderkey"]
EVENTS_ORDER = ["ts", "event_id"]


class Tables:
    """Lazy access to ``{sf_dir}/{name}.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def status_table(t: Tables, keep: list[str] | None = None) -> DataFrame:
    """Newest order per customer (keyed table, key o_custkey); the order is unique, so ``keep`` may name just the
    columns that a view needs."""
    return latest_per_key(t.orders, "o_custkey", ORDERS_ORDER, keep=keep)


def usage_table(t: Tables, keep: list[str] | None = None) -> DataFrame:
    """``keep``: the columns besides the key that go through the fold (all by default)."""
    return latest_per_key(t.lineitem, LINEITEM_KEY, ["l_shipdate"], keep=keep)


def events_with_nulls(t: Tables) -> DataFrame:
    """``events`` with null cells by a content rule: ``value`` is null on
    ``view`` events and ``props`` is null on ``click`` events."""
    e = t.events
    return e.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "click", F.col("props")).alias("props"),
    )


EVENTS_WITH_NULLS_SQL = (
    "(SELECT event_id, ts, user_id, event_type, "
    "CASE WHEN event_type <> 'view' THEN value END AS value, "
    "CASE WHEN event_type <> 'click' THEN props END AS props FROM events)"
)
