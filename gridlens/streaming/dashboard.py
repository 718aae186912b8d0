"""The reference's end-to-end shape on Spark: named JSON-line feeds -> live tables -> views.

``start_feeds`` starts one named streaming query per feed (each with its own
checkpoint, X5) writing into a :class:`TableRegistry`; ``DASHBOARD_VIEWS``
holds the shipped view configurations (D1-D5), applied with
:func:`dashboard_views` to the tables' current snapshots.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridlens.plans.view import View
from gridlens.sources.json_stream import json_stream
from gridlens.sources.tables import LOG_ORDER
from gridlens.streaming.sink import LiveSink, TableRegistry, start_stream


@dataclasses.dataclass
class Feed:
    """One line feed: where lines come from and the table they fold into."""

    schema: dict
    source: str = "text"            # "text" (landing folder), "socket", "kafka", …
    path: str | None = None
    options: dict = dataclasses.field(default_factory=dict)
    index: str | None = None        # keyed table when set, append table otherwise
    seq: list | None = None         # data columns giving arrival order
    nulls: str = "keep"


def start_feeds(spark: SparkSession, registry: TableRegistry, feeds: dict[str, Feed], *,
                checkpoint_root: str, available_now: bool = False, compact_every: int | None = 50,
                processing_time: str | None = "5 seconds") -> dict[str, StreamingQuery]:
    """Start one named stream per feed into its table; returns the queries."""
    queries = {}
    for name, feed in feeds.items():
        table = registry.host_table(name, feed.schema, index=feed.index, seq=feed.seq, nulls=feed.nulls)
        stream = json_stream(spark, table.schema, source=feed.source, path=feed.path, options=feed.options,
                             keep_raw=feed.nulls == "overwrite")
        queries[name] = start_stream(stream, LiveSink(table, compact_every=compact_every), checkpoint=f"{checkpoint_root}/{name}",
                                     name=f"feed_{name}", available_now=available_now,
                                     processing_time=None if available_now else processing_time)
    return queries


# The dashboards the reference ships, as view configurations.
DASHBOARD_VIEWS = {
    "Machines": ("machines", {"columns": ["machine_id", "kind", "cores", "region", "zone"]}),
    "Usage": ("usage", {"columns": ["machine_id", "cpu", "cpubar", "mem", "membar", "free", "network", "disk",
                                    "kind", "cores", "region", "zone"],
                        "expressions": {"cpubar": '//cpubar\n\n"cpu"\n', "membar": '"mem"'}}),
    "Usage Graph": ("usage", {"group_by": ["kind", "region", "zone"], "columns": ["cores", "cpu", None]}),
    "Status": ("status", {"group_by": ["status"], "columns": ["machine_id"], "aggregates": {"status": "last"},
                          "sort": [["last_update", "desc"]]}),
    "Jobs": ("jobs", {"group_by": ["machine_id"], "columns": ["job_id", "name", "units", "start_time", "end_time"],
                      "aggregates": {"job_id": "count", "name": "last", "units": "sum", "start_time": "last",
                                     "end_time": "last"}}),
}


def dashboard_views(registry: TableRegistry, views: dict = DASHBOARD_VIEWS) -> dict[str, View]:
    """The configured views over the tables' current snapshots."""
    out = {}
    for title, (table, cfg) in views.items():
        if table in registry.get_hosted_table_names():
            t = registry.open_table(table)
            snap = t.snapshot(with_meta=True)
            order = t.seq + LOG_ORDER
            out[title] = View(snap.drop("_port"), cfg, index=t.index, order=order)
    return out
