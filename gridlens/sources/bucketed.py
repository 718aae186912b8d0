"""Keyed tables filed by hash bucket of their key, and views kept from the changes of such tables.

The state of a table is one row per key, in a folder per bucket. A batch reads only the buckets that its keys fall in,
folds its rows into theirs and writes those buckets anew; a small list says for each bucket which batch wrote it last.
Reading the table is a scan of these folders: nothing is folded or shuffled, however long the history is. A
batch that is replayed starts from the buckets as of before it and writes the same folders again.

Every batch also leaves its signed row changes behind: the row that a key held before with sign -1, the one that it holds
now with +1. A view's values follow from them without reading the table again: the changes are summed into a state of
its own, (group, value) -> count, from which median, dominant, distinct count, join, min, max and sums are read off for
the groups that a batch touched, under moves and removals as well.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.operators.holistic import median_of_counts
from gridlens.session import cut_lineage, scratch_path
from gridlens.sources.tables import BATCH, DELETE, OP, RESERVED, SEQ, UPSERT
from gridlens.types import conform, to_struct

SIGN = "_sign"
BUCKET = "bucket"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _matched(names: list[str], prefix: str) -> Column:
    """Equality of columns with their prefixed namesakes; null equals null."""
    return functools.reduce(operator.and_, [_q(c).eqNullSafe(_q(prefix + c)) for c in names])


class BucketedState:
    """Rows filed by the hash bucket of ``by`` under ``path``; a version per batch, of which only the touched buckets are
    written. ``spread`` more columns decide the file inside a bucket, so that one value of ``by`` isn't one task."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: list[str], *, buckets: int = 32,
                 spread: list[str] | None = None):
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, list(by)
        self.buckets, self.spread = buckets, list(spread or [])

    def bucket(self, prefix: str = "") -> Column:
        return F.pmod(F.xxhash64(*[_q(prefix + c) for c in self.by]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall in: at most their fixed number of small integers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [(st.getPath(), st.getPath().getName()) for st in fs.listStatus(root)]
        return sorted(int(n[len("batch="):]) for p, n in names
                      if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """For each bucket that has rows, the batch that wrote it last (of those older than ``before``)."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/version/batch={known[-1]}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows now (or as of just before batch ``before``), of the buckets ``only`` if given: a scan of the folders
        that hold them."""
        held = self.manifest(before)
        paths = [f"{self.path}/rows/batch={b}/bucket={k}" for k, b in sorted(held.items()) if only is None or k in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        fields = [*self.schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
        found = self.spark.read.schema(T.StructType(fields)).option("basePath", f"{self.path}/rows").parquet(*paths)
        return found.select(*[_q(f.name) for f in self.schema.fields])

    def write(self, rows: DataFrame, batch_id: int, touched: list[int]) -> None:
        """Put ``rows`` in the place of all rows of the buckets ``touched``, as batch ``batch_id``."""
        held = {k: b for k, b in self.manifest(before=batch_id).items() if k not in touched}
        out = rows.select(*[_q(f.name) for f in self.schema.fields], self.bucket().alias(BUCKET))
        files = F.pmod(F.xxhash64(*[_q(c) for c in self.spread]), F.lit(8)) if self.spread else F.lit(0)
        out.repartition(BUCKET, files).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/rows/batch={int(batch_id)}")
        written = {k: batch_id for k in self._written(batch_id)}
        entries = sorted({**held, **written}.items())
        listed = self.spark.createDataFrame(entries, "bucket int, batch long").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.path}/version/batch={int(batch_id)}")

    def _written(self, batch_id: int) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/batch={int(batch_id)}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [st.getPath().getName() for st in fs.listStatus(root)]
        return [int(n[len("bucket="):]) for n in names if n.startswith("bucket=")]

    def vacuum(self, keep: int = 2) -> int:
        """Let go of folders that the ``keep`` newest versions don't name; the number of folders removed."""
        versions = self._versions()
        named = {(k, b) for v in versions[-keep:] for k, b in self.manifest(before=v + 1).items()}
        jvm, gone = self.spark.sparkContext._jvm, 0
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for v in versions:
            for k in self._written(v):
                if (k, v) not in named:
                    p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/batch={v}/bucket={k}")
                    p.getFileSystem(conf).delete(p, True)
                    gone += 1
        return gone


class BucketedTable:
    """A live keyed table whose rows are replaced whole by newer ones (``seq``; without it, by later batches).

    ``update`` and ``remove`` take a batch number each; a replayed number gives the same state. A removal is as new as the
    newest row of its key that came before it: older rows that arrive later stay dead, a newer one revives the key. A
    null key is a key like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema, *, index, seq=None, buckets: int = 32):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), to_struct(schema)
        self.keys = [index] if isinstance(index, str) else list(index)
        self.seq = [seq] if isinstance(seq, str) else list(seq or [])
        clash = [f.name for f in self.schema.fields if f.name in (*RESERVED, SIGN, BUCKET, "_step", "_dated")]
        if clash:
            raise ValueError(f"column names {clash} are reserved")
        self.columns = [f.name for f in self.schema.fields]
        dated = T.StructType([self.schema[c] for c in self.seq])
        fields = [*self.schema.fields, T.StructField("_dated", dated) if self.seq else T.StructField("_dated", T.LongType()),
                  T.StructField("_step", T.LongType()), T.StructField(SEQ, T.LongType()), T.StructField(OP, T.StringType())]
        self.state = BucketedState(spark, f"{self.path}/state", T.StructType(fields), self.keys, buckets=buckets)

    def _order(self, prefix: str = "") -> Column:
        return F.struct(_q(f"{prefix}_dated").alias("d"), _q(f"{prefix}_step").alias("s"), _q(prefix + SEQ).alias("p"))

    def update(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Fold upserts in as batch ``batch_id`` and return its signed row changes."""
        return self._apply(conform(df, self.schema), 2 * int(batch_id), UPSERT)

    def remove(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Remove keys in batch ``batch_id``, after its upserts, and return the signed row changes."""
        return self._apply(conform(keys.select(*[_q(k) for k in self.keys]), self.schema), 2 * int(batch_id) + 1, DELETE)

    def _apply(self, rows: DataFrame, step: int, op: str) -> DataFrame:
        dated = F.struct(*[_q(c) for c in self.seq]) if self.seq else F.lit(0).cast("long")
        rows = rows.withColumn("_dated", dated).withColumn("_step", F.lit(step).cast("long"))
        rows = rows.withColumn(SEQ, F.monotonically_increasing_id()).withColumn(OP, F.lit(op))
        newest = rows.groupBy(*[_q(k) for k in self.keys]).agg(
            F.max(F.struct(self._order().alias("o"), F.struct(*[_q(f.name) for f in self.state.schema.fields]).alias("r"))).alias("n"))
        newest = cut_lineage(newest.select("n.r.*"))
        touched = self.state.touched(newest)
        before = self.state.read(before=step, only=touched)
        new = newest.withColumnsRenamed({c: f"_new_{c}" for c in newest.columns})
        both = before.join(new, _matched(self.keys, "_new_"), "full")
        absent = _q(f"_new_{OP}").isNull()
        if op == DELETE:
            # as new as what the key holds
            date = F.greatest(_q("_dated"), _q("_new__dated")) if self.seq else _q("_new__dated")
            wins = ~absent
        else:
            date = _q("_new__dated")
            wins = ~absent & (_q(OP).isNull() | (self._order("_new_") > self._order()))
        pick = {c: F.when(wins, date if c == "_dated" else _q(f"_new_{c}")).otherwise(_q(c)).alias(c) for c in before.columns}
        lived, lives = _q(OP) == UPSERT, F.when(wins, F.lit(op == UPSERT)).otherwise(_q(OP) == UPSERT)
        was = F.when(wins & F.coalesce(lived, F.lit(False)), F.struct(F.lit(-1).alias(SIGN), *[_q(c) for c in self.columns]))
        now = F.when(wins & lives, F.struct(F.lit(1).alias(SIGN), *[_q(f"_new_{c}").alias(c) for c in self.columns]))
        folded = cut_lineage(both.select(*pick.values(), F.array_compact(F.array(was, now)).alias("_changes")))
        self.state.write(folded, step, touched)
        return folded.select(F.explode("_changes").alias("c")).select("c.*")

    def snapshot(self, before: int | None = None) -> DataFrame:
        """The live rows now, or as of just before batch ``before``: a scan, without a shuffle."""
        rows = self.state.read(before=None if before is None else 2 * int(before))
        return rows.where(F.col(OP) == UPSERT).select(*[_q(c) for c in self.columns])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The live rows of ``keys``, from the buckets that they fall in."""
        keys = keys.select(*[_q(k).alias(f"_key_{k}") for k in self.keys])
        held = self.state.read(only=self.state.touched(keys.withColumnsRenamed({f"_key_{k}": k for k in self.keys})))
        found = held.where(F.col(OP) == UPSERT).join(keys, _matched(self.keys, "_key_"), "left_semi")
        return found.select(*[_q(c) for c in self.columns])


#: Aggregates that follow from the counts of a group's values (``_v``, ``_n``; null values are among them).
FROM_COUNTS = {
    "count": lambda v, n: F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)),
    "distinct count": lambda v, n: F.count(v),
    "sum": lambda v, n: F.sum(v * n),
    "abs sum": lambda v, n: F.abs(F.sum(v * n)),
    "sum abs": lambda v, n: F.sum(F.abs(v) * n),
    "mean": lambda v, n: F.sum(v * n) / F.sum(F.when(v.isNotNull(), n)),
    "min": lambda v, n: F.min(v), "low": lambda v, n: F.min(v),
    "max": lambda v, n: F.max(v), "high": lambda v, n: F.max(v),
    "high minus low": lambda v, n: F.max(v) - F.min(v),
    "unique": lambda v, n: F.when(F.min(v) == F.max(v), F.min(v)),
    "dominant": lambda v, n: F.min(F.when(v.isNotNull(), F.struct((-n).alias("n"), v.alias("v")))).getField("v"),
    "join": lambda v, n: F.when(F.count(v) > 0, F.array_join(F.transform(
        F.array_sort(F.collect_list(v)), lambda x: x.cast("string")), ", ")),
}


class CountedView:
    """One column of a grouped view, kept from signed row changes: (group, value) -> count.

    ``aggregates``: ``{output: name}`` over the column ``value``, from FROM_COUNTS or ``median``.
    """

    def __init__(self, spark: SparkSession, path: str, schema, group_by: list[str], value: str,
                 aggregates: dict[str, str], *, buckets: int = 32):
        unknown = [a for a in aggregates.values() if a != "median" and a not in FROM_COUNTS]
        if unknown:
            raise ValueError(f"{unknown} don't follow from counts of values; known are {sorted([*FROM_COUNTS, 'median'])}")
        self.group_by, self.value, self.aggregates = list(group_by), value, dict(aggregates)
        kinds = {f.name: f.dataType for f in to_struct(schema).fields}
        self.groups = [f"_g{i}" for i in range(len(self.group_by))]
        fields = [T.StructField(g, kinds[c]) for g, c in zip(self.groups, self.group_by)]
        fields += [T.StructField("_v", kinds[value]), T.StructField("_n", T.LongType())]
        self.state = BucketedState(spark, path, T.StructType(fields), self.groups, buckets=buckets, spread=["_v"])

    def apply(self, changes: DataFrame, step: int) -> DataFrame:
        """Sum ``changes`` in as version ``step``; the groups they touch, with their aggregates as they are now. Groups that
        are empty now have ``_op`` delete."""
        names = [*self.groups, "_v"]
        delta = changes.select(*[_q(c).alias(g) for c, g in zip(self.group_by, self.groups)], _q(self.value).alias("_v"), SIGN)
        delta = cut_lineage(delta.groupBy(*names).agg(F.sum(SIGN).cast("long").alias("_d")))
        touched = self.state.touched(delta)
        new = delta.withColumnsRenamed({c: f"_new_{c}" for c in names})
        both = self.state.read(before=step, only=touched).join(new, _matched(names, "_new_"), "full")
        n = (F.coalesce("_n", F.lit(0)) + F.coalesce("_d", F.lit(0))).alias("_n")
        summed = cut_lineage(both.select(*[F.when(_q("_n").isNull(), _q(f"_new_{c}")).otherwise(_q(c)).alias(c) for c in names], n)
                             .where("_n > 0"))
        self.state.write(summed, step, touched)
        groups = delta.select(*[_q(g).alias(f"_t{g}") for g in self.groups]).distinct()
        return self._answer(summed.join(groups, _matched(self.groups, "_t"), "left_semi"), groups)

    def _answer(self, counts: DataFrame, groups: DataFrame) -> DataFrame:
        v, n = F.col("_v"), F.col("_n")
        plain = [FROM_COUNTS[a](v, n).alias(out) for out, a in self.aggregates.items() if a != "median"]
        now = counts.groupBy(*self.groups).agg(F.lit(UPSERT).alias(OP), *plain)
        if "median" in self.aggregates.values():
            middle = median_of_counts(counts.where("_v is not null"), self.groups)
            middle = middle.withColumnsRenamed({g: f"_m{g}" for g in self.groups})
            now = now.join(middle, _matched(self.groups, "_m"), "left")
            now = now.withColumns({out: F.col("_agg") for out, a in self.aggregates.items() if a == "median"})
        out = groups.join(now, _matched(self.groups, "_t"), "left")
        return out.select(*[_q(f"_t{g}").alias(c) for g, c in zip(self.groups, self.group_by)],
                          *[_q(o) for o in self.aggregates], F.coalesce(F.col(OP), F.lit(DELETE)).alias(OP))


def chain_counted(source: BucketedTable, target: BucketedTable, view: CountedView):
    """A ``foreachBatch`` function that folds a batch into ``source`` and keeps ``target``, keyed by the group columns,
    at the view's values. Each of the three reads and writes only the buckets that the batch touches."""
    def run(batch: DataFrame, batch_id: int) -> None:
        changes = cut_lineage(source.update(batch, batch_id))
        answer = cut_lineage(view.apply(changes, 2 * int(batch_id)))
        target.update(answer.where(F.col(OP) == UPSERT).drop(OP), batch_id)
        target.remove(answer.where(F.col(OP) == DELETE), batch_id)

    return run


def counted_chain(spark: SparkSession, schema, *, index, seq, group_by: list[str], value: str, aggregates: dict[str, str],
                  out_schema, buckets: int = 32):
    """(source, target, function for each batch) of a new chain in the scratch folder."""
    root = scratch_path(spark, "counted")
    source = BucketedTable(spark, f"{root}/source", schema, index=index, seq=seq, buckets=buckets)
    target = BucketedTable(spark, f"{root}/target", out_schema, index=group_by, buckets=buckets)
    view = CountedView(spark, f"{root}/view", schema, group_by, value, aggregates, buckets=buckets)
    return source, target, chain_counted(source, target, view)
