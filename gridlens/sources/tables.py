"""Live tables as change logs: keyed (upsert), append and capped.

A table is a log of change rows ``key, cols…, _pos, _op, _port`` on Parquet.
Reading folds the log with aggregate functions: the newest row per key is
``max(struct(seq, row))`` - an aggregate with map-side partial aggregation, so
one key holding a third of the log is folded inside every task before the
shuffle.  Writes go to ``log/batch=N/writer=W`` in overwrite mode: replaying a
micro-batch of a writer is harmless, and writers (ports, streams, updates and
removals) never touch one another's folders.  There is no MERGE and no rewrite
of old files; compaction writes a new snapshot version that keeps every change
row that can still decide a cell.
"""

from __future__ import annotations

import functools
import json
import operator
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.types import conform, to_struct

SEQ, OP, PORT, ROW_ID, PRESENT = "_pos", "_op", "_port", "_row_id", "_present"
RAW = "_raw"  # raw JSON text kept by parse_json_lines(keep_raw=True)
BATCH, WRITER = "batch", "writer"
# arrival order: micro-batch id, then writer (its removals after its upserts), then position
LOG_ORDER = [BATCH, WRITER, SEQ]
UPSERT, DELETE = "upsert", "delete"
WRITER_KINDS = {UPSERT: "1", DELETE: "2"}  # sorts a writer's removals after its upserts of the same batch
RESERVED = ("batch", "writer", "_pos", "_op", "_port", "_row_id", "_present", "_raw")
ROW_ID_TYPE = T.StructType([T.StructField("b", T.LongType()), T.StructField("p", T.LongType())])


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _ordering(seq) -> Column:
    seq = [seq] if isinstance(seq, str) else list(seq)
    return F.struct(*[_q(c) for c in seq]) if len(seq) > 1 else _q(seq[0])


def latest_per_key(log: DataFrame, key, seq, *, nulls: str = "overwrite",
                   op_col: str | None = None, keep: list[str] | None = None,
                   present_col: str | None = None) -> DataFrame:
    """Fold a change log into the newest row per key.

    ``nulls="overwrite"``: the newest row replaces the whole row.
    ``nulls="keep"``: a null cell is absent; every column keeps its newest
    non-null value (partial updates).
    ``op_col``: rows whose op is ``delete`` are tombstones; a key whose newest
    change is a delete is dropped, and in keep mode cells written before the
    delete do not survive a later re-insert.
    ``present_col`` (array of field names a change row actually carried, e.g.
    from ``json_object_keys`` of the raw line): with ``nulls="overwrite"`` an
    explicit null overwrites while an absent field keeps the older value.
    ``seq`` gives arrival order; ties are broken by the key-free row content.
    """
    keys = [key] if isinstance(key, str) else list(key)
    seqs = [seq] if isinstance(seq, str) else list(seq)
    cols = keep or [c for c in log.columns
                    if c not in keys and c not in seqs and c not in (op_col, present_col)]
    order = _ordering(seqs)
    is_del = (_q(op_col) == F.lit(DELETE)) if op_col else F.lit(False)
    if nulls == "overwrite" and present_col is None:
        rec = F.struct(*[_q(c) for c in cols + [s for s in seqs if s not in cols and s not in keys]],
                       is_del.alias("_del"))
        # max of (order, row): equal sequence values are settled by row content
        best = F.max(F.struct(order.alias("_o"), rec.alias("_r"))).alias("_best")
        folded = log.groupBy(*[_q(k) for k in keys]).agg(best)
        return (folded.where(~F.col("_best._r._del"))
                .select(*[_q(k) for k in keys], "_best._r.*").drop("_del"))
    if nulls not in ("keep", "overwrite"):
        raise ValueError("nulls must be 'overwrite' or 'keep'")
    aggs = []
    for c in cols:
        if nulls == "overwrite":
            carried = F.coalesce(F.array_contains(_q(present_col), F.lit(c)), F.lit(False))
        else:
            carried = _q(c).isNotNull()
        touched = carried | is_del
        cell = F.struct(is_del.alias("d"), _q(c).alias("v"))
        # newest change touching the cell; ties settled by (delete first, value)
        aggs.append(F.max(F.when(touched, F.struct(order.alias("o"), cell.alias("c")))).alias(f"_c_{c}"))
    aggs.append(F.max(F.struct(order.alias("o"), is_del.alias("d"))).alias("_last"))
    for s in seqs:
        if s not in keys:
            aggs.append(F.max(_q(s)).alias(s))
    folded = log.groupBy(*[_q(k) for k in keys]).agg(*aggs)
    folded = folded.where(~F.col("_last.d"))
    sel = [_q(k) for k in keys]
    for c in cols:
        sel.append(F.when(~F.col(f"_c_{c}.c.d"), F.col(f"_c_{c}.c.v")).alias(c))
    sel += [_q(s) for s in seqs if s not in cols and s not in keys]
    return folded.select(*sel)


def newest_rows(df: DataFrame, seq, limit: int) -> DataFrame:
    """A capped table keeps its ``limit`` newest rows by ``seq``.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps
    its own newest ``limit`` rows, then one merge of ``tasks * limit`` rows.
    """
    from gridlens.operators.sorting import slice_rows

    seqs = [seq] if isinstance(seq, str) else list(seq)
    return slice_rows(df, [_q(s).desc() for s in seqs], 0, int(limit))


def tombstones(keys: DataFrame, seq_value=None) -> DataFrame:
    """Delete rows for a key DataFrame (T8): ``_op = delete``."""
    out = keys.withColumn(OP, F.lit(DELETE))
    if seq_value is not None and SEQ not in keys.columns:
        out = out.withColumn(SEQ, F.lit(seq_value))
    return out


class LiveTable:
    """A named live table stored as a change log under ``path``.

    ``index``: key column or columns (upsert table) or None (append table).
    ``limit``: capped table size (not allowed with ``index``).
    ``nulls``: ``"keep"`` (null cell = absent, default) or ``"overwrite"``.
    ``seq``: data columns giving arrival order; a row with a lower seq never
    overwrites one with a higher seq, however late it arrives.  Without it rows
    order by micro-batch, writer and position as read, and the position of rows
    inside one batch depends on how Spark cut it into tasks: streams whose
    batches may hold a key twice should name a ``seq``.
    """

    def __init__(self, spark: SparkSession, path: str, schema, *, index=None,
                 limit: int | None = None, nulls: str = "keep", seq=None):
        if index is not None and limit is not None:
            raise ValueError("a table takes either index or limit, not both")
        clash = [f.name for f in to_struct(schema).fields if f.name in RESERVED]
        if clash:
            raise ValueError(f"column names {clash} are reserved for the change log: {list(RESERVED)}")
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = to_struct(schema)
        self.index = index
        self.keys = [index] if isinstance(index, str) else list(index or [])
        self.limit = limit
        self.nulls = nulls
        self.seq = [seq] if isinstance(seq, str) else list(seq or [])

    # ------------------------------------------------------------ description
    def save_description(self) -> None:
        """Write what :meth:`open` needs beside the log, once."""
        if not self._exists(f"{self.path}/table/_SUCCESS"):
            about = {"schema": self.schema.jsonValue(), "index": self.index, "limit": self.limit, "nulls": self.nulls,
                     "seq": self.seq}
            self.spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{self.path}/table")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "LiveTable":
        """The table described under ``path`` by :meth:`save_description`."""
        about = json.loads(spark.read.parquet(f"{path.rstrip('/')}/table").first()["about"])
        return cls(spark, path, T.StructType.fromJson(about["schema"]), index=about["index"], limit=about["limit"],
                   nulls=about["nulls"], seq=about["seq"])

    # --------------------------------------------------------------- metadata
    def schema_names(self) -> dict[str, str]:
        """M1: ``{column: type name}`` of the table."""
        from gridlens.types import type_name

        return {f.name: type_name(f.dataType) for f in self.schema.fields}

    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def size(self) -> int:
        """M4: number of rows now (one aggregation job)."""
        return self.snapshot().count()

    def view(self, config=None, **kw):
        """A :class:`View` over the current snapshot, ordered by arrival.

        Only the columns that the configuration names go through the fold
        (all, where it computes some from text).
        """
        from gridlens.plans.view import View

        cfg = self.view_config(config)
        needed = None
        if not cfg.expressions:
            weights = [x for a in cfg.aggregates.values() if isinstance(a, (list, tuple)) for x in a[1:]]
            needed = [*cfg.columns, *cfg.group_by, *cfg.split_by, *[c for c, _ in cfg.sort], *[c[0] for c in cfg.filter],
                      *[x for w in weights for x in (w if isinstance(w, (list, tuple)) else [w])], *self.seq]
            if any(c[1:2] == ["any of"] for c in cfg.filter):
                needed = None
        snap = self.snapshot(with_meta=True, columns=needed).drop(PORT)
        return View(snap, cfg, index=self.index, order=self.seq + LOG_ORDER, **kw)

    def view_config(self, config):
        """The config with default columns = the table's columns (+ expressions),
        so the bookkeeping columns a view needs for arrival order stay hidden."""
        from gridlens.config import normalize_config

        cfg = normalize_config(config)
        if cfg.columns is None:
            import copy

            cfg = copy.copy(cfg)
            cfg.columns = self.columns() + [a for a in cfg.expressions if a not in self.columns()]
        return cfg

    # ----------------------------------------------------------------- writes
    @property
    def log_path(self) -> str:
        return f"{self.path}/log"

    def make_port(self) -> int:
        """A new input port id (port 0 is the default), remembered with the table."""
        p = max(self._numbers(f"{self.path}/ports", "port="), default=0) + 1
        self.spark.createDataFrame([(p,)], "port int").write.mode("overwrite").parquet(f"{self.path}/ports/port={p}")
        return p

    def _log_rows(self, df: DataFrame, port_id: int, op: str, extra: list | None = None) -> DataFrame:
        names = [f.name for f in self.schema.fields]
        if RAW in df.columns:
            # fields the line really carried (null vs absent)
            present = F.filter(F.json_object_keys(F.col(RAW)), lambda k: k.isin(names))
        else:
            present = F.array(*[F.lit(c) for c in names if c in df.columns]).cast("array<string>")
        data = conform(df.withColumn(PRESENT, present),
                       T.StructType(self.schema.fields + list(extra or [])
                                    + [T.StructField(PRESENT, T.ArrayType(T.StringType()))]))
        # arrival order inside the batch: the row's position as read
        return (data.withColumn(SEQ, F.monotonically_increasing_id())
                .withColumn(OP, F.lit(op)).withColumn(PORT, F.lit(int(port_id))))

    @staticmethod
    def _writer(port_id: int, op: str, writer: str | None) -> str:
        return f"{writer or ''}p{int(port_id):04d}-{WRITER_KINDS[op]}{op}"

    def _write(self, rows: DataFrame, batch_id: int, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.log_path}/{BATCH}={int(batch_id)}/{WRITER}={name}")

    def update(self, df: DataFrame, batch_id: int, *, port_id: int = 0, writer: str | None = None) -> str:
        """Upsert (keyed) or append rows as batch ``batch_id`` of a writer (idempotent).

        ``writer`` names the stream, so that streams that count their batches
        alike don't meet; returns the name under which the batch is logged.
        """
        name = self._writer(port_id, UPSERT, writer)
        rows = self._log_rows(df, port_id, UPSERT)
        if not self.keys:
            # implicit row number: unique across batches and writers
            number = int(port_id) if writer is None else (1 << 16) + zlib.crc32(name.encode()) % (1 << 22)
            rows = rows.withColumn(ROW_ID, F.struct(F.lit(int(batch_id) + (number << 40)).alias("b"), F.col(SEQ).alias("p")))
        self._write(rows, batch_id, name)
        return name

    def remove(self, keys: DataFrame, batch_id: int, *, port_id: int = 0, writer: str | None = None) -> str:
        """Delete keys (index required); a later upsert revives a key.

        On a table with ``seq`` a removal is as new as the newest row of its
        key that arrived before it (or as the ``seq`` columns that ``keys``
        carries): rows older than that stay dead however late they arrive.
        """
        if not self.keys:
            raise ValueError("remove() needs an indexed table")
        carried = [c for c in self.seq if c in keys.columns and c not in self.keys]
        name = self._writer(port_id, DELETE, writer)
        self._write(self._log_rows(keys.select(*self.keys, *carried), port_id, DELETE), batch_id, name)
        return name

    def clear(self, batch_id: int) -> None:
        """Every earlier row is gone from batch ``batch_id`` on."""
        marker = self.spark.createDataFrame([(int(batch_id),)], "cleared_at long")
        marker.write.mode("overwrite").parquet(f"{self.path}/clear/batch={int(batch_id)}")

    def replace(self, df: DataFrame, batch_id: int) -> None:
        """Update and clear as one batch; the new rows are there before the old ones go."""
        self.update(df, batch_id)
        self.clear(batch_id)

    # ------------------------------------------------------------------ reads
    def _fs(self, p: str):
        jvm = self.spark.sparkContext._jvm
        hp = jvm.org.apache.hadoop.fs.Path(p)
        return hp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hp

    def _exists(self, p: str) -> bool:
        fs, hp = self._fs(p)
        return fs.exists(hp)

    def _folders(self, folder: str, prefix: str) -> list[str]:
        """What follows ``prefix`` in the names of the sub-folders (metadata listing only)."""
        if not self._exists(folder):
            return []
        fs, hp = self._fs(folder)
        names = [st.getPath().getName() for st in fs.listStatus(hp)]
        return [n[len(prefix):] for n in names if n.startswith(prefix)]

    def _numbers(self, folder: str, prefix: str = "batch=") -> list[int]:
        return sorted(int(n) for n in self._folders(folder, prefix) if self._exists(f"{folder}/{prefix}{n}/_SUCCESS"))

    def _written(self) -> dict[str, int]:
        """Newest logged batch of each writer."""
        out: dict[str, int] = {}
        for n in self._folders(self.log_path, f"{BATCH}="):
            folder = f"{self.log_path}/{BATCH}={n}"
            for w in self._folders(folder, f"{WRITER}="):
                if self._exists(f"{folder}/{WRITER}={w}/_SUCCESS"):
                    out[w] = max(out.get(w, -1), int(n))
        return out

    def _log_schema(self) -> T.StructType:
        fields = self.schema.fields + [T.StructField(PRESENT, T.ArrayType(T.StringType())),
                                       T.StructField(SEQ, T.LongType()), T.StructField(OP, T.StringType()),
                                       T.StructField(PORT, T.IntegerType())]
        if not self.keys:
            fields.append(T.StructField(ROW_ID, ROW_ID_TYPE))
        return T.StructType(fields + [T.StructField(BATCH, T.LongType()), T.StructField(WRITER, T.StringType())])

    def _cleared_at(self, before: int | None = None) -> int | None:
        marks = [n for n in self._numbers(f"{self.path}/clear") if before is None or n < before]
        return marks[-1] if marks else None

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self._log_schema())

    def log(self, before: int | None = None, covered: dict[str, int] | None = None) -> DataFrame:
        """Change rows in force: those after the last clear (of batches older than ``before``), without the batches
        of each writer that ``covered`` says a snapshot holds."""
        if not self._written():
            return self._empty()
        df = self.spark.read.schema(self._log_schema()).parquet(self.log_path)
        cleared = self._cleared_at(before)
        if cleared is not None:
            df = df.where(F.col(BATCH) >= cleared)
        if before is not None:
            df = df.where(F.col(BATCH) < before)
        for w, n in (covered or {}).items():
            df = df.where((F.col(WRITER) != w) | (F.col(BATCH) > n))
        return df

    def batch_rows(self, batch_id: int, name: str) -> DataFrame:
        """The rows a writer logged as batch ``batch_id``: the table's columns, read from the log."""
        rows = self.spark.read.schema(self._log_schema()).parquet(f"{self.log_path}/{BATCH}={int(batch_id)}/{WRITER}={name}")
        return rows.select(*[_q(c) for c in self.columns()])

    def _snapshots(self) -> list[tuple[str, dict]]:
        """(path, description) of the complete snapshots, newest first."""
        folder, out = f"{self.path}/snapshot", []
        for n in sorted(self._folders(folder, "through="), key=lambda n: [int(x) for x in n.split("-")], reverse=True):
            about = f"{folder}/through={n}/about"
            if self._exists(f"{about}/_SUCCESS"):
                out.append((f"{folder}/through={n}", json.loads(self.spark.read.parquet(about).first()["about"])))
        return out

    def _usable(self, before: int | None = None) -> tuple[str, dict] | None:
        """The newest snapshot that holds no batch from ``before`` on and knows the last clear."""
        cleared = self._cleared_at(before)
        for path, about in self._snapshots():
            newest = max(about["covered"].values(), default=-1)
            if (before is None or newest < before) and about["cleared"] == cleared:
                return path, about
        return None

    def _state_log(self, before: int | None = None) -> DataFrame:
        """The newest usable snapshot (in log form) plus what was logged since.

        ``before``: only batches older than this one (the state a replayed
        batch must start from).
        """
        found = self._usable(before)
        if found is None:
            gone = self._vacuumed()
            if gone is not None and (before is None or before <= gone):
                raise ValueError(f"the log through batch {gone} is gone, and no snapshot holds the state asked for")
            return self.log(before)
        base = self.spark.read.schema(self._log_schema()).parquet(f"{found[0]}/rows")
        return base.unionByName(self.log(before, found[1]["covered"]))

    def _deadlines(self, log: DataFrame) -> DataFrame:
        """Keyed table with ``seq``: rows that no removal has outdated.

        A removal outdates the rows of its key up to the newest ``seq`` that
        arrived before it; among rows of that very ``seq`` those that arrived
        before it.
        """
        dead = log.where(F.col(OP) == DELETE)
        order, seq = F.struct(*[_q(c) for c in LOG_ORDER]), F.struct(*[_q(c) for c in self.seq])
        known = functools.reduce(operator.or_, [_q(c).isNotNull() for c in self.seq])
        last = dead.groupBy(*self.keys).agg(F.max(order).alias("_cut"), F.max(F.when(known, seq)).alias("_own"))
        last = last.withColumnsRenamed({k: f"_k_{k}" for k in self.keys})
        same = functools.reduce(operator.and_, [_q(k).eqNullSafe(F.col(f"`_k_{k}`")) for k in self.keys])
        live = log.where(F.col(OP) == UPSERT).join(last, same, "left")
        old = live.where(order < F.col("_cut")).groupBy(*[F.col(f"`_k_{k}`") for k in self.keys]).agg(F.max(seq).alias("_seen"))
        old = old.withColumnsRenamed({f"_k_{k}": f"_j_{k}" for k in self.keys})
        same = functools.reduce(operator.and_, [_q(k).eqNullSafe(F.col(f"`_j_{k}`")) for k in self.keys])
        dated = live.join(old, same, "left").withColumn("_until", F.greatest("_own", "_seen"))
        alive = F.col("_until").isNull() | (seq > F.col("_until")) | ((seq == F.col("_until")) & (order > F.col("_cut")))
        return dated.where(alive).select(*[_q(c) for c in log.columns])

    def _removals(self, before: int | None) -> bool:
        """Whether any writer has logged removals (folder names only)."""
        kind = f"-{WRITER_KINDS[DELETE]}{DELETE}"
        found = self._usable(before)
        return any(w.endswith(kind) for w in [*self._written(), *(found[1]["covered"] if found else ())])

    def _fold(self, log: DataFrame, before: int | None = None, keep: list[str] | None = None) -> DataFrame:
        names = keep or self.columns()
        if self.keys:
            if self.seq and self._removals(before):
                log = self._deadlines(log)
            # every row carries its port
            none = F.array().cast("array<string>")
            log = log.withColumn(PRESENT, F.concat(F.coalesce(F.col(PRESENT), none), F.array(F.lit(PORT))))
            return latest_per_key(log, self.keys, self.seq + LOG_ORDER, nulls=self.nulls, op_col=OP,
                                  keep=[c for c in names if c not in self.keys] + [PORT],
                                  present_col=PRESENT if self.nulls == "overwrite" else None)
        out = self._patched(log.where(F.col(OP) == UPSERT), before)
        if self.limit is not None:
            out = newest_rows(out, self.seq + LOG_ORDER, self.limit)
        return out

    def _patches(self, before: int | None) -> DataFrame | None:
        if not self._numbers(f"{self.path}/patch"):
            return None
        schema = T.StructType([f for f in self._log_schema().fields if f.name != WRITER])
        patches = self.spark.read.schema(schema).parquet(f"{self.path}/patch")
        cleared = self._cleared_at(before)
        if cleared is not None:
            patches = patches.where(F.col(BATCH) >= cleared)
        return patches if before is None else patches.where(F.col(BATCH) < before)

    def _patched(self, rows: DataFrame, before: int | None) -> DataFrame:
        """Patched cells on the rows they name; rows keep their arrival, unknown row numbers change nothing."""
        patches = self._patches(before)
        if patches is None:
            return rows
        names = self.columns()
        cells = latest_per_key(patches, ROW_ID, [BATCH, SEQ], nulls="keep", keep=names)
        cells = cells.select(F.col(ROW_ID).alias("_pid"), *[_q(c).alias(f"_new_{c}") for c in names])
        out = rows.join(cells, F.col(ROW_ID) == F.col("_pid"), "left")
        return out.select(*[F.coalesce(F.col(f"`_new_{c}`"), _q(c)).alias(c) if c in names else _q(c) for c in rows.columns])

    def snapshot(self, *, with_meta: bool = False, before: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """The table now (or as of just before batch ``before``): newest row per
        key, all rows, or the newest ``limit``.  ``columns`` are the only ones
        carried through the fold (keys always come along)."""
        names = self.columns()
        if columns is not None:
            names = [c for c in names if c in columns or c in self.keys]
        out = self._fold(self._state_log(before), before, names)
        cols = names + ([*LOG_ORDER, PORT] if with_meta else []) + ([ROW_ID] if not self.keys and with_meta else [])
        return out.select(*[_q(c) for c in cols])

    def patch_rows(self, patches: DataFrame, batch_id: int) -> None:
        """Change cells of an append table by implicit row number ``_row_id``.

        ``patches`` holds ``_row_id`` (as returned by ``snapshot(with_meta=True)``)
        plus the changed cells; null cells are left as they are.
        """
        if self.keys:
            raise ValueError("patch_rows() is for append tables; use update() on keyed tables")
        rows = self._log_rows(patches, 0, UPSERT, [T.StructField(ROW_ID, ROW_ID_TYPE)])
        rows.write.mode("overwrite").parquet(f"{self.path}/patch/batch={int(batch_id)}")

    # ----------------------------------------------------------------- upkeep
    def _deciding(self, log: DataFrame) -> DataFrame:
        """The change rows of a keyed table that can still decide a cell, a removal or an order."""
        order = F.struct(*[_q(c) for c in self.seq + LOG_ORDER])
        arrival, dead = F.struct(*[_q(c) for c in LOG_ORDER]), F.col(OP) == DELETE
        renamed = {k: f"_k_{k}" for k in self.keys}
        same = functools.reduce(operator.and_, [_q(k).eqNullSafe(F.col(f"`_k_{k}`")) for k in self.keys])
        cuts = log.where(dead).groupBy(*self.keys).agg(F.max(arrival).alias("_cut"))
        cut = log.join(cuts.withColumnsRenamed(renamed), same, "left").drop(*renamed.values())
        # the newest row, the newest before the last removal (it dates the removal), and the winner of each cell
        wins = {"_newest": F.max(F.when(~dead, order)), "_edge": F.max(F.when(~dead & (arrival < F.col("_cut")), order)),
                "_own": F.max(F.when(dead, order))}
        for i, c in enumerate(self.columns()):
            carried = _q(c).isNotNull() if self.nulls == "keep" else F.coalesce(F.array_contains(PRESENT, F.lit(c)), F.lit(False))
            wins[f"_w{i}"] = F.max(F.when(carried & ~dead, order))
        best = cut.groupBy(*self.keys).agg(*[w.alias(n) for n, w in wins.items()]).withColumnsRenamed(renamed)
        won = functools.reduce(operator.or_, [F.coalesce(order == F.col(n), F.lit(False)) for n in wins])
        kept = won | F.coalesce(dead & (arrival == F.col("_cut")), F.lit(False))
        return cut.join(best, same).where(kept).select(*[_q(c) for c in log.columns])

    def compact(self, through: int | None = None) -> str | None:
        """Write ``snapshot/through=N``: what the log through batch ``through``
        (default: the newest) still has to say.  Readers then take that
        snapshot and each writer's later batches; cells keep their order and
        removals stay, so nothing that arrives later reads differently.  A
        capped table keeps its newest rows only.  Old files stay for readers
        in flight until :meth:`vacuum`.
        """
        covered = {}
        for n in self._folders(self.log_path, f"{BATCH}="):
            if through is None or int(n) <= through:
                for w in self._folders(f"{self.log_path}/{BATCH}={n}", f"{WRITER}="):
                    covered[w] = max(covered.get(w, -1), int(n))
        if not covered:
            return None
        folder, n = f"{self.path}/snapshot", max(covered.values())
        found = self._usable()
        if found and all(found[1]["covered"].get(w, -1) >= b for w, b in covered.items()):
            return found[0]
        if found:
            covered = {w: max(covered.get(w, -1), found[1]["covered"].get(w, -1)) for w in {*covered, *found[1]["covered"]}}
        upto = functools.reduce(operator.or_, [(F.col(WRITER) == w) & (F.col(BATCH) <= b) for w, b in covered.items()])
        state = self._state_log().where(upto)
        if self.keys:
            state = self._deciding(state)
        elif self.limit is not None:
            state = newest_rows(state, self.seq + LOG_ORDER, self.limit)
        taken = self._folders(folder, "through=")
        name = str(n) if str(n) not in taken else f"{n}-{sum(t.split('-')[0] == str(n) for t in taken)}"
        out = f"{folder}/through={name}"
        fields = self._log_schema().fields
        state.select(*[_q(f.name).cast(f.dataType) for f in fields]).write.mode("overwrite").parquet(f"{out}/rows")
        about = json.dumps({"covered": covered, "cleared": self._cleared_at()})
        self.spark.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{out}/about")
        return out

    def _vacuumed(self) -> int | None:
        gone = self._numbers(f"{self.path}/vacuum", "through=")
        return gone[-1] if gone else None

    def vacuum(self, keep: int = 2) -> int:
        """Let go of log batches that the ``keep`` newest snapshots all hold, and of older snapshots; returns the
        number of folders removed.  States before those snapshots can't be read any more."""
        snapshots = self._snapshots()
        if len(snapshots) < keep or any(a["cleared"] != self._cleared_at() for _, a in snapshots[:keep]):
            return 0
        covered = snapshots[keep - 1][1]["covered"]
        doomed = [f"{self.log_path}/{BATCH}={n}/{WRITER}={w}" for n in self._folders(self.log_path, f"{BATCH}=")
                  for w in self._folders(f"{self.log_path}/{BATCH}={n}", f"{WRITER}=") if int(n) <= covered.get(w, -1)]
        doomed += [path for path, _ in snapshots[keep:]]
        if doomed:
            through = max(covered.values())
            self.spark.createDataFrame([(through,)], "through long").write.mode("overwrite").parquet(f"{self.path}/vacuum/through={through}")
        for p in doomed:
            fs, hp = self._fs(p)
            fs.delete(hp, True)
        return len(doomed)


def patch_by_row_id(base: DataFrame, patches: DataFrame, *, row_id: str = ROW_ID,
                    seq: str = SEQ) -> DataFrame:
    """Apply partial rows keyed by the implicit row number.

    ``base`` rows and ``patches`` (``row_id`` + changed cells, others null)
    form one log; the fold keeps each cell's newest non-null value.
    """
    log = base.unionByName(patches, allowMissingColumns=True)
    cols = [c for c in base.columns if c not in (row_id, seq)]
    return latest_per_key(log, row_id, seq, nulls="keep", keep=cols).select(row_id, *cols)
