"""Prefix trie of conversations, from adaptive radix trees over fixed-width turn ids.

A turn is one id, the 16 bytes of a digest of role and text; a conversation's key is its turn ids in a row. Keys are
range-sorted over the cluster, and each run of at most RUN sorted keys becomes an adaptive radix tree: nodes grow from
4 to 16, 48 and 256 children, and a path without branches is one node with a compressed prefix. Only byte depths that
are a whole number of turns emit trie nodes. A node that is no prefix of its run's first or last key lies in that run
alone and is complete. The others, at most two paths a run, are edges: what the runs know of them is summed up by
node, and their own small tree is closed from the deepest nodes up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import stored

#: Bytes of a turn id.
WIDTH = 16
#: Keys, and bytes of keys, of which one radix tree is made.
RUN, RUN_BYTES = 50_000, 32 << 20
#: Ids in a piece of a list of conversations that end at an edge node.
PIECE = 50_000

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# ---- adaptive radix tree

class Node:
    """A node with its compressed ``prefix`` (bytes after its parent's branch byte), the ``ids`` of keys that end there and
    the numbers ``size`` that come with those keys. ``small`` holds the branch bytes of layouts 4 and 16, sorted beside
    ``kids``; ``index`` maps a byte to its place in ``kids`` (48), or ``kids`` has a place for every byte (256)."""

    __slots__ = ("prefix", "ids", "sizes", "layout", "small", "index", "kids")

    def __init__(self, prefix: bytes):
        self.prefix, self.ids, self.sizes = prefix, None, None
        self.layout, self.small, self.index, self.kids = 4, bytearray(), None, []

    def child(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.kids[byte]
        if self.layout == 48:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        at = bisect_left(self.small, byte)
        return self.kids[at] if at < len(self.small) and self.small[at] == byte else None

    def put(self, byte: int, kid: Node) -> None:
        """Set the child of a branch byte, in the next larger layout where this one is full."""
        if self.layout <= 16:
            at = bisect_left(self.small, byte)
            if at < len(self.small) and self.small[at] == byte:
                self.kids[at] = kid
                return
            if len(self.small) < self.layout:
                self.small.insert(at, byte)
                self.kids.insert(at, kid)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                self.layout, self.index = 48, bytearray(256)
                for i, b in enumerate(self.small):
                    self.index[b] = i + 1
                self.small = None
            return self.put(byte, kid)
        if self.layout == 48:
            at = self.index[byte]
            if at:
                self.kids[at - 1] = kid
                return
            if len(self.kids) < 48:
                self.kids.append(kid)
                self.index[byte] = len(self.kids)
                return
            wide = [None] * 256
            for b, i in enumerate(self.index):
                if i:
                    wide[b] = self.kids[i - 1]
            self.layout, self.index, self.kids = 256, None, wide
        self.kids[byte] = kid

    def branches(self) -> Iterator[tuple[int, Node]]:
        """(branch byte, child) in ascending order of bytes."""
        if self.layout <= 16:
            yield from zip(self.small, self.kids)
        elif self.layout == 48:
            yield from ((b, self.kids[i - 1]) for b, i in enumerate(self.index) if i)
        else:
            yield from ((b, n) for b, n in enumerate(self.kids) if n is not None)


class RadixTree:
    """Byte keys with the ids of those that are equal, and numbers that equal keys share."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, own: int, sizes: list[int]) -> None:
        node, at, above, byte = self.root, 0, None, 0
        while True:
            p, rest = node.prefix, len(key) - at
            if len(p) > rest or key[at:at + len(p)] != p:  # the key leaves inside the compressed path: split it
                k = next((i for i in range(min(len(p), rest)) if p[i] != key[at + i]), min(len(p), rest))
                upper = Node(p[:k])
                node.prefix = p[k + 1:]
                upper.put(p[k], node)
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node, at = upper, at + k
            else:
                at += len(p)
            if at == len(key):
                if node.ids is None:
                    node.ids, node.sizes = [], sizes
                node.ids.append(own)
                return
            above, byte = node, key[at]
            node = above.child(byte)
            at += 1
            if node is None:
                node = Node(key[at:])
                above.put(byte, node)


def _chain(digest: bytes, turn: bytes) -> bytes:
    """The name of a trie node: that of its parent digested with the turn that leads to it."""
    return hashlib.blake2b(digest + turn, digest_size=16).digest()


class _Open:
    """A trie node whose subtree is being walked."""

    __slots__ = ("name", "parent", "depth", "ids", "size", "low", "n", "children", "leaves", "saved", "edge")

    def __init__(self, name, parent, depth, size, edge):
        self.name, self.parent, self.depth, self.size, self.edge = name, parent, depth, size, edge
        self.ids, self.low, self.n, self.children, self.leaves, self.saved = None, None, 0, 0, 0, 0


def trie_nodes(tree: RadixTree, first: bytes, last: bytes) -> Iterator[_Open]:
    """The trie's nodes, children before their parents, from one walk of the radix tree.

    An edge node (a prefix of ``first`` or ``last``) holds what lies below it apart from edge nodes: children, childless
    nodes and saved tokens of the inner nodes of its subtree; whether it has children itself is not decided here."""
    top = _Open(b"", None, 0, 0, True)
    path, todo = [top], [(0, tree.root, None, b"")]
    # todo: (byte depth, radix node, branch byte, bytes since the last whole turn) to enter; (None, ...) closes a depth
    while todo:
        at, node, byte, tail = todo.pop()
        while len(path) - 1 > at // WIDTH:
            yield _close(path)
        tail = tail + (b"" if byte is None else bytes([byte])) + node.prefix
        sizes = None
        while len(tail) >= WIDTH:
            if sizes is None:
                sizes = _sizes(node)
            turn, tail, above = tail[:WIDTH], tail[WIDTH:], path[-1]
            depth = above.depth + 1
            lo, hi = above.depth * WIDTH, depth * WIDTH
            edge = above.edge and (_on(first, above, lo, hi, turn) or _on(last, above, lo, hi, turn))
            path.append(_Open(_chain(above.name, turn), above, depth, sizes[depth - 1], edge))
        if node.ids is not None:
            path[-1].ids = node.ids
        here = path[-1].depth * WIDTH + len(tail)
        todo += [(here, kid, b, tail) for b, kid in reversed(list(node.branches()))]
    while path:
        yield _close(path)


def _on(key: bytes, above: _Open, lo: int, hi: int, turn: bytes) -> bool:
    """Whether the child of ``above`` by ``turn`` is a prefix of ``key``; the names of prefixes tell that ``above`` is one."""
    return key[lo:hi] == turn and _name(key, above.depth) == above.name


_names: dict[bytes, list[bytes]] = {}


def _name(key: bytes, depth: int) -> bytes:
    if key not in _names:
        if len(_names) > 1:
            _names.clear()
        _names[key] = [b""]
    names = _names[key]
    while len(names) <= depth:
        d = len(names) - 1
        names.append(_chain(names[-1], key[d * WIDTH:(d + 1) * WIDTH]))
    return names[depth]


def _sizes(node: Node) -> list[int]:
    """The sizes of the turns of any key at or below a node."""
    while node.sizes is None:
        node = next(node.branches())[1]
    return node.sizes


def _close(path: list[_Open]) -> _Open:
    x = path.pop()
    if x.ids:
        x.n += len(x.ids)
        x.low = min(x.ids) if x.low is None else min(x.low, min(x.ids))
    if not x.edge:
        x.leaves += x.children == 0
        x.saved += (x.n - 1) * x.size
    if path:
        up = path[-1]
        up.n += x.n
        up.low = x.low if up.low is None else min(up.low, x.low)
        if not x.edge:
            up.children += 1
        if not (x.edge and up.edge):  # edge nodes below edge nodes are closed later, over all runs
            up.leaves += x.leaves
            up.saved += x.saved
    return x


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, sorted(ids))).encode()


ROWS = ("name binary, parent binary, depth int, conv_id long, parent_low long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, size long, edge boolean, part long, piece int, ends binary")


def _run_rows(keys: list[tuple[bytes, int, list[int]]], part: int) -> pa.RecordBatch:
    """Rows of ROWS for a run of sorted keys: its inner nodes, complete but for parents that are edges; its edge nodes; and
    the ids of conversations that end at edge nodes, in sorted pieces."""
    tree = RadixTree()
    for key, own, sizes in keys:
        tree.insert(key, own, sizes)
    rows, waiting = [], []

    for x in trie_nodes(tree, keys[0][0], keys[-1][0]):
        up = x.parent
        digest = None if x.edge else hashlib.sha256(_joined(x.ids)).hexdigest() if x.ids else EMPTY_SHA256
        row = [x.name, up.name if up else None, x.depth, x.low, None, x.n, x.children, x.leaves, x.saved, digest, x.size,
               x.edge, part, None, None]
        rows.append(row)
        if up is not None and not up.edge:
            waiting.append((row, up))
        if x.edge and x.ids:
            ids = sorted(x.ids)
            for i in range(0, len(ids), PIECE):
                rows.append([x.name, *[None] * 10, True, part, i // PIECE, _joined(ids[i:i + PIECE])])
    for row, up in waiting:  # a parent is closed after its children
        row[4] = up.low
    fields = pa.schema([(c.split()[0], {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(),
                                        "boolean": pa.bool_()}[c.split()[1]]) for c in ROWS.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def _trees(limit: int):
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for key, own, sizes in zip(*(batch.column(i) for i in range(3))):
                run.append((key.as_py(), own.as_py(), sizes.as_py()))
                held += len(run[-1][0]) * 2
                if len(run) >= limit or held >= RUN_BYTES:
                    yield _run_rows(run, part)
                    part, run, held = part + 1, [], 0
        if run:
            yield _run_rows(run, part)

    return trees


# ---- jobs

def turn_id(*parts: Column) -> Column:
    """The digest that stands for a turn; lengths keep its parts apart."""
    told = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.encode(F.concat(*told), "UTF-8")))


def conversations(turns: DataFrame, id_col: str = "conv_id", order: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv, turns): every conversation's turns (id, size) in order, size the code points of the text.

    Turns stand by ``order``, null first, equal ones by their id; null roles and texts are empty. Rows without a
    conversation are left out. The texts end here: 16 bytes and a number for each turn go on.
    """
    own, said = F.coalesce(turns[f"`{role}`"].cast("string"), F.lit("")), F.coalesce(turns[f"`{text}`"].cast("string"), F.lit(""))
    rows = turns.select(turns[f"`{id_col}`"].cast("long").alias("conv"), turns[f"`{order}`"].alias("at"),
                        turn_id(own, said).alias("id"), F.char_length(said).cast("long").alias("size")).where("conv is not null")
    kept = F.struct(F.col("at").isNotNull().alias("known"), "at", "id", "size")
    said = F.transform(F.array_sort(F.collect_list(kept)), lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))
    return rows.groupBy("conv").agg(said.alias("turns"))


def rebuilt(convs: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv, turns): the first h turns of conversation c - c % ``block`` (all if fewer, none if absent), then the turns of c
    after its first h; h is the crc32 of the decimal id modulo ``heads``."""
    convs = stored(convs, "conversations")
    base = (F.col("conv") - F.col("conv") % block).alias("base")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    starts = (convs.where(F.col("conv") % block == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
              if heads > 1 else None)
    if starts is None:
        return convs
    out = convs.select("conv", "turns", base, h.alias("h")).join(starts, "base", "left")
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("turns", 1, 0)).otherwise(F.expr("slice(head, 1, h)"))
    return out.select("conv", F.concat(head, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


def trie(convs: DataFrame, run: int = RUN) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv, turns), a row for each different sequence of first turns: conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root only; equal conversations end at the same node; an empty table
    has no nodes. A conversation's turn ids (16 bytes a turn, no texts) are one key; ``conv`` is unique. ``run`` keys at most
    make one radix tree.
    """
    key = F.coalesce(F.expr("aggregate(turns.id, cast('' as binary), (a, x) -> concat(a, x))"), F.lit(b""))
    keys = convs.select(key.alias("key"), "conv", F.col("turns.size").alias("sizes"))
    runs = keys.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_trees(run), ROWS)
    runs = stored(runs, "trie-runs")
    pieces, nodes = runs.where("piece is not null"), runs.where("piece is null")
    edges = _closed(stored(nodes.where("edge").groupBy("name").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.first("size").alias("size")),
        "trie-edges"))
    edges = stored(edges, "trie-closed")
    digests = (pieces.select("name", "part", "piece", "ends").repartition("name").sortWithinPartitions("name", "part", "piece")
               .mapInArrow(_digests, "name binary, ends_sha256 string"))
    edges = edges.join(digests, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    above = edges.select(F.col("name").alias("parent"), F.col("conv_id").alias("edge_low"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = (nodes.where("not edge").join(above, "parent", "left")
             .withColumn("parent_conv_id", F.coalesce("parent_low", "edge_low")))
    edges = edges.join(above, "parent", "left").withColumnRenamed("edge_low", "parent_conv_id")
    return inner.select(columns).unionByName(edges.select(columns)).withColumn("depth", F.col("depth").cast("long"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each name's pieces, which come in order; only one piece is held at a time."""
    now, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    for batch in batches:
        for name, ends in zip(batch.column("name"), batch.column("ends")):
            if (name := name.as_py()) != now:
                if state is not None:
                    yield out()
                now, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.as_buffer())
    if state is not None:
        yield out()


def _closed(edges: DataFrame) -> DataFrame:
    """Edge nodes with the totals of their subtrees. They are at most two paths a run, so one task closes them all."""
    fields = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        children: dict[bytes, int] = {}
        leaves: dict[bytes, int] = {}
        saved: dict[bytes, int] = {}

        for batch in batches:  # the deepest first
            rows = [dict(r) for r in batch.to_pylist()]
            for r in rows:
                name = r["name"]
                r["n_children"] += children.pop(name, 0)
                r["n_leaves"] += leaves.pop(name, 0) + (r["n_children"] == 0)
                r["saved_tokens"] += saved.pop(name, 0) + (r["n_convs"] - 1) * r["size"]
                if (up := r["parent"]) is not None:
                    children[up] = children.get(up, 0) + 1
                    leaves[up] = leaves.get(up, 0) + r["n_leaves"]
                    saved[up] = saved.get(up, 0) + r["saved_tokens"]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    ordered = edges.coalesce(1).sortWithinPartitions(F.col("depth").desc())
    return ordered.mapInArrow(run, edges.schema).select(fields)


__all__ = ["conversations", "rebuilt", "trie", "RadixTree", "trie_nodes", "turn_id"]
