"""Token-id files: texts become ids of a tokenizer's vocabulary, stored in patched frame-of-reference blocks.

A file is a run of segments, each followed by one line feed. A segment holds whole documents: a header, the ids of the
documents, their lengths and the ids of all their tokens. Lengths and tokens are packed in blocks of BLOCK numbers: the
block's minimum is subtracted, the rest is packed at the width that one of a few percentiles of the block needs,
whichever makes the block smallest, and the numbers that need more bits are stored whole in a list of exceptions. An
index of block starts lets a reader decode only the blocks that a range of positions touches.

Files are written by Spark's own text writer (bytes as they are), so its commit protocol covers lost tasks and any
storage that Spark reaches; they are read by its binary file source.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from gridlens.llm.common import scratch_path, small_batches, stored

MAGIC, BLOCK = b"PFR1", 256
#: Shares of a block's numbers of which one chooses its width; the last always packs all.
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.98, 1.0)
#: Tokens of a segment (a longer document has one of its own) and bytes of text of a file.
SEGMENT, FILE_BYTES = 1 << 18, 32 << 20
#: magic, number of the file, documents, position of the first token in the file, then bytes of: ids, lengths, tokens.
HEADER = struct.Struct("<4sIIQIII")
#: Pieces of words, and words that Arrow doesn't part, whose ids a Python worker remembers.
REMEMBERED_PIECES, REMEMBERED_WORDS = 600_000, 200_000


# ---- blocks

def _widths(high: np.ndarray) -> np.ndarray:
    return np.frexp(high.astype(np.float64))[1].astype(np.int64)


def _highest(widths: np.ndarray) -> np.ndarray:
    """The greatest number of each width."""
    return ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def _places(width: int) -> list[tuple[int, int, int]]:
    """(place in the block, 64-bit word it starts in, bit of that word) of each packed number."""
    return [(j, *divmod(j * width, 64)) for j in range(BLOCK)]


def _packed(rows: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of the numbers of each row (blocks, BLOCK), as rows of 64-bit words."""
    low = np.ascontiguousarray(rows.T).astype(np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((BLOCK * width // 64, len(rows)), np.uint64)
    for j, k, bit in _places(width) if width else ():
        words[k] |= low[j] << np.uint64(bit)
        if bit + width > 64:
            words[k + 1] |= low[j] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words.T)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """What :func:`_packed` packed: (blocks, BLOCK)."""
    w = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, len(words)), np.uint64)
    for j, k, bit in _places(width) if width else ():
        out[j] = w[k] >> np.uint64(bit)
        if bit + width > 64:
            out[j] |= w[k + 1] << np.uint64(64 - bit)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32).T


def pack(values: np.ndarray) -> bytes:
    """Patched frame of reference of unsigned 32-bit numbers; the last block is filled up with the last number.

    Layout: number of values, number of blocks, start of each block and the end of the last (all unsigned 32-bit);
    a block: minimum (32 bits), width (8), number of exceptions (16), packed values, places of the exceptions in the
    block (8 each), their differences from the minimum (32 each)."""
    n = len(values)
    n_blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<III", 0, 0, 0)
    padded = np.full(n_blocks * BLOCK, values[-1], np.uint32)
    padded[:n] = values
    v = padded.reshape(n_blocks, BLOCK)
    least = v.min(1)
    d = v - least[:, None]
    ranked = np.sort(d, 1)
    widths = _widths(ranked[:, [int(np.ceil(p * BLOCK)) - 1 for p in PERCENTILES]])
    above = np.stack([(d > _highest(w)[:, None]).sum(1) for w in widths.T], 1)
    width = widths[np.arange(n_blocks), np.argmin(widths * BLOCK + above * 40, 1)]
    body: list = [b""] * n_blocks
    for w in np.unique(width).tolist():
        mine = np.nonzero(width == w)[0]
        data, size = memoryview(_packed(d[mine], w).tobytes()), BLOCK * w // 8
        for i, row in enumerate(mine.tolist()):
            body[row] = data[i * size:(i + 1) * size]
    block, place = np.nonzero(d > _highest(width)[:, None])
    values_out, places_out = d[block, place].astype("<u4").tobytes(), place.astype(np.uint8).tobytes()
    ends = np.searchsorted(block, np.arange(n_blocks + 1)).tolist()
    parts, starts, total = [], [0], 0
    for i, (low, w) in enumerate(zip(least.tolist(), width.tolist())):
        a, z = ends[i], ends[i + 1]
        parts += (struct.pack("<IBH", low, w, z - a), body[i], places_out[a:z], values_out[4 * a:4 * z])
        total += 7 + BLOCK * w // 8 + 5 * (z - a)
        starts.append(total)
    return struct.pack("<II", n, n_blocks) + np.array(starts, "<u4").tobytes() + b"".join(parts)


def unpack(data: bytes | memoryview, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The numbers at the positions [start, stop) of what :func:`pack` made; only the blocks they lie in are decoded."""
    data = memoryview(data)
    n, n_blocks = struct.unpack_from("<II", data)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    base = 12 + 4 * n_blocks
    first, last = start // BLOCK, (stop - 1) // BLOCK
    at = (np.frombuffer(data[8:base], "<u4")[first:last + 1].astype(np.int64) + base).tolist()
    heads = [struct.unpack_from("<IBH", data, i) for i in at]
    least, width, exceptions = (np.array(c, np.int64) for c in zip(*heads))
    out = np.empty((len(at), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        mine = np.nonzero(width == w)[0]
        size = BLOCK * w // 8
        packed = b"".join([data[at[i] + 7:at[i] + 7 + size] for i in mine.tolist()])
        out[mine] = _unpacked(np.frombuffer(packed, "<u8").reshape(len(mine), size // 8), w)
    for i in np.nonzero(exceptions)[0].tolist():
        a, k = at[i] + 7 + BLOCK * int(width[i]) // 8, int(exceptions[i])
        out[i, np.frombuffer(data[a:a + k], np.uint8)] = np.frombuffer(data[a + k:a + 5 * k], "<u4")
    return (out + least.astype(np.uint32)[:, None]).reshape(-1)[start - first * BLOCK:stop - first * BLOCK]


# ---- segments

def segment(part: int, first: int, ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    """A segment of whole documents; ``first`` is the position of its first token in the file."""
    known = np.array([i is not None for i in ids], np.uint8)
    own = np.array([i or 0 for i in ids], "<i8").tobytes() + known.tobytes()
    lengths = pack(np.array([len(t) for t in tokens], np.uint32))
    body = pack(np.concatenate(tokens).astype(np.uint32))
    return HEADER.pack(MAGIC, part, len(ids), first, len(own), len(lengths), len(body)) + own + lengths + body


def segments(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, memoryview]]:
    """(number of the file, position of the first token, document ids, lengths, packed tokens) of each segment."""
    data, at = memoryview(content), 0
    while at < len(data):
        magic, part, n, first, a, b, c = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += HEADER.size
        known = np.frombuffer(data[at + 8 * n:at + a], np.uint8)
        ids = [i if k else None for i, k in zip(np.frombuffer(data[at:at + 8 * n], "<i8").tolist(), known)]
        yield part, first, ids, unpack(data[at + a:at + a + b]), data[at + a + b:at + a + b + c]
        at += a + b + c + 1  # the line feed


# ---- tokens

def _drops_space(tokenizer: Tokenizer) -> bool:
    """Whether white space only separates words for this tokenizer, so that texts can be encoded word by word: it
    normalises characters one by one, to lower case, and its pieces are the matches of a pattern without white space."""
    spec = json.loads(tokenizer.to_str())
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
            and pre[0]["pattern"].get("Regex") == WORD_PATTERN and not pre[1]["add_prefix_space"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))


#: The one pattern of pieces whose matches are known to be those of each word by itself.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: WORD_PATTERN for lower-case words of printable ASCII.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Words of printable ASCII and of the letters from U+00C0 to U+00FF, which don't combine with one another and have one
#: lower-case letter each; and WORD_PATTERN for such words in lower case. Both are for Arrow.
PLAIN = r"^[!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*$"
PLAIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+|[0-9]|[^a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}]+"


class Recent(dict):
    """Values of the keys used last: a full dictionary becomes the older one in place of that before it, from which keys
    met again come back. None for a key in neither."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        return None if value is None else self.put(key, value)

    def put(self, key, value):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Words(Recent):
    """Ids of words, as bytes of 32-bit numbers. Lower-case words of printable ASCII, and words of Latin letters with at
    most a mark behind, need no normaliser; their pieces go to the model at once, each piece once while remembered."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__(REMEMBERED_WORDS)
        self.model, self.tokenizer = tokenizer.model, tokenizer
        self.of_piece = Recent(REMEMBERED_PIECES)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.as_bytes = {c: as_bytes(chr(c))[0][0] for c in range(0x80, 0x250)}

    def __missing__(self, word: bytes) -> bytes:
        known = super().__missing__(word)
        if known is not None:
            return known
        pieces = self._pieces(word.decode())
        if pieces is None:
            return self.put(word, array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes())
        return self.put(word, b"".join(self._modelled(pieces)))

    def _modelled(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces; the model is asked once for those of words that differ by the marks around them."""
        out = list(map(self.of_piece.__getitem__, pieces))
        for k, piece in enumerate(pieces):
            if out[k] is None:
                known = piece if piece.isascii() else piece.translate(self.as_bytes)
                out[k] = self.of_piece.put(piece, array("I", [t.id for t in self.model.tokenize(known)]).tobytes())
        return out

    def _pieces(self, word: str) -> list[str] | None:
        """The pieces of a word as normalised, None where only the library may say."""
        if word.isascii():
            if word.isalpha():
                return [word]
            return ASCII_PIECES.findall(word) if word.isprintable() and "<|" not in word else None
        mark = word[-1] if word[-1] in ".,;:!?)" else ""
        letters = word[:-1] if mark else word
        # letters below U+0250 don't combine with one another, and those below U+0100 have one lower-case letter each
        if letters.isalpha():
            most, lower = max(letters), letters.lower()
            if most < "\u0100" or (most < "\u0250" and lower == letters):
                return [lower, *mark]
        return None

    def all(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of different words. Arrow parts the plain ones into pieces, of which each different one is looked up."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        lower = pc.utf8_lower(pc.if_else(plain, words, ""))
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, PLAIN_PIECES, r"\0 "))
        ids = _spelled(pieces, lambda different: self._modelled(_listed(different)))
        if pc.all(plain).as_py() in (True, None):
            return ids
        others = list(map(self.__getitem__, _listed(words.filter(pc.invert(plain)).cast(pa.binary()))))
        return pc.replace_with_mask(ids, pc.invert(plain), pa.array(others, pa.large_binary()))


def _listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def _spelled(parts: pa.ListArray, ids_of) -> pa.LargeBinaryArray:
    """The ids of the parts of each list one after another; ``ids_of`` gives those of all different parts."""
    coded = parts.flatten().dictionary_encode()
    ids = pa.array(ids_of(coded.dictionary), pa.large_binary()).take(coded.indices)
    offsets = _offsets(ids)[_offsets(parts) - parts.offsets[0].as_py()]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(offsets), ids.buffers()[2]])


def _offsets(values: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(values.type)
    return np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset:values.offset + len(values) + 1]


class Encoder:
    """Ids of whole texts, ``end`` appended. A tokenizer for which white space only separates words encodes each
    different word of a batch once; any other gets the texts as they are."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer) if _drops_space(self.tokenizer) else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each vocabulary and Python worker, which serves many tasks."""
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def ids(self, text: str | None, end: int) -> np.ndarray:
        return self.all(pa.array([text or ""]), end)[0]

    def all(self, texts: pa.StringArray, end: int) -> list[np.ndarray]:
        """Ids of each text of a batch without nulls."""
        if self.words is None:
            return [np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end], np.uint32) for t in _listed(texts)]
        special = pc.match_substring(texts, "<|")  # special tokens count in their own case only
        kept = [b" ".join([w if b"<|" in w else w.lower() for w in t.split()])
                for t in _listed(texts.filter(special).cast(pa.binary()))]
        lower = pc.replace_with_mask(pc.ascii_lower(texts), special, pa.array(kept, pa.binary()).cast(texts.type))
        found = _spelled(pc.ascii_split_whitespace(lower), self.words.all)
        ids, at = np.frombuffer(found.buffers()[2], "<u4"), (_offsets(found) // 4).tolist()
        return [np.append(ids[a:z], np.uint32(end)) for a, z in zip(at, at[1:])]


# ---- jobs

def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int, file_bytes: int = FILE_BYTES, text: str = "text",
              id_col: str = "doc_id") -> None:
    """Write the token ids of all whole texts, each with ``end`` appended, to files under ``path``.

    Documents stand in ascending order of ``id_col`` (an integer column; null last; equal ids by text); the files hold
    ranges of it, about ``file_bytes`` of text each, and are numbered in that order. Null texts are empty: their ids are
    ``end`` alone. Rows that repeat are documents of their own; an empty table writes no segment. A text is tokenized
    once, in the task that writes its file.
    """
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), body.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    # repeated rows are told apart by their place as read, so that a hot one spreads over files as well
    ranges = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order, F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, ids, tokens, held = TaskContext.get().partitionId(), 0, [], [], 0
        encoder = Encoder.of(tokenizer)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(part, first, ids, tokens)], pa.binary())], ["value"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), encoder.all(batch.column(1), end)):
                if held and held + len(t) > SEGMENT:
                    yield out()
                    first, ids, tokens, held = first + held, [], [], 0
                ids.append(i)
                tokens.append(t)
                held += len(t)
        if held:
            yield out()

    small_batches(docs.sparkSession)
    packed = ranges.sortWithinPartitions(*order).mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def read_ids(spark, path: str) -> DataFrame:
    """(part, doc_id, at, ids): every document of the files under ``path``; ``at`` is the position of its first id in
    file ``part``, ``ids`` are the ids as little-endian unsigned 32-bit numbers. A file is decoded segment by segment."""
    return _decoded(spark, path, "part int, doc_id long, at long, ids binary", lambda ids: pa.array(ids, pa.binary()))


def id_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files under ``path``: ``start`` counts the ids of
    all documents before it, in all files; ``ids_crc32`` is the crc32 of its ids as little-endian 32-bit numbers."""
    digests = _decoded(spark, path, "part int, doc_id long, at long, n_tokens long, ids_crc32 long",
                       lambda ids: [pa.array([len(i) // 4 for i in ids], pa.int64()),
                                    pa.array([zlib.crc32(i) for i in ids], pa.int64())])
    digests = stored(digests, "digests")
    # a row per file
    files = digests.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return digests.join(files, "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _decoded(spark, path: str, schema: str, columns) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, first, ids, lengths, packed in segments(content.as_buffer()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    data = unpack(packed).astype("<u4").tobytes()
                    starts = ends - lengths
                    own = [data[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                    made = columns(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
                         pa.array(starts + first, pa.int64()), *(made if isinstance(made, list) else [made])], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def tokenized(docs: DataFrame, tokenizer: str, end: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The digests of :func:`id_digests` of ``docs``, read back from files written to the shared scratch folder."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, end, text=text, id_col=id_col)
    return id_digests(docs.sparkSession, path)


__all__ = ["pack", "unpack", "write_ids", "read_ids", "id_digests", "tokenized"]
