import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridlens.llm import token_files
from gridlens.session import scratch_path
from tests.llm.fixtures import docs, odd_rows

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 900), st.integers(0, 32), st.floats(0, 0.2), st.integers(0, 1 << 30), st.data())
def test_blocks_round_trip(n, bits, outliers, seed, data):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 1 << bits, n, dtype=np.uint64)
    far = rng.random(n) < outliers
    v = np.where(far, rng.integers(0, 1 << 32, n, dtype=np.uint64), v).astype(np.uint32)
    packed = token_files.pack(v)
    assert (token_files.unpack(packed) == v).all()
    a, b = sorted((data.draw(st.integers(0, n)), data.draw(st.integers(0, n + 5))))
    assert (token_files.unpack(packed, a, b) == v[a:b]).all()


def test_outliers_are_exceptions_and_blocks_stay_small():
    v = np.arange(2560, dtype=np.uint32) % 16 + 70_000
    v[::100] = 4_000_000_000
    assert len(token_files.pack(v)) < 2560 * 4 / 8 + 10 * 7 + 26 * 5 + 60
    assert (token_files.unpack(token_files.pack(v)) == v).all()
    assert len(token_files.pack(np.full(10_000, 7, np.uint32))) < 600


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_the_library_on_whole_texts(path):
    rng = random.Random(2)
    library, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    assert (encoder.words is not None) == (path == WORDS)
    texts = ["", " ", "a", "It's the END, isn't it... 'S 'll", "á Á Å Å ẞΣσς", "x<|endoftext|>y <|ENDOFTEXT|> Z",
             "tab\tnl\nvt\x0bff\x0ccr\r\x1c\x1d\x85\xa0  end", "3.14 1,000 a1b2 été. naïve, w.", "\U0001f600‍\U0001f600 ́́ ²"]
    marks = ["a", "B", "é", "ß", "́", " ", "\n", " ", "'", ".", ",", "9", "<|endoftext|>", "|", "Σ", "İ"]
    texts += ["".join(rng.choice(marks) for _ in range(40)) for _ in range(300)]
    for t in texts:
        assert encoder.ids(t, 1).tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


def expected(rows):
    library = Tokenizer.from_file(WORDS)
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_digests_over_many_files(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "Zyx.", "1234"]) for _ in range(rng.randint(0, 400))), "s") for i in range(-50, 250)]
    rng.shuffle(rows)
    path = scratch_path(spark, "ids")
    token_files.write_ids(docs(spark, rows), path, WORDS, 1, file_bytes=20_000)
    assert sum(n.startswith("part-") for n in os.listdir(path)) > 5
    got = token_files.id_digests(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected([r[:2] for r in rows])
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_ids(spark, path).collect()}
    library = Tokenizer.from_file(WORDS)
    assert back == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in rows}


def test_odd_rows_repeats_and_an_empty_table(spark):
    rows = odd_rows() * 2
    got = token_files.tokenized(docs(spark, rows), WORDS, 1).orderBy("start").collect()
    want = expected([r[:2] for r in rows])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(w[0]), *w[2:]) for w in want)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.tokenized(docs(spark, []), WORDS, 1).collect() == []


def test_a_long_text_has_a_segment_of_its_own(spark):
    long = "one two " * 150_000
    rows = [(1, "a", "s"), (2, long, "s"), (3, "b", "s")]
    got = token_files.tokenized(docs(spark, rows), WORDS, 1).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected([r[:2] for r in rows])


def test_the_model_is_asked_once_for_a_piece():
    library, asked = Tokenizer.from_file(WORDS), []
    words = token_files.Words(library)

    class Model:
        def tokenize(self, piece):
            asked.append(piece)
            return library.model.tokenize(piece)

    words.model = Model()
    for w in ("zyxq", "zyxq.", '"zyxq', "zyxq,", "(zyxq)", "zyxq's", "caf\u00e9", "caf\u00e9."):
        assert np.frombuffer(words[w.encode()], "<u4").tolist() == library.encode(w, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and "zyxq" in asked


def asked_of(encoder):
    """The list of pieces that the encoder's model is asked for from now on."""
    model, asked = encoder.words.model, []

    class Model:
        def tokenize(self, piece):
            asked.append(piece)
            return model.tokenize(piece)

    encoder.words.model = Model()
    return asked


def test_a_full_memory_keeps_the_words_in_use(monkeypatch):
    for name in ("REMEMBERED", "REMEMBERED_PIECES", "REMEMBERED_WORDS"):
        monkeypatch.setattr(token_files, name, 60, raising=False)
    library, encoder, rng = Tokenizer.from_file(WORDS), token_files.Encoder(WORDS), random.Random(5)
    asked = asked_of(encoder)
    for k in range(30):
        seldom = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(10)]
        in_use = ["zyxq zyxq, Zyxq.", "caf\u00e9 caf\u00e9; CAF\u00c9!"] if k > 9 else []
        text = " ".join([*seldom, *in_use])
        assert encoder.ids(text, 1).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    assert asked.count("zyxq") == 1 and len(encoder.words.of_piece) <= 60
    assert len(asked) == len(set(asked)) > 200


def test_batches_equal_the_library_on_whole_texts():
    rng = random.Random(7)
    library, encoder = Tokenizer.from_file(WORDS), token_files.Encoder(WORDS)
    marks = [chr(c) for c in range(0x21, 0x180)] + [" "] * 60 + ["'s", "'LL", "<|endoftext|>", "\u0301", "\u4e2d", "\u01c5", "\n\n"]
    texts = ["", " ", *["".join(rng.choice(marks) for _ in range(rng.randint(0, 80))) for _ in range(400)], *map(chr, range(1, 0x250)), ""]
    whole = pa.array(["cut off", *texts, "cut off"])
    for batch in (pa.array(texts), whole.slice(1, len(texts)), pa.array(texts, pa.large_string())):
        got = encoder.all(batch, 1)
        assert [g.tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert encoder.all(pa.array([], pa.string()), 1) == []
    assert [g.tolist() for g in encoder.all(pa.array(["", "  "]), 7)] == [[7], [7]]
