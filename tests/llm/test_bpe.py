"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sceneline.llm import bpe

PATH = bpe.default_path()
EDGES = [None, "", " ", "a", "A'S 'LL don't", "ΑΣ ΣΑΣ", "<|endoftext|>", "x<|startoftext|>y <|endoftext|", "é é ﬁ", "\x85 \x1c a\x1fb", "😀👍🏽 日本語", "a" * 4000, "12 345", "İstanbul", "ab cd"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(3)
    out = list(EDGES)
    for _ in range(1500):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x250), rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(30))))
    return out


def test_same_as_library(library):
    mine = bpe.load(PATH)
    for text in texts():
        want = library.encode(text or "", add_special_tokens=False).ids
        got = mine.encode(text or "")
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert mine.decode(got) == library.decode(want, skip_special_tokens=False)


def test_table(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts()[:60])] + [(None, "null id", "x"), (1, "again", "y"), (1, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in bpe.encode_digests(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_small_tables(monkeypatch, library):
    """Emptied tables of words and slices change nothing."""
    monkeypatch.setattr(bpe, "MAX_CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "SLICE_WORDS", 3)
    monkeypatch.setattr(bpe, "MAX_CACHED_LENGTH", 4)
    mine = bpe.WordBpe(PATH)
    for text in ["one two three four five six seven eight nine ten", "one two eleven twelve one, two! " * 5]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables_end_with_the_task():
    """Workers are used again by stages that need the memory: a task leaves no word and no pair behind."""
    import pyarrow as pa

    from sceneline.llm.common import TextMap

    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], names=["doc_id", "text"])
    encode = bpe.Encode(bpe.default_path(), False)
    got = list(TextMap(encode, {"ids": "binary", "decoded": "string"}, 32)([rows]))
    assert got[0].column(2).to_pylist()[0] and got[0].column(2).to_pylist()[1] == ""
    encoder = bpe.load(bpe.default_path())
    assert not encoder.cache and not encoder.runs and not encoder.pairs
