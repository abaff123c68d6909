"""Byte-level BPE against the tiktoken library: white space of all kinds, long texts, bounded caches, column clashes."""

import base64
import hashlib
import random
import sys
import time

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from spanforge.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)


def ids(codec, text):
    (parts,) = codec.texts([text])
    values = [v for part in parts for v in part]
    assert b"".join(v[1] for v in values) == text.encode()
    return [int(x) for v in values for x in v[0].split(b",")]


def test_random_texts(codec, enc, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 7)  # so that texts are cut wherever they may be
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("ab c\n\t  \r\x1c\x85\xa0é中1½'s're!?.. 　​ Ж😀") for _ in range(rng.randint(0, 60)))
        assert ids(codec, text) == enc.encode_ordinary(text), repr(text)


def test_long_text_with_blank_lines_keeps_the_cache_bounded(enc):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéж") for _ in range(rng.randint(1, 12)))
    text = "".join(word() + rng.choice([" ", " ", " ", "\n\n", "  ", ".\n"]) for _ in range(120_000))
    small = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN, cache_bytes=1 << 20)
    texts = [text[:400_000], text[400_000:], "", "x" * 5000, text[:100]]
    for t in texts:
        assert ids(small, t) == enc.encode_ordinary(t)
        small.rest()
    assert len(small.words[0]) == 0 or small.size <= 1 << 20


def test_rows_columns_and_empty_tables(spark, enc):
    rows = [(1, "a b\n\nc", "x", 7), (1, "a b\n\nc", "x", 7), (None, None, None, None), (2, "", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, bytes int")
    want = [enc.encode_ordinary(t or "") for _, t, _, _ in rows]
    got = bpe.encode(docs, PATH, P.PATTERN).collect()
    assert sorted((r.text or "", r.ids) for r in got) == sorted((t or "", w) for (_, t, _, _), w in zip(rows, want))
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back) and len(back) == 4
    got = bpe.digests(docs, PATH, P.PATTERN).collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, len(w), sha(",".join(map(str, w)).encode()), sha((t or "").encode())) for (i, t, _, _), w in zip(rows, want)), key=key)
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0 == bpe.encode(docs.limit(0), PATH, P.PATTERN).count()


def test_ids_outside_the_vocabulary(codec):
    assert codec.decode([[], [64], []])[0] == b"" and codec.decode([]) == []
    for bad in (-1, 10**6):
        with pytest.raises(ValueError):
            codec.decode([[bad]])


def test_idle_workers_hold_no_codec(spark):
    """Spark keeps workers for later stages, which must not run beside the caches of this one."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    assert bpe.digests(docs, PATH, P.PATTERN).count() == 40
    bpe.digests(docs, PATH, P.PATTERN).collect()
    time.sleep(4)

    def held(batches):
        module = sys.modules.get("spanforge.llm.bpe")
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"used": [module is not None], "held": [len(module._codecs) if module else 0]})

    rows = docs.mapInArrow(held, "used boolean, held long").collect()
    assert any(r.used for r in rows)
    assert not any(r.held for r in rows)
