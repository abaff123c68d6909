"""Suffix dedup against brute force: order of rows, long blocks, depth of the tree, rows that share an id, hot keys."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from spanforge.llm import bwt
from spanforge.llm.tally import Tree, pack, totals, unpack
from spanforge.llm.textnp import raw


def brute(rows):
    """Sorted results of (id, text) rows by the definition: a string that starts in a document with a smaller id goes."""
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - 49):
                g = b[k : k + 50]
                if first.get(g, i) >= i:
                    first[g] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        gone = gone[: len(b)]
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((-1 if i is None else i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def some_rows(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(14)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(0, n), "|".join(parts)))
    return [*rows, (None, passage[0] * 2), (None, passage[0] * 2), (3, None), (4, ""), (70, "x" * 400), (71, "x" * 333 + "y")]


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    a, b = "a b c d e f g h i j " * 6, "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(1, a), (5, a), (5, b), (5, b)]
    assert result(bwt.dedup(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize(("block_bytes", "bits"), [(1 << 20, 8), (700, 8), (700, 2), (300, 1)])
def test_trees_of_all_depths_give_the_same(spark, block_bytes, bits):
    rows = some_rows()
    assert result(bwt.dedup(frame(spark, rows), block_bytes=block_bytes, digit_bits=bits, merge_bytes=4000)) == brute(rows)


def test_frequent_keys_are_cut_by_a_second_key(spark):
    rng = random.Random(5)
    tail = lambda: "".join(rng.choice("abcdefgh") for _ in range(70))
    rows = [(i, tail() + "this passage stands in every one of these documents, with other words on both of its sides" + tail()) for i in range(120)] + some_rows(9)
    assert result(bwt.dedup(frame(spark, rows), block_bytes=4000, hot=3)) == brute(rows)


def test_shuffled_rows_and_blocks_over_two_megabytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(i + 100_000, t) for i, t in rows[:300]] + [(i + 200_000, "p" * (i % 40) + (t or "")) for i, t in rows[300:600]]
    assert sum(len((t or "").encode()) for _, t in rows) > 2 << 20
    want = brute(rows)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        assert result(bwt.dedup(frame(spark, rows, 7), block_bytes=64 << 20)) == want


def test_runs_do_not_depend_on_where_a_buffer_is_cut():
    texts = ["ab" * 300, "z" * 49, "q" * 50, "", "é" * 200, "".join(chr(97 + i * i % 23) for i in range(900))] * 3
    whole = {}
    for order in (1, -1):
        data, offsets = raw(pa.array(texts[::order]))
        for piece in (64, 100, 1 << 19):
            k, s, n = bwt.runs(data, offsets, piece)
            body = data.tobytes()
            found = sorted((int(a), body[b : b + c + 49]) for a, b, c in zip(k, s, n))
            assert whole.setdefault("runs", found) == found
            assert (bwt.hashes(data, s, n + 49, piece) == bwt.hashes(data, s, n + 49)).all()


def test_answers_for_unknown_stretches_raise():
    tree = Tree.over(1, 5)
    with pytest.raises(RuntimeError):
        tree.block_totals(np.array([1 << 30], np.uint64), [], [])
    texts = pa.table({"id": pa.array([1], pa.int64()), "digest": ["d"], "text": ["ab" * 90]})
    none = {"id": pa.int64(), "digest": pa.string(), "digit": pa.int32(), "counts": pa.binary(), "grp": pa.int64(), "sum": pa.int64(), "marks": pa.binary()}
    k, _, _ = bwt.runs(*raw(texts.column("text").combine_chunks()))
    sent = tree.block_rows(0, *np.unique(tree.whole(k), return_counts=True))
    note = lambda kind, **v: {c: v.get(c) for c in none} | {"kind": kind}
    back = [note(1, digit=p, counts=c) for p, c in zip(sent.column("path").to_pylist(), sent.column("counts").to_pylist())]
    schema = pa.schema([*none.items(), ("kind", pa.int32())])
    build = bwt._assembler(tree, 1 << 14, 1, pa.int64())
    for more in ([], [note(2, grp=0, sum=5, marks=bwt._pack())]):
        with pytest.raises(RuntimeError):
            build((pa.scalar(0),), texts, pa.Table.from_pylist(back + more, schema))


def test_other_ids_are_refused(spark):
    with pytest.raises(TypeError):
        bwt.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_totals_of_keys(spark, bits):
    rng = np.random.default_rng(bits)
    blocks = [np.unique(rng.integers(0, 50, 30).astype(np.uint64) << np.uint64(58)) for _ in range(9)]
    counts = [rng.integers(1, 900, len(b)) for b in blocks]
    tree = Tree.over(len(blocks), 8, bits)
    sent = [r for i, (k, c) in enumerate(zip(blocks, counts)) for r in tree.block_rows(i, k, c).to_pylist()]
    back, _ = totals(tree, spark.createDataFrame(sent, "path long, grp long, child long, keys binary, counts binary"))
    got = back.collect()
    every = {}
    for k, c in zip(blocks, counts):
        for x, n in zip(k.tolist(), c.tolist()):
            every[x] = every.get(x, 0) + n
    for i, k in enumerate(blocks):
        mine = [r for r in got if r.grp == i]
        assert tree.block_totals(k, [r.digit for r in mine], [bytes(r.counts) for r in mine]).tolist() == [every[x] for x in k.tolist()]
    assert unpack(pack(np.array([0, 254, 255, 70000])), 4).tolist() == [0, 254, 255, 70000]
