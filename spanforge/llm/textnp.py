"""Vectorised text primitives: whole Arrow string columns as byte buffers, words as 64-bit hashes.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; as UTF-8 continuation bytes never
fall in that set, byte and code-point tokenisation agree.  Hashes are 64 bits wide and equal for
equal words in every process; among a thousand million different words the odds of any collision
are about three in a hundred, within one document they are nil.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_BYTE_FOLDED = _BYTE[_FOLD]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least ``n`` positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _ODD, U64)
        down = np.full(size, _INV, U64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty texts."""
    arr = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(arr.type) and not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    return arr.fill_null("") if arr.null_count else arr


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; ``offsets`` has one entry more than there are rows."""
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none has much more than ``limit`` bytes of text (a single text may)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, o = raw(column(batch, text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def pack_sorted(v: np.ndarray) -> bytes:
    """Sorted, distinct numbers as the first one and the steps between them, each in as few bytes as the widest needs."""
    if not len(v):
        return b""
    step = np.diff(v)
    wide = max(1, -(-int(step.max()).bit_length() // 8)) if len(step) else 1
    b = np.ascontiguousarray(step.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :wide]
    return bytes([wide]) + int(v[0]).to_bytes(8, "little") + np.ascontiguousarray(b).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U64)
    wide = data[0]
    n = (len(data) - 9) // wide
    b = np.zeros((n, 8), np.uint8)
    b[:, :wide] = np.frombuffer(data, np.uint8, offset=9).reshape(n, wide)
    v = np.empty(n + 1, U64)
    v[0] = int.from_bytes(data[1:9], "little")
    v[1:] = b.view("<u8").ravel()
    return np.cumsum(v, dtype=U64)


class Words:
    """Words of several texts: ``hash``, ``doc`` (row of each word), ``first`` (row -> first word)."""

    __slots__ = ("hash", "doc", "first", "start", "end", "offsets", "data")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        n, rows = len(data), len(offsets) - 1
        word = ~_WS[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets[:-1]] = True
        edge[n] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        start = np.flatnonzero(word & (~before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        up, down = _tables(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((_BYTE_FOLDED if fold else _BYTE)[data] * up[:n], out=total[1:])
        self.hash = mix((total[end] - total[start]) * down[start])
        self.first = np.searchsorted(start, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        self.start, self.end, self.offsets, self.data = start, end, offsets, data


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of ``k`` words; texts of 1 to k-1 words give one shorter window."""
    h, n = words.hash, len(words.hash)
    doc, out = [], []
    if n >= k:
        s = np.full(n - k + 1, k, U64)
        for j in range(k):
            s = mix(s * U64(_ODD) + h[j : n - k + 1 + j])
        same = words.doc[: n - k + 1] == words.doc[k - 1 :]
        doc.append(words.doc[: n - k + 1][same])
        out.append(s[same])
    counts = np.diff(words.first)
    for size in range(1, k):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            s = np.full(len(rows), size, U64)
            for j in range(size):
                s = mix(s * U64(_ODD) + h[words.first[rows] + j])
            doc.append(rows)
            out.append(s)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    doc, out = np.concatenate(doc), np.concatenate(out)
    if len(np.flatnonzero(counts < k)):
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out


def sets(doc: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values of each row: (values, offsets)."""
    if not len(values):
        return values, np.zeros(rows + 1, np.int64)
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    doc, values = doc[new], values[new]
    return values, np.searchsorted(doc, np.arange(rows + 1))
