"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m bytes with at most k edits shares at least ``m + 1 - q - k q`` of
the item's q-grams with the document, all within k diagonals of each other.  Each document is
looked up in an index of the items' q-grams; shared q-grams are counted in overlapping bands of
2k+1 or more diagonals; bands that meet the bound are verified by a banded alignment.  Texts are
compared with A-Z lower-cased and white space as plain spaces.  The benchmark goes to the workers
in blocks of bounded size, one pass over the documents for each block, and nothing is shuffled.

Defined results: null or empty texts have no matches, null or empty items match nothing; items
shorter than q bytes must occur literally; of overlapping matches of one item the best stays
(fewest edits, then leftmost) and others are looked for on both sides of it; repeated documents are
reported one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnp import column, raw, slices

Q = 8
#: Edits allowed for each byte of an item, as far as the lemma's bound holds: an item of m bytes has (m - Q) // Q at most.
EDIT_RATE = 0.1
#: Bytes of benchmark items in one block.
BLOCK_BYTES = 4 << 20
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[[9, 10, 11, 12, 13]] = 32
_BITS = 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray) -> np.ndarray:
    """Every Q-gram as one 64-bit number, overlapping, without a copy."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data), 0, (1,))


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _ODD) >> np.uint64(64 - _BITS)


class Index:
    """Q-grams of a block of items: which occur, and where in which item."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float):
        self.ids = [i for i, _ in items]
        self.text = [_NORMAL[np.frombuffer(t, np.uint8)] for _, t in items]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.k = np.minimum((self.size * rate).astype(np.int64), np.maximum(self.size - Q, 0) // Q)
        self.need = np.maximum(self.size + 1 - Q - self.k * Q, 1)
        grams = [_grams(t) for t in self.text]
        self.short = [i for i, t in enumerate(self.text) if 0 < len(t) < Q]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        pos = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        # q-grams that many items share are left out, at most half of what an item needs, and the need is lowered by as many
        _, same, shared = np.unique(flat, return_inverse=True, return_counts=True)
        common = shared[same] if len(flat) else np.zeros(0, np.int64)
        order = np.lexsort((-common, item))
        rank = np.arange(len(flat)) - np.repeat(np.searchsorted(item, np.arange(len(items))), np.bincount(item, minlength=len(items)))
        leave = (common[order] > 1) & (rank < self.need[item[order]] // 2)
        self.need = self.need - np.bincount(item[order][leave], minlength=len(items))
        stay = order[~leave]
        flat, item, pos = flat[stay], item[stay], pos[stay]
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.item, self.pos = item[order], pos[order]
        self.there = np.zeros(1 << _BITS, bool)
        self.there[_slot(self.grams).astype(np.int64)] = True
        self.least = int(self.need.min()) if len(self.need) else 1
        self.reach = int((self.size + 2 * self.k).max()) if len(self.size) else 0

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (document, item, lowest diagonal, diagonal beyond the highest) of bands with enough shared q-grams."""
        none = np.zeros((0, 4), np.int64)
        grams = _grams(data)
        if not len(grams) or not len(self.grams):
            return none
        hit = self.there[_slot(grams).astype(np.int64)]
        at = np.flatnonzero(hit)
        if not len(at):
            return none
        g = grams[at]
        slot = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        ok = self.grams[slot] == g
        at, slot = at[ok], slot[ok]
        doc = np.searchsorted(offsets, at, "right") - 1
        ok = at + Q <= offsets[doc + 1]
        at, slot, doc = at[ok], slot[ok], doc[ok]
        if not len(at):
            return none
        # fewest shared q-grams of any item must lie within the longest reach around a position
        left = np.searchsorted(at, np.maximum(at - self.reach, offsets[doc]))
        right = np.searchsorted(at, np.minimum(at + self.reach, offsets[doc + 1]), "right")
        ok = right - left >= self.least
        at, slot, doc = at[ok], slot[ok], doc[ok]
        out = []
        step = max(1, (1 << 21) // max(1, int(self.count.max())))
        keys = []
        for b in range(0, len(at), step):  # expand to the places in items, in bounded pieces
            s, n = slot[b : b + step], self.count[slot[b : b + step]]
            to = np.repeat(self.first[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item, d = self.item[to], np.repeat(doc[b : b + step], n)
            diagonal = np.repeat(at[b : b + step], n) - offsets[d] - self.pos[to]
            keys.append(np.stack([d, item, diagonal, np.repeat(at[b : b + step], n)], 1))
        rows = np.concatenate([*keys, np.zeros((0, 4), np.int64)])
        if not len(rows):
            return none
        d, item, diagonal = rows[:, 0], rows[:, 1], rows[:, 2]
        width = 2 * self.k[item] + 1
        for shift in (0, 1):  # bands of twice the width, the second half a band further
            band = (diagonal + shift * width) // (2 * width)
            order = np.lexsort((rows[:, 3], band, item, d))
            kd, ki, kb, place = d[order], item[order], band[order], rows[order, 3]
            once = np.ones(len(order), bool)  # a place of the document counts once in a band
            once[1:] = (kd[1:] != kd[:-1]) | (ki[1:] != ki[:-1]) | (kb[1:] != kb[:-1]) | (place[1:] != place[:-1])
            kd, ki, kb = kd[once], ki[once], kb[once]
            new = np.ones(len(kd), bool)
            new[1:] = (kd[1:] != kd[:-1]) | (ki[1:] != ki[:-1]) | (kb[1:] != kb[:-1])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(kd)))
            full = n >= self.need[ki[start]]
            s = start[full]
            if len(s):
                out.append(np.stack([kd[s], ki[s], kb[s] * 2 * (2 * self.k[ki[s]] + 1) - shift * (2 * self.k[ki[s]] + 1)], 1))
        if not out:
            return none
        bands = np.unique(np.concatenate(out), axis=0)
        d, item, low = bands.T
        width = 2 * (2 * self.k[item] + 1)
        new = np.ones(len(bands), bool)  # bands that touch become one
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (low[1:] > low[:-1] + width[:-1])
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(bands)) - 1
        return np.stack([d[start], item[start], low[start], low[last] + width[last]], 1)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int]:
    """(fewest edits, end) of the item against any stretch of text that starts on diagonals low..high; (k+1, 0) beyond k.

    The band also holds every diagonal that so many edits can reach.  Ties: the leftmost end.
    """
    m, n = len(item), len(text)
    j = np.arange(low, high + 1)  # diagonal: text position minus item position
    big = m + n + 1
    ramp = np.arange(len(j))
    row = np.where((j >= 0) & (j <= n), 0, big)
    for i in range(m):
        at = j + i  # text index of the diagonal step
        inside = (at >= 0) & (at < n)
        same = np.zeros(len(j), bool)
        same[inside] = text[at[inside]] == item[i]
        step = np.where(inside, row + ~same, big)
        gone = np.append(row[1:], big) + 1  # item byte without a text byte: from the diagonal above
        gone[(at + 1 < 0) | (at + 1 > n)] = big
        best = np.minimum(step, gone)
        best = np.minimum.accumulate(best - ramp) + ramp  # text bytes without an item byte
        best[(at + 1 < 0) | (at + 1 > n)] = big
        row = best
        if i % 8 == 7 and row.min() > k:
            return k + 1, 0
    end = int(row.argmin())
    return int(row[end]), int(j[end] + m)


def verify(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence on diagonals low..high, None beyond k edits."""
    m = len(item)
    a, b = max(0, low - 2 * k), min(len(text), high + m + 2 * k)
    region = text[a:b]
    exact = region.tobytes().find(item.tobytes())
    if exact >= 0:
        return 0, a + exact, a + exact + m
    first, last = max(low - k - a, -k), min(high + k - a, len(region) - m + k)
    if not k or first > last:  # no edits allowed, or too little text
        return None
    edits, end = align(item, region, first, last, k)
    if edits > k:
        return None
    back, length = align(item[::-1], region[:end][::-1], -k, k, k)
    return edits, a + end - (length if back <= k else m), a + end


def occurrences(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of disjoint occurrences: the best, then those that fit to its left and to its right."""
    out, todo, m = [], [(0, len(text), low, high)], len(item)
    while todo:
        a, b, low, high = todo.pop()
        if b - a < m - k or low > high:
            continue
        got = verify(item, text[a:b], low - a, high - a, k)
        if got:
            edits, start, end = got[0], got[1] + a, got[2] + a
            out.append((edits, start, end))
            todo += [(a, start, low, min(high, start - m + k)), (end, b, max(low, end - k), high)]
    return sorted(out, key=lambda s: s[1])


def literal(item: bytes, text: bytes) -> list[tuple[int, int, int]]:
    """(0, start, end) of the occurrences of an item that is too short for the lemma, from the left."""
    out, at = [], text.find(item)
    while at >= 0:
        out.append((0, at, at + len(item)))
        at = text.find(item, at + len(item))
    return out


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (id, item, start, end, edits) of documents that contain an item; offsets in bytes of the text."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).filter("length(t) > 0 AND i IS NOT NULL").distinct()
    sizes = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-sizes // block_bytes))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for b in range(n_blocks):  # each block is about block_bytes, whatever the size of the benchmark
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        rows = sorted(((r.i, r.t.encode()) for r in part.toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
        got = source.mapInArrow(_matcher(rows, rate, part.schema["i"].dataType), f"id {kind}, item {item_kind}, start long, `end` long, edits int")
        found = got if found is None else found.unionByName(got)
    return found.withColumnsRenamed({"id": id_col, "item": item_col if item_col != id_col else "item_id"})


def _matcher(rows: list[tuple[object, bytes]], rate: float, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(item_type)
    held: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Index(rows, rate))
        index = held[0]
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = raw(column(batch, "text"))
            data = _NORMAL[data]
            found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for d, i, low, high in index.candidates(data, offsets).tolist():
                got = occurrences(index.text[i], data[offsets[d] : offsets[d + 1]], low, high, int(index.k[i]))
                if got:
                    found.setdefault((d, i), []).extend(got)
            for i in index.short:
                for d in range(batch.num_rows):
                    if got := literal(index.text[i].tobytes(), data[offsets[d] : offsets[d + 1]].tobytes()):
                        found.setdefault((d, i), []).extend(got)
            out = []
            for (d, i), got in sorted(found.items()):
                kept: list[tuple[int, int, int]] = []
                for e, a, b in sorted(set(got)):
                    if all(b <= x or y <= a for _, x, y in kept):
                        kept.append((e, a, b))
                out += [(d, i, a, b, e) for e, a, b in sorted(kept, key=lambda s: s[1])]
            if out:
                d, i, a, b, e = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d)), pa.array([index.ids[x] for x in i], arrow), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.int32())],
                    ["id", "item", "start", "end", "edits"],
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """Rows of ``docs`` whose text contains no item, columns unchanged."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).filter("length(t) > 0 AND i IS NOT NULL").distinct()
    sizes = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-sizes // BLOCK_BYTES))
    out = docs
    for b in range(n_blocks):
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        rows = sorted(((r.i, r.t.encode()) for r in part.toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
        out = out.mapInArrow(_cleaner(rows, rate, text_col), docs.schema)
    return out


def _cleaner(rows: list[tuple[object, bytes]], rate: float, text_col: str):
    held: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Index(rows, rate))
        index = held[0]
        for batch in slices(batches, text_col, 1 << 20):
            data, offsets = raw(column(batch, text_col))
            data = _NORMAL[data]
            bad = np.zeros(batch.num_rows, bool)
            for d, i, low, high in index.candidates(data, offsets).tolist():
                if not bad[d] and verify(index.text[i], data[offsets[d] : offsets[d + 1]], low, high, int(index.k[i])):
                    bad[d] = True
            for i in index.short:
                for d in np.flatnonzero(~bad):
                    bad[d] = data[offsets[d] : offsets[d + 1]].tobytes().find(index.text[i].tobytes()) >= 0
            if not bad.all():
                yield batch.filter(pa.array(~bad)) if bad.any() else batch

    return run
