"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Two occurrences of a string of LENGTH bytes share its smallest hashed q-gram, its key.  So windows
of one key form an independent problem, and keys seen once in the corpus are none at all.  Blocks
of documents learn from a tree of counters (``tally``) which of their keys recur; the stretches
around recurring keys, each different one once with the smallest document that has it, go to the
group of their key.  A group cuts its stretches into shards, sorts the suffixes of each shard on
its own, and merges the shards' transforms by interleave refinement: the interleave of all shards
is refined from order by h bytes to order by h+1 by a stable scatter of the merged transform,
which also marks where neighbours begin to differ, that is their common prefixes.  After LENGTH
rounds the unmarked runs are the repeated intervals; their smallest document decides which windows
of which documents are repeats.  Equal texts are compared once, by their smallest document.

Keys that occur very often are cut again by a second key under another hash, so that no group has
to hold all surroundings of a frequent passage; windows that agree agree in both keys.

A block packs its stretches by group; there are as many groups as blocks, so at worst a row holds
one stretch.  An answer carries a digest of the stretches that it is about; a block that cannot
find them again raises an error.  Stretches depend on their own text alone, not on the order of
rows or on where a block's buffer is cut.

Defined results: a null text is an empty one; texts shorter than LENGTH keep all their bytes; rows
with the same id never make each other's bytes repeats; rows with a null id keep everything and
make no repeats; an empty table gives an empty result.  The id must be an integer column, anything
else raises ``TypeError``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tally import BITS, DOWN, UP, Tree, totals
from .textnp import _BYTE, U64, _tables, mix, raw

LENGTH = 50
Q = 24
#: Most windows of one stretch; longer ones are cut, as each window is a matter of its own.
RUN = 64
#: Bytes of text in a block, and of stretches in a shard.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 15
#: Bytes of stretches merged at a time.
MERGE_BYTES = 1 << 18
#: Occurrences from which a key is cut by a second one.
HOT = 1 << 14
#: Bytes of a buffer that are worked on at a time.
PIECE = 1 << 19
_W = LENGTH - Q + 1
_SECOND = U64(0xD6E8FEB86659FD93)


def window_keys(data: np.ndarray, salt: U64 | None = None) -> np.ndarray:
    """The key of each window of LENGTH bytes: its smallest hashed q-gram."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, U64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    m = eight[: len(data) - Q + 1] * U64(0x9E3779B97F4A7C15)
    for at in range(8, Q, 8):
        m = mix(m) * U64(0x9E3779B97F4A7C15) + eight[at : len(data) - Q + 1 + at]
    m = mix(m if salt is None else m ^ salt)
    span = 1
    while span * 2 <= _W:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < _W:
        m = np.minimum(m[:n], m[_W - span : _W - span + n])
    return mix(m[:n])


def cut_runs(start: np.ndarray, n: np.ndarray, *with_: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows cut every RUN windows from their start."""
    pieces = -(-n // RUN)
    if not len(n) or pieces.max() == 1:
        return start, n, *with_
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(start, pieces) + nth * RUN, np.minimum(np.repeat(n, pieces) - nth * RUN, RUN), *(np.repeat(w, pieces) for w in with_)


def runs(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of maximal runs of windows of one text with one key, cut every RUN."""
    long_ = np.flatnonzero(np.diff(offsets) >= LENGTH)
    if not len(long_):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = offsets[long_], offsets[long_ + 1] - LENGTH + 1  # windows of each text
    keys, starts = [], []
    last = U64(0)
    for at in range(0, len(data) - LENGTH + 1, piece):
        k = window_keys(data[at : at + piece + LENGTH - 1])
        new = np.empty(len(k), bool)
        new[0] = k[0] != last or at == 0
        np.not_equal(k[1:], k[:-1], out=new[1:])
        a, b = np.searchsorted(begin, (at, at + len(k)))
        new[begin[a:b] - at] = True  # a text begins a run, whatever stood before it
        s = np.flatnonzero(new)
        keys.append(k[s])
        starts.append(s + at)
        last = k[-1]
    key, start = np.concatenate(keys), np.concatenate(starts)
    text = np.searchsorted(begin, start, "right") - 1
    inside = (text >= 0) & (start < end[text])
    n = np.minimum(np.append(start[1:], len(data)), end[text]) - start
    start, n, key = cut_runs(start[inside], n[inside], key[inside])
    return key, start, n


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """64-bit content hash of stretches, in pieces."""
    out = np.empty(len(start), U64)
    order = np.argsort(start, kind="stable")
    s = start[order]
    up, down = _tables(piece + 4 * RUN)
    for at in range(0, len(data), piece):
        a, b = np.searchsorted(s, (at, at + piece))
        if a == b:
            continue
        part = data[at : at + piece + RUN + LENGTH]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        i = order[a:b]
        x = start[i] - at
        out[i] = mix((total[x + size[i]] - total[x]) * down[x])
    return out


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... size[0] of them, then those of the next."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


# --- a block's stretches --------------------------------------------------------------------
def _own(texts: pa.Table, copies: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(rows that no smaller document equals, the others), in an order that the rows alone decide."""
    texts = texts.take(pc.sort_indices(texts, [("id", "ascending"), ("digest", "ascending")]))
    known = set(zip(copies.column("id").to_pylist(), copies.column("digest").to_pylist(), strict=True))
    if not known:
        return texts, texts.slice(0, 0)
    copy = pa.array([x in known for x in zip(texts.column("id").to_pylist(), texts.column("digest").to_pylist(), strict=True)], pa.bool_())
    return texts.filter(pc.invert(copy)), texts.filter(copy)


def _bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return raw(table.column("text").combine_chunks()) if table.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


class Stretches:
    """Stretches of a block around recurring keys: occurrences by key, content and document, and the different ones."""

    def __init__(self, table: pa.Table, tree: Tree, digits: list[int], answers: list[bytes], hot: int = HOT):
        self.data, self.offsets = _bytes(table)
        k, start, n = runs(self.data, self.offsets)
        u, of = np.unique(tree.whole(k), return_inverse=True)
        many = tree.block_totals(u, digits, answers)[of]
        keep = many > 1
        k, start, n, often = k[keep], start[keep], n[keep], many[keep] >= hot
        if often.any():
            k, start, n = self._second(k, start, n, often)
        row = np.searchsorted(self.offsets, start, "right") - 1
        ids = table.column("id").to_numpy().astype(np.int64)[row]
        h = hashes(self.data, start, n + LENGTH - 1)
        order = np.lexsort((start, ids, h, k))
        self.start, self.n, self.id = start[order], n[order], ids[order]
        k, h = k[order], h[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(order)))
        self.key, self.hash = k[self.first], h[self.first]  # of each different stretch

    def _second(self, k: np.ndarray, start: np.ndarray, n: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut the runs of frequent keys where their second key changes."""
        size = n[often]
        where = spread(start[often], size)
        second = np.empty(len(where), U64)
        order = np.argsort(where, kind="stable")
        w = where[order]
        for at in range(0, len(self.data) - LENGTH + 1, PIECE):
            a, b = np.searchsorted(w, (at, at + PIECE))
            if a < b:
                second[order[a:b]] = window_keys(self.data[at : at + PIECE + LENGTH - 1], _SECOND)[w[a:b] - at]
        new = np.ones(len(where), bool)
        new[1:] = second[1:] != second[:-1]
        new[np.cumsum(size) - size] = True
        s = np.flatnonzero(new)
        both = mix(np.repeat(k[often], size)[s] + second[s])
        rest = ~often
        return np.append(k[rest], both), np.append(start[rest], where[s]), np.append(n[rest], np.diff(np.append(s, len(where))))

    def messages(self, groups: int) -> np.ndarray:
        """Where the stretches of each group of keys begin; groups are ranges of keys."""
        bounds = np.array([(i << 64) // groups for i in range(groups)], dtype=U64)
        return np.append(np.searchsorted(self.key, bounds), len(self.key))


def check_sum(key: np.ndarray, h: np.ndarray) -> int:
    """A digest of the stretches of a message, to tell that an answer is about them."""
    return int(np.bitwise_xor.reduce(mix(mix(key) + h), initial=U64(len(key))).view(np.int64))


# what goes to the tasks of a block beside its texts; kind 0: copies, 1: totals of keys, 2: marks on stretches
_NOTE = "block long, kind int, id long, digest string, digit int, counts binary, grp long, sum long, marks binary"


def _kind(notes: pa.Table, kind: int) -> pa.Table:
    return notes.filter(pc.equal(notes.column("kind"), kind))


def _totals_in(notes: pa.Table) -> tuple[list[int], list[bytes]]:
    t = _kind(notes, 1)
    return t.column("digit").to_pylist(), t.column("counts").to_pylist()


def _sender(tree: Tree):
    def send(key: tuple, texts: pa.Table, copies: pa.Table) -> pa.Table:
        own, _ = _own(texts, copies)
        k, _, _ = runs(*_bytes(own))
        u, n = np.unique(tree.whole(k), return_counts=True)
        return tree.block_rows(key[0].as_py(), u, n)

    return send


_FOUND = "grp long, block long, data binary"


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(b"".join(parts))


def _emitter(tree: Tree, hot: int, groups: int):
    def emit(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        own, _ = _own(texts, _kind(notes, 0))
        st = Stretches(own, tree, *_totals_in(notes), hot)
        f = st.first
        size = st.n[f] + LENGTH - 1
        body = st.data[spread(st.start[f], size)]
        ends = np.append(0, np.cumsum(size))
        low, edge = st.id[f].astype("<i8"), st.messages(groups)
        rows = np.flatnonzero(edge[:-1] < edge[1:])
        data = []
        for a, z in zip(edge[rows].tolist(), edge[rows + 1].tolist(), strict=True):
            data.append(_pack((z - a).to_bytes(8, "little"), st.key[a:z].tobytes(), st.hash[a:z].tobytes(), low[a:z].tobytes(), st.count[a:z].astype("<u4").tobytes(), size[a:z].astype(np.uint8).tobytes(), body[ends[a] : ends[z]].tobytes()))
        return pa.table({"grp": pa.array(rows, pa.int64()), "block": pa.array(np.full(len(rows), key[0].as_py(), np.int64)), "data": pa.array(data, pa.binary())})

    return emit


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """(key, hash, low, count, size, bytes) of a message."""
    x = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(x[:8], "little")
    at = [8 + n * k for k in (0, 8, 16, 24, 28, 29)]
    return (*(np.frombuffer(x, kind, n, o) for kind, o in zip((U64, U64, "<i8", "<u4", np.uint8), at, strict=False)), np.frombuffer(x, np.uint8, offset=at[5]))


# --- transforms and their merge -------------------------------------------------------------
def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a shard in order; 0 ends each string, and of equal rests that of the earlier string comes first."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    string = np.zeros(n, np.int64)
    string[ends] = 1
    string = np.cumsum(string) - string
    left = ends[string] - np.arange(n)  # bytes before the end of the string
    wide = 4 if text.max(initial=0) > 255 else 8
    pad = np.zeros(n + wide, np.uint64)
    pad[:n] = text
    key = np.zeros(n, U64)
    for j in range(wide):
        c = pad[j : n + j].copy()
        c[left < j] = 0
        key |= c << U64(64 - 64 // wide * (j + 1))
    rank, h = np.empty(n, np.int64), wide
    new = np.zeros(n, bool)
    while True:
        order = np.argsort(key)
        r = key[order]
        np.not_equal(r[1:], r[:-1], out=new[1:])
        dense = np.cumsum(new)
        if not n or dense[-1] == n - 1:
            return order
        rank[order] = dense
        second = np.where(left < h, string, 0)  # of those that ended, the earlier string comes first
        on = np.flatnonzero(left >= h)
        second[on] = rank[on + h]
        key = rank * n + second
        h *= 2


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' transforms up to ``depth`` bytes.

    Returns, for all suffixes of all shards in merged order, the place of the suffix in the
    concatenated shards and the number of the interval of suffixes that agree in ``depth`` bytes.
    """
    orders = [suffix_order(s) for s in shards]
    base = np.cumsum([0, *(len(s) for s in shards)])
    codes = np.unique(np.concatenate(shards))
    number = np.zeros(int(codes[-1]) + 1, np.uint16)
    number[codes] = np.arange(len(codes), dtype=np.uint16)
    # the bytes before each suffix are its symbol: two of them where pairs fit 16 bits, which halves the rounds
    stride = 2 if len(codes) ** 2 <= 1 << 16 and depth % 2 == 0 else 1
    transform = []
    for s, o in zip(shards, orders, strict=True):
        d = number[s]
        transform.append(d[o - 2] * np.uint16(len(codes)) + d[o - 1] if stride == 2 else d[o - 1])
    source = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), np.diff(base))
    interval = np.zeros(len(source), np.int32)
    merged = np.empty(len(source), np.uint16)
    new = np.zeros(len(source), bool)
    for _ in range(depth // stride):
        for i, t in enumerate(transform):
            merged[np.flatnonzero(source == i)] = t  # each shard's symbols in its own order
        to = np.argsort(merged, kind="stable")
        source, now, old = source[to], merged[to], interval[to]
        np.not_equal(now[1:], now[:-1], out=new[1:])
        np.logical_or(new[1:], old[1:] != old[:-1], out=new[1:])  # strings end before a window could hold an end
        interval = np.cumsum(new, dtype=np.int32)
    out = np.empty(len(source), np.int64)
    for i, (o, b) in enumerate(zip(orders, base[:-1], strict=True)):
        out[np.flatnonzero(source == i)] = o + b
    return out, interval


def lowest(size: np.ndarray, flat: np.ndarray, low: np.ndarray, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For every window of every stretch (laid end to end), the smallest document that has the window."""
    size = size.astype(np.int64)
    at = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(size), np.uint16)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat.astype(np.uint16) + 1
    cuts, last = [0], 0
    for end in (at + size + 1).tolist():
        if end - last >= shard_bytes:
            cuts.append(end)
            last = end
    if cuts[-1] != len(text):
        cuts.append(len(text))
    place, interval = merge([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], LENGTH)
    of = np.searchsorted(at, place, "right") - 1
    window = place - at[of] <= size[of] - LENGTH  # suffixes that hold a whole window
    place, interval, of = place[window], interval[window], of[window]
    edge = np.ones(len(interval), bool)
    edge[1:] = interval[1:] != interval[:-1]
    least = np.minimum.reduceat(low[of], np.flatnonzero(edge))
    by_place = np.zeros(len(text), np.int64)
    by_place[place] = least[np.cumsum(edge) - 1]
    return by_place[spread(at, size - LENGTH + 1)]


_DECIDED = "block long, grp long, sum long, marks binary"
#: A run of windows of a stretch (by its number in the message) and the smallest document that has them.
MARK = np.dtype([("of", "<u4"), ("first", "u1"), ("last", "u1"), ("low", "<i8")])


def _resolver(merge_bytes: int):
    def resolve(group: tuple, table: pa.Table) -> pa.Table:
        """For the stretches of each message, the marks that they need."""
        parts = [_unpack(d) for d in table.column("data").to_pylist()]
        k, h, low, count, size, flat = (np.concatenate([p[i] for p in parts]) for i in range(6))
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.lexsort((h, k))
        new = np.ones(len(order), bool)
        new[1:] = (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(low[order], np.flatnonzero(new))
        one = order[new]  # an entry for each different stretch
        key, size, begin = k[one], size[one], begin[one]
        other = np.ones(len(one), bool)
        other[1:] = key[1:] != key[:-1]
        key_no = np.cumsum(other) - 1
        todo = np.flatnonzero(np.bincount(key_no)[key_no] > 1)
        n = size - LENGTH + 1
        value = np.repeat(least, n)  # smallest document of each window of each stretch
        at = np.cumsum(n) - n
        a, until = 0, np.cumsum(size[todo])
        while a < len(todo):  # keys are independent: a few at a time
            b = max(a + 1, int(np.searchsorted(until, (until[a - 1] if a else 0) + merge_bytes, "right")))
            b = int(np.searchsorted(key_no[todo], key_no[todo[b - 1]], "right"))
            u = todo[a:b]
            value[spread(at[u], n[u])] = lowest(size[u], flat[spread(begin[u], size[u])], least[u])
            a = b
        edge = np.zeros(len(value), bool)
        edge[at] = True
        edge[1:] |= value[1:] != value[:-1]
        run = np.flatnonzero(edge)
        run_of = np.searchsorted(at, run, "right") - 1
        first, last = run - at[run_of], np.append(run[1:], len(value)) - 1 - at[run_of]
        from_, runs_ = np.searchsorted(run_of, np.arange(len(one))), np.bincount(run_of, minlength=len(one))
        out, sums, e = [], [], 0
        for p in parts:
            mine = of[e : e + len(p[0])]
            e += len(p[0])
            r = spread(from_[mine], runs_[mine])
            who = np.repeat(np.arange(len(mine)), runs_[mine])
            useful = (value[run[r]] < p[2][who]) | (p[3][who] > 1)
            r, who = r[useful], who[useful]
            mark = np.empty(len(r), MARK)
            mark["of"], mark["first"], mark["last"], mark["low"] = who, first[r], last[r], value[run[r]]
            out.append(_pack(mark.tobytes()))
            sums.append(check_sum(p[0], p[1]))
        return pa.table({"block": table.column("block"), "grp": table.column("grp"), "sum": pa.array(sums, pa.int64()), "marks": pa.array(out, pa.binary())})

    return resolve


def _assembler(tree: Tree, hot: int, groups: int, id_type: pa.DataType):
    def build(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        table, rest = _own(texts, _kind(notes, 0))
        st = Stretches(table, tree, *_totals_in(notes), hot)
        decided = _kind(notes, 2)
        message = st.messages(groups)
        if decided.num_rows != np.count_nonzero(message[:-1] < message[1:]):
            raise RuntimeError("a block's messages and the answers to them differ in number")
        edge = np.zeros(len(st.data) + 1, np.int32)
        for grp, total, marks in zip(*(decided.column(c).to_pylist() for c in ("grp", "sum", "marks")), strict=True):
            a, z = message[grp], message[grp + 1]
            if check_sum(st.key[a:z], st.hash[a:z]) != total:
                raise RuntimeError("an answer came back for stretches that the block does not have")
            mark = np.frombuffer(zstandard.ZstdDecompressor().decompress(marks), MARK)
            e = mark["of"].astype(np.int64) + a
            m = st.count[e]
            occ = spread(st.first[e], m)
            r = np.repeat(np.arange(len(e)), m)
            hit = mark["low"][r] < st.id[occ]
            occ, r = occ[hit], r[hit]
            np.add.at(edge, st.start[occ] + mark["first"][r], 1)
            np.add.at(edge, st.start[occ] + mark["last"][r].astype(np.int64) + LENGTH, -1)
        data, offsets = st.data, st.offsets
        gone = np.cumsum(edge[:-1]) > 0
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        rise[inner] = gone[inner]  # a run ends with its document
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]).astype(np.int64)
        body, n = data.tobytes(), count(gone)
        digest = [hashlib.sha256(body[a:b] if not c else data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b, c in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n.tolist(), strict=True)]
        kept = pa.table({"id": table.column("id").cast(id_type), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n), "n_spans": pa.array(count(rise)), "kept_sha256": pa.array(digest, pa.string())})
        # equal to a smaller document: all of a text that holds a window goes
        size = pc.binary_length(rest.column("text")).cast(pa.int64()).to_numpy()
        whole = size >= LENGTH
        digest = [hashlib.sha256(b"" if w else t.encode()).hexdigest() for t, w in zip(rest.column("text").to_pylist(), whole.tolist(), strict=True)]
        equal = pa.table({"id": rest.column("id").cast(id_type), "n_bytes": pa.array(size), "n_removed": pa.array(np.where(whole, size, 0)), "n_spans": pa.array(whole.astype(np.int64)), "kept_sha256": pa.array(digest, pa.string())})
        return pa.concat_tables([kept, equal])

    return build


#: Parts into which the copies of one text are dealt when they look up its smallest document.
SALT = 16


def _copies(rows: DataFrame) -> DataFrame:
    """(block, id, digest) of rows that a smaller document equals."""
    light = rows.select("block", "id", "digest", F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt"))
    equal = light.groupBy("digest").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    equal = equal.select("digest", "smallest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    return light.join(equal, ["digest", "salt"]).filter("id > smallest").select("block", "id", "digest").distinct()


def _note(df: DataFrame, kind: int) -> DataFrame:
    """``df`` with the columns of ``_NOTE``, those it lacks as nulls."""
    have = set(df.columns)
    cols = []
    for part in _NOTE.split(", "):
        name, type_ = part.split(" ")
        cols.append((F.lit(kind) if name == "kind" else F.col(name) if name in have else F.lit(None)).cast(type_).alias(name))
    return df.select(*cols)


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digit_bits: int = BITS, hot: int = HOT, merge_bytes: int = MERGE_BYTES
) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``; the id must be an integer."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    all_rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    total = all_rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = max(1, -(-((total[0] or 0) + 64 * total[1]) // block_bytes))
    tree = Tree.over(blocks, 5, digit_bits)
    rows = all_rows.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text", F.md5("text").alias("digest"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "digest"), F.lit(blocks)))
    copies = _note(_copies(rows), 0)
    texts = rows.repartition(blocks, "block").groupBy("block")
    sent = texts.cogroup(copies.groupBy("block")).applyInArrow(_sender(tree), UP)
    back, _ = totals(tree, sent)
    known = copies.unionByName(_note(back.select(F.col("grp").alias("block"), "digit", "counts"), 1))
    found = texts.cogroup(known.groupBy("block")).applyInArrow(_emitter(tree, hot, blocks), _FOUND)
    decided = found.groupBy("grp").applyInArrow(_resolver(merge_bytes), _DECIDED)
    notes = known.unionByName(_note(decided, 2))
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = texts.cogroup(notes.groupBy("block")).applyInArrow(_assembler(tree, hot, blocks, to_arrow_type(kind)), f"id {kind.simpleString()}, {fields}")
    bare = all_rows.filter("id IS NULL").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return out.unionByName(bare).withColumnRenamed("id", id_col)
