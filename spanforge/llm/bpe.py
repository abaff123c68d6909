"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

Every distinct pre-token ("word") of a slice of a partition becomes one state of a recursive query:
its tokens are unnested into token-position rows, joined with the merge table, and the leftmost
pair of minimum rank is contracted, round after round, until no pair can be merged.  Decoding joins
token rows with the vocabulary and concatenates them by an ordered aggregation.  Words recur, so
what the queries give is kept by word in a cache of two generations, each bounded in bytes; the
cache only saves work, and a worker without such a task gives it back.  Nothing is shuffled, a
partition needs memory for a slice of texts and for a stretch of a long text, and a lost task is
simply run again.

Defined results: a null text is an empty one, an empty text has no ids (``n_tokens`` 0, the digest
of the empty string); rows are treated one by one, so ties, repeated rows and null ids do not
matter, and an empty table gives an empty result.  A column of ``docs`` that has the name of an
output column is replaced by it.  Words of more than ``LONG_WORD`` bytes take the same contractions
from a heap, as the rounds of a query would take quadratic time there.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import heapq
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a word from which contraction leaves the recursive query.
LONG_WORD = 1000
#: Bytes a worker keeps in each of its two cache generations, about.
CACHE_BYTES = 128 << 20
#: Bytes of words in one recursive query.
QUERY_BYTES = 1 << 19
#: Bytes of text in a slice, and characters of a long text that are worked on at a time.
SLICE_BYTES = 2 << 20
STRETCH = 1 << 18
#: Largest rank file that is sent to the workers.
MAX_RANK_FILE = 64 << 20
#: Seconds without a task after which a worker drops its codec.
IDLE = 1.0
#: What a cached word takes beside its own bytes and those of its values.
_ENTRY = 330

_ENCODE = """
CREATE OR REPLACE TEMP TABLE encoded AS
WITH RECURSIVE state(w, ts) AS (
    SELECT w, ts FROM symbols
  UNION ALL
    SELECT s.w, s.ts[1:(h.k & 16777215) - 1] || [(h.k >> 24)::INT] || s.ts[(h.k & 16777215) + 2:]
    FROM state s
    JOIN (SELECT r.w, min((m.merged::BIGINT << 24) | r.p) AS k
          FROM (SELECT w, unnest(range(1, len(ts))) AS p, (unnest(ts[:-2])::BIGINT << 32) | unnest(ts[2:]) AS pair FROM state) r
          JOIN merges m ON m.pair = r.pair
          GROUP BY r.w) h ON h.w = s.w
)
SELECT w, arg_min(ts, len(ts)) AS ids FROM state GROUP BY w
"""
_SHOWN = "SELECT array_to_string(ids, ',') AS shown FROM encoded ORDER BY w"
#: Rows of all words at once; the row -1 behind each word is a mark, which no decoded byte equals.
_DECODE = "SELECT string_agg(v.piece, '' ORDER BY r.w, r.p) FROM {rows} r JOIN vocabulary v ON v.id = r.id"
_ENCODED_ROWS = "(SELECT w, unnest(ids || [-1]) AS id, generate_subscripts(ids || [-1], 1) AS p FROM encoded)"
_MARK = "\u0100"


def read_ranks(path: str) -> bytes:
    """Content of a rank file (lines of base64 token and rank), checked to be small."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE + 1)
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"rank file over {MAX_RANK_FILE} bytes")
    return data


#: glibc keeps freed blocks unless told otherwise; other libraries lack the call.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    """Return free memory to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Codec:
    """One DuckDB connection with the merge table and the vocabulary of a rank file."""

    def __init__(self, data: bytes, pattern: str, cache_bytes: int = CACHE_BYTES):
        import duckdb
        import regex

        self.cache_bytes = cache_bytes
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.last = max(self.ranks.values())
        pairs = [
            (left << 32 | right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        self.piece = {r: t for t, r in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.cut = regex.compile(r"(?<=\S)(?= \S)").search
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "350MB"})
        pair, m = zip(*pairs, strict=True) if pairs else ((), ())
        self.con.register("pairs_in", pa.table({"pair": pa.array(pair, pa.int64()), "merged": pa.array(m, pa.int32())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM pairs_in")
        pieces = [*(t.decode("latin-1") for t in self.ranks), _MARK]
        self.con.register("voc_in", pa.table({"id": pa.array([*self.ranks.values(), -1], pa.int32()), "piece": pa.array(pieces)}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM voc_in")
        # by word: its ids in decimals joined by commas, the bytes decoded from them
        self.words: tuple[dict[str, tuple[bytes, bytes]], dict[str, tuple[bytes, bytes]]] = ({}, {})
        self.size = 0

    def _merge(self, a: int, b: int) -> int | None:
        return self.ranks.get(self.piece[a] + self.piece[b])

    def _long(self, word: bytes) -> list[int]:
        """Leftmost minimum-rank contraction by a heap over a linked list."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self._merge(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = m, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := self._merge(m, ids[k])) is not None:
                    heapq.heappush(heap, (x, i, m, ids[k]))
            h = before[i]
            if h >= 0 and (x := self._merge(ids[h], m)) is not None:
                heapq.heappush(heap, (x, h, ids[h], m))
        return [x for x in ids if x >= 0]

    def _query(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """What the recursive query and the ordered aggregation give for each word."""
        whole = [i for i, w in enumerate(words) if w in self.ranks]  # tokens as they are
        long_ = [i for i, w in enumerate(words) if len(w) > LONG_WORD and w not in self.ranks]
        apart = {i: [self.ranks[words[i]]] for i in whole} | {i: self._long(words[i]) for i in long_}
        plain = [i for i in range(len(words)) if i not in apart]
        order = [*apart, *plain]
        lens = [len(x) for x in apart.values()] + [len(words[i]) for i in plain]
        flat = np.concatenate([np.array([x for a in apart.values() for x in a], np.int32), self.byte[np.frombuffer(b"".join([words[i] for i in plain]), np.uint8)]])
        ends = np.zeros(len(words) + 1, np.int32)
        np.cumsum(lens, out=ends[1:])
        self.con.register("symbols", pa.table({"w": pa.array(order, pa.int32()), "ts": pa.ListArray.from_arrays(ends, flat)}))
        self.con.execute(_ENCODE)
        self.con.unregister("symbols")
        shown = self.con.sql(_SHOWN).to_arrow_table().column(0).cast(pa.binary()).to_pylist()
        return list(zip(shown, self._pieces(_ENCODED_ROWS), strict=True))

    def _pieces(self, rows: str) -> list[bytes]:
        """The bytes that each word of the rows decodes to, in order of the words."""
        whole = self.con.execute(_DECODE.format(rows=rows)).fetchall()[0][0] or ""
        return [p.encode("latin-1") for p in whole.split(_MARK)[:-1]]

    def encode_words(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """The cache, with all of ``words`` in it."""
        new, old = self.words
        todo: list[str] = []
        for word in words.difference(new):
            if (got := old.get(word)) is not None:
                new[word] = got
                self.size += len(word) + len(got[0]) + len(got[1]) + _ENTRY
            else:
                todo.append(word)
        at = 0
        data = [w.encode() for w in todo]
        while at < len(todo):
            to, total = at, 0
            while to < len(todo) and (to == at or total + len(data[to]) <= QUERY_BYTES):
                total += len(data[to])
                to += 1
            for word, got in zip(todo[at:to], self._query(data[at:to]), strict=True):
                new[word] = got
                self.size += len(word) + len(got[0]) + len(got[1]) + _ENTRY
            at = to
        return new

    def decode(self, rows: list[list[int]]) -> list[bytes]:
        """Bytes of each row of ids; an id outside the vocabulary raises ``ValueError``."""
        lens = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
        ids = np.fromiter((x for r in rows for x in (*r, -1)), np.int64, int(lens.sum()))
        last = np.cumsum(lens) - 1
        inner = np.delete(ids, last)
        if len(inner) and (inner.min() < 0 or inner.max() > self.last):
            raise ValueError("an id is not in the vocabulary")
        self.con.register("rows_in", pa.table({"w": np.repeat(np.arange(len(lens), dtype=np.int32), lens), "p": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)}))
        out = self._pieces("rows_in")
        self.con.unregister("rows_in")
        return out

    def stretches(self, text: str) -> Iterator[str]:
        """Parts of a text that pre-tokenise on their own, cut before a lone space about every STRETCH characters.

        The pattern never continues a match from a non-space character into white space, and a
        space between two such characters joins only what follows it, so such a cut is one between matches.
        """
        at = 0
        while len(text) - at > STRETCH and (m := self.cut(text, at + STRETCH)) is not None:
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def texts(self, texts: list[str]) -> Iterator[Iterator[list[tuple[bytes, bytes]]]]:
        """For each text its stretches, each as the values of its words in order."""
        short = [self.find(t) if len(t) <= STRETCH else None for t in texts]
        known = self.encode_words({w for s in short if s is not None for w in s})
        for t, s in zip(texts, short, strict=True):
            yield iter([[known[w] for w in s]]) if s is not None else self._long_text(t)

    def _long_text(self, text: str) -> Iterator[list[tuple[bytes, bytes]]]:
        for part in self.stretches(text):
            words = self.find(part)
            known = self.encode_words(set(words))
            yield [known[w] for w in words]

    def rest(self) -> None:
        """Age the cache and give free memory back to the system; to be called between slices."""
        if self.size > self.cache_bytes:
            self.words, self.size = ({}, self.words[0]), 0
        _give_back()


_codecs: dict[tuple[str, str, int], Codec] = {}
_lock = threading.Lock()
#: Uses begun and ended so far.
_turn = 0


@contextmanager
def _codec(data: bytes, pattern: str, cache_bytes: int = CACHE_BYTES) -> Iterator[Codec]:
    """The worker's codec, for one task.

    Tasks that follow at once find it warm.  When none has come for ``IDLE`` seconds it is dropped:
    Spark keeps idle workers, and later stages would have to run beside what they hold.
    """
    global _turn
    key = (hashlib.sha256(data).hexdigest(), pattern, cache_bytes)
    with _lock:
        _turn += 1
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(data, pattern, cache_bytes)
        codec = _codecs[key]
    try:
        yield codec
    finally:
        del codec
        with _lock:
            _turn += 1
            timer = threading.Timer(IDLE, _drop, [_turn])
        timer.daemon = True
        timer.start()


def _drop(turn: int) -> None:
    """Drop the codec, unless it was used since ``turn``."""
    with _lock:
        if turn == _turn:
            _codecs.clear()
            _give_back()


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    from .textnp import column, slices

    for batch in slices(batches, text, SLICE_BYTES):
        yield batch, column(batch, text).to_pylist()


def _keep(batch: pa.RecordBatch, out_col: str) -> tuple[list[pa.Array], list[str]]:
    at = [i for i, name in enumerate(batch.schema.names) if name != out_col]
    return [batch.column(i) for i in at], [batch.schema.names[i] for i in at]


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` (ids joined by commas), ``decoded_sha256`` (bytes decoded from the ids).

    ``cache_bytes`` bounds a generation of a worker's cache: fewer bytes take less memory and more time.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))  # at most MAX_RANK_FILE bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(data.value, pattern, cache_bytes) as codec:
            for batch, texts in _slices(batches, "text"):
                n, ids_hex, out_hex = [], [], []
                for parts in codec.texts(texts):
                    count, ids_sha, out_sha = 0, hashlib.sha256(), hashlib.sha256()
                    for values in parts:
                        if values:
                            shown, pieces = zip(*values, strict=True)
                            ids = b",".join(shown)
                            ids_sha.update(b"," + ids if count else ids)
                            out_sha.update(b"".join(pieces))
                            count += ids.count(b",") + 1
                    n.append(count)
                    ids_hex.append(ids_sha.hexdigest())
                    out_hex.append(out_sha.hexdigest())
                codec.rest()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(out_hex)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``out_col``, an array of token ids (empty for null or empty texts)."""
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != out_col) + f", `{out_col}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(data.value, pattern) as codec:
            for batch, texts in _slices(batches, text_col):
                ids, ends = [], [0]
                for parts in codec.texts(texts):
                    got = b",".join([v[0] for values in parts for v in values])
                    ids.append(np.array(got.split(b",") if got else [], np.int32))
                    ends.append(ends[-1] + len(ids[-1]))
                codec.rest()
                columns, names = _keep(batch, out_col)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*columns, lists], [*names, out_col])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """All columns of ``docs`` and ``out_col``, the bytes of its token ids (null ids: empty)."""
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != out_col) + f", `{out_col}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(data.value, pattern) as codec:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    rows = [r or [] for r in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
                    columns, names = _keep(batch, out_col)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(codec.decode(rows), pa.binary())], [*names, out_col])

    return docs.mapInArrow(run, schema)
