"""Near-duplicate classes by MinHash bands and odd sketches.

One pass turns each text into its set of word shingles (64-bit hashes), a digest of the whole set,
banded MinHash values and an odd sketch: a parity bitmap into which the MinHash samples are folded,
so that the population count of the XOR of two sketches estimates a high similarity.  A second
bitmap holds the parities of the whole set; the population count of two of them XORed is at most
the number of shingles in which the sets differ, so it refuses pairs without any error, sharply
for small sets, where the samples tell least.  Equal sets collapse to one representative before
anything is compared.

Links are then looked for among representatives that share a band.  First each is compared with
the smallest of its bucket.  As only classes are asked for, later rounds compare just those members
of a bucket that are not yet in one class: in blocks, each such member gets its likeliest partners
by the sketches, a few at first, then more, then all that the sketches admit; rounds end as soon as
no member had more partners than it was given.  Every comparison is confirmed on the full sets.  So a group of many near copies costs about as many comparisons as it
has members, no bucket is capped, and no link between different classes goes unseen but for the
odds of the method: there are as many bands of 4 as it takes for two sets at the threshold to share
none with odds of at most 7.5 in a million (16 at 0.85, 23 at 0.8), and the sketch bound lies four
standard deviations below the threshold.

Full sets travel as the first 46 bits of their shingles' hashes: two unequal shingles of two texts of
500 words agree there with odds of four in a thousand million, and matter only to a pair that close to the threshold.

Everything stays in DataFrames; what is used again is written to the checkpoint folder.

Defined results: null and empty texts have an empty set and are linked with nothing; texts with
fewer words than a shingle have their whole sequence as one; rows that share an id but not the text
are linked each by its own text, and a class is named by its smallest id; a row with a null id has a
null class and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut
from .textnp import Words, column, mix, pack_sorted, raw, sets, shingles, slices, unpack_sorted

ROWS = 4
#: Highest odds that two sets at the threshold share no band.
MISS = 7.5e-6
#: MinHash samples; bands use the first ones, odd sketches all.
SAMPLES = 256
#: 64-bit words of an odd sketch of the samples, and of the parities of a whole set.
SKETCH, PARITY = 16, 32
#: Rows whose samples are held at once.
_ROWS = 2048
_A = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples (rows x SAMPLES) of non-empty sets laid end to end."""
    out = np.empty((len(offsets) - 1, SAMPLES), np.uint64)
    if not len(out):
        return out
    # bounded pieces stay in cache
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 16), "right")) - 1)
        v, o = values[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        for p in range(SAMPLES):
            out[at:to, p] = np.minimum.reduceat((v ^ _B[p]) * _A[p], o)
        at = to
    return mix(out)


def how_many(threshold: float) -> int:
    """Bands of ROWS samples by which sets at ``threshold`` are missed with odds of ``MISS`` at most, as far as there are samples."""
    return min(SAMPLES // ROWS, max(1, math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS))))) if threshold < 1 else 1


def bands(sig: np.ndarray, count: int) -> np.ndarray:
    """One key for each band of each row."""
    s = sig[:, : count * ROWS].reshape(len(sig), count, ROWS)
    out = np.full((len(sig), count), 7, np.uint64) * np.arange(1, count + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out + s[:, :, r])
    return out


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x SKETCH words) of the samples."""
    slot = (mix(sig + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(64 * SKETCH)
    out = np.zeros((len(sig), SKETCH), np.uint64)
    rows = np.arange(len(sig))
    for p in range(SAMPLES):
        out[rows, slot[:, p] >> np.uint64(6)] ^= np.uint64(1) << (slot[:, p] & np.uint64(63))
    return out


def parities(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x PARITY words) of sets laid end to end."""
    out = np.zeros((len(offsets) - 1) * PARITY, np.uint64)
    slot = mix(values) % np.uint64(64 * PARITY)
    row = np.repeat(np.arange(len(offsets) - 1) * PARITY, np.diff(offsets))
    np.bitwise_xor.at(out, row + (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out.reshape(-1, PARITY)


def shingle_sets(arr: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct shingle hashes of each text."""
    w = Words(*raw(arr))
    doc, h = shingles(w, k)
    return sets(doc, h, len(arr))


def most_bits(threshold: float) -> int:
    """Most differing bits of two sketches that may still be of sets at ``threshold``."""
    low = threshold - 4 * math.sqrt(threshold * (1 - threshold) / SAMPLES)
    n, m = 64 * SKETCH, 2 * SAMPLES * (1 - max(0.0, low))
    return math.ceil(n / 2 * (1 - math.exp(-2 * m / n)) + math.sqrt(n) / 4)


def text_key(text_col: str):
    """128 bits that tell texts apart; a null text differs from an empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(text_col).cast("string")), F.lit("")), 256)), 1, 16)


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def prepare(docs: DataFrame, id_col: str, text_col: str, k: int, count: int) -> DataFrame:
    """(id, text_key, n, digest, bands, odd, parity) of every row with ``count`` bands; all but the first three are null for empty sets."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            values, o = shingle_sets(column(batch, "text"), k)
            n = np.diff(o)
            some = np.flatnonzero(n)
            ends = np.append(o[some], len(values))
            digest: list[bytes | None] = [None] * len(n)
            traits: list[list[np.ndarray | None]] = [[None] * len(n) for _ in range(3)]
            for at in range(0, len(some), _ROWS):
                i = some[at : at + _ROWS]
                v, e = values[ends[at] : ends[at + len(i)]], ends[at : at + len(i) + 1] - ends[at]
                sig = signatures(v, e)
                for kept, found in zip(traits, (bands(sig, count), odd_sketches(sig), parities(v, e)), strict=True):
                    for j, row in zip(i.tolist(), found.view(np.int64), strict=True):
                        kept[j] = row
            for j in some.tolist():
                digest[j] = set_digest(values[o[j] : o[j + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), *(pa.array(t, pa.list_(pa.int64())) for t in traits)],
                ["id", "text_key", "n", "digest", "bands", "odd", "parity"],
            )

    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_key binary, n long, digest binary, bands array<long>, odd array<long>, parity array<long>")


#: Bits of a shingle's hash that travel in full sets, so that a step between two of some hundred takes five bytes.
KEPT = 46


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, hashes) of each (id, rep, digest) of ``nodes``: the packed set with that digest, from a row of ``docs`` with the id ``rep``.

    Sets are smaller than their texts, so they, not the texts, meet the nodes: one exchange.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            values, o = shingle_sets(column(batch, "text"), k)
            parts = [values[i:j] for i, j in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            short = [pack_sorted(np.unique(v >> np.uint64(64 - KEPT))) for v in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_digest(v) for v in parts], pa.binary()), pa.array(np.diff(o).astype(np.int64)), pa.array(short, pa.binary())], ["rep", "digest", "n", "hashes"])

    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text")).filter("rep IS NOT NULL")
    found = rows.mapInArrow(run, f"rep {kind}, digest binary, n long, hashes binary")
    return found.join(nodes, ["rep", "digest"]).groupBy("rep", "digest").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("hashes").alias("hashes")).select("id", "n", "hashes")


#: Pairs with both their sets that go to a worker at a time.
_PAIRS = 1000


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Inside, Arrow batches have _PAIRS rows at most, as each holds two whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, _PAIRS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def confirm(pairs: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * shared >= percent * united, as a checkpoint."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            keep, last, left = [], None, None
            for x, y, n in zip(batch.column(4), batch.column(5), sizes, strict=True):
                data = x.as_py()
                if data != last:
                    last, left = data, unpack_sorted(data)
                both = len(np.intersect1d(left, unpack_sorted(y.as_py()), assume_unique=True))
                keep.append(100 * both >= percent * (n - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets_.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("hashes").alias("h" + x))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ha", "hb")
    with _few_rows(pairs.sparkSession):
        return cut(both.mapInArrow(run, f"a {kind}, b {kind}"))


def components(nodes: DataFrame, links: DataFrame, most: int = 60) -> DataFrame:
    """(id, class): the smallest id reachable, by minimum labels and pointer jumping; links are (a, b)."""
    edges = cut(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    label = edges.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("id"), F.least("a", "l").alias("l"))
    for _ in range(most):
        near = edges.join(label.select(F.col("id").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m")).withColumnRenamed("a", "id")
        low = label.join(near, "id", "left").select("id", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = low.select(F.col("id").alias("l"), F.col("l").alias("j"))
        label2 = cut(low.join(jump, "l", "left").select("id", "old", F.least("l", F.coalesce("j", "l")).alias("l")))
        label = label2.select("id", "l")
        if label2.filter("l != old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(label, "id", "left").select("id", F.coalesce("l", "id").alias("class"))


_SCAN = 4096


def _words(table: pa.Table, name: str, width: int) -> np.ndarray:
    """A column of equally long bitmaps as rows x words."""
    held = table.column(name).combine_chunks()
    return held.values.to_numpy().view(np.uint64)[held.offset * width : (held.offset + len(held)) * width].reshape(-1, width)


def _partners(limit: int | None, bits: int, percent: int):
    """For each member that asks, its likeliest partners of other classes within a block of its bucket.

    ``more`` marks pairs of members that had further partners.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        odd, parity = _words(table, "odd", SKETCH), _words(table, "parity", PARITY)
        ids, classes, n, asks = (table.column(c).to_numpy() for c in ("id", "class", "n", "asks"))
        there = np.flatnonzero(~asks)
        out_a, out_b, out_more = [], [], []
        for i in np.flatnonzero(asks):
            rest = there[(classes[there] != classes[i]) & (100 * np.minimum(n[there], n[i]) >= percent * np.maximum(n[there], n[i]))]
            z = np.bitwise_count(odd[rest] ^ odd[i]).sum(1)
            apart = np.bitwise_count(parity[rest] ^ parity[i]).sum(1).astype(np.int64)
            ok = (z <= bits) & ((100 + percent) * apart <= (100 - percent) * (n[rest] + n[i]))
            best = rest[ok]
            cut_off = limit is not None and len(best) > limit
            if cut_off:
                best = best[np.argsort(z[ok], kind="stable")[:limit]]
            out_a.append(np.minimum(ids[best], ids[i]))
            out_b.append(np.maximum(ids[best], ids[i]))
            out_more.append(np.full(len(best), cut_off))
        a, b = (np.concatenate([*x, ids[:0]]) for x in (out_a, out_b))
        more = np.concatenate([*out_more, asks[:0]])
        order = np.lexsort((~more, b, a))
        a, b, more = a[order], b[order], more[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(a[new], kind), "b": pa.array(b[new], kind), "more": pa.array(more[new])})

    return run


def _differ(x: str, y: str):
    """Bits in which two bitmaps differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, z: total + z)


def _linked(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, n, digest) of every row, and (digest, class, smallest id of the class) of every set.

    A set is a node by a number of its own, as rows that share an id may hold different sets.
    """
    ready = cut(prepare(docs, id_col, text_col, k, how_many(percent / 100)))
    some = ready.filter("digest IS NOT NULL AND id IS NOT NULL")
    equal = some.groupBy("digest").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "bands", "odd", "parity"), "id").alias("x"))
    # numbers are fixed by the checkpoint
    reps = cut(equal.select("digest", "rep", F.monotonically_increasing_id().alias("id"), "x.n", "x.bands", "x.odd", "x.parity"))
    member = reps.select("id", F.posexplode("bands").alias("band", "value"))
    bucket = member.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).filter("size > 1")
    member = cut(member.join(bucket, ["band", "value"]))
    bits = most_bits(percent / 100)
    traits = reps.select("id", "n", "odd", "parity")
    star = member.filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    for side in ("a", "b"):
        star = star.join(traits.select(F.col("id").alias(side), *(F.col(c).alias(c + side) for c in ("n", "odd", "parity"))), side)
    star = star.filter(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & ((100 + percent) * _differ("paritya", "parityb") <= (100 - percent) * (F.col("na") + F.col("nb")))
        & (_differ("odda", "oddb") <= bits)
    ).select("a", "b")
    involved = member.select("id").distinct()
    texts = cut(full_sets(docs, reps.select("id", "rep", "digest").join(involved, "id", "left_semi"), id_col, text_col, k))
    tried = cut(star)
    links = confirm(tried, texts, percent)
    label = components(involved, links)
    wide = member.filter("size > 2")
    for limit in (8, 64, None):
        # members of buckets that are in several classes; those outside the largest class ask
        at = wide.join(label, "id")
        by_class = at.groupBy("band", "value", "class").agg(F.count(F.lit(1)).alias("m"))
        most = F.max_by("class", F.struct("m", "class")).alias("top")
        top = by_class.groupBy("band", "value").agg(F.count(F.lit(1)).alias("classes"), most, (F.sum("m") - F.max("m")).alias("others")).filter("classes > 1")
        at = at.join(top, ["band", "value"]).join(traits, "id")
        # both sides are blocked by their own numbers, so that a task has at most about _SCAN members of each
        sides = {"held": "size", "asking": "others"}
        at = at.withColumns({f"{s}_n": F.greatest(F.lit(1), F.ceil(F.col(n) / _SCAN).cast("int")) for s, n in sides.items()})
        own = lambda s: F.pmod(F.xxhash64("id"), f"{s}_n").cast("int").alias(f"{s}_block")
        every = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"{s}_n") - 1)).alias(f"{s}_block")
        held = at.select("band", "value", "id", "class", "n", "odd", "parity", own("held"), every("asking"), F.lit(False).alias("asks"))
        ask = at.filter("class != top").select("band", "value", "id", "class", "n", "odd", "parity", every("held"), own("asking"), F.lit(True).alias("asks"))
        kind = member.schema["id"].dataType.simpleString()
        found = held.unionByName(ask).groupBy("band", "value", "held_block", "asking_block").applyInArrow(_partners(limit, bits, percent), f"a {kind}, b {kind}, more boolean")
        found = cut(found.groupBy("a", "b").agg(F.max("more").alias("more")))
        last = found.filter("more").isEmpty()
        found = cut(found.select("a", "b").join(tried, ["a", "b"], "left_anti"))
        if found.isEmpty():
            if last:
                break
            continue
        more = confirm(found, texts, percent)
        tried = tried.unionByName(found)
        if not more.isEmpty():
            links = links.unionByName(more)
            label = components(involved, links)
        if last:
            break
    of_digest = reps.select("digest", "rep", "id").join(label, "id", "left").select("digest", "rep", F.coalesce("class", "id").alias("class"))
    return ready.select("id", "text_key", "n", "digest"), cut(of_digest.join(of_digest.groupBy("class").agg(F.min("rep").alias("smallest")), "class").select("digest", "class", "smallest"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` and ``kept`` (the row's id is its class's smallest)."""
    rows, of_digest = _linked(docs, id_col, text_col, k, percent)
    out = rows.filter("id IS NOT NULL").join(of_digest, "digest", "left").select("id", "n", F.coalesce("smallest", "id").alias("class"))
    out = out.unionByName(rows.filter("id IS NULL").select("id", "n", F.col("id").alias("class")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("class").alias("component_id"), F.coalesce(F.col("id") == F.col("class"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of near duplicates, columns unchanged: of the smallest id, then of the smallest key of the text.

    Rows without a word or an id are in no class.  Rows that repeat id and text give one row, the
    first by the other columns; those that share only the id are told apart.
    """
    rows, of_digest = _linked(docs, id_col, text_col, k, percent)
    member = rows.filter("id IS NOT NULL").join(of_digest, "digest").select("class", F.struct("id", "text_key").alias("row")).distinct()
    first = member.groupBy("class").agg(F.min("row").alias("first"))
    gone = member.join(first, "class").filter("row != first").select(F.col("row.id").alias("_id"), F.col("row.text_key").alias("_key")).distinct()
    known = docs.filter(F.col(id_col).isNotNull()).withColumns({"_id": F.col(id_col), "_key": text_key(text_col)}).join(gone, ["_id", "_key"], "left_anti")
    order = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text_col and "map<" not in f.dataType.simpleString()]
    once = known.groupBy("_id", "_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*order)).alias("row"))
    return docs.filter(F.col(id_col).isNull()).unionByName(once.select("row.*"))
