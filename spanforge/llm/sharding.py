"""Shards of bounded size by extendible hashing.

A row's key is a 60-bit hash of its identifier.  The directory maps hash prefixes to buckets; a
bucket over the byte limit splits on its next bit, others stay, so a row's shard is the shortest
prefix of its key whose rows fit.  Bytes are first summed by a prefix somewhat finer than needed;
all further levels are sums of these sums.  Identifiers, sizes and keys are read from the texts once
and checkpointed; rows are shuffled by prefixes that hashing spreads evenly.  Rows of one key that fit no bucket even at the last bit go to
overflow pages of that bucket, as in the published scheme.

Defined results: a null text has no bytes; a null identifier is the text ``null``; a single row
over the limit gets a shard of its own with other rows excluded (``oversized`` is true); repeated
rows with one identifier share a key; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

KEY_BITS = 60
#: Bytes of text in a shard at most.
SHARD_BYTES = 64 << 20


def key(ident: Column) -> Column:
    """The first 60 bits of the MD5 of the identifier's text."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def prefix(k: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.call_function("shiftright", k, (F.lit(KEY_BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int, fine: int, low: int = 0) -> DataFrame:
    """(cell, depth, shard_bytes) from (k, bytes): the bucket of each prefix of ``fine`` bits; depth is null where even these bits are too few."""
    cells = sizes.groupBy(prefix(F.col("k"), fine).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(fine))).alias("depth"))
    bucket = F.call_function("shiftright", F.col("cell"), (F.lit(fine) - F.col("depth")).cast("int"))
    levels = levels.withColumn("bucket", bucket)
    fit = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    found = levels.join(fit, ["depth", "bucket"]).groupBy("cell").agg(F.min_by(F.struct("depth", "shard_bytes"), "depth").alias("b"))
    return cells.join(found, "cell", "left").select("cell", F.col("b.depth").alias("depth"), F.col("b.shard_bytes").alias("shard_bytes"))


def _narrow(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long")
    return docs.select(docs[id_col].alias("id"), size.alias("bytes"), key(docs[id_col]).alias("k"), *more)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Per row: id, ``n_bytes``, ``shard`` (bits of the prefix, and ``+page`` on overflow), ``depth``, ``shard_bytes``, ``oversized``."""
    rows = cut(_narrow(docs, id_col, text_col))
    got = _placed(rows, rows, limit)
    return got.select(F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def _placed(rows: DataFrame, narrow: DataFrame, limit: int) -> DataFrame:
    """``rows`` (id, bytes, k and whatever else) with depth, shard_bytes and shard; ``narrow`` has the first three of the same rows."""
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    fine = min(KEY_BITS, max(1, (max(1, total // limit)).bit_length() + 6))
    tree = cut(directory(narrow, limit, fine))
    got = rows.withColumn("cell", prefix(F.col("k"), fine)).join(tree, "cell").drop("cell")
    none = F.lit(None).cast("long")
    if fine < KEY_BITS and not tree.filter("depth IS NULL").isEmpty():  # a key, or a row, holds much: use all bits there
        deep = narrow.withColumn("cell", prefix(F.col("k"), fine)).join(tree.filter("depth IS NULL").select("cell"), "cell", "left_semi")
        # levels beyond the fine one, for the few cells that need them; the sums of single keys are small
        keys = deep.groupBy("k").agg(F.sum("bytes").alias("bytes"))
        full = cut(directory(keys, limit, KEY_BITS, fine + 1).withColumnRenamed("cell", "k"))
        hot = got.filter("depth IS NULL").drop("depth", "shard_bytes").join(full, "k")
        good = got.filter("depth IS NOT NULL").unionByName(hot.filter("depth IS NOT NULL")).withColumn("page", none)
        got = good.unionByName(_pages(hot.filter("depth IS NULL").drop("depth", "shard_bytes"), limit))
    else:
        got = got.withColumn("page", none)
    bits = F.lpad(F.conv(prefix(F.col("k"), F.col("depth")).cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0"))
    name = F.concat(F.when(F.col("depth") == 0, F.lit("")).otherwise(bits), F.coalesce(F.concat(F.lit("+"), F.col("page").cast("string")), F.lit("")))
    return got.withColumn("shard", name)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of full-depth buckets: rows of one key by size class, each class in pages that fit.

    A class holds rows of 2**(c-1)..2**c-1 bytes, so limit // (2**c-1) of them, one at least, fill
    at least half a page and never more than one.  Ranks come from counts by (key, class, partition)
    over checkpointed rows, so that no task sees all rows of a key.
    """
    held = rows.withColumn("c", F.length(F.bin("bytes")).cast("long")).withColumn("part", F.spark_partition_id())
    held = cut(held)
    counts = held.groupBy("k", "c", "part").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("k", "c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = held.withColumn("r", F.row_number().over(W.partitionBy("k", "c", "part").orderBy("id")) - 1).join(counts.withColumn("before", before).drop("count"), ["k", "c", "part"])
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c").cast("int")) - 1)))
    paged = ranked.withColumn("page", F.floor((F.col("r") + F.col("before")) / each) * 64 + F.col("c"))
    sums = paged.groupBy("k", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.join(sums, ["k", "page"]).drop("c", "part", "r", "before").withColumn("depth", F.lit(KEY_BITS))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write every row of ``docs`` once, as Parquet with one folder for each shard.

    Rows carry their columns through the assignment, so rows that share an identifier, or have none,
    are written as often as they occur.
    """
    rows = _narrow(docs, id_col, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = _placed(rows, cut(_narrow(docs, id_col, text_col)), limit).select("row.*", F.col("shard").alias("_shard"))
    out.repartition("_shard").write.partitionBy("_shard").parquet(path)
