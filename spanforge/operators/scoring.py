"""Scores of masks against gold spans: coverage, entities, risk, agreement, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from . import intervals as I


def coverage(gold: DataFrame, mask: DataFrame, combos: list[str], predicate: str = "overlap", typed: bool = False) -> DataFrame:
    """(combo, canon, c, fn, pred_hit, fp): recall by the gold's type, precision by the type given to the mask.

    Precision asks for overlap whatever ``predicate`` is, unless that is ``exact``.  With ``typed``
    a match also needs the gold's type among the labels that contributed to the mask.
    """
    g = gold.select("doc_id", "start", "end", "canon", "seq", "detector", F.explode(F.array(*[F.lit(c) for c in combos])).alias("combo"))
    same = F.array_contains(F.col("r.canons"), F.col("l.canon")) if typed else None
    hit = I.semi(g, mask, ["combo", "doc_id"], predicate, same).groupBy("combo", "canon").agg(F.count(F.lit(1)).alias("c"))
    every = g.groupBy("combo", "canon").agg(F.count(F.lit(1)).alias("support"))
    same = F.array_contains(F.col("l.canons"), F.col("r.canon")) if typed else None
    good = I.semi(mask, g, ["combo", "doc_id"], "exact" if predicate == "exact" else "overlap", same, swap=True).groupBy("combo", "canon").agg(F.count(F.lit(1)).alias("pred_hit"))
    inside = mask.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    made = inside.groupBy("combo", "canon").agg(F.count(F.lit(1)).alias("n_pred"))
    out = every.join(hit, ["combo", "canon"], "left").join(made.join(good, ["combo", "canon"], "left"), ["combo", "canon"], "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("combo", "canon", z("c").alias("c"), (z("support") - z("c")).alias("fn"), z("pred_hit").alias("pred_hit"), (z("n_pred") - z("pred_hit")).alias("fp"))


def totals(cov: DataFrame) -> DataFrame:
    """Counts by type and, as ``ALL``, over all types."""
    sums = [F.sum(c).alias(c) for c in ("c", "fn", "pred_hit", "fp")]
    both = cov.groupingSets([[F.col("combo"), F.col("canon")], [F.col("combo")]], "combo", "canon").agg(*sums, F.grouping("canon").alias("g"))
    return both.select("combo", F.when(F.col("g") == 1, "ALL").otherwise(F.col("canon")).alias("canon"), "c", "fn", "pred_hit", "fp")


def rates(cov: DataFrame) -> DataFrame:
    """Precision, recall, F1 and F2 of each row of counts, 0 where undefined."""
    p, r = L.ratio(F.col("pred_hit"), F.col("pred_hit") + F.col("fp")), L.ratio(F.col("c"), F.col("c") + F.col("fn"))
    return cov.withColumns({"p": p, "r": r}).withColumns({"f1": L.f_beta(F.col("p"), F.col("r"), 1), "f2": L.f_beta(F.col("p"), F.col("r"), 4)})


def macro(cov: DataFrame) -> DataFrame:
    """Mean F1 and recall of the types that have support."""
    x = rates(cov).filter("c + fn > 0")
    return x.groupBy("combo").agg(F.count(F.lit(1)).alias("n_types"), F.avg("f1").alias("macro_f1"), F.avg("r").alias("macro_r"))


def caught(gold: DataFrame, mask: DataFrame, predicate: str = "overlap") -> DataFrame:
    """Gold spans with ``covered``."""
    keys = ["doc_id", "detector", "seq"]
    hit = I.semi(gold, mask, ["doc_id"], predicate).select(*keys).withColumn("covered", F.lit(True))
    return gold.join(hit, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def entities(spans: DataFrame) -> DataFrame:
    """(entity_id, canon, identifier_class, protected): all mentions covered; type and class of the first mention."""
    first = F.struct("doc_id", "start", "detector")
    return spans.groupBy("entity_id").agg(F.min_by("canon", first).alias("canon"), F.min_by("identifier_class", first).alias("identifier_class"), F.bool_and("covered").alias("protected"))


def confusion(counts: DataFrame) -> DataFrame:
    """tp, fp, fn, tn with accuracy, precision, recall, f1, base rate and majority accuracy."""
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    every, p, r = tp + fp + fn + tn, L.ratio(tp, tp + fp), L.ratio(tp, tp + fn)
    x = counts.select("tp", "fp", "fn", "tn").withColumns({"accuracy": L.ratio(tp + tn, every), "p": p, "r": r, "base_rate": L.ratio(tp + fn, every)})
    return x.withColumns({"f1": L.f_beta(F.col("p"), F.col("r"), 1), "majority": F.greatest("base_rate", 1 - F.col("base_rate"))})


def area(x: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc) from ``w``, twice the wins of positives over negatives with ties as half, and the two counts."""
    return x.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), 0.5).otherwise(F.col("w") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"))


#: Ranges of values whose running sums are separate tasks.
_RANGES = 64


def _ranged(x: DataFrame, key: str) -> DataFrame:
    """``x`` with ``range``, the number of its quantiles below ``key``."""
    cuts = x.agg(F.percentile_approx(key, [i / _RANGES for i in range(1, _RANGES)], 10_000).alias("cuts"))
    return x.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(key)))).drop("cuts")  # one row


def _before(x: DataFrame, n: str) -> DataFrame:
    """``x`` with ``before``, the sum of ``n`` over all lower ranges."""
    sums = x.groupBy("range").agg(F.sum(n).alias("n_"))
    sums = sums.select("range", F.coalesce(F.sum("n_").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # _RANGES rows
    return x.join(F.broadcast(sums), "range")


def numbered(x: DataFrame, key: str) -> DataFrame:
    """``x`` with ``ord``, the place of each row from 0 in order of a unique, numeric ``key``."""
    y = _before(_ranged(x, key).withColumn("one", F.lit(1).cast("long")), "one")
    within = F.row_number().over(W.partitionBy("range").orderBy(key)) - 1
    return y.withColumn("ord", within + F.col("before")).drop("range", "before", "one")


def auc(scored: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks; ties count half, one class alone gives 0.5.

    Equal scores are summed first.  Distinct scores are dealt into ranges by their quantiles, so that the
    running sum of a range is one task's work and only the sums of the ranges are added in one place.
    """
    by = scored.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    x = _before(_ranged(by, score), "neg").withColumn("below", F.coalesce(F.sum("neg").over(W.partitionBy("range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("wins2", F.col("pos") * (2 * (F.col("below") + F.col("before")) + F.col("neg")))
    return area(x.agg(F.coalesce(F.sum("wins2"), F.lit(0)).alias("w"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg")))


def kappa(table: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Cohen's kappa of two label columns; chance agreement 1 gives 1, no weight gives null."""
    cells = table.groupBy(a, b).agg(F.sum(weight).alias("n"))
    left = cells.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("x"))
    right = cells.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    x = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("n"))), F.lit(0)).alias("same")).join(F.broadcast(chance))  # one row each
    n, same, xy = F.col("n").cast("double"), F.col("same").cast("double"), F.col("xy").cast("double")
    return x.select("n", "same", F.when(n * n == xy, 1.0).otherwise((same * n - xy) / (n * n - xy)).alias("kappa"))


#: Keys of a group that travel as one block; pairs that a task makes, as long as that takes no more tasks than these.
_BLOCK, _PAIRS, _TASKS = 2048, 1 << 24, 4096


def _meetings(units: DataFrame, group: str, key: str) -> DataFrame:
    """(blocks, own): each two blocks of keys of one group once, and each block with itself (``own``); a null group is one too.

    A block is one sorted array, so a group of n keys takes n / _BLOCK rows, and its meetings the square of that.
    """
    g = units.select(F.col(group).alias("g"), F.col(key).alias("key")).filter("key IS NOT NULL")
    sizes = g.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("pairs")).first().pairs
    tasks = min(_TASKS, max(g.sparkSession.sparkContext.defaultParallelism, int(pairs / _PAIRS)))
    large = sizes.filter(F.col("n") > _BLOCK).select(F.col("g").alias("of"), F.ceil(F.col("n") / _BLOCK).cast("int").alias("m"))
    g = g.join(F.broadcast(large), F.col("g").eqNullSafe(F.col("of")), "left").withColumn("m", F.coalesce("m", F.lit(1)))  # a row for a full block at most
    x = g.groupBy("g", "m", F.pmod(F.xxhash64("key"), "m").cast("int").alias("i")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    # a lambda keeps an explode out of generated code, which would hold all its rows at once
    with_ = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    x = x.select("g", "keys", F.explode(with_).alias("at")).select("g", "at.lo", "at.hi", "keys").repartition(tasks, "g", "lo", "hi")
    own = F.col("lo") == F.col("hi")
    x = x.groupBy("g", "lo", "hi").agg(F.collect_list("keys").alias("blocks"))
    return x.filter(own | (F.size("blocks") == 2)).select("blocks", own.alias("own"))  # a block that met an empty one is alone


def same_pairs(units: DataFrame, group: str, key: str) -> DataFrame:
    """All pairs (a, b) of one group, a < b; a null group is one too.

    A task holds the blocks of its meetings and the pairs of one key with one block; no pair is shuffled.
    """
    one = F.explode(F.transform(F.element_at("blocks", 1), lambda x: F.struct(x.alias("x")))).alias("one")
    x = _meetings(units, group, key).select("own", F.element_at("blocks", -1).alias("keys"), one)
    x = x.select("own", F.col("one.x").alias("x"), F.explode("keys").alias("y")).filter((F.col("x") < F.col("y")) | ~F.col("own") & (F.col("x") > F.col("y")))
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def different_pairs(units: DataFrame, group: str, key: str, k: int, cap: int) -> DataFrame:
    """Every k-th pair (a, b) of different groups in key order, a < b, ``cap`` at most.

    These are among the first m = k * cap such pairs, and only the last units can be without a partner, so ``a`` is
    one of the first m units and ``b`` one of the m next of other groups.  So ``b`` is in the first 2 m of its group,
    and in the first 4 m of all that are: 2 m may be of the group of ``a`` and m not after ``a``.  Keys are unique.
    """
    m = k * cap
    u = units.select(F.col(key).alias("key"), F.col(group).alias("g")).filter("key IS NOT NULL")
    near = u.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("key"))).filter(F.col("r") <= 2 * m).orderBy("key").limit(4 * m)
    a = near.orderBy("key").limit(m).select(F.col("key").alias("a"), F.col("g").alias("ga"))
    pairs = F.broadcast(a).join(near.select(F.col("key").alias("b"), F.col("g").alias("gb")), (F.col("a") < F.col("b")) & ~F.col("ga").eqNullSafe(F.col("gb")))
    first = pairs.select("a", "b").orderBy("a", "b").limit(m)  # few rows
    return first.withColumn("rank", F.row_number().over(W.orderBy("a", "b")) - 1).filter(F.col("rank") % k == 0).select("a", "b")


def stride_pairs(units: DataFrame, group: str, key: str, k: int, cap: int) -> DataFrame:
    """All pairs of one group and every k-th pair of different groups in key order, ``cap`` of these at most.

    The result grows with the square of a group; ``farther`` counts its pairs without making them.
    """
    return same_pairs(units, group, key).withColumn("same", F.lit(True)).unionByName(different_pairs(units, group, key, k, cap).withColumn("same", F.lit(False)))


def farther(units: DataFrame, group: str, value: str, limits: list[int]) -> DataFrame:
    """One row: ``every``, the pairs of one group, and ``far_<limit>``, those whose values differ by more than each limit (0 or more).

    Equal values are counted first, so the windows run over the distinct values of a group.  Rows without a value form no pair.
    """
    by = units.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(group).orderBy(value)
    z = lambda frame: F.coalesce(F.sum("n").over(frame), F.lit(0))
    below = {"every": z(w.rowsBetween(W.unboundedPreceding, -1))} | {f"far_{t}": z(w.rangeBetween(W.unboundedPreceding, -t - 1)) for t in limits}
    x = by.select("n", *[v.alias(c) for c, v in below.items()])
    own = F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))
    return x.agg(*[(F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)) + (own if c == "every" else F.lit(0))).alias(c) for c in below])


#: Documents whose counts each task may hold.
_HELD = 1_000_000


def bootstrap(counts: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(lo, mean, hi) of recall over resamples of documents, from each document's (ord, c, n) with ord = 0..size-1.

    Draws come from integer arithmetic on (iteration, draw), so that any engine gives the same.
    """
    size = counts.count()
    draw = F.pmod(F.pmod((F.col("it") * 7919 + F.col("draw") * 104729 + seed) * 48271, F.lit(2147483647)) * 16807, F.lit(2147483647))
    every = counts.sparkSession.range(iterations * size).select(F.expr(f"id div {max(size, 1)}").alias("it"), F.expr(f"id % {max(size, 1)}").alias("draw"))
    draws = every.select("it", F.pmod(draw, F.lit(max(size, 1))).alias("ord"))
    # draws of an iteration are neighbours, so its sums form before the shuffle; counts of more documents than this meet the draws in one
    held = F.broadcast(counts) if size <= _HELD else counts
    stat = draws.join(held, "ord").groupBy("it").agg(L.ratio(F.sum("c"), F.sum("n")).alias("x"))
    lo, hi = int(0.025 * iterations), int(0.975 * iterations) - 1
    s = stat.agg(F.array_sort(F.collect_list("x")).alias("s"))  # one number for each iteration
    return s.select(F.get("s", F.lit(lo)).alias("lo"), (F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")).alias("mean"), F.get("s", F.lit(hi)).alias("hi"))
