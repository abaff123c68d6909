"""Attack scorecards, utility of what redaction leaves, and resampling over judged pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from .scoring import area

#: Ranked guesses of an attribute that count.
TOP = 3


def repair_verdict(same: Column, confidence: Column) -> Column:
    """Confidence that two texts are of one person: missing is 1 or 0 by the verdict, clamped, and turned
    round where a verdict "different" came with confidence in itself."""
    conf = F.coalesce(confidence, F.when(same, 1.0).otherwise(0.0))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))
    return F.when((same == F.lit(False)) & (conf > 0.5), 1.0 - conf).otherwise(conf)


def top_hits(guesses: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attribute, top1, top3): whether the first, or one of the first TOP, guesses holds a truth.

    ``guesses`` has (keys, attribute, ranked), ``truth`` (client, attribute, needle) in lower case.
    Null and empty guesses are left out before ranks are counted.
    """
    known = truth.groupBy("client", "attribute").agg(F.collect_set("needle").alias("needles"))
    said = F.filter(F.transform("ranked", lambda g: F.lower(g)), lambda g: g.isNotNull() & (g != ""))
    x = guesses.withColumn("said", F.slice(said, 1, TOP)).join(known, ["client", "attribute"])
    hit = lambda g: F.exists("needles", lambda n: F.contains(g, n))
    first = F.coalesce(hit(F.get("said", F.lit(0))), F.lit(False))
    return x.select(*keys, "attribute", first.alias("top1"), F.exists("said", hit).alias("top3"))


def scorecard(hits: DataFrame, session: str = "session") -> DataFrame:
    """(client, single_best, bulk, gain, of): most attributes recovered in one session, in all together (session 0)."""
    by = hits.groupBy("client", session).agg(F.count_if("top3").alias("n"), F.count(F.lit(1)).alias("of"))
    single, bulk = F.max(F.when(F.col(session) > 0, F.col("n"))), F.max(F.when(F.col(session) == 0, F.col("n")))
    return by.groupBy("client").agg(F.coalesce(single, F.lit(0)).alias("single_best"), F.coalesce(bulk, F.lit(0)).alias("bulk"), F.max("of").alias("of")).withColumn("gain", F.col("bulk") - F.col("single_best"))


def risk(hits: DataFrame, survival: DataFrame) -> DataFrame:
    """(client, top1, top3, survival, risk) from attribute hits and each client's share of surviving quasi-identifiers."""
    x = hits.groupBy("client").agg(F.count_if("top1").alias("top1"), F.count_if("top3").alias("top3")).join(survival, "client", "left").fillna(0.0, ["survival"])
    return x.withColumn("risk", L.risk_class(F.col("top1"), F.col("top3"), F.col("survival")))


def named_in(said: Column, vocabulary: list[str]) -> Column:
    """The entries of a vocabulary that an answer names: one holds the other, in either direction."""
    low = F.transform(said, lambda s: F.lower(s))
    return F.filter(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.exists(low, lambda s: F.contains(s, v) | F.contains(v, s)))


def signal_kept(sessions: DataFrame, before: str, after: str) -> DataFrame:
    """(client, sessions, mean_kept): share of the types found before redaction that are found after it, null ones left out."""
    kept = F.when(F.size(before) > 0, F.size(F.array_intersect(before, after)) / F.size(before))
    return sessions.groupBy("client").agg(F.count(F.lit(1)).alias("sessions"), F.avg(kept).alias("mean_kept"))


def inference_summary(tests: DataFrame) -> DataFrame:
    """Recovered and tested attributes by client and, as null, over all."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_recovered", "n_tested")]
    x = tests.groupingSets([[F.col("client")], []], "client").agg(*sums)
    return x.withColumn("rate", F.round(L.ratio(F.col("n_recovered"), F.col("n_tested")), 4))


def draws(spark, size: int, iterations: int, seed: int) -> DataFrame:
    """(it, ord): ``size`` draws with replacement from 0..size-1 in each iteration, by integer arithmetic."""
    n = max(size, 1)
    every = spark.range(iterations * size).select(F.expr(f"id div {n}").alias("it"), F.expr(f"id % {n}").alias("draw"))
    value = F.pmod(F.pmod((F.col("it") * 7919 + F.col("draw") * 104729 + seed) * 48271, F.lit(2147483647)) * 16807, F.lit(2147483647))
    return every.select("it", F.pmod(value, F.lit(n)).alias("ord"))


def pair_bootstrap(verdicts: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(measure, mean, lo, hi) of accuracy and AUC over resampled verdicts (ord, same, called, confidence), ord from 0.

    A resample is a multiplicity of each verdict, so equal draws are one row, and the AUC of an
    iteration comes from its sums by score.
    """
    times = draws(verdicts.sparkSession, verdicts.count(), iterations, seed).groupBy("it", "ord").agg(F.count(F.lit(1)).alias("k"))
    x = times.join(verdicts, "ord")
    acc = x.groupBy("it").agg(F.round(F.sum(F.when(F.col("same") == F.col("called"), F.col("k")).otherwise(0)) / F.sum("k"), 4).alias("accuracy"))
    by = x.groupBy("it", "confidence").agg(F.sum(F.when(F.col("same"), F.col("k")).otherwise(0)).alias("pos"), F.sum(F.when(~F.col("same"), F.col("k")).otherwise(0)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.partitionBy("it").orderBy("confidence").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = by.withColumn("w2", F.col("pos") * (2 * below + F.col("neg"))).groupBy("it").agg(F.sum("w2").alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = area(wins, "it").select("it", F.round("auc", 4).alias("auc"))
    both = acc.join(auc, "it").select("it", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("accuracy", "auc")])))
    s = both.groupBy("measure").agg(F.array_sort(F.collect_list("x")).alias("s"))  # one number for each iteration
    lo, hi = int(0.025 * iterations), int(0.975 * iterations) - 1
    mean = F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.size("s")
    return s.select("measure", F.round(mean, 4).alias("mean"), F.get("s", F.lit(lo)).alias("lo"), F.get("s", F.lit(hi)).alias("hi"))
