"""Algebra over character intervals keyed by document: merging, matching, redaction, segments.

Every join has the document as an equi key, so Catalyst plans hash or sort-merge joins with the
range condition as a residual; merges are window folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge(spans: DataFrame, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """Rows with their island: columns ``ord``, ``before`` (largest end so far), ``island``, ``island_start``, ``first_conf``.

    Intervals merge when a start lies before the running end; touching ones stay apart.
    """
    order = order or ["start", F.col("end").desc(), "layer_rank", "seq"]
    w = W.partitionBy(*keys).orderBy(*order)
    r = spans.withColumn("ord", F.row_number().over(w)).withColumn("before", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    r = r.withColumn("island", F.sum(F.when(F.col("before").isNull() | (F.col("start") >= F.col("before")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = W.partitionBy(*keys, "island")
    return r.withColumn("island_start", F.min("start").over(g))


def masks(spans: DataFrame, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """Disjoint intervals (keys, start, end), labels ignored."""
    return merge(spans, keys, order).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def first_label(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint intervals with the label of the first span."""
    m = merge(spans, keys)
    return m.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", "ord").alias("label")).drop("island")


def longest_label(spans: DataFrame, keys: list[str], label: str = "canon") -> DataFrame:
    """Disjoint intervals; the label switches to a span longer than the interval merged so far.

    ``canons`` has all labels that contributed.
    """
    m = merge(spans, keys)
    wins = F.col("before").isNull() | (F.col("ord") == F.col("first_ord")) | (F.col("end") - F.col("start") > F.col("before") - F.col("island_start"))
    m = m.withColumn("first_ord", F.min("ord").over(W.partitionBy(*keys, "island")))
    return m.groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max_by(label, F.when(wins, F.col("ord"))).alias("canon"), F.array_sort(F.collect_set(label)).alias("canons")
    ).drop("island")


def confident_label(spans: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Disjoint intervals; the label is that of the last span more confident than the island's first, else the first's."""
    g = W.partitionBy(*keys, "island").orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    m = merge(spans, keys).withColumn("first_ord", F.first("ord").over(g)).withColumn("first_conf", F.first("confidence").over(g))
    wins = (F.col("ord") == F.col("first_ord")) | (F.col("confidence") > F.col("first_conf"))
    return m.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by(label, F.when(wins, F.col("ord"))).alias("label")).drop("island")


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def exact(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") == F.col(f"{b}.start")) & (F.col(f"{a}.end") == F.col(f"{b}.end"))


def contains(mask: str, gold: str) -> Column:
    """At least four fifths of the gold interval lie in the mask; in integers, so without rounding."""
    shared = F.least(F.col(f"{mask}.end"), F.col(f"{gold}.end")) - F.greatest(F.col(f"{mask}.start"), F.col(f"{gold}.start"))
    size = F.col(f"{gold}.end") - F.col(f"{gold}.start")
    return overlaps(mask, gold) & (size > 0) & (5 * shared >= 4 * size)


PREDICATES = {"overlap": overlaps, "exact": exact, "contain": contains}


def on_keys(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return out


def semi(left: DataFrame, right: DataFrame, keys: list[str], predicate: str = "overlap", typed: Column | None = None, anti: bool = False, swap: bool = False) -> DataFrame:
    """Rows of ``left`` with (or without) a match in ``right``; ``swap`` puts the mask on the left of the predicate."""
    a, b = left.alias("l"), right.alias("r")
    cond = on_keys("l", "r", keys) & (PREDICATES[predicate]("l", "r") if swap else PREDICATES[predicate]("r", "l"))
    if typed is not None:
        cond = cond & typed
    return a.join(b, cond, "left_anti" if anti else "left_semi")


def redact(docs: DataFrame, mask: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "label", marks: tuple[str, str] = ("<", ">")) -> DataFrame:
    """(id, redacted): the text with each mask interval replaced by its label between ``marks``."""
    w = W.partitionBy(id_col).orderBy("start")
    pieces = mask.withColumn("after", F.lag("end", 1, 0).over(w)).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "after", F.col(label).alias("label")))).alias("m"))
    joined = docs.join(pieces, id_col, "left")
    t = F.col(text_col)
    body = F.transform("m", lambda x: F.concat(F.substring(t, x["after"] + 1, x["start"] - x["after"]), F.lit(marks[0]), x["label"], F.lit(marks[1])))
    tail = F.substring(t, F.element_at("m", -1)["end"] + 1, F.length(t))
    return joined.select(id_col, F.when(F.col("m").isNull(), t).otherwise(F.concat(F.array_join(body, ""), tail)).alias("redacted"))


def segments(spans: DataFrame, lengths: DataFrame, keys: list[str], who: str, people: list[str]) -> DataFrame:
    """Elementary segments of each document with, for each annotator, the label that covers them (O for none).

    ``lengths`` has (keys, n), ``people`` are the values of ``who``.  Of several labels the longest wins, of equal ones the later.
    """
    edges = spans.select(*keys, F.col("start").alias("at")).unionByName(spans.select(*keys, F.col("end").alias("at")))
    edges = edges.unionByName(lengths.select(*keys, F.lit(0).alias("at"))).unionByName(lengths.select(*keys, F.col("n").alias("at"))).distinct()
    w = W.partitionBy(*keys).orderBy("at")
    seg = edges.withColumn("to", F.lead("at").over(w)).filter("to IS NOT NULL").withColumnRenamed("at", "from")
    grid = seg.withColumn(who, F.explode(F.array(*[F.lit(x) for x in people])))
    a, b = grid.alias("g"), spans.alias("s")
    cond = on_keys("g", "s", keys) & (F.col(f"g.{who}") == F.col(f"s.{who}")) & (F.col("s.start") <= F.col("g.from")) & (F.col("s.end") >= F.col("g.to"))
    best = F.max_by("s.label", F.struct(F.col("s.end") - F.col("s.start"), F.col("s.layer_rank"), F.col("s.seq")))
    return a.join(b, cond, "left").groupBy(*[F.col(f"g.{k}").alias(k) for k in keys], F.col("g.from").alias("from"), F.col("g.to").alias("to"), F.col(f"g.{who}").alias(who)).agg(F.coalesce(best, F.lit("O")).alias("label"))


def size(mask: DataFrame, name: str) -> Column:
    return F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias(name)


def last_at_or_before(events: DataFrame, points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """As-of join, backward and inclusive: each point with the latest event's ``value``; one sort, no join."""
    tagged = events.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast("struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in points.schema) + ">").alias("_p"))
    asked = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(events.schema[value].dataType).alias("_value"), F.struct(*points.columns).alias("_p"))
    w = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    return tagged.unionByName(asked).withColumn("_v", F.last("_value", True).over(w)).filter("_side = 1").select("_p.*", F.col("_v").alias(value))
