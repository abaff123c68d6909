"""Registered queries of the reference's operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions import spans as S
from ..operators import intervals as I
from ..operators import scoring as Q
from ..operators import sequential as E
from ..sources.stage import stage
from . import relations as R

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that engines agree on types."""
    return df.select([F.col(f.name).cast("long") if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name) for f in df.schema])


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _wide(f(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    _ALL[f.__name__] = run
    return run


def staged(f: Query) -> Query:
    """A query that uses spans several times: they are found once and written out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with R.sharing():
            return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return query(run)


def queries() -> dict[str, Query]:
    return dict(_ALL)


# --- detectors ------------------------------------------------------------------------------
def _detector(name: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.spans(R.with_samples(spark, sf_dir), [S.DETECTORS[name]]).select("doc_id", "seq", "start", "end", "label", "value")

    f.__name__ = f"spans_{name}"
    query(f)


for _name in S.DETECTORS:
    _detector(_name)


@query
def span_union_by_combo(spark, d):
    return R.by_combo(spark, d).groupBy("combo", "canon").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


@query
def safe_label_counts(spark, d):
    return R.preds(spark, d).groupBy(L.safe(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@staged
def located_benchmark_values(spark, d):
    """Every occurrence of the e-mail values of a document in its text, whatever the case."""
    values = R.gold(spark, d).filter("canon = 'EMAIL'").select("doc_id", "value").distinct()
    return S.locate_all(R.documents(spark, d), values)


# --- merging and redaction ------------------------------------------------------------------
@query
def mask_merge(spark, d):
    return I.masks(R.preds(spark, d), ["doc_id"])


@query
def mask_first_label(spark, d):
    return I.first_label(R.preds(spark, d), ["doc_id"])


@query
def mask_longest_label(spark, d):
    return I.longest_label(R.by_combo(spark, d), ["combo", "doc_id"]).withColumn("canons", F.array_join("canons", ","))


@query
def mask_confidence_label(spark, d):
    return I.confident_label(R.preds(spark, d), ["doc_id"])


@query
def redacted_text(spark, d):
    return I.redact(R.documents(spark, d), R.default_mask(spark, d), label="canon")


@query
def redaction_rate_by_lang(spark, d):
    """Masked share of the characters by language, with counts."""
    m = I.masks(R.preds(spark, d), ["doc_id"]).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("masked"), F.count(F.lit(1)).alias("n_masks"))
    x = R.documents(spark, d).select("doc_id", "lang", F.length("text").alias("chars")).join(m, "doc_id", "left")
    sums = [F.count(F.lit(1)).alias("n_docs"), F.sum("chars").alias("chars"), F.coalesce(F.sum("masked"), F.lit(0)).alias("masked"), F.coalesce(F.sum("n_masks"), F.lit(0)).alias("n_masks")]
    return x.groupBy("lang").agg(*sums).withColumn("rate", L.ratio(F.col("masked"), F.col("chars")))


@query
def counts_by_type_and_layer(spark, d):
    g = R.preds(spark, d).groupingSets([[F.col("canon")], [F.col("detector")], []], "canon", "detector")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("canon", F.lit("-")).alias("canon"), F.coalesce("detector", F.lit("-")).alias("detector"), "n")


@staged
def offset_validity(spark, d):
    """Spans that break 0 <= start < end <= length or whose value is not what the text holds there."""
    x = R.preds(spark, d).join(R.documents(spark, d).select("doc_id", "text"), "doc_id")
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")) & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("invalid"))


# --- scores ---------------------------------------------------------------------------------
def _coverage(spark: SparkSession, d: str, predicate: str = "overlap", typed: bool = False) -> DataFrame:
    return Q.coverage(R.gold(spark, d), I.longest_label(R.by_combo(spark, d), ["combo", "doc_id"]), list(R.COMBOS), predicate, typed)


@staged
def coverage_relaxed(spark, d):
    return Q.rates(Q.totals(_coverage(spark, d)))


@staged
def coverage_strict(spark, d):
    return Q.totals(_coverage(spark, d, "exact"))


@staged
def coverage_containment(spark, d):
    return Q.totals(_coverage(spark, d, "contain"))


@staged
def coverage_typed(spark, d):
    return Q.totals(_coverage(spark, d, "overlap", True))


@staged
def coverage_typed_strict(spark, d):
    return Q.totals(_coverage(spark, d, "exact", True))


@staged
def macro_metrics(spark, d):
    return Q.macro(_coverage(spark, d))


@staged
def leaked_spans_anti(spark, d):
    return I.semi(R.gold(spark, d), R.default_mask(spark, d), ["doc_id"], anti=True).select("doc_id", "detector", "seq", "start", "end", "canon")


@staged
def over_redaction_anti(spark, d):
    """Masks that touch no direct identifier."""
    direct = R.gold(spark, d).filter("identifier_class = 'direct'")
    bad = I.semi(R.default_mask(spark, d), direct, ["doc_id"], anti=True, swap=True)
    return bad.select("doc_id", "start", "end", "canon")


@staged
def unique_captures(spark, d):
    """Gold spans that the first layer misses and the last one catches."""
    p = R.preds(spark, d)
    missed = I.semi(R.gold(spark, d), p.filter("detector = 'mail'"), ["doc_id"], anti=True)
    return I.semi(missed, p.filter("detector = 'digits'"), ["doc_id"]).groupBy("canon").agg(F.count(F.lit(1)).alias("n"))


def _caught(spark: SparkSession, d: str, predicate: str = "overlap") -> DataFrame:
    return Q.caught(R.gold(spark, d), R.default_mask(spark, d), predicate)


@staged
def entity_recall(spark, d):
    """Protected and all entities by class, by type, and overall."""
    e = Q.entities(_caught(spark, d))
    g = e.groupingSets([[F.col("identifier_class")], [F.col("canon")], []], "identifier_class", "canon").agg(F.count_if("protected").alias("protected"), F.count(F.lit(1)).alias("total"))
    return g.select(F.coalesce("identifier_class", F.lit("-")).alias("identifier_class"), F.coalesce("canon", F.lit("-")).alias("canon"), "protected", "total", L.ratio(F.col("protected"), F.col("total")).alias("recall"))


@staged
def harm_weighted_recall(spark, d):
    e = Q.entities(_caught(spark, d)).withColumn("w", L.harm(F.col("canon")))
    x = e.agg(F.coalesce(F.sum(F.when(F.col("protected"), F.col("w"))), F.lit(0)).alias("got"), F.coalesce(F.sum("w"), F.lit(0)).alias("weight"))
    return x.withColumn("recall", L.ratio(F.col("got"), F.col("weight")))


@staged
def split_headline(spark, d):
    split = F.when(F.regexp_extract("client", "[0-9]+", 0).cast("int") % 2 == 0, "dev").otherwise("test")
    x = _caught(spark, d).groupBy(split.alias("split")).agg(F.count_if("covered").alias("c"), F.count(F.lit(1)).alias("n"))
    return x.withColumn("recall", L.ratio(F.col("c"), F.col("n")))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    x = _caught(spark, d, "contain").groupBy("doc_id").agg(F.count_if(~F.col("covered")).alias("leaked"), F.count(F.lit(1)).alias("gold"))
    x = R.documents(spark, d).select("doc_id", F.length("text").alias("chars")).join(x, "doc_id", "left").fillna(0, ["leaked", "gold"])
    return x.withColumn("recall", F.when(F.col("gold") == 0, F.lit(1.0)).otherwise((F.col("gold") - F.col("leaked")) / F.col("gold").cast("double")))


@staged
def leaks_per_document(spark, d):
    return _leaks(spark, d)


@staged
def worst_case_leak(spark, d):
    return _leaks(spark, d).agg(
        F.min("recall").alias("min_recall"), F.expr("percentile(recall, 0.1)").alias("p10_recall"), F.sum("leaked").alias("leaked"), F.sum("gold").alias("gold"), F.sum("chars").alias("chars"),
        (F.sum("leaked") * 10000.0 / F.sum("chars")).alias("leaks_per_10k"), F.min_by("doc_id", F.struct("recall", -F.col("leaked"), "doc_id")).alias("worst_doc"),
    )


@staged
def category_pass(spark, d):
    """By regulatory category: support, missed, and whether all was removed."""
    x = _caught(spark, d).groupBy(L.category(F.col("canon")).alias("category")).agg(F.count(F.lit(1)).alias("support"), F.count_if(~F.col("covered")).alias("fn"))
    return x.withColumn("passed", F.col("fn") == 0)


def _direct_residual(spark: SparkSession, d: str) -> DataFrame:
    """Leaked direct entities; out of scope where every leaked mention is a phone or id without a digit."""
    spelled = F.col("canon").isin("PHONE", "ID") & ~F.col("value").rlike(r"(?U)\d")
    return _caught(spark, d).filter("identifier_class = 'direct' AND NOT covered").groupBy("entity_id").agg(F.bool_and(spelled).alias("out_of_scope"))


@staged
def residual_tier(spark, d):
    a = _direct_residual(spark, d).agg(F.count_if(~F.col("out_of_scope")).alias("direct"), F.count_if("out_of_scope").alias("out_of_scope"))
    b = Q.entities(_caught(spark, d)).agg(F.count_if((F.col("canon") == "MEDICATION") & ~F.col("protected")).alias("special"))
    x = a.join(F.broadcast(b))  # one row each
    return x.withColumn("tier", L.tier(F.col("direct"), F.col("special"), F.lit(0.0), F.lit(0.5)))


@staged
def quasi_survivors(spark, d):
    q = _caught(spark, d).filter("identifier_class = 'quasi'").groupBy("client", "entity_id").agg(F.bool_or(~F.col("covered")).alias("survives"), F.min("canon").alias("canon"))
    x = q.groupBy("client").agg(F.count_if("survives").alias("survivors"), F.count(F.lit(1)).alias("total"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("survives"), F.col("canon")))), ",").alias("types"))
    return x.withColumn("rate", L.ratio(F.col("survivors"), F.col("total")))


POPULATION = L.POPULATION


def _priors(spark: SparkSession, d: str) -> DataFrame:
    """Survivor entities of each source with a population share by type (a power of two, so products are exact)."""
    g = R.gold(spark, d).select("client", "canon").distinct()
    share = F.when(F.col("canon") == "EMAIL", 1 / 1024).when(F.col("canon") == "PHONE", 1 / 4096).when(F.col("canon") == "ID", 1 / 65536).when(F.col("canon") == "IP", 1 / 256)
    return g.withColumn("prior", share).filter("prior IS NOT NULL")


def _product(x: str = "prior"):
    return F.aggregate(F.array_sort(F.collect_list(x)), F.lit(1.0), lambda a, v: a * v)


@query
def expected_matches(spark, d):
    x = _priors(spark, d).groupBy("client").agg(F.count(F.lit(1)).alias("dims"), (POPULATION * _product()).alias("expected"))
    return x.withColumn("singled_out", F.col("expected") < 1)


@staged
def sensitivity_sweep(spark, d):
    """Expected matches with each prior halved or doubled alone, then all; whether the verdict stays."""
    p = _priors(spark, d)
    scenario = p.select("client", F.col("canon").alias("which")).unionByName(p.select("client", F.lit("*").alias("which")).distinct())
    factor = spark.createDataFrame([(0.5,), (2.0,)], "factor double")
    s = scenario.join(F.broadcast(factor)).join(p, "client")
    s = s.withColumn("prior", F.when(F.col("which").isin("*") | (F.col("which") == F.col("canon")), F.least(F.lit(1.0), F.col("prior") * F.col("factor"))).otherwise(F.col("prior")))
    e = s.groupBy("client", "which", "factor").agg((POPULATION * _product()).alias("expected"))
    base = p.groupBy("client").agg((POPULATION * _product()).alias("base"))
    x = e.join(base, "client").withColumn("same", (F.col("expected") < 1) == (F.col("base") < 1))
    return x.groupBy("client").agg(F.min("expected").alias("low"), F.max("expected").alias("high"), F.bool_and("same").alias("robust"))


# --- linkability ----------------------------------------------------------------------------
def _units(spark: SparkSession, d: str) -> DataFrame:
    """All documents: the sessions of the sources under an attack."""
    return R.documents(spark, d).select("doc_id", "client", F.length("text").alias("chars"))


def _different(u: DataFrame) -> DataFrame:
    """The sampled pairs of different sources with the distance of their lengths; the score is its negative."""
    p = Q.different_pairs(u, "client", "doc_id", 5, 40)
    p = u.select(F.col("doc_id").alias("a"), F.col("chars").alias("ca")).join(F.broadcast(p), "a")
    return u.select(F.col("doc_id").alias("b"), F.col("chars").alias("cb")).join(F.broadcast(p), "b").select(F.abs(F.col("ca") - F.col("cb")).alias("distance"))


@query
def stride_sample(spark, d):
    """All pairs of one source, as many as there are, and the sampled pairs of different sources."""
    return Q.stride_pairs(_units(spark, d), "client", "doc_id", 5, 40)


@query
def confusion_metrics(spark, d):
    """Pairs of ``stride_sample`` called the same where lengths differ by less than 500; those of one source are counted, not made."""
    u = _units(spark, d)
    same = Q.farther(u, "client", "chars", [499]).select((F.col("every") - F.col("far_499")).alias("tp"), F.col("far_499").alias("fn"))
    other = _different(u).agg(F.count_if(F.col("distance") <= 499).alias("fp"), F.count_if(F.col("distance") > 499).alias("tn"))
    return Q.confusion(same.join(F.broadcast(other)))  # one row each


@query
def roc_auc(spark, d):
    """Area under the curve of the score over the pairs of ``stride_sample``, from counts of pairs beyond the few distances of different sources."""
    u = _units(spark, d)
    apart = [r.distance for r in _different(u).filter("distance IS NOT NULL").collect()]  # 40 at most
    limits = sorted({t for x in apart for t in (x - 1, x) if t >= 0})
    far = lambda t: F.col(f"far_{t}") if t >= 0 else F.col("every")
    # pairs of one source that are closer than x win twice a half, those at x once
    wins = sum((2 * F.col("every") - far(x - 1) - far(x) for x in apart), F.lit(0))
    return Q.area(Q.farther(u, "client", "chars", limits).select(F.col("every").alias("n_pos"), F.lit(len(apart)).cast("long").alias("n_neg"), wins.alias("w")))


@query
def label_auc(spark, d):
    x = R.table(spark, d, "labels").join(R.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return Q.auc(x.select((F.col("quality") == 1).alias("good"), "n_chars"), "good", "n_chars")


# --- agreement ------------------------------------------------------------------------------
@query
def cohen_kappa_labels(spark, d):
    x = R.table(spark, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"), F.lit(1).alias("n"))
    return Q.kappa(x, "a", "b", "n")


def _annotators(spark: SparkSession, d: str) -> DataFrame:
    """Gold and two detector layers as three annotators."""
    p = R.preds(spark, d)
    cols = ["doc_id", "start", "end", F.col("canon").alias("label"), "layer_rank", "seq"]
    parts = [R.gold(spark, d).select(*cols, F.lit("gold").alias("who")), p.filter("detector != 'digits'").select(*cols, F.lit("a1").alias("who")), p.filter("detector != 'phone'").select(*cols, F.lit("a2").alias("who"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _segments(spark: SparkSession, d: str) -> DataFrame:
    a = _annotators(spark, d)
    n = R.documents(spark, d).select("doc_id", F.length("text").alias("n")).join(a.select("doc_id").distinct(), "doc_id", "left_semi")
    s = I.segments(a, n, ["doc_id"], "who", ["gold", "a1", "a2"])
    return stage(s.groupBy("doc_id", "from", "to").pivot("who", ["gold", "a1", "a2"]).agg(F.first("label")).withColumn("len", F.col("to") - F.col("from")))


@staged
def cohen_kappa_segments(spark, d):
    """Character-level kappa of two annotators, from elementary segments weighted by length."""
    return Q.kappa(_segments(spark, d), "gold", "a2", "len")


@staged
def fleiss_kappa(spark, d):
    s = _segments(spark, d)
    agree = (F.col("gold") == F.col("a1")).cast("long") + (F.col("gold") == F.col("a2")).cast("long") + (F.col("a1") == F.col("a2")).cast("long")
    p = s.agg(F.sum("len").alias("n"), F.sum(F.col("len") * agree).alias("same"))
    share = s.select("len", F.explode(F.array("gold", "a1", "a2")).alias("k")).groupBy("k").agg(F.sum("len").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("xx"))
    x = p.join(F.broadcast(share))  # one row each
    pe = F.col("xx") / (9.0 * F.col("n") * F.col("n"))
    pa = F.col("same") / (3.0 * F.col("n"))
    return x.select("n", "same", "xx", F.when(pe == 1, 1.0).otherwise((pa - pe) / (1 - pe)).alias("kappa"))


@staged
def span_f1_pairwise(spark, d):
    """Typed overlap agreement of annotators i < j: hits and misses of either side."""
    a = _annotators(spark, d)
    pairs = spark.createDataFrame([("a1", "a2"), ("a1", "gold"), ("a2", "gold")], "i string, j string")
    left = a.join(F.broadcast(pairs), a.who == pairs.i).select("i", "j", *a.columns)
    right = a.join(F.broadcast(pairs), a.who == pairs.j).select("i", "j", *a.columns)
    same = F.col("l.label") == F.col("r.label")
    tp = I.semi(left, right, ["i", "j", "doc_id"], typed=same).groupBy("i", "j").agg(F.count(F.lit(1)).alias("tp"))
    fp = I.semi(left, right, ["i", "j", "doc_id"], typed=same, anti=True).groupBy("i", "j").agg(F.count(F.lit(1)).alias("fp"))
    fn = I.semi(right, left, ["i", "j", "doc_id"], typed=same, anti=True).groupBy("i", "j").agg(F.count(F.lit(1)).alias("fn"))
    x = pairs.join(tp, ["i", "j"], "left").join(fp, ["i", "j"], "left").join(fn, ["i", "j"], "left").fillna(0)
    return x.withColumn("f1", L.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


@staged
def cluster_majority(spark, d):
    """Clusters of overlapping spans of all annotators with the majority type and its extent."""
    a = _annotators(spark, d)
    c = I.merge(a, ["doc_id"], ["start", "end", "who", "layer_rank", "seq"]).select("doc_id", "island", "island_start", "ord", "label", "start", "end", "who")
    by = c.groupBy("doc_id", "island", "island_start", "label").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.min("start").alias("s"), F.max("end").alias("e"))
    win = F.struct("n", -F.col("first"))
    return by.groupBy("doc_id", F.col("island_start").alias("cluster_start")).agg(F.max_by("label", win).alias("label"), F.max_by("s", win).alias("start"), F.max_by("e", win).alias("end"), F.max("n").alias("votes"), (F.count(F.lit(1)) == 1).alias("unanimous"))


@staged
def nonpii_preservation(spark, d):
    """Share of characters outside gold that the mask leaves alone, from interval lengths."""
    m, g = I.masks(R.preds(spark, d), ["doc_id"]), I.masks(R.gold(spark, d), ["doc_id"])
    both = m.alias("m").join(g.alias("g"), I.on_keys("m", "g", ["doc_id"]) & I.overlaps("m", "g"))
    shared = both.agg(F.coalesce(F.sum(F.least("m.end", "g.end") - F.greatest("m.start", "g.start")), F.lit(0)).alias("shared"))
    x = m.agg(I.size(m, "masked")).join(F.broadcast(g.agg(I.size(g, "pii")))).join(F.broadcast(shared)).join(F.broadcast(R.documents(spark, d).agg(F.sum(F.length("text")).alias("chars"))))
    return x.withColumn("kept", 1 - (F.col("masked") - F.col("shared")) / (F.col("chars") - F.col("pii")).cast("double"))


# --- turns, runs, windows, hashes -----------------------------------------------------------
@query
def turn_asof(spark, d):
    """Each assistant turn with the latest user turn at or before it."""
    c = R.table(spark, d, "conversations")
    users = c.filter("role = 'user'").select("conv_id", "turn", F.col("turn").alias("user_turn"))
    points = c.filter("role = 'assistant'").select("conv_id", "turn")
    return I.last_at_or_before(users, points, ["conv_id"], "turn", "user_turn").withColumn("user_turn", F.coalesce("user_turn", F.lit(-1)))


@query
def role_turn_counts(spark, d):
    return R.table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query
def run_islands(spark, d):
    """Runs of consecutive events of one type of a user: gaps and islands, as for runs of equal tags."""
    e = R.table(spark, d, "events").select("user_id", "event_id", "event_type")
    w = W.partitionBy("user_id").orderBy("event_id")
    new = F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1)
    x = e.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"), F.sum("n").alias("events"))


@query
def fixed_windows(spark, d):
    return S.windows(R.documents(spark, d))


@query
def pseudonym_rank(spark, d):
    """Pseudonym number of each distinct e-mail value of a document, in order of first appearance."""
    g = R.gold(spark, d).filter("canon = 'EMAIL'").groupBy("doc_id", F.trim("value").alias("value")).agg(F.min("start").alias("first"))
    return g.select("doc_id", "value", F.dense_rank().over(W.partitionBy("doc_id").orderBy("first")).alias("number"))


@query
def duplicate_text_hash(spark, d):
    h = R.documents(spark, d).groupBy(F.substring(F.sha2("text", 256), 1, 12).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return h.filter("n > 1")


@query
def corpus_fingerprint(spark, d):
    """Fingerprint by language: documents are hashed by bucket of their id, then the buckets' hashes, so no row holds them all."""
    x = R.documents(spark, d).select("lang", "doc_id", F.expr("doc_id div 1024").alias("bucket"), F.sha2("text", 256).alias("h"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda s: s["h"]), ""), 256)
    b = x.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"), joined("doc_id").alias("h"))
    top = b.groupBy("lang", F.expr("bucket div 1024").alias("bucket")).agg(F.sum("n").alias("n"), joined("bucket").alias("h"))
    return top.groupBy("lang").agg(F.sum("n").alias("n_docs"), F.substring(joined("bucket"), 1, 12).alias("sha"))


@query
def manifest_validation(spark, d):
    """Ids that only one side has, between the documents and the cache of ``labels``: set equality by two anti-joins."""
    a, b = R.documents(spark, d).select("doc_id"), R.table(spark, d, "labels").select("doc_id")
    return a.subtract(b).agg(F.count(F.lit(1)).alias("missing")).join(F.broadcast(b.subtract(a).agg(F.count(F.lit(1)).alias("extra"))))  # one row each


@query
def resume_anti_join(spark, d):
    done = R.table(spark, d, "labels").select("doc_id").distinct()
    return R.documents(spark, d).join(done, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("todo"))


@staged
def metric_drift_full_outer(spark, d):
    """Counts by type of two layers side by side, with the difference."""
    p = R.preds(spark, d).groupBy("canon").agg(F.count(F.lit(1)).alias("fresh"))
    g = R.gold(spark, d).groupBy("canon").agg(F.count(F.lit(1)).alias("committed"))
    x = g.join(p, "canon", "full_outer").fillna(0, ["committed", "fresh"])
    return x.withColumn("drift", F.col("fresh") - F.col("committed"))


@query
def run_variance(spark, d):
    e = R.table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.expr("percentile(v, 0.5)").alias("median"), F.max("v").alias("high"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))


@query
def registry_latest(spark, d):
    """The latest record of each kind in the append-only log."""
    e = R.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("records"))


@staged
def bootstrap_recall(spark, d):
    """95 % interval of recall over resampled documents."""
    x = _caught(spark, d).groupBy("doc_id").agg(F.count_if("covered").alias("c"), F.count(F.lit(1)).alias("n"))
    return Q.bootstrap(stage(Q.numbered(stage(x), "doc_id").select("ord", "c", "n")), 2000, 20260601)


# --- sequential steps -----------------------------------------------------------------------
@query
def chunk_boundaries(spark, d):
    return E.chunk_spans(R.documents(spark, d))


@staged
def greedy_matching(spark, d):
    x = E.greedy_counts(R.gold(spark, d), R.preds(spark, d))
    return x.agg(*[F.sum(c).alias(c) for c in ("correct", "partial", "wrong_type", "fp", "fn")])
