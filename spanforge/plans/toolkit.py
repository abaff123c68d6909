"""Registered queries of gold builders, attacks, agreement, model post-processing and driver-side relations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import spans as S
from ..operators import attacks as A
from ..operators import builders as B
from ..operators import intervals as I
from ..operators import scoring as Q
from ..operators import sequential as E
from ..sources.stage import stage
from . import catalog as C
from . import relations as R
from .catalog import query, staged
from .fixtures import frame

DISTORTIONS = ["катастрофизация", "обобщение", "чтение мыслей"]


# --- detectors over samples -----------------------------------------------------------------
@query
def spans_frontmatter(spark, d):
    return E.frontmatter(R.with_samples(spark, d)).select("doc_id", "start", "end", "label", "value")


@query
def spans_age(spark, d):
    """Ages by any of three rules, each number once."""
    return S.first_of_each(S.spans(R.with_samples(spark, d), S.AGES)).select("doc_id", "start", "end", "value")


@query
def turn_markers(spark, d):
    return S.turns(R.with_samples(spark, d))


@query
def turn_of_span(spark, d):
    """Each detected date with the turn at or before its start; -1 and no speaker where there is none."""
    docs = R.with_samples(spark, d)
    dates = S.spans(docs, [S.NUMERIC_DATE, S.URL]).select("doc_id", "start", "value")
    t = S.turns(docs).withColumn("t", F.struct("turn", "speaker"))
    x = I.last_at_or_before(t, dates, ["doc_id"], "start", "t")
    return x.select("doc_id", "start", "value", F.coalesce("t.turn", F.lit(-1)).cast("long").alias("turn"), F.col("t.speaker").alias("speaker"))


@query
def propagated_names(spark, d):
    return E.propagate(R.with_samples(spark, d), frame(spark, "values"))


@query
def gazetteer_names(spark, d):
    """The offline stand-in for a name model: a list of names, looked up in every text by an equi join of words."""
    names = F.broadcast(spark.createDataFrame([(n.lower(), t) for n, t in (("Анна", "PER"), ("Тимур", "PER"), ("London", "LOC"), ("December", "ORG"))], "w string, label string"))  # fixed list
    words = S.spans(R.samples(spark), [S.WORD]).withColumn("w", F.lower("value"))
    return words.join(names, "w").select("doc_id", "start", "end", "value", words["w"].alias("word"), names["label"].alias("kind"))


@query
def located_or_stem(spark, d):
    """Values named by a model, found in the texts, by their stem where they do not occur as they are."""
    return B.locate_or_stem(R.with_samples(spark, d), frame(spark, "named"))


@query
def gold_patterns(spark, d):
    return B.match_patterns(frame(spark, "client_texts"), frame(spark, "patterns"))


@query
def metadata_leaks(spark, d):
    """Redacted texts that still show a client id."""
    docs = R.with_samples(spark, d)
    spans = S.spans(docs, [S.EMAIL, S.NUMERIC_DATE]).select("doc_id", "start", "end", "label")
    red = I.redact(docs, I.first_label(spans.withColumns({"layer_rank": F.lit(0), "seq": F.lit(0)}), ["doc_id"]))
    return red.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("redacted").rlike(r"client_id:\s*\w")).alias("leaks"))


# --- model output ---------------------------------------------------------------------------
@query
def score_threshold(spark, d):
    return frame(spark, "hits").filter("score >= 0.45").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def adjacent_merge(spark, d):
    return B.join_adjacent(frame(spark, "hits"), frame(spark, "hit_texts"))


@query
def chunk_rebase(spark, d):
    n = spark.createDataFrame([(1, 60), (2, 8)], "doc_id long, n long")
    return E.rebase(frame(spark, "chunk_places"), frame(spark, "chunk_hits"), n)


@query
def first_json_array(spark, d):
    """The first JSON array of each answer, thoughts stripped."""
    raw = F.regexp_replace("raw", r"(?s)<think>.*?</think>", "")
    return frame(spark, "answers").select("id", E.first_array(raw).alias("found"))


@query
def repaired_verdicts(spark, d):
    return frame(spark, "verdicts").select("ord", F.coalesce(F.col("said"), F.lit(False)).alias("called"), A.repair_verdict(F.col("said"), F.col("confidence")).alias("confidence"))


@query
def layer_names(spark, d):
    """Layers of a run, each once; ``opf`` is another name of ``regex``."""
    x = F.array_distinct(F.transform("names", lambda n: F.when(F.lower(n) == "opf", "regex").otherwise(F.lower(n))))
    return frame(spark, "layers").select("run", F.array_join(F.array_sort(x), ",").alias("layers"), F.array_contains(x, "regex").alias("has_regex"))


# --- gold builders --------------------------------------------------------------------------
@query
def placed_values(spark, d):
    return B.place_values(frame(spark, "fact_texts"), frame(spark, "facts"))


@query
def nested_dropped(spark, d):
    return E.drop_nested(frame(spark, "golds")).select("doc_id", "start", "end", "entity_id")


@query
def structured_containment(spark, d):
    return E.drop_inside(E.drop_nested(frame(spark, "golds"))).select("doc_id", "start", "end", "entity_id")


@query
def enriched_spans(spark, d):
    return B.enrich(frame(spark, "golds"), ("b-age",)).select("doc_id", "start", "entity_id", "person_role", "confidential_status", "mask_decision", "utility_tag", "harm")


@query
def tag_spans(spark, d):
    return B.tag_spans(frame(spark, "tokens"))


@query
def documents_in_scope(spark, d):
    """The first two token documents that have a known tag, in order of id."""
    x = frame(spark, "tokens").groupBy("doc_id").agg(F.bool_or(F.substring("tag", 3, 100).isin(*B.TAGS)).alias("ok"), F.count(F.lit(1)).alias("n_tokens"))
    return x.filter("ok").orderBy("doc_id").limit(2).select("doc_id", "n_tokens")


@query
def pronoun_filter(spark, d):
    return frame(spark, "facts").filter(~F.lower("value").isin(*B.PRONOUNS)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def short_english(spark, d):
    """Documents whose text has 40 to 320 characters, by language, English apart."""
    x = R.documents(spark, d).select("lang", F.length("text").between(40, 320).alias("short"))
    return x.groupBy("lang").agg(F.count_if("short").alias("short"), F.count_if(F.col("short") & (F.col("lang") == "en")).alias("short_english"))


@query
def gold_distribution(spark, d):
    g = frame(spark, "golds").groupingSets([[F.col("type")], [F.col("identifier_class")], []], "type", "identifier_class")
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("type", F.lit("-")).alias("type"), F.coalesce("identifier_class", F.lit("-")).alias("identifier_class"), "n")


@query
def pseudonym_map(spark, d):
    spans = S.spans(R.with_samples(spark, d), [S.EMAIL, S.NUMERIC_DATE, S.PHONE_RU, S.PATRONYMIC]).filter("doc_id < 0")
    org = S.spans(R.samples(spark), [S.WORD]).filter(F.lower("value").isin("карта", "снилс", "london", "timur", "анна")).withColumn("label", F.when(F.lower("value") == "анна", "PERSON").when(F.lower("value") == "timur", "LOCATION").otherwise("ORG"))
    cols = ["start", "label", "value"]
    return B.pseudonyms(spans.select(*cols).unionByName(org.select(*cols)).withColumn("all", F.lit(1)).withColumn("start", F.col("start")), ["all"]).drop("all")


@query
def redaction_unmerged(spark, d):
    """Redaction straight from overlapping spans: by start, the first span of an island names it."""
    spans = frame(spark, "overlapping").withColumn("layer_rank", F.lit(0))
    m = I.merge(spans, ["doc_id"], ["start", "layer_rank", "seq"])
    one = m.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.upper(F.min_by("type", "ord")).alias("label")).drop("island")
    return I.redact(frame(spark, "over_texts"), one)


# --- selection, unions, prefixes ------------------------------------------------------------
_WANTED = [(2, 0), (0, 1), (5, 2), (1, 3)]


@query
def selected_documents(spark, d):
    """The first three documents of a list of ids, in its order."""
    wanted = spark.createDataFrame(_WANTED, "doc_id long, ord long")
    return B.select_in_order(R.documents(spark, d), wanted, 3).select("ord", "doc_id", F.length("text").alias("chars"))


@query
def cached_ids_union(spark, d):
    """Ids of any cache, with how many hold them, and how many caches hold all."""
    c = frame(spark, "caches")
    n = c.agg(F.count_distinct("dataset").alias("n"))
    by = c.groupBy("doc_id").agg(F.count_distinct("dataset").alias("held"))
    return by.join(F.broadcast(n)).select("doc_id", "held", (F.col("held") == F.col("n")).alias("in_all"))  # one row


@query
def prompt_heads(spark, d):
    """How many texts each prompt would cut, and the characters it would send."""
    sizes = F.explode(F.array(*[F.lit(n) for n in (7000, 9000, 12000, 14000, 16000)]))
    x = R.documents(spark, d).select(F.length("text").alias("n"), sizes.alias("size"))
    return x.groupBy("size").agg(F.count_if(F.col("n") > F.col("size")).alias("cut"), F.sum(F.least("n", "size")).alias("sent"))


@query
def splits_in_order(spark, d):
    """Splits in their fixed order, by the client's letter or number."""
    split = F.when(F.col("client").isin("a", "c", "e"), "dev").when(F.regexp_extract("client", "[0-9]+", 0).cast("int") % 2 == 0, "dev").otherwise("test")
    return R.documents(spark, d).groupBy(split.alias("split")).agg(F.count_distinct("client").alias("clients"), F.count(F.lit(1)).alias("docs")).orderBy("split")


@query
def small_corpus_hash(spark, d):
    """The first twelve digits of the hash of a small set's texts one after another, in order of id: benchmark items."""
    b = R.table(spark, d, "benchmark").select("item_id", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return b.agg(F.count(F.lit(1)).alias("n"), F.substring(F.sha2(joined, 256), 1, 12).alias("sha"))


# --- scores ---------------------------------------------------------------------------------
@query
def positional_zip(spark, d):
    """Gold and output documents joined by their rank; every rank must be on both sides or is reported."""
    rank = lambda df, n: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n)).withColumn("ord", F.row_number().over(W.orderBy("doc_id")) - 1).drop("doc_id")  # noqa: E731  (small sets)
    x = rank(frame(spark, "golds"), "gold").join(rank(frame(spark, "outputs"), "pred"), "ord", "full_outer")
    return x.select("ord", F.coalesce("gold", F.lit(0)).alias("gold"), F.coalesce("pred", F.lit(0)).alias("pred"))


def _pairs(spark):
    return frame(spark, "golds").withColumn("canon", F.col("type")), frame(spark, "outputs").withColumn("canon", F.col("type"))


def _coupled(x):
    """Precision against the matched predictions themselves."""
    p, r = L.ratio(F.col("correct"), F.col("correct") + F.col("fp")), L.ratio(F.col("correct"), F.col("correct") + F.col("fn"))
    return x.withColumns({"p": p, "r": r}).withColumns({"f1": L.f_beta(F.col("p"), F.col("r"), 1), "f2": L.f_beta(F.col("p"), F.col("r"), 4)})


@query
def legacy_scores(spark, d):
    """Strict and relaxed one-to-one counts with precision, recall, F1 and F2."""
    g, p = _pairs(spark)
    types = {r.type for r in g.select("type").distinct().collect()} | {"DATE"}  # the closed list of labels
    sums = [F.sum(k).alias(k) for k in ("correct", "partial", "wrong_type", "fp", "fn")]
    parts = [E.greedy_counts(g, p, relaxed, types).agg(*sums).withColumn("mode", F.lit("relaxed" if relaxed else "strict")) for relaxed in (True, False)]
    return _coupled(parts[0].unionByName(parts[1]))


@staged
def cli_labels(spark, d):
    """Merged intervals with the label of their longest raw span, the first in layer order of equal ones."""
    p = R.preds(spark, d)
    m = I.masks(p, ["doc_id"]).alias("m")
    x = m.join(p.alias("s"), I.on_keys("m", "s", ["doc_id"]) & I.overlaps("m", "s"))
    best = F.max_by(L.safe(F.col("s.label")), F.struct(F.col("s.end") - F.col("s.start"), -F.col("s.layer_rank"), -F.col("s.seq")))
    return x.groupBy("m.doc_id", "m.start", "m.end").agg(best.alias("label"))


@staged
def entity_agreement(spark, d):
    """By language: entities of gold that the other side touches, and the other side's values that touch gold."""
    g, p = R.gold(spark, d), R.preds(spark, d)
    hit = lambda a, b: I.semi(a, b, ["doc_id"]).select("doc_id", "detector", "seq").withColumn("hit", F.lit(True))
    side = lambda a, b, v: a.join(hit(a, b), ["doc_id", "detector", "seq"], "left").groupBy("lang", "doc_id", v).agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    a1 = side(g, p, F.lower("value").alias("v")).groupBy("lang").agg(F.count(F.lit(1)).alias("a1"), F.count_if("hit").alias("a1_hit"))
    a2 = side(p, g, F.lower("value").alias("v")).groupBy("lang").agg(F.count(F.lit(1)).alias("a2"), F.count_if("hit").alias("a2_hit"))
    return a1.join(a2, "lang", "full_outer").fillna(0)


@staged
def blind_spots(spark, d):
    """The first 40 values that only one side has, in order: lists for adjudication."""
    g, p = R.gold(spark, d), R.preds(spark, d)
    only = I.semi(p, g, ["doc_id"], anti=True).select("doc_id", "start", "value", F.lit("a2 only").alias("side")).unionByName(I.semi(g, p, ["doc_id"], anti=True).select("doc_id", "start", "value", F.lit("a1 only").alias("side")))
    return only.orderBy("side", "doc_id", "start", "value").limit(40)


@staged
def binary_kappa(spark, d):
    """Kappa of masked or not, by character, of gold and the default mask, from interval lengths."""
    m, g = stage(I.masks(R.preds(spark, d), ["doc_id"])), stage(I.masks(R.gold(spark, d), ["doc_id"]))
    both = m.alias("m").join(g.alias("g"), I.on_keys("m", "g", ["doc_id"]) & I.overlaps("m", "g")).select("m.doc_id", (F.least("m.end", "g.end") - F.greatest("m.start", "g.start")).alias("x"))
    size = lambda df, name, x: df.groupBy("doc_id").agg(F.sum(x).alias(name))
    docs = R.documents(spark, d).select("doc_id", "lang", F.length("text").alias("n"))
    x = docs.join(size(m, "m", F.col("end") - F.col("start")), "doc_id", "left").join(size(g, "g", F.col("end") - F.col("start")), "doc_id", "left").join(size(both, "b", F.col("x")), "doc_id", "left").fillna(0)
    s = x.groupBy("lang").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "m", "g", "b")])
    n, m1, g1, b1 = (F.col(c).cast("double") for c in ("n", "m", "g", "b"))
    po, pe = (b1 + (n - m1 - g1 + b1)) / n, (m1 / n) * (g1 / n) + (1 - m1 / n) * (1 - g1 / n)
    return s.select("lang", "n", "m", "g", "b", F.when(n == 0, 0.0).when(1 - pe == 0, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


@staged
def over_redaction_rate(spark, d):
    """By type: masks that touch gold, those that do not, and the share of these."""
    m = R.default_mask(spark, d)
    hit = I.semi(m, R.gold(spark, d), ["doc_id"], swap=True).select("doc_id", "start").withColumn("hit", F.lit(True))
    x = m.join(hit, ["doc_id", "start"], "left").groupBy("canon").agg(F.count_if("hit").alias("tp"), F.count_if(F.col("hit").isNull()).alias("fp"))
    return x.withColumn("rate", L.ratio(F.col("fp"), F.col("tp") + F.col("fp")))


@staged
def category_summary(spark, d):
    """Regulatory categories over all types: how many apply, how many pass, and which types are special, not applicable or unmapped."""
    x = C._caught(spark, d).groupBy("canon").agg(F.count_if(~F.col("covered")).alias("fn")).withColumn("category", L.category(F.col("canon")))
    kind = F.when(F.col("category").isin("n/a", "special", "unmapped"), F.col("category")).otherwise("applicable")
    y = x.withColumn("kind", kind)
    applicable, passed = F.count_if(F.col("kind") == "applicable"), F.count_if((F.col("kind") == "applicable") & (F.col("fn") == 0))
    types = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("canon")))), ",").alias(k.replace("/", ""))
    return y.agg(applicable.alias("applicable"), passed.alias("passed"), types("n/a"), types("special"), types("unmapped")).withColumn("removed_frac", L.ratio(F.col("passed"), F.col("applicable")))


@staged
def mean_leak(spark, d):
    return C._leaks(spark, d).agg(F.avg("recall").alias("mean_recall"), F.count_if(F.col("leaked") > 0).alias("docs_with_leaks"))


@staged
def transfer_gap(spark, d):
    """Recall by type in each language, with the difference to English."""
    x = C._caught(spark, d).groupBy("lang", "canon").agg(F.count_if("covered").alias("c"), F.count(F.lit(1)).alias("n")).withColumn("recall", L.ratio(F.col("c"), F.col("n")))
    en = x.filter("lang = 'en'").select("canon", F.col("recall").alias("base"))
    return x.join(en, "canon").select("lang", "canon", "recall", (F.col("recall") - F.col("base")).alias("gap"))


@staged
def combo_comparison(spark, d):
    """Recall by type of the default combination beside that of its first layer alone."""
    r = Q.rates(C._coverage(spark, d)).filter(F.col("combo").isin("mail", R.DEFAULT))
    one = lambda c: F.max(F.when(F.col("combo") == c, F.col("r")))
    x = r.groupBy("canon").agg(one("mail").alias("mail"), one(R.DEFAULT).alias("every"))
    return x.withColumn("gain", F.coalesce("every", F.lit(0.0)) - F.coalesce("mail", F.lit(0.0)))


@query
def run_spread(spark, d):
    """Mean, both standard deviations, least and greatest value of repeated runs."""
    e = R.table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    s = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.min("v").alias("low"), F.max("v").alias("high"))
    n, m = F.col("n").cast("double"), F.col("s") / F.col("n").cast("double")
    spread = F.greatest(F.lit(0.0), F.col("q") / n - m * m)
    return s.select("event_type", m.alias("mean"), F.round(F.sqrt(spread), 6).alias("sd_pop"), F.round(F.sqrt(spread * n / (n - 1)), 6).alias("sd_sample"), "low", "high")


@query
def latency(spark, d):
    """Least, median and greatest time of a call, and the time of a document, by kind."""
    e = R.table(spark, d, "events").select("event_type", F.round(F.col("value") * 1000).cast("long").alias("ms"))
    return e.groupBy("event_type").agg(F.min("ms").alias("least"), F.expr("percentile(ms, 0.5)").alias("median"), F.max("ms").alias("most"), (F.sum("ms") / F.count(F.lit(1)).cast("double")).alias("ms_per_doc"))


@staged
def bootstrap_entities(spark, d):
    """95 % interval of entity recall over resampled documents; a document drawn k times counts its entities k times."""
    e = C._caught(spark, d).groupBy("doc_id", "entity_id").agg(F.bool_and("covered").alias("ok"))
    x = e.groupBy("doc_id").agg(F.count_if("ok").alias("c"), F.count(F.lit(1)).alias("n"))
    return Q.bootstrap(stage(Q.numbered(stage(x), "doc_id").select("ord", "c", "n")), 2000, 20260601)


@query
def mapped_labels(spark, d):
    """Labels of models as canonical types; null where a label is dropped."""
    return frame(spark, "raw_labels").select("model", "label", L.of_model(F.col("model"), F.col("label")).alias("canon"))


@query
def singling_out(spark, d):
    """Expected people that share what survives of each client, by a lookup of population shares; parts of another attribute count once."""
    shares = F.broadcast(spark.createDataFrame(list(L.PRIORS.items()), "entity_id string, prior double"))  # a fixed list
    x = frame(spark, "survivors").withColumn("folded", F.col("entity_id").isin(*L.FOLDED)).join(shares, "entity_id", "left")
    used = F.when(~F.col("folded"), F.col("prior"))
    product = F.aggregate(F.transform(F.array_sort(F.collect_list(F.when(used.isNotNull(), F.struct("entity_id", "prior")))), lambda s: s["prior"]), F.lit(1.0), lambda a, v: a * v)
    g = x.groupBy("client").agg(F.count(used).alias("dims"), product.alias("share"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    expected = F.when(F.col("dims") > 0, F.round(L.POPULATION * F.col("share"), 1))
    return g.select("client", "dims", "types", expected.alias("expected"), F.coalesce(expected < 1.0, F.lit(False)).alias("singled_out"))


# --- attacks --------------------------------------------------------------------------------
def _hits(spark):
    return A.top_hits(frame(spark, "guesses"), frame(spark, "truth"), ["client", "session"])


@query
def top_hits(spark, d):
    return _hits(spark)


@query
def attack_scorecard(spark, d):
    return A.scorecard(_hits(spark))


@query
def risk_classes(spark, d):
    return A.risk(_hits(spark).filter("session = 0"), frame(spark, "survival"))


@query
def inference_rates(spark, d):
    return A.inference_summary(frame(spark, "tests")).withColumn("client", F.coalesce("client", F.lit("ALL")))


@query
def signal_kept(spark, d):
    x = frame(spark, "sessions").withColumns({c: A.named_in(F.col(c), DISTORTIONS) for c in ("before", "after")})
    return A.signal_kept(x, "before", "after")


@query
def pair_bootstrap(spark, d):
    v = frame(spark, "verdicts").select("ord", "same", F.coalesce(F.col("said"), F.lit(False)).alias("called"), A.repair_verdict(F.col("said"), F.col("confidence")).alias("confidence"))
    return A.pair_bootstrap(v, 2000, 20260601)
