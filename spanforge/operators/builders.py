"""Building gold spans: values found in texts, patterns by client, token tags, enrichment, model output cleaned up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.spans import edge_trim
from . import sequential as E

# Bare pronouns are no identifiers; token tags with their type, class and harm; roles of entities;
# pseudonyms and placeholders; labels of the models, null where a label is dropped.
PRONOUNS = ("him", "her", "them", "he", "she", "they")
TAGS = {"PERSON": ("PERSON", "direct", "high"), "PER": ("PERSON", "direct", "high"), "GPE": ("LOCATION", "quasi", "medium"), "STREET_ADDRESS": ("LOCATION", "direct", "medium"), "PUBLIC_PLACES": ("LOCATION", "quasi", "low")}
ROLES = {
    "a-marina": "client", "a-andrey": "partner", "a-petrova": "clinician", "a-boss": "third_party", "a-neuromed": "institution", "a-yandex": "institution",
    "b-igor": "client", "b-svetlana": "partner", "b-alexey": "relative", "b-pavel": "third_party", "b-kontur": "institution", "b-sber": "institution", "b-ekaterinburg": "institution",
    "c-alina": "client", "c-maksim": "partner", "c-zaytseva": "clinician", "c-boss": "third_party", "c-alliance": "institution", "c-avito": "institution",
    "d-roman": "client", "d-natalya": "partner", "d-morozov": "clinician", "d-artem": "third_party", "d-insight": "institution", "d-sibtrans": "institution",
    "e-vera": "client", "e-dmitry": "partner", "e-sonya": "relative", "e-sokolova": "clinician", "e-larisa": "third_party", "e-school": "institution",
    "f-timur": "client", "f-timur-latin": "client", "f-gulnara": "relative", "f-vasilyev": "clinician", "f-denis": "third_party", "f-kfu": "institution",
}
NAMES = ("Алексей", "Мария", "Дмитрий", "Елена", "Сергей", "Анна", "Павел", "Ольга")
CITIES = ("Город-А", "Город-Б", "Город-В", "Город-Г")
PLACEHOLDERS = {"PHONE": "[ТЕЛЕФОН]", "PRIVATE_PHONE": "[ТЕЛЕФОН]", "DATE": "[ДАТА]", "PRIVATE_DATE": "[ДАТА]", "MEDICATION": "[ПРЕПАРАТ]", "ACCOUNT_NUMBER": "[ID-НОМЕР]", "ID": "[ID-НОМЕР]"}


def place_values(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, type, value) of (id, ord, value, type), each found behind the one before, else anywhere.

    Values that are bare pronouns are left out; a value that the text lacks raises an error.
    """
    real = values.filter(~F.lower("value").isin(*PRONOUNS))
    listed = real.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", "value", "type"))).alias("v"))
    x = docs.select(id_col, text_col).join(listed, id_col)
    out = "array<struct<start:int,end:int,type:string,value:string>>"

    def step(acc: Column, v: Column) -> Column:
        behind = F.call_function("locate", v["value"], F.col(text_col), acc["cursor"] + 1)
        at = F.when(behind > 0, behind).otherwise(F.call_function("locate", v["value"], F.col(text_col), F.lit(1))) - 1
        at = F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("not in the text: "), v["value"])).cast("int"))
        end = at + F.length(v["value"])
        return F.struct(end.alias("cursor"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), v["type"].alias("type"), v["value"].alias("value")))).alias("out"))

    zero = F.struct(F.lit(0).alias("cursor"), F.array().cast(out).alias("out"))
    return x.select(id_col, F.inline(F.aggregate("v", zero, step, lambda a: a["out"])))


def match_patterns(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Gold spans from entity patterns of the document's client: (client, entity_id, type, identifier_class, pattern).

    Matches ignore case; ``%V`` in an entity id stands for the letters and digits of the match.  Nested
    matches of one entity and what lies in a structured span of another entity are dropped.
    """
    p = F.concat(F.lit("(?iuU)"), F.col("pattern"))
    found = F.arrays_zip(F.regexp_extract_all(F.col(text_col), p, F.lit(0)).alias("m"), F.split(F.col(text_col), p, -1).alias("g"))
    x = docs.join(patterns, "client").select(id_col, "entity_id", "type", "identifier_class", "pattern", F.posexplode(F.filter(found, lambda y: y["m"].isNotNull())).alias("seq", "y"))
    end = F.sum(F.length("y.g") + F.length("y.m")).over(W.partitionBy(id_col, "entity_id", "pattern").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    own = F.expr(r"replace(entity_id, '%V', regexp_replace(lower(y.m), '(?U)\\W+', ''))")
    spans = x.withColumn("end", end).select(id_col, (F.col("end") - F.length("y.m")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", F.col("y.m").alias("value"), "identifier_class", own.alias("entity_id"))
    return E.drop_inside(E.drop_nested(spans, id_col=id_col), id_col=id_col)


def enrich(spans: DataFrame, critical: tuple[str, ...] = ()) -> DataFrame:
    """Spans with person_role, confidential_status, mask_decision, utility_tag and harm; ``critical`` entity ids escalate."""
    level = F.when(L.harm(F.col("type")) == 3, "high").when(L.harm(F.col("type")) == 1, "low").otherwise("medium")
    role = F.create_map(*[F.lit(v) for kv in ROLES.items() for v in kv])
    clinical = F.when(F.col("type") == "MEDICATION", "clinically_important").when(F.col("type").isin("AGE", "PROFESSION", "DATE", "LOCATION"), "narrative_context").otherwise("low_utility")
    return spans.withColumns({
        "person_role": F.element_at(role, F.substring_index("entity_id", "-", 2)), "confidential_status": F.col("type") == "MEDICATION",
        "mask_decision": F.when(F.col("identifier_class") == "direct", "MASK").otherwise("GENERALIZE"), "utility_tag": clinical,
        "harm": F.when(F.col("entity_id").isin(*critical), "critical").otherwise(level),
    })


def tag_spans(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans of the known tags of (id, pos, token, tag), with entity ids by surface form in order of appearance."""
    table = F.create_map(*[x for k, (t, c, h) in TAGS.items() for x in (F.lit(k), F.struct(F.lit(t).alias("type"), F.lit(c).alias("identifier_class"), F.lit(h).alias("harm")))])
    runs = E.word_runs(tokens, [id_col]).withColumn("t", F.element_at(table, F.col("source_tag"))).filter("t IS NOT NULL").select(id_col, "start", "end", "value", "source_tag", "t.*")
    first = F.min("start").over(W.partitionBy(id_col, "type", F.lower("value")))
    return runs.withColumn("_first", first).withColumn("_n", F.dense_rank().over(W.partitionBy(id_col).orderBy("_first")) - 1).select(
        id_col, "start", "end", "type", "value", "identifier_class", "harm", "source_tag", F.concat_ws("-", F.col(id_col).cast("string"), F.lower("type"), F.col("_n").cast("string")).alias("entity_id")
    )


def join_adjacent(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans (id, start, end, type, score) of a model, edges trimmed, neighbours of one type joined over blank gaps.

    A gap is the text between the end of the span before and the start of this one; it is empty where
    they overlap, so such spans join too.  The end of a joined span is that of its last part, the score
    the lowest.  A span of which nothing is left is dropped.
    """
    x = spans.join(docs.select(id_col, text_col), id_col)
    body, left, right = edge_trim(F.substring(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start")))
    x = x.withColumn("_b", body).withColumn("start", F.col("start") + left).withColumn("end", F.col("end") - right).filter("_b != ''")
    w = W.partitionBy(id_col).orderBy("start", "end", "type")
    before = F.lag("end").over(w)
    blank = F.substring(F.col(text_col), before + 1, F.greatest(F.lit(0), F.col("start") - before)).rlike(r"(?U)\A\s*\z")
    x = x.withColumn("_new", F.when((F.lag("type").over(w) == F.col("type")) & blank, 0).otherwise(1)).withColumn("_at", F.row_number().over(w))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(id_col, "_island", "type").agg(F.min("start").alias("start"), F.max_by("end", "_at").alias("end"), F.min("score").alias("score")).drop("_island")


def pseudonyms(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, pseudonym) of each different value, in order of first appearance in (keys, start, label, value).

    Persons and places take names from cycles, organisations a number, others the placeholder of their label.
    """
    value = F.trim("value")
    one = spans.groupBy(*keys, value.alias("value")).agg(F.min("start").alias("first"), F.min_by("label", "start").alias("label"))
    kind = F.when(F.col("label").isin("PERSON", "PRIVATE_PERSON"), "person").when(F.col("label").isin("LOCATION", "ADDRESS", "PRIVATE_ADDRESS"), "place").when(F.col("label") == "ORG", "org").otherwise("other")
    x = one.withColumn("kind", kind).withColumn("n", F.row_number().over(W.partitionBy(*keys, "kind").orderBy("first", "value")) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("n", F.lit(len(values))) + 1).cast("int"))
    wrap = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    fixed = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in PLACEHOLDERS.items()], wrap(F.col("label")))
    name = F.when(F.col("kind") == "person", wrap(pick(NAMES))).when(F.col("kind") == "place", wrap(pick(CITIES))).when(F.col("kind") == "org", F.concat(F.lit("[Организация-"), (F.col("n") + 1).cast("string"), F.lit("]"))).otherwise(fixed)
    return x.select(*keys, "value", name.alias("pseudonym"))


def locate_or_stem(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, value, start, end) of every occurrence of a model's value; of none, of words that begin with its stem.

    A stem is the value without its last two letters, three letters at least; values of one letter are left out.
    """
    v = values.select(id_col, F.trim("value").alias("value")).filter(F.length("value") >= 2).distinct()
    quote = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    exact = F.concat(F.lit("(?iu)"), quote(F.col("value")))
    stem = F.concat(F.lit(r"(?iuU)\b"), quote(F.substring(F.col("value"), F.lit(1), F.greatest(F.lit(3), F.length("value") - 2))), F.lit(r"\w*"))
    x = docs.select(id_col, text_col).join(v, id_col)
    x = x.withColumn("p", F.when(F.regexp_like(F.col(text_col), exact), exact).otherwise(stem))
    zipped = F.arrays_zip(F.regexp_extract_all(F.col(text_col), F.col("p"), F.lit(0)).alias("m"), F.split(F.col(text_col), F.col("p"), -1).alias("g"))
    rows = x.select(id_col, "value", F.posexplode(F.filter(zipped, lambda y: y["m"].isNotNull())).alias("seq", "y"))
    end = F.sum(F.length("y.g") + F.length("y.m")).over(W.partitionBy(id_col, "value").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(id_col, "value", (end - F.length("y.m")).cast("int").alias("start"), end.cast("int").alias("end"))


def select_in_order(docs: DataFrame, wanted: DataFrame, first: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents of a list (id, ord) in its order, the first ``first`` of them; an id without a document raises ``ValueError``."""
    missing = wanted.join(docs.select(id_col), id_col, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"unknown documents: {[r[id_col] for r in missing]}")
    out = docs.join(wanted, id_col).orderBy("ord")
    return out.limit(first) if first is not None else out
