"""Regular-expression table functions with offsets, as JVM expressions.

All offsets are 0-based half-open code points.  Spark has no function for the positions of all
matches; for a pattern that never matches the empty string they follow from the pieces between the
matches: start of match i = lengths of pieces 0..i plus lengths of matches before i.  Letters, digits
and spaces are those of Unicode; combining marks count as letters, which is the one deviation known.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    """A named pattern layer.

    ``pick`` says where the span lies in a match: ``whole`` of it, or group 1 at its ``head`` or ``tail``.
    """

    name: str
    label: str
    pattern: str
    source: str = "regex"
    confidence: float = 1.0
    pick: str = "whole"
    #: A text that every match contains; looked for before the pattern is tried.
    holds: str = ""


# Own rules, in place of libraries that the toolkit calls for these kinds; none validates against number plans.
EMAIL = Detector("email", "EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", holds="@")
PHONE = Detector("phone", "PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", holds="+1 (")
PHONE_RU = Detector("phone_ru", "PHONE", r"(?<![\w+])(?:\+7|8)[\s-]?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}(?!\d)", "phonenumbers")
CARD = Detector("id16", "ID", r"\b[0-9]{16}\b")
DOTTED_QUAD = Detector("ip", "IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b")
SECRET = Detector("secret", "SECRET", r"\b[0-9a-f]{32,}\b")
URL = Detector("url", "URL", r"(?:https?://|www\.)[A-Za-z0-9._~/?#=&%:+-]+")

# The patterns and word lists of the toolkit whose results are matched.  The flag U makes
# \w, \d, \s and \b those of Unicode, as they are there; u lets i fold letters beyond ASCII.
_MONTHS_EN = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
_DAYS_EN = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
_NUMBERS_EN = r"(?:\d{1,3}|a|an|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
_MONTHS_RU = "(?:январ[ья]|феврал[ья]|марта|апрел[ья]|ма[йя]|июн[ья]|июл[ья]|август[а]?|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья])"
_DAYS_RU = "(?:понедельник|вторник|сред[уы]|четверг|пятниц[уы]|суббот[уы]|воскресень[ея])"
_ORDINALS_RU = (
    r"(?:перв|втор|треть|четверт|пят|шест|седьм|восьм|девят|десят|одиннадцат|двенадцат|тринадцат|четырнадцат|пятнадцат|шестнадцат"
    r"|семнадцат|восемнадцат|девятнадцат|двадцат|тридцат)\w*"
)
_TENS_RU = "двадцать|тридцать|сорок|пятьдесят|шестьдесят|семьдесят|восемьдесят|девяносто|сто"
_UNITS_RU = "один|одна|два|две|три|четыре|пять|шесть|семь|восемь|девять"
_TEENS_RU = "десять|одиннадцать|двенадцать|тринадцать|четырнадцать|пятнадцать|шестнадцать|семнадцать|восемнадцать|девятнадцать"
_YEARS_RU = "(?:год(?:а|у|ом|е|ов)?|лет|годик(?:а|ов)?)"
_PEOPLE_RU = r"(?:мужик\w*|мужчин\w*|женщин\w*|девушк\w*|парн\w*|пацан\w*|человек\w*|тётк\w*|тетк\w*|дядьк\w*|бабушк\w*|дедушк\w*|мальчик\w*|девочк\w*)"
_FILL_RU = r"(?:уже\s+|сейчас\s+|почти\s+|только\s+)?"
_AGE_RU = rf"(?:(?:(?:{_TENS_RU})(?:\s+(?:{_UNITS_RU}))?|{_TEENS_RU}|{_UNITS_RU})|\d{{1,3}})"
_AFTER_AGE = r"""(?=\s*(?:\n?\z|[.,;:!?…)»"'—–-]|год|лет|\b(?:и|а|но|уже|всего|только|скоро|будет|было)\b))"""

GROUPED_ID = Detector("grouped_id", "ID", r"(?U)\b\d{4}[\s-]\d{4}[\s-]\d{2,4}(?:[\s-]\d{2,4})?\b")
NUMERIC_DATE = Detector(
    "numeric_date", "DATE",
    r"(?U)\b(?:(?:0?[1-9]|[12]\d|3[01])[.\/](?:0?[1-9]|1[0-2])[.\/]\d{2,4}|\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:T\d{2}:\d{2}(?::\d{2})?)?)\b",
)
EN_DATE = Detector(
    "en_date", "DATE",
    rf"(?iuU)\b(?:(?:last|next|this|on)\s+{_DAYS_EN}|{_NUMBERS_EN}\s+(?:day|week|month|year)s?\s+ago|yesterday|tomorrow|today|(?:last|next|this)\s+(?:week|month|year)"
    rf"|the\s+\d{{1,2}}(?:st|nd|rd|th)(?:\s+of\s+(?:the\s+month|{_MONTHS_EN}))?|\d{{1,2}}(?:st|nd|rd|th)\s+of\s+(?:the\s+month|{_MONTHS_EN})"
    rf"|{_MONTHS_EN}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?|\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTHS_EN}(?:,?\s+\d{{4}})?|{_MONTHS_EN}/\d{{2,4}})\b",
)
RU_DATE = Detector(
    "ru_date", "DATE",
    rf"(?iuU)(?<!\w)(?:в\s+(?:прошл|следующ|эт)\w+\s+{_DAYS_RU}|\d{{1,3}}\s+(?:дн\w+|недел\w+|месяц\w+|год\w+|лет)\s+(?:тому\s+)?назад"
    rf"|(?:до|после|перед|к)\s+Нов\w+\s+год\w+|{_ORDINALS_RU}\s+{_MONTHS_RU}|\d{{1,2}}\s+{_MONTHS_RU})\b",
)
SNILS = Detector("snils", "ID", r"(?U)\b\d{3}-\d{3}-\d{3}[ -]\d{2}\b")
PASSPORT = Detector("passport", "ID", r"(?U)\b\d{4}\s\d{6}\b")
INN = Detector("inn", "ID", r"(?iuU)\bИНН\D{0,12}(\d{12}|\d{10})\b", pick="tail")
HANDLE = Detector("handle", "URL", r"(?iuU)(?:(?:https?://)?(?:www\.)?(?:t\.me|vk\.com|instagram\.com|wa\.me)/[\w./+]*[\w/+]|(?<!\w)@[A-Za-z][\w.]*[A-Za-z0-9])")
PATRONYMIC = Detector(
    "patronymic", "PERSON",
    r"(?U)\b[А-ЯЁ][а-яё]+(?:ович|овича|овичу|овичем|овиче|евич|евича|евичу|евичем|евиче|овна|овны|овне|овну|овной|евна|евны|евне|евну|евной"
    r"|ична|ичны|ичне|ичну|ичной|инична|иничны|иничне|иничну|иничной)\b", "patronymic", 0.9,
)
AGE_CUE = Detector("age_cue", "AGE", rf"(?iuU)\b(?:возраст\w*|исполни\w+|стукнул\w+)[\s—:\-–]+{_FILL_RU}({_AGE_RU})\b", "age", 0.85, "tail")
AGE_PRONOUN = Detector("age_pronoun", "AGE", rf"(?iuU)\b(?:мне|тебе|ему|ей|вам|нам|им)[\s—:\-–]+{_FILL_RU}({_AGE_RU})\b{_AFTER_AGE}", "age", 0.85, "tail")
AGE_PERSON = Detector("age_person", "AGE", rf"(?iuU)\b({_AGE_RU})\s+{_YEARS_RU}\s+{_PEOPLE_RU}", "age", 0.85, "head")
TURN_INLINE = Detector("turn_inline", "TURN", r"(?U)\*\*\d{1,2}:\d{2}(?::\d{2})?\s*([ТК])\s*:\*\*", holds="**")
TURN_SPLIT = Detector("turn_split", "TURN", r"(?U)\*\*\d{1,2}:\d{2}(?::\d{2})?\s*\*\*\s*([ТК])\s*:", holds="**")
WORD = Detector("word", "WORD", "[А-Яа-яЁё]+|[A-Za-z]+")

#: Detectors whose spans are taken as they are.
DETECTORS = {d.name: d for d in (EMAIL, PHONE, PHONE_RU, CARD, GROUPED_ID, DOTTED_QUAD, SECRET, URL, NUMERIC_DATE, EN_DATE, RU_DATE, SNILS, PASSPORT, INN, HANDLE, PATRONYMIC)}
#: The three age rules; a number that several of them find counts once.
AGES = [AGE_CUE, AGE_PRONOUN, AGE_PERSON]
#: The layer of patterns that redaction uses, in order.
REGEX_LAYER = [EMAIL, URL, PHONE, PHONE_RU, GROUPED_ID, NUMERIC_DATE, EN_DATE, RU_DATE, SNILS, PASSPORT, INN, HANDLE, PATRONYMIC, *AGES]

_HIT = "array<struct<layer_rank:int,seq:int,gap:int,m:string,value:string>>"


def _hits(text: Column, rank: int, d: Detector) -> Column:
    """Array of the matches of a pattern that never matches empty text, with the length of what lies before each."""
    parts = [F.regexp_extract_all(text, F.lit(d.pattern), F.lit(0)).alias("m"), F.split(text, d.pattern, -1).alias("g")]
    if d.pick != "whole":
        parts.append(F.regexp_extract_all(text, F.lit(d.pattern), F.lit(1)).alias("v"))
    found = F.filter(F.arrays_zip(*parts), lambda x: x["m"].isNotNull())
    rows = F.transform(found, lambda x, i: F.struct(F.lit(rank).alias("layer_rank"), i.alias("seq"), F.length(x["g"]).alias("gap"), x["m"].alias("m"), x["v" if d.pick != "whole" else "m"].alias("value")))
    some = F.contains(text, F.lit(d.holds)) & text.rlike(d.pattern) if d.holds else text.rlike(d.pattern)
    return F.when(some, rows.cast(_HIT)).otherwise(F.array().cast(_HIT))


def spans(docs: DataFrame, detectors: list[Detector], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, detector, layer_rank, seq, start, end, label, value, source, confidence), one for each match.

    One scan of the documents tries all detectors.  A start is the running sum of the lengths of
    matches and of what lies between them, over the rows of a document, which are spread by document
    as all span operators want them.  The id must be unique; a null text has no spans.
    """
    arrays = [_hits(F.col(text_col), rank, d) for rank, d in enumerate(detectors)]
    hits = docs.select(*keep, id_col, F.inline(F.concat(*arrays))).repartition(id_col)
    end = F.sum(F.col("gap") + F.length("m")).over(W.partitionBy(id_col, "layer_rank").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("layer_rank") + 1)
    placed = hits.withColumn("to", end).withColumn("pick", of([d.pick for d in detectors]))
    start = F.when(F.col("pick") == "tail", F.col("to") - F.length("value")).otherwise(F.col("to") - F.length("m"))
    return placed.select(
        *keep, id_col, of([d.name for d in detectors]).alias("detector"), "layer_rank", "seq", start.cast("int").alias("start"), (start + F.length("value")).cast("int").alias("end"),
        of([d.label for d in detectors]).alias("label"), "value", of([d.source for d in detectors]).alias("source"), of([d.confidence for d in detectors]).alias("confidence"),
    )


def first_of_each(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each (id, start, end): of several the one of the first detector."""
    w = W.partitionBy(id_col, "start", "end").orderBy("layer_rank", "seq")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def turns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, turn, start, speaker) of the turn markers of transcripts, in order of place."""
    # the speaker is group 1 in the middle of a match, so the span of the whole match is asked for and the letter read from it
    whole = [replace(d, pattern=d.pattern.replace("([ТК])", "[ТК]")) for d in (TURN_INLINE, TURN_SPLIT)]
    found = spans(docs, whole, id_col, text_col).select(id_col, "start", F.regexp_extract("value", "[ТК]", 0).alias("speaker"))
    return found.select(id_col, (F.row_number().over(W.partitionBy(id_col).orderBy("start", "speaker")) - 1).alias("turn"), "start", "speaker")


def locate_all(docs: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text", value_col: str = "value") -> DataFrame:
    """Every occurrence, case-insensitive and non-overlapping, of each value of a document in its text."""
    quoted = F.concat(F.lit("(?iu)\\Q"), F.col(value_col), F.lit("\\E"))
    found = F.regexp_extract_all(F.col(text_col), quoted, F.lit(0))
    gaps = F.split(F.col(text_col), quoted, -1)
    rows = docs.join(values.filter(F.length(F.trim(value_col)) >= 2), id_col).select(id_col, value_col, F.posexplode(F.arrays_zip(found.alias("m"), gaps.alias("g"))).alias("seq", "x")).filter("x.m IS NOT NULL")
    w = W.partitionBy(id_col, value_col).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length("x.g") + F.length("x.m")).over(w)
    return rows.select(id_col, value_col, "seq", (end - F.length("x.m")).cast("int").alias("start"), end.cast("int").alias("end"))


def edge_trim(text: Column, chars: str = " \t\n.,;:!?\"'()[]") -> tuple[Column, Column, Column]:
    """(trimmed text, characters cut in front, characters cut behind)."""
    left = F.call_function("ltrim", F.lit(chars), text)
    both = F.call_function("trim", F.lit(chars), text)
    return both, F.length(text) - F.length(left), F.length(left) - F.length(both)


def windows(docs: DataFrame, size: int = 1200, overlap: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fixed windows (id, chunk, start, end) of ``size`` characters with ``overlap``; one when the text fits."""
    n = F.length(text_col)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    return docs.select(id_col, n.alias("n"), F.posexplode(starts).alias("chunk", "start")).select(id_col, "chunk", "start", F.least(F.col("start") + size, F.col("n")).alias("end"))


# Cyrillic letters and their Latin spelling.
LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" "), strict=True))


def transliterate(x: Column) -> Column:
    """Latin spelling of a Cyrillic word in lower case; other letters stay."""
    table = F.create_map(*[F.lit(v) for kv in LATIN.items() for v in kv])
    return F.array_join(F.transform(F.split(F.lower(x), ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
