"""Steps that depend on what came before inside one document: metadata block, chunks, names, matching, folds.

Those that Catalyst can express are DataFrame operations; the others run a document (or a text) at
a time over Arrow batches, so memory is bounded by a document and documents are spread over tasks.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import WORD, Detector, spans, transliterate

# The shape of a metadata block and of its lines, the keys that name people, names that are also common nouns.
FRONT_BLOCK = r"(?s)\A﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
FRONT_LINE = r"""(?im)^[ \t]*[A-Za-z_][\w-]*[ \t]*:[ \t]*(?:"[^"\r\n]*"|'[^'\r\n]*'|[^\r\n#]*?)[ \t]*(?:#.*)?$"""
FRONT_KEYS = {"client_id": "ID", "client": "PERSON", "patient": "PERSON", "name": "PERSON", "therapist": "PERSON"}
COMMON_NAMES = ("вера", "роман", "инсайт", "мир", "надежда", "любовь", "роза", "лилия", "майя", "ангел", "марс", "владимир")


def frontmatter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, label, value) of identifying values in a leading block between two ``---`` lines.

    The block is a text of its own whose lines are found by the span recipe; a value that is blank
    or a single letter (a speaker's code) is left out.
    """
    block = F.regexp_extract(text_col, FRONT_BLOCK, 1)
    inner = docs.select(id_col, block.alias("_block"), (F.length(F.regexp_extract(text_col, r"\A﻿?---[ \t]*\r?\n", 0))).alias("_base")).filter(F.col("_block") != "")
    lines = spans(inner, [Detector("front", "LINE", FRONT_LINE)], id_col, "_block", ("_base",))
    head = F.regexp_extract("value", r"^[ \t]*[A-Za-z_][\w-]*[ \t]*:[ \t]*", 0)
    rest = F.substring("value", F.length(head) + 1, F.length("value"))
    quote = F.when(F.substring(rest, 1, 1).isin('"', "'"), 1).otherwise(0)
    body = F.when(quote == 1, F.regexp_extract(rest, r"""^(?:"([^"]*)"|'([^']*)')""", 1)).otherwise(F.regexp_extract(rest, r"^[^#]*?(?=[ \t]*(?:#|$))", 0))
    body = F.when((quote == 1) & rest.startswith("'"), F.regexp_extract(rest, r"^'([^']*)'", 1)).otherwise(body)
    key = F.lower(F.regexp_extract("value", r"[A-Za-z_][\w-]*", 0))
    label = F.coalesce(*[F.when(key == k, v) for k, v in FRONT_KEYS.items()])
    start = F.col("_base") + F.col("start") + F.length(head) + quote
    out = lines.select(id_col, start.alias("start"), (start + F.length(body)).alias("end"), label.alias("label"), body.alias("value"))
    return out.filter(F.col("label").isNotNull() & (F.trim("value") != "") & ~F.trim("value").rlike(r"^[A-Za-zА-Яа-яЁё]$"))


def same_name(a: Column, b: Column) -> Column:
    """Whether two words in lower case are forms of one name.

    They are if equal, or if both have four letters or more, agree but for the last two letters of the
    shorter one at most, and go on for at most three letters where they part.
    """
    short = F.least(F.length(a), F.length(b))
    common = F.coalesce(*[F.when(F.substring(a, F.lit(1), short - k) == F.substring(b, F.lit(1), short - k), short - k) for k in (0, 1, 2)])
    return (a == b) | ((short >= 4) & common.isNotNull() & (F.greatest(F.length(a), F.length(b)) - common <= 3))


def propagate(docs: DataFrame, persons: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, value) of further words that are forms of detected names; ``persons`` has (id, value).

    Words of the text meet the tokens of the names by document and first two letters, which all forms
    of a name share: the reading of "same name" becomes a join.  A Cyrillic word must be capitalised
    unless it equals a name, has five letters or more and is no common noun; a Latin word must equal a
    Latin token or the transliteration of a Cyrillic one.
    """
    cyrillic = lambda c: F.col(c).rlike("^[А-Яа-яЁё]")
    tokens = persons.select(id_col, F.explode(F.regexp_extract_all("value", F.lit(WORD.pattern), F.lit(0))).alias("t")).filter(F.length("t") >= 2)
    low = F.lower("t")
    latin = tokens.select(id_col, F.when(cyrillic("t"), transliterate(F.col("t"))).otherwise(low).alias("n"), F.lit(False).alias("cyr"))
    names = tokens.filter(cyrillic("t")).select(id_col, low.alias("n"), F.lit(True).alias("cyr")).unionByName(latin).distinct()
    names = names.withColumn("k", F.substring("n", 1, 2))
    some = docs.join(persons.select(id_col).distinct(), id_col, "left_semi")
    words = spans(some, [WORD], id_col, text_col).filter(F.length("value") >= 2)
    words = words.select(id_col, "start", "end", "value", F.lower("value").alias("w"), cyrillic("value").alias("cyr")).withColumn("k", F.substring("w", 1, 2))
    pairs = words.join(names, [id_col, "cyr", "k"]).filter(F.when(F.col("cyr"), same_name(F.col("w"), F.col("n"))).otherwise(F.col("w") == F.col("n")))
    hit = pairs.groupBy(id_col, "start", "end", "value", "w", "cyr").agg(F.bool_or(F.col("w") == F.col("n")).alias("exact"))
    capital = F.substring("value", 1, 1) != F.lower(F.substring("value", 1, 1))
    lower_too = F.col("exact") & (F.length("w") >= 5) & ~F.col("w").isin(*COMMON_NAMES)
    return hit.filter(~F.col("cyr") | capital | lower_too).select(id_col, "start", "end", "value")


class Cutter:
    """Ends of overlapping chunks of a text, from the sorted places behind each kind of separator."""

    def __init__(self, text: str, separators: tuple[str, ...]):
        self.length = len(text)
        self.sizes = [len(s) for s in separators]
        self.places: list[list[int]] = []
        for s in separators:
            at, found = text.find(s), []
            while at >= 0:
                found.append(at)
                at = text.find(s, at + 1)
            self.places.append(found)

    def end(self, start: int, size: int) -> int:
        """Behind the last separator, of the first kind that has one, that lies whole in the later two thirds of the chunk."""
        stop = start + size
        if stop >= self.length:
            return self.length
        least = start + max(1, size // 3)
        for places, width in zip(self.places, self.sizes, strict=True):
            i = bisect_left(places, stop - width + 1) - 1
            if i >= 0 and places[i] >= least:
                return places[i] + width
        return stop


def chunks(text: str, size: int = 2500, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", "? ", "! ")) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of a text; the next one begins ``overlap`` before the end of the last."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller")
    cutter, start = Cutter(text, separators), 0
    while start < cutter.length:
        end = cutter.end(start, size)
        yield start, end
        start = cutter.length if end == cutter.length else max(end - overlap, start + 1)


def chunk_spans(docs: DataFrame, size: int = 2500, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start, end) of the chunks of each text; null and empty texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [list(chunks(t or "", size, overlap)) for t in b["t"]]
            flat = pd.DataFrame({"id": b["id"], "c": cut}).explode("c").dropna(subset="c")
            yield pd.DataFrame({"id": flat["id"], "chunk": flat.groupby(level=0).cumcount(), "start": [c[0] for c in flat["c"]], "end": [c[1] for c in flat["c"]]})

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, chunk long, start long, `end` long")
    return out.withColumnRenamed("id", id_col)


def rebase(chunk_rows: DataFrame, found: DataFrame, lengths: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans found in chunks, (id, chunk, start, end, label), as spans of the whole text, each once.

    ``chunk_rows`` has (id, chunk, start), ``lengths`` (id, n).  Spans out of the text are dropped.
    """
    x = found.alias("s").join(chunk_rows.select(id_col, "chunk", F.col("start").alias("_at")), [id_col, "chunk"]).join(lengths, id_col)
    x = x.select(id_col, "chunk", (F.col("start") + F.col("_at")).alias("start"), (F.col("end") + F.col("_at")).alias("end"), "label", "n")
    return x.filter("0 <= start AND start < `end` AND `end` <= n").groupBy(id_col, "start", "end", "label").agg(F.min("chunk").alias("chunk"))


_KINDS = ("correct", "partial", "wrong_type", "fp", "fn")


def _one_to_one(gold: list[tuple[int, int, str]], pred: list[tuple[int, int, str]], relaxed: bool, types: set[str] | None) -> dict[str, int]:
    """Counts of one document: predictions in order take the first free gold span, of their own type, then of any."""
    out = dict.fromkeys(_KINDS, 0)
    free, left = dict.fromkeys(range(len(gold))), []
    fits = (lambda p, g: p[0] < g[1] and g[0] < p[1]) if relaxed else (lambda p, g: p[:2] == g[:2])
    scored = lambda p: types is None or p[2] in types
    for p in pred:
        hit = next((i for i in free if gold[i][2] == p[2] and fits(p, gold[i])), None) if scored(p) else None
        if hit is None:
            left.append(p)
            continue
        del free[hit]
        out["correct"] += 1
        out["partial"] += p[:2] != gold[hit][:2]
    for p in left:
        hit = next((i for i in free if fits(p, gold[i])), None)
        out["fp"] += scored(p)
        if hit is not None:
            del free[hit]
            out["wrong_type"] += 1
            out["fn"] += 1
    out["fn"] += len(free)
    return out


def greedy_counts(gold: DataFrame, pred: DataFrame, relaxed: bool = True, types: set[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per document the counts of a one-to-one matching in two passes; both frames have (id, start, end, canon).

    In the first pass a prediction takes the first free gold span of its type, in the second any that
    it fits, which costs both sides.  It fits by overlap where ``relaxed``, else by equality.  Labels
    out of ``types`` are never counted as predictions.  Spans are taken in order of place.
    """
    side = lambda df, name: df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "canon"))).alias(name))
    both = side(gold, "g").join(side(pred, "p"), id_col, "full_outer")
    kind = gold.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = lambda x: [(s["start"], s["end"], s["canon"]) for s in x] if x is not None else []
        for b in batches:
            counts = [_one_to_one(rows(g), rows(p), relaxed, types) for g, p in zip(b["g"], b["p"], strict=True)]
            yield pd.DataFrame(counts, columns=list(_KINDS)).assign(id=b["id"].to_numpy())[["id", *_KINDS]]

    out = both.select(F.col(id_col).alias("id"), "g", "p").mapInPandas(run, f"id {kind}, " + ", ".join(f"{k} long" for k in _KINDS))
    return out.withColumnRenamed("id", id_col)


def drop_nested(found: DataFrame, entity: str = "entity_id", id_col: str = "doc_id") -> DataFrame:
    """Spans without those that overlap the last span kept and are of its entity, in order of place, longest first.

    The outcome for a span depends on the last one kept, so each document's sorted spans are folded.
    """
    cols = [c for c in found.columns if c != id_col]
    item = F.struct(F.col("start").alias("_s"), (-F.col("end")).alias("_e"), *[F.col(c) for c in cols])
    rows = found.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    kind = rows.schema["_all"].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        covered = last.isNotNull() & (x["start"] < last["end"]) & (x[entity] == last[entity])
        return F.when(F.coalesce(covered, F.lit(False)), acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("_all", F.array().cast(kind), step)
    return rows.select(id_col, F.inline(kept)).select(*found.columns)


def drop_inside(found: DataFrame, structured: tuple[str, ...] = ("EMAIL", "URL", "ID"), entity: str = "entity_id", id_col: str = "doc_id") -> DataFrame:
    """Spans without those that lie in a longer structured span of another entity; structured spans stay."""
    outer = found.filter(F.col("type").isin(*structured)).alias("o")
    inner = found.alias("i")
    inside = (F.col(f"i.{id_col}") == F.col(f"o.{id_col}")) & (F.col(f"i.{entity}") != F.col(f"o.{entity}")) & (F.col("o.start") <= F.col("i.start")) & (F.col("i.end") <= F.col("o.end"))
    inside = inside & (F.col("o.end") - F.col("o.start") > F.col("i.end") - F.col("i.start")) & ~F.col("i.type").isin(*structured)
    return inner.join(outer, inside, "left_anti")


def _first_array(text: str | None) -> str | None:
    """The first stretch from ``[`` to its matching ``]``, strings skipped, that is a JSON array."""
    text = text or ""
    for start in (i for i, c in enumerate(text) if c == "["):
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "[]":
                depth += 1 if c == "[" else -1
                if depth == 0:
                    try:
                        return json.dumps(json.loads(text[start : i + 1]), ensure_ascii=False)
                    except ValueError:
                        break
    return None


def first_array(text: Column) -> Column:
    """The first JSON array in a model's answer, as JSON text; null where there is none."""
    return F.pandas_udf(lambda s: s.map(_first_array), "string")(text)


def word_runs(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal ``B-`` tags of (keys, pos, token, tag) as spans over the tokens joined by single spaces.

    Token offsets are running sums of lengths plus one space each; runs are islands of equal neighbours.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    x = tokens.withColumn("end", F.sum(F.length("token") + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).withColumn("start", F.col("end") - F.length("token"))
    x = x.withColumn("_new", F.when(F.lag("tag").over(w).eqNullSafe(F.col("tag")), 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("tag").startswith("B-"))
    runs = x.groupBy(*keys, "_run", F.substring("tag", 3, 1000).alias("source_tag"))
    return runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ").alias("value")).drop("_run")
