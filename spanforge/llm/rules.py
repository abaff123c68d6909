"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a Boolean column.  ``plan`` measures, on a bounded sample, the time each rule takes
and the share of rows it rejects; ``cascade`` evaluates the rules by rejection per cost in one
CASE, which stops at the first rule that rejects a row.  The order changes the cost, never the
verdict.  No shuffle and no Python on the data path.

Defined results: a null text has no words; a text without words fails ``min_words``; nulls in
other columns do not matter; rows are judged one by one, so ties and repeated rows do not matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows on which cost and selectivity are estimated.
SAMPLE_ROWS = 1000
#: Words are runs of characters outside this class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of characters that are not white space; only the ends of a split can be empty."""
    return F.array_remove(F.split(text, rf"[{SPACE}]+", -1), "")


def word_chars(words: Column) -> Column:
    """Code points inside words."""
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    """Characters out of ``#*$%&|<>``."""
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]"))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur at least twice; ``windows`` has a hash for each position."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        hit = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | ((k + 1 < n) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def add(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["to"])).alias("n"), (p + WINDOW).alias("to"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(let(pairs, repeated), zero, add, lambda acc: acc["n"])


def n_repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text (64-bit window hashes)."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(words, i - 1 + j) for j in range(WINDOW)]))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(some).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``_m``: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        return let(words_of(t), lambda w: let(lines_of(t), lambda x: F.struct(
            F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(t).alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).alias("n_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
        )))

    return docs.withColumn("_m", let(text, of))


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes, from a text column, the Boolean that is true for texts to be dropped."""

    name: str
    rejects: Callable[[Column], Column]


def _n_words(t: Column) -> Column:
    return F.size(words_of(t))


def _odd_length(chars: Column, words: Column) -> Column:
    return (chars < 2 * words) | (chars > 25 * words)


#: Fewest words, share of repeated words, symbols a word, mean length of words, share of repeated lines.
RULES = (
    Rule("min_words", lambda t: _n_words(t) < 20),
    Rule("repeated_words", lambda t: let(words_of(t), lambda w: 100 * n_repeat_words(w) > 30 * F.size(w))),
    Rule("symbols", lambda t: 2 * n_symbols(t) > _n_words(t)),
    Rule("word_length", lambda t: let(words_of(t), lambda w: _odd_length(word_chars(w), F.size(w)))),
    Rule("repeated_lines", lambda t: let(lines_of(t), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
)
#: The same rules over the measures of ``measure``.
BY_MEASURE: dict[str, Callable[[Column], Column]] = {
    "min_words": lambda m: m["n_words"] < 20,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 2 * m["n_symbols"] > m["n_words"],
    "word_length": lambda m: _odd_length(m["word_chars"], m["n_words"]),
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
}


@dataclass
class Plan:
    """Rules in the order of evaluation, with what the sample said of each (seconds, share rejected)."""

    order: list[Rule]
    seen: dict[str, tuple[float, float]] = field(default_factory=dict)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, known: dict[str, tuple[float, float]] | None = None) -> Plan:
    """Order ``rules`` by rejection per cost, as measured on a sample of about ``sample_rows`` rows from all over the table.

    The cost of a rule is the time of a job over the cached sample less that of a job that only reads
    it, the lower of two runs each.  ``known`` (name -> seconds, share rejected) replaces the
    measurement.  An empty table keeps the given order.  The order decides what is evaluated, never
    which rows are kept.
    """
    seen = dict(known or {})
    todo = [r for r in rules if r.name not in seen]
    if todo:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
        total = docs.count()
        rows = docs.select(text).sample(min(1.0, sample_rows / max(total, 1)), seed=7).persist()

        def timed(x: Column) -> tuple[float, int]:
            took = []
            for _ in range(2):
                began = time.perf_counter()
                bad = rows.agg(F.count_if(x)).first()[0]
                took.append(time.perf_counter() - began)
            return min(took), bad

        try:
            n = rows.count()
            idle, _ = timed(F.length("t") < 0) if n else (0.0, 0)
            for r in todo if n else ():
                took, bad = timed(r.rejects(F.col("t")))
                seen[r.name] = (max(took - idle, 1e-4), bad / n)
        finally:
            rows.unpersist()
    worth = {r.name: (seen[r.name][1] + 1e-6) / max(seen[r.name][0], 1e-6) if r.name in seen else 0.0 for r in rules}
    return Plan(sorted(rules, key=lambda r: -worth[r.name]), seen)


def cascade(value: Column, order: list[Rule]) -> Column:
    """True where no rule rejects; evaluation ends at the first that does."""
    verdict = F.lit(True)
    for r in reversed(order):
        verdict = F.when(r.rejects(value), F.lit(False)).otherwise(verdict)
    return verdict


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` that pass all rules, with their columns unchanged."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.filter(cascade(text, plan(docs, rules, text_col, sample_rows).order))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: id, the five measures, ``base_failed`` and ``kept`` (false if the base failed, else the cascade)."""
    rest = tuple(r for r in RULES if r.name not in ("min_words", "repeated_words"))
    order = [Rule(r.name, BY_MEASURE[r.name]) for r in plan(docs, rest, text_col, sample_rows).order]
    m = F.col("_m")
    failed = BY_MEASURE["min_words"](m) | BY_MEASURE["repeated_words"](m)
    return measure(docs.select(id_col, text_col), text_col).select(
        id_col, *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(cascade(m, order)).alias("kept"),
    )
