"""Small literal relations for operators whose inputs the test tables lack; the queries and their SQL read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (columns with types, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "hits": ("doc_id long, start int, `end` int, type string, score double", [
        (1, 0, 9, "PERSON", 0.9), (1, 9, 12, "PERSON", 0.5), (1, 14, 18, "PERSON", 0.45), (1, 22, 31, "LOCATION", 0.44), (2, 0, 4, "PERSON", 0.7), (2, 2, 7, "PERSON", 0.6),
        (2, 8, 10, "ORG", 0.3), (3, 0, 3, "DATE", 0.2), (3, 3, 8, "DATE", 0.95), (3, 9, 10, "DATE", 0.99),
    ]),
    "hit_texts": ("doc_id long, text string", [(1, "Ann Marie Lee  (Kim), in London city"), (2, "Bobby K Inc"), (3, "5, March.")]),
    "facts": ("doc_id long, ord long, value string, type string", [(1, 0, "Ann", "PERSON"), (1, 1, "him", "PERSON"), (1, 2, "Ann", "PERSON"), (1, 3, "Lee", "PERSON"), (2, 0, "Rome", "LOCATION"), (2, 1, "Bob", "PERSON"), (2, 2, "She", "PERSON")]),
    "fact_texts": ("doc_id long, text string", [(1, "Ann met him. Ann knows Lee and Ann."), (2, "Bob lives in Rome; she does not.")]),
    "golds": ("doc_id long, start int, `end` int, type string, entity_id string, identifier_class string", [
        (1, 0, 20, "EMAIL", "a-mail", "direct"), (1, 2, 5, "PERSON", "a-marina", "direct"), (1, 30, 36, "PERSON", "a-marina-x", "direct"), (1, 31, 35, "PERSON", "a-marina-x", "direct"),
        (2, 0, 8, "MEDICATION", "b-drug", "quasi"), (2, 4, 12, "AGE", "b-age", "quasi"), (2, 5, 7, "MEDICATION", "b-drug", "quasi"), (3, 1, 4, "ORG", "f-timur-latin", "direct"),
    ]),
    "outputs": ("doc_id long, start int, `end` int, type string", [(1, 0, 18, "EMAIL"), (1, 30, 36, "PERSON"), (1, 40, 44, "DATE"), (2, 0, 8, "PERSON"), (2, 4, 12, "AGE"), (4, 0, 3, "ORG"), (4, 5, 8, "WEIRD")]),
    "guesses": ("client string, session int, attribute string, ranked array<string>", [
        ("a", 1, "city", ["Moscow", "Kazan"]), ("a", 1, "age", []), ("a", 1, "job", ["doctor", "nurse", "clerk", "teacher"]), ("a", 2, "city", ["kazan city"]), ("a", 2, "age", ["34"]), ("a", 2, "job", [None, "Teacher"]),
        ("a", 0, "city", ["Kazan"]), ("a", 0, "age", ["about 34"]), ("a", 0, "job", ["teacher"]), ("b", 1, "city", ["Omsk"]), ("b", 1, "age", ["51"]), ("b", 0, "city", ["Tomsk", "Perm"]), ("b", 0, "age", None),
    ]),
    "truth": ("client string, attribute string, needle string", [("a", "city", "kazan"), ("a", "age", "34"), ("a", "job", "teacher"), ("b", "city", "perm"), ("b", "city", "tomsk"), ("b", "age", "50")]),
    "survival": ("client string, survival double", [("a", 0.25), ("b", 0.1)]),
    "sessions": ("client string, session int, before array<string>, after array<string>", [
        ("a", 1, ["катастрофизация", "обобщение"], ["обобщение"]), ("a", 2, ["чтение мыслей"], ["это чтение мыслей!"]), ("b", 1, [], ["обобщение"]), ("b", 2, ["Катастроф", "ничего"], []), ("c", 1, [], []),
    ]),
    "tests": ("client string, n_recovered long, n_tested long", [("a", 2, 5), ("b", 0, 5), ("c", 3, 0), ("d", None, None), ("a", 1, 4)]),
    "verdicts": ("ord long, same boolean, said boolean, confidence double", [
        (i, i % 3 == 0, None if i % 7 == 6 else (i * 5) % 4 < 2, None if i % 5 == 4 else (i * 37 % 11) / 8 - 0.125) for i in range(24)
    ]),
    "tokens": ("doc_id string, pos int, token string, tag string", [
        ("d1", i, t, g) for i, (t, g) in enumerate([("Анна", "B-PER"), ("Ли", "B-PER"), ("и", "O"), ("Омск", "B-GPE"), ("Омск", "B-GPE"), (",", "O"), ("анна", "B-PER"), ("ли", "B-PER"), ("Кот", "B-PET")])
    ] + [("d2", i, t, g) for i, (t, g) in enumerate([("Рим", "B-GPE"), ("Парк", "B-PUBLIC_PLACES"), ("рим", "B-GPE"), ("x", "O"), ("РИМ", "B-GPE")])] + [("d3", 0, "Он", "O")]),
    "answers": ("id long, raw string", [
        (1, 'ok <think>a [1]\n</think>[{"text": "x"}] rest'), (2, "none"), (3, 'noise [broken [1, "]", {"a": [2]}] tail [3]'), (4, None), (5, '<think>open [7]'), (6, 'x {"same": true, "confidence": 0.9} y'),
    ]),
    "chunk_hits": ("doc_id long, chunk long, start long, `end` long, label string", [(1, 0, 5, 9, "P"), (1, 1, 2, 6, "P"), (1, 1, 2, 6, "Q"), (1, 2, 900, 990, "P"), (2, 0, 0, 3, "P"), (2, 0, 0, 3, "P"), (2, 0, 4, 4, "P")]),
    "chunk_places": ("doc_id long, chunk long, start long", [(1, 0, 0), (1, 1, 3), (1, 2, 40), (2, 0, 0)]),
    "layers": ("run long, names array<string>", [(1, ["natasha", "opf"]), (2, ["regex"]), (3, ["OPF", "ollama", "opf", "regex"]), (4, [])]),
    "caches": ("dataset string, doc_id long", [("m1", 1), ("m1", 2), ("m2", 2), ("m2", 3), ("m3", 1)]),
    "values": ("doc_id long, value string", [(-6, "Тимур Маратович"), (-8, "Тимур Лебедев"), (-8, "Вера"), (-1, "ж")]),
    "named": ("doc_id long, value string", [(-8, "Тимур"), (-8, "Лебедевым"), (-4, "march 3RD"), (-4, "q"), (-5, "Мария")]),
    "patterns": ("client string, entity_id string, type string, identifier_class string, pattern string", [
        ("x", "x-ann", "PERSON", "direct", "ann( lee)?"), ("x", "x-mail", "EMAIL", "direct", r"[a-z.]+@[a-z]+\.[a-z]+"), ("x", "x-date-%V", "DATE", "quasi", r"\d+ (may|june)"), ("y", "y-ann", "PERSON", "direct", "Ann"),
    ]),
    "client_texts": ("doc_id long, client string, text string", [(1, "x", "Ann Lee wrote ann.lee@mail.org on 3 May, Ann on 4 June and 3 may."), (2, "y", "ANN, annex."), (3, "z", "Ann")]),
    "raw_labels": ("model string, label string", [("natasha", "PER"), ("natasha", "MISC"), ("presidio", "NRP"), ("presidio", "UK_NHS"), ("philter", "Name"), ("philter", "Odd"), ("ai4", "TITLE"), ("ai4", "BOD"), ("ai4", "PASS"), ("ai4", "TEL"), ("none", "PER")]),
    "survivors": ("client string, entity_id string, type string", [
        ("a", "a-kaluga", "LOCATION"), ("a", "a-age", "AGE"), ("a", "a-profession", "PROFESSION"), ("a", "a-careerlevel", "PROFESSION"), ("b", "b-role", "PROFESSION"), ("c", "c-spb", "LOCATION"), ("c", "c-age", "AGE"),
        ("c", "c-profession", "PROFESSION"), ("c", "c-escitalopram", "MEDICATION"), ("c", "c-unknown", "ORG"), ("d", "d-other", "ORG"), ("f", "f-kazan", "LOCATION"), ("f", "f-atomoxetine", "MEDICATION"), ("f", "f-age", "AGE"), ("f", "f-profession", "PROFESSION"),
    ]),
    "overlapping": ("doc_id long, seq int, start int, `end` int, type string", [(1, 0, 0, 4, "a"), (1, 1, 2, 6, "b"), (1, 2, 6, 8, "c"), (1, 3, 5, 7, "d"), (2, 0, 3, 5, "x"), (2, 1, 3, 9, "y")]),
    "over_texts": ("doc_id long, text string", [(1, "0123456789"), (2, "abcdefghijk"), (3, "nothing")]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)
