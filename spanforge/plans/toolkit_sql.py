"""DuckDB SQL for the queries of ``toolkit``; expectations over samples are written down by hand."""

from __future__ import annotations

from ..functions import labels as L
from ..operators import builders as B
from . import oracles as O
from . import relations as R
from .fixtures import TABLES


def _value(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


_KINDS = {"long": "BIGINT", "int": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def _fixture(name: str) -> str:
    """The rows of a fixture as a named relation."""
    schema, rows = TABLES[name]
    cols = [c.replace("`", "").rsplit(" ", 1) for c in schema.split(", ")]
    casts = ", ".join(f'"{c}"::{_KINDS[k]} AS "{c}"' for c, k in cols)
    names = ", ".join('"' + c + '"' for c, _ in cols)
    return f"{name} AS (SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({names}))"


def _with(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(map(_fixture, names))


_SAMPLES = f"samples AS (SELECT * FROM (VALUES {', '.join('(' + _value(i) + '::BIGINT, ' + _value(t) + ')' for i, t in R.SAMPLES.items())}) t(doc_id, text))"
_LIT = O.literal
_CONF = "CASE WHEN said = false AND c > 0.5 THEN 1.0 - c ELSE c END"
_VERDICTS = f"""{_fixture('verdicts')}, w AS (SELECT ord, same, said, greatest(0.0, least(1.0, coalesce(confidence, CASE WHEN said THEN 1.0 ELSE 0.0 END)))::DOUBLE AS c FROM verdicts),
  v AS (SELECT ord, same, coalesce(said, false) AS called, ({_CONF})::DOUBLE AS confidence FROM w)"""
_DRAW = "((((it * 7919 + draw * 104729 + 20260601) * 48271) % 2147483647) * 16807 % 2147483647)"
_TOP = f"""{_with('guesses', 'truth')}, g AS (SELECT client, session, attribute, list_filter(coalesce(list_transform(ranked, lambda x: lower(x)), []), lambda x: x IS NOT NULL AND x <> '')[1:3] AS said FROM guesses WHERE (client, attribute) IN (SELECT (client, attribute) FROM truth)),
  h AS (SELECT g.client, g.session, g.attribute, ranked IS NOT NULL AS has, coalesce(bool_or(contains(said[1], needle)), false) AS top1,
    coalesce(bool_or(contains(said[1], needle) OR contains(said[2], needle) OR contains(said[3], needle)), false) AS top3
    FROM g JOIN truth t ON t.client = g.client AND t.attribute = g.attribute JOIN guesses r ON r.client = g.client AND r.session = g.session AND r.attribute = g.attribute GROUP BY ALL),
  hits AS (SELECT client, session, attribute, top1, CASE WHEN has THEN top3 END AS top3 FROM h)"""


def _case(x: str, table: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {_value(k)} THEN {_value(v)}" for k, v in table.items()) + f" ELSE {other} END"


_LEVEL = f"CASE {_case('type', L.HARM, str(L.DEFAULT_HARM))} WHEN 3 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END"
_KEPT = """(1, 0, 20, 'a-mail'), (1, 2, 5, 'a-marina'), (1, 30, 36, 'a-marina-x'), (2, 0, 8, 'b-drug'), (2, 4, 12, 'b-age'), (2, 5, 7, 'b-drug'), (3, 1, 4, 'f-timur-latin')"""
_ANN = ('"start"', '"end"')


def oracle_sql() -> dict[str, str]:
    pub = ", ".join(f"'{x}'" for x in L.PUBLISHABLE)
    over = 'm."start" < s."end" AND s."start" < m."end"'
    out = {
        "spans_frontmatter": "SELECT * FROM " + _LIT([(-7, 15, 21, "ID", "marina"), (-7, 36, 48, "PERSON", "Анна Петрова")], 'doc_id, "start", "end", label, value'),
        "spans_age": "SELECT * FROM " + _LIT([(-6, 52, 62, "сорок один"), (-6, 68, 69, "7"), (-6, 90, 92, "33"), (-6, 94, 104, "Сорок пять")], 'doc_id, "start", "end", value'),
        "turn_markers": "SELECT * FROM " + _LIT([(-7, 0, 84, "Т"), (-7, 1, 114, "К")], 'doc_id, turn, "start", speaker'),
        "propagated_names": "SELECT * FROM " + _LIT([(-8, 0, 6, "Тимура"), (-8, 15, 20, "Timur"), (-8, 36, 41, "тимур"), (-8, 44, 49, "Верой"), (-8, 51, 58, "лебедев"), (-8, 64, 72, "Лебедева"), (-6, 0, 5, "Тимур"), (-6, 6, 15, "Маратович")], 'doc_id, "start", "end", value'),
        "gazetteer_names": "SELECT * FROM " + _LIT([(-6, 0, 5, "Тимур", "тимур", "PER"), (-6, 18, 22, "Анна", "анна", "PER"), (-7, 36, 40, "Анна", "анна", "PER"), (-8, 36, 41, "тимур", "тимур", "PER"), (-4, 82, 90, "December", "december", "ORG"), (-4, 95, 103, "December", "december", "ORG")], 'doc_id, "start", "end", value, word, kind'),
        "located_or_stem": "SELECT * FROM " + _LIT([(-8, "Тимур", 0, 5), (-8, "Тимур", 36, 41), (-8, "Лебедевым", 51, 58), (-8, "Лебедевым", 64, 72), (-4, "march 3RD", 62, 71)], 'doc_id, value, "start", "end"'),
        "gold_patterns": "SELECT * FROM " + _LIT([(1, 0, 7, "PERSON", "Ann Lee", "direct", "x-ann"), (1, 14, 30, "EMAIL", "ann.lee@mail.org", "direct", "x-mail"), (1, 34, 39, "DATE", "3 May", "quasi", "x-date-3may"), (1, 41, 44, "PERSON", "Ann", "direct", "x-ann"), (1, 48, 54, "DATE", "4 June", "quasi", "x-date-4june"), (1, 59, 64, "DATE", "3 may", "quasi", "x-date-3may"), (2, 0, 3, "PERSON", "ANN", "direct", "y-ann"), (2, 5, 8, "PERSON", "ann", "direct", "y-ann")], 'doc_id, "start", "end", type, value, identifier_class, entity_id'),
        "metadata_leaks": r"SELECT (SELECT count(*) FROM documents) + 8 AS n, (SELECT count(*) FROM documents WHERE regexp_matches(text, 'client_id:\s*\w')) + 1 AS leaks",
        "turn_of_span": f"""SELECT doc_id, "start", value, -1::BIGINT AS turn, NULL::VARCHAR AS speaker FROM ({O._detector('url')} UNION ALL {O._detector('numeric_date')}) WHERE NOT (doc_id = -7 AND "start" > 114) UNION ALL SELECT -7, 137, 'www.example.org/a?b=1.', 1, 'К'""",
        "mapped_labels": "SELECT * FROM " + _LIT([("natasha", "PER", "PERSON"), ("natasha", "MISC", None), ("presidio", "NRP", "LOCATION"), ("presidio", "UK_NHS", None), ("philter", "Name", "PERSON"), ("philter", "Odd", "OTHER"), ("ai4", "TITLE", None), ("ai4", "BOD", "DATE"), ("ai4", "PASS", "ID"), ("ai4", "TEL", "PHONE"), ("none", "PER", None)], "model, label, canon"),
        "singling_out": "SELECT client, dims::BIGINT AS dims, types, expected::DOUBLE AS expected, singled_out FROM (VALUES ('a', 3, 'AGE,LOCATION,PROFESSION', 28.3, false), ('b', 0, 'PROFESSION', NULL, false), ('c', 4, 'AGE,LOCATION,MEDICATION,ORG,PROFESSION', 1.3, false), ('d', 0, 'ORG', NULL, false), ('f', 4, 'AGE,LOCATION,MEDICATION,PROFESSION', 0.7, true)) t(client, dims, types, expected, singled_out)",
        "score_threshold": f"{_with('hits')} SELECT type, count(*) AS n FROM hits WHERE score >= 0.45 GROUP BY 1",
        "adjacent_merge": "SELECT * FROM " + _LIT([(1, 0, 12, "PERSON", 0.5), (1, 16, 18, "PERSON", 0.45), (1, 22, 31, "LOCATION", 0.44), (2, 0, 7, "PERSON", 0.6), (2, 8, 10, "ORG", 0.3), (3, 0, 1, "DATE", 0.2), (3, 3, 8, "DATE", 0.95)], 'doc_id, "start", "end", type, score'),
        "chunk_rebase": f"""{_with('chunk_places', 'chunk_hits')} SELECT doc_id, h."start" + c."start" AS "start", h."end" + c."start" AS "end", label, min(chunk) AS chunk FROM chunk_hits h JOIN chunk_places c USING (doc_id, chunk)
          WHERE h."start" < h."end" AND h."end" + c."start" <= CASE doc_id WHEN 1 THEN 60 ELSE 8 END GROUP BY ALL""",
        "first_json_array": "SELECT * FROM " + _LIT([(1, '[{"text": "x"}]'), (2, None), (3, '[1, "]", {"a": [2]}]'), (4, None), (5, "[7]"), (6, None)], "id, found"),
        "repaired_verdicts": f"WITH {_VERDICTS} SELECT ord, called, confidence FROM v",
        "layer_names": f"{_with('layers')}, x AS (SELECT run, list_distinct(list_transform(names, lambda n: CASE WHEN lower(n) = 'opf' THEN 'regex' ELSE lower(n) END)) AS l FROM layers) SELECT run, coalesce(array_to_string(list_sort(l), ','), '') AS layers, list_contains(l, 'regex') AS has_regex FROM x",
        "placed_values": "SELECT * FROM " + _LIT([(1, 0, 3, "PERSON", "Ann"), (1, 13, 16, "PERSON", "Ann"), (1, 23, 26, "PERSON", "Lee"), (2, 13, 17, "LOCATION", "Rome"), (2, 0, 3, "PERSON", "Bob")], 'doc_id, "start", "end", type, value'),
        "nested_dropped": f'SELECT doc_id::BIGINT AS doc_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end", entity_id FROM (VALUES {_KEPT}) t(doc_id, "start", "end", entity_id)',
        "structured_containment": f"""SELECT doc_id::BIGINT AS doc_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end", entity_id FROM (VALUES {_KEPT}) t(doc_id, "start", "end", entity_id) WHERE entity_id <> 'a-marina'""",
        "enriched_spans": f"""{_with('golds')} SELECT doc_id, "start", entity_id, {_case("regexp_extract(entity_id, '^[^-]*-[^-]*')", {k: v for k, v in B.ROLES.items() if k.count('-') == 1}, 'NULL')} AS person_role, type = 'MEDICATION' AS confidential_status,
          CASE identifier_class WHEN 'direct' THEN 'MASK' ELSE 'GENERALIZE' END AS mask_decision, CASE WHEN type = 'MEDICATION' THEN 'clinically_important' WHEN type IN ('AGE', 'PROFESSION', 'DATE', 'LOCATION') THEN 'narrative_context' ELSE 'low_utility' END AS utility_tag,
          CASE WHEN entity_id = 'b-age' THEN 'critical' ELSE {_LEVEL} END AS harm FROM golds""",
        "tag_spans": "SELECT * FROM " + _LIT([
            ("d1", 0, 7, "PERSON", "Анна Ли", "direct", "high", "PER", "d1-person-0"), ("d1", 10, 19, "LOCATION", "Омск Омск", "quasi", "medium", "GPE", "d1-location-1"), ("d1", 22, 29, "PERSON", "анна ли", "direct", "high", "PER", "d1-person-0"),
            ("d2", 0, 3, "LOCATION", "Рим", "quasi", "medium", "GPE", "d2-location-0"), ("d2", 4, 8, "LOCATION", "Парк", "quasi", "low", "PUBLIC_PLACES", "d2-location-1"), ("d2", 9, 12, "LOCATION", "рим", "quasi", "medium", "GPE", "d2-location-0"), ("d2", 15, 18, "LOCATION", "РИМ", "quasi", "medium", "GPE", "d2-location-0"),
        ], 'doc_id, "start", "end", type, value, identifier_class, harm, source_tag, entity_id'),
        "documents_in_scope": f"{_with('tokens')} SELECT doc_id, count(*) AS n_tokens FROM tokens GROUP BY 1 HAVING bool_or(tag IN ({', '.join(_value('B-' + t) for t in B.TAGS)})) ORDER BY 1 LIMIT 2",
        "pronoun_filter": f"{_with('facts')} SELECT type, count(*) AS n FROM facts WHERE lower(value) NOT IN ('him', 'her', 'them', 'he', 'she', 'they') GROUP BY 1",
        "short_english": "SELECT lang, count(*) FILTER (WHERE length(text) BETWEEN 40 AND 320) AS short, count(*) FILTER (WHERE length(text) BETWEEN 40 AND 320 AND lang = 'en') AS short_english FROM documents GROUP BY 1",
        "gold_distribution": f"{_with('golds')} SELECT coalesce(type, '-') AS type, coalesce(identifier_class, '-') AS identifier_class, count(*) AS n FROM golds GROUP BY GROUPING SETS ((type), (identifier_class), ())",
        "pseudonym_map": "SELECT * FROM " + _LIT([
            ("a@b.ru", "[EMAIL]"), ("15.01.2024", "[ДАТА]"), ("3/4/99", "[ДАТА]"), ("1984-08-08T00:00", "[ДАТА]"), ("2024-01-15", "[ДАТА]"), ("+7 (912) 345-67-89", "[ТЕЛЕФОН]"), ("8 912 345 67 89", "[ТЕЛЕФОН]"),
            ("Маратович", "[Алексей]"), ("Анна", "[Мария]"), ("Сергеевна", "[Дмитрий]"), ("Timur", "[Город-А]"), ("Карта", "[Организация-1]"), ("СНИЛС", "[Организация-2]"),
        ], "value, pseudonym"),
        "redaction_unmerged": "SELECT * FROM " + _LIT([(1, "<A>89"), (2, "abc<X>jk"), (3, "nothing")], "doc_id, redacted"),
        "selected_documents": "SELECT ord::BIGINT AS ord, doc_id, length(text)::BIGINT AS chars FROM documents JOIN (VALUES (2, 0), (0, 1), (5, 2)) w(doc_id, ord) USING (doc_id)",
        "cached_ids_union": f"{_with('caches')} SELECT doc_id, count(DISTINCT dataset) AS held, count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM caches) AS in_all FROM caches GROUP BY 1",
        "prompt_heads": "SELECT size::BIGINT AS size, count(*) FILTER (WHERE length(text) > size) AS cut, sum(least(length(text), size))::BIGINT AS sent FROM documents, (VALUES (7000), (9000), (12000), (14000), (16000)) s(size) GROUP BY 1",
        "splits_in_order": "SELECT CASE WHEN source IN ('a', 'c', 'e') OR regexp_extract(source, '[0-9]+')::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS split, count(DISTINCT source) AS clients, count(*) AS docs FROM documents GROUP BY 1 ORDER BY 1",
        "small_corpus_hash": "SELECT count(*) AS n, substring(sha256(string_agg(coalesce(text, ''), '' ORDER BY item_id)), 1, 12) AS sha FROM benchmark",
        "positional_zip": f"""{_with('golds', 'outputs')}, g AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, count(*) AS gold FROM golds GROUP BY doc_id), p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, count(*) AS pred FROM outputs GROUP BY doc_id)
          SELECT ord, coalesce(gold, 0) AS gold, coalesce(pred, 0) AS pred FROM g FULL JOIN p USING (ord)""",
        "legacy_scores": f"""WITH x AS (SELECT * FROM (VALUES ('relaxed', 3, 1, 1, 3, 5), ('strict', 2, 0, 1, 4, 6)) t(mode, correct, partial, wrong_type, fp, fn)), y AS (SELECT mode, correct::BIGINT AS correct, partial::BIGINT AS partial, wrong_type::BIGINT AS wrong_type, fp::BIGINT AS fp, fn::BIGINT AS fn,
          correct / (correct + fp)::DOUBLE AS p, correct / (correct + fn)::DOUBLE AS r FROM x) SELECT *, 2.0 * p * r / (p + r) AS f1, 5.0 * p * r / (4.0 * p + r) AS f2 FROM y""",
        "cli_labels": f"""WITH {O.PREDS}, {O._PLAIN} SELECT m.doc_id, m."start", m."end", arg_max(CASE WHEN upper(s.label) IN ({pub}) THEN upper(s.label) ELSE 'OTHER' END, row(s."end" - s."start", -s.layer_rank, -s.seq)) AS label FROM pm m JOIN preds s ON m.doc_id = s.doc_id AND {over} GROUP BY 1, 2, 3""",
        "entity_agreement": f"""WITH {O.GOLD}, {O.PREDS}, a AS (SELECT lang, doc_id, lower(value) AS v, bool_or(EXISTS (SELECT 1 FROM preds s WHERE s.doc_id = m.doc_id AND {over})) AS hit FROM gold m GROUP BY 1, 2, 3), b AS (SELECT lang, doc_id, lower(value) AS v, bool_or(EXISTS (SELECT 1 FROM gold s WHERE s.doc_id = m.doc_id AND {over})) AS hit FROM preds m GROUP BY 1, 2, 3)
          SELECT lang, coalesce(a1, 0) AS a1, coalesce(a1_hit, 0) AS a1_hit, coalesce(a2, 0) AS a2, coalesce(a2_hit, 0) AS a2_hit FROM (SELECT lang, count(*) AS a1, count(*) FILTER (WHERE hit) AS a1_hit FROM a GROUP BY 1) FULL JOIN (SELECT lang, count(*) AS a2, count(*) FILTER (WHERE hit) AS a2_hit FROM b GROUP BY 1) USING (lang)""",
        "blind_spots": f"""WITH {O.GOLD}, {O.PREDS}, x AS (SELECT doc_id, "start", value, 'a2 only' AS side FROM preds m WHERE NOT EXISTS (SELECT 1 FROM gold s WHERE s.doc_id = m.doc_id AND {over}) UNION ALL SELECT doc_id, "start", value, 'a1 only' FROM gold m WHERE NOT EXISTS (SELECT 1 FROM preds s WHERE s.doc_id = m.doc_id AND {over}))
          SELECT * FROM x ORDER BY side, doc_id, "start", value LIMIT 40""",
        "binary_kappa": f"""WITH {O.GOLD}, {O.PREDS}, {O._PLAIN}, {O._islands("q", "gold", "doc_id")}, gm AS (SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM q_i GROUP BY doc_id, island),
          s AS (SELECT lang, sum(length(text))::BIGINT AS n, sum(coalesce((SELECT sum("end" - "start") FROM pm WHERE pm.doc_id = d.doc_id), 0))::BIGINT AS m, sum(coalesce((SELECT sum("end" - "start") FROM gm WHERE gm.doc_id = d.doc_id), 0))::BIGINT AS g,
            sum(coalesce((SELECT sum(least(m."end", s."end") - greatest(m."start", s."start")) FROM pm m JOIN gm s ON m.doc_id = s.doc_id AND {over} WHERE m.doc_id = d.doc_id), 0))::BIGINT AS b FROM documents d GROUP BY 1),
          k AS (SELECT *, (b + (n - m - g + b)) / n::DOUBLE AS po, (m / n::DOUBLE) * (g / n::DOUBLE) + (1 - m / n::DOUBLE) * (1 - g / n::DOUBLE) AS pe FROM s) SELECT lang, n, m, g, b, CASE WHEN 1 - pe = 0 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM k""",
        "over_redaction_rate": f"""WITH {O.GOLD}, {O._MASK}, x AS (SELECT canon, EXISTS (SELECT 1 FROM gold s WHERE s.doc_id = m.doc_id AND {over}) AS hit FROM mask m) SELECT canon, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp, count(*) FILTER (WHERE NOT hit) / count(*)::DOUBLE AS rate FROM x GROUP BY 1""",
        "category_summary": f"""WITH {O._CAUGHT}, x AS (SELECT canon, count(*) FILTER (WHERE NOT covered) AS fn FROM caught GROUP BY 1), y AS (SELECT *, CASE WHEN canon = 'AGE' THEN 'n/a' WHEN canon IN ('MEDICATION', 'PROFESSION', 'DIAGNOSIS') THEN 'special' WHEN canon IN ('PERSON', 'LOCATION', 'DATE', 'PHONE', 'FAX', 'EMAIL', 'URL', 'IP', 'ID') THEN 'applicable' ELSE 'unmapped' END AS kind FROM x)
          SELECT *, CASE WHEN applicable = 0 THEN 0.0 ELSE passed / applicable::DOUBLE END AS removed_frac FROM (SELECT count(*) FILTER (WHERE kind = 'applicable') AS applicable, count(*) FILTER (WHERE kind = 'applicable' AND fn = 0) AS passed,
          coalesce(string_agg(canon, ',' ORDER BY canon) FILTER (WHERE kind = 'n/a'), '') AS "na", coalesce(string_agg(canon, ',' ORDER BY canon) FILTER (WHERE kind = 'special'), '') AS special, coalesce(string_agg(canon, ',' ORDER BY canon) FILTER (WHERE kind = 'unmapped'), '') AS unmapped FROM y)""",
        "mean_leak": f"WITH {O._LEAKS} SELECT avg(recall) AS mean_recall, count(*) FILTER (WHERE leaked > 0) AS docs_with_leaks FROM leaks",
        "transfer_gap": f"WITH {O._CAUGHT}, x AS (SELECT lang, canon, count(*) FILTER (WHERE covered) / count(*)::DOUBLE AS recall FROM caught GROUP BY 1, 2) SELECT x.lang, x.canon, x.recall, x.recall - e.recall AS gap FROM x JOIN x e ON e.lang = 'en' AND e.canon = x.canon",
        "combo_comparison": f"WITH {O._coverage(O._OVER, O._OVER)}, {O._RATED.format('cov')}, z AS (SELECT canon, max(r) FILTER (WHERE combo = 'mail') AS mail, max(r) FILTER (WHERE combo = '{R.DEFAULT}') AS every FROM rated WHERE combo IN ('mail', '{R.DEFAULT}') GROUP BY 1) SELECT *, coalesce(every, 0) - coalesce(mail, 0) AS gain FROM z",
        "run_spread": "SELECT event_type, avg(v)::DOUBLE AS mean, round(stddev_pop(v), 6) AS sd_pop, round(stddev_samp(v), 6) AS sd_sample, min(v) AS low, max(v) AS high FROM (SELECT event_type, round(value * 100)::BIGINT AS v FROM events) GROUP BY 1",
        "latency": "SELECT event_type, min(ms) AS least, quantile_cont(ms, 0.5)::DOUBLE AS median, max(ms) AS most, sum(ms) / count(*)::DOUBLE AS ms_per_doc FROM (SELECT event_type, round(value * 1000)::BIGINT AS ms FROM events) GROUP BY 1",
        "bootstrap_entities": f"""WITH {O._CAUGHT}, e AS (SELECT doc_id, entity_id, bool_and(covered) AS ok FROM caught GROUP BY 1, 2), k AS (SELECT doc_id, count(*) FILTER (WHERE ok) AS c, count(*) AS n FROM e GROUP BY 1), o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, c, n FROM k), z AS (SELECT count(*) AS size FROM o),
          d AS (SELECT it, {_DRAW} % z.size AS ord FROM range(2000) a(it), z, range((SELECT size FROM z)) b(draw)), s AS (SELECT it, sum(c)::DOUBLE / sum(n)::DOUBLE AS x FROM d JOIN o USING (ord) GROUP BY 1)
          SELECT (SELECT x FROM s ORDER BY x LIMIT 1 OFFSET 50) AS lo, (SELECT list_sum(list(x ORDER BY x)) / count(*) FROM s) AS mean, (SELECT x FROM s ORDER BY x LIMIT 1 OFFSET 1949) AS hi""",
        "top_hits": f"{_TOP} SELECT * FROM hits",
        "attack_scorecard": f"{_TOP}, b AS (SELECT client, session, count(*) FILTER (WHERE top3) AS n, count(*) AS o FROM hits GROUP BY 1, 2), s AS (SELECT client, coalesce(max(n) FILTER (WHERE session > 0), 0) AS single_best, coalesce(max(n) FILTER (WHERE session = 0), 0) AS bulk, max(o) AS \"of\" FROM b GROUP BY 1) SELECT *, bulk - single_best AS gain FROM s",
        "risk_classes": f"{_TOP}, {_fixture('survival')}, x AS (SELECT client, count(*) FILTER (WHERE top1) AS top1, count(*) FILTER (WHERE top3) AS top3 FROM hits WHERE session = 0 GROUP BY 1) SELECT client, top1, top3, survival, CASE WHEN top1 >= 2 OR survival >= 0.5 THEN 'HIGH' WHEN top3 >= 1 OR survival >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x JOIN survival USING (client)",
        "inference_rates": f"{_with('tests')}, x AS (SELECT CASE WHEN grouping(client) = 1 THEN 'ALL' ELSE client END AS client, coalesce(sum(n_recovered), 0)::BIGINT AS n_recovered, coalesce(sum(n_tested), 0)::BIGINT AS n_tested FROM tests GROUP BY GROUPING SETS ((client), ())) SELECT *, round(CASE WHEN n_tested = 0 THEN 0.0 ELSE n_recovered / n_tested::DOUBLE END, 4) AS rate FROM x",
        "signal_kept": "SELECT client, sessions::BIGINT AS sessions, mean_kept::DOUBLE AS mean_kept FROM (VALUES ('a', 2, 0.75), ('b', 2, 0.0), ('c', 1, NULL)) t(client, sessions, mean_kept)",
        "pair_bootstrap": f"""WITH {_VERDICTS}, d AS (SELECT it, {_DRAW} % 24 AS ord FROM range(2000) a(it), range(24) b(draw)), x AS (SELECT it, same, called, confidence FROM d JOIN v USING (ord)),
          acc AS (SELECT it, round(count(*) FILTER (WHERE same = called) / count(*)::DOUBLE, 4) AS x FROM x GROUP BY 1),
          wins AS (SELECT p.it, sum(CASE WHEN p.confidence > n.confidence THEN 1.0 WHEN p.confidence = n.confidence THEN 0.5 ELSE 0 END) / count(*) AS a FROM x p JOIN x n ON p.it = n.it WHERE p.same AND NOT n.same GROUP BY 1),
          auc AS (SELECT it, round(coalesce(a, 0.5), 4) AS x FROM range(2000) r(it) LEFT JOIN wins USING (it)), m AS (SELECT 'accuracy' AS measure, x FROM acc UNION ALL SELECT 'auc', x FROM auc)
          SELECT measure, round(list_sum(list(x ORDER BY x)) / count(*), 4) AS mean, list_sort(list(x))[51] AS lo, list_sort(list(x))[1950] AS hi FROM m GROUP BY 1""",
    }
    return out
