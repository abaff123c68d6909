"""DuckDB SQL for the registered queries, built from the same shared relations."""

from __future__ import annotations

from ..functions import labels as L
from ..functions.spans import DETECTORS, Detector
from . import relations as R
from .catalog import POPULATION


def _spans(d: Detector, rank: int) -> str:
    """Matches of one pattern with offsets, from the pieces between them."""
    p = d.pattern.replace("'", "''")
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    start = f"({size.format('g[1:i]')} + {size.format('m[1:i - 1]')})::BIGINT"
    return f"""SELECT doc_id, client, lang, '{d.name}' AS detector, {rank} AS layer_rank, i - 1 AS seq, {start} AS "start",
      {start} + length(m[i]) AS "end", '{d.label}' AS label, m[i] AS value, {d.confidence} AS confidence
    FROM (SELECT doc_id, client, lang, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, source AS client, lang, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g
      FROM documents WHERE regexp_matches(text, '{p}')))"""


def _case(x: str, table: dict, other: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {' '.join(f'WHEN {x} = {q(k)} THEN {q(v)}' for k, v in table.items())} ELSE {other} END"


_CANON = _case("upper(label)", L.CANONICAL, "upper(label)")
_QUASI = ", ".join(f"'{x}'" for x in L.QUASI)
_UNION = "\n    UNION ALL\n    "
_COMBOS = ", ".join(f"('{c}', '{x}', {i})" for c, xs in R.COMBOS.items() for i, x in enumerate(xs))

GOLD = f"""gold AS MATERIALIZED (SELECT *, {_CANON} AS canon, lower(value) AS entity_id,
    CASE WHEN {_CANON} IN ({_QUASI}) THEN 'quasi' ELSE 'direct' END AS identifier_class FROM (
    {_UNION.join(_spans(d, i) for i, d in enumerate(R.GOLD))}))"""
PREDS = f"""preds AS MATERIALIZED (SELECT *, {_CANON} AS canon FROM (
    {_UNION.join(_spans(d, i) for i, d in enumerate(R.LAYERS))}))"""
COMBO = f"""combo AS MATERIALIZED (SELECT c.combo, p.* EXCLUDE (layer_rank), c.layer_rank
    FROM preds p JOIN (VALUES {_COMBOS}) c(combo, detector, layer_rank) USING (detector))"""


def _islands(name: str, source: str, keys: str, order: str = '"start", "end" DESC, layer_rank, seq') -> str:
    return f"""{name}_o AS (SELECT *, row_number() OVER w AS ord, max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
    {name}_g AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" >= before THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ord) AS island FROM {name}_o),
    {name}_i AS MATERIALIZED (SELECT *, min("start") OVER (PARTITION BY {keys}, island) AS island_start, min(ord) OVER (PARTITION BY {keys}, island) AS first_ord,
      first_value(confidence) OVER (PARTITION BY {keys}, island ORDER BY ord) AS first_conf FROM {name}_g)"""


def _longest(name: str, source: str, keys: str) -> str:
    return f"""{_islands(name, source, keys)},
    {name} AS MATERIALIZED (SELECT {keys}, min("start") AS "start", max("end") AS "end",
      arg_max(canon, ord) FILTER (WHERE ord = first_ord OR "end" - "start" > before - island_start) AS canon,
      list_sort(list_distinct(list(canon))) AS canons FROM {name}_i GROUP BY {keys}, island)"""


_PLAIN = f"""{_islands("p", "preds", "doc_id")}, pm AS MATERIALIZED (SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM p_i GROUP BY doc_id, island)"""
_MASK = f"{PREDS}, {_longest('mask', 'preds', 'doc_id')}"
_CMASK = f"{PREDS}, {COMBO}, {_longest('cmask', 'combo', 'combo, doc_id')}"
_OVER = 'm."start" < g."end" AND g."start" < m."end"'
_EXACT = 'm."start" = g."start" AND m."end" = g."end"'
_CONTAIN = _OVER + ' AND 5 * (least(m."end", g."end") - greatest(m."start", g."start")) >= 4 * (g."end" - g."start")'
_NAMES = ", ".join(f"('{c}')" for c in R.COMBOS)


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


def _f(p: str, r: str, b: int) -> str:
    return f"CASE WHEN {b} * {p} + {r} = 0 THEN 0.0::DOUBLE ELSE {1 + b}::DOUBLE * {p} * {r} / ({b}::DOUBLE * {p} + {r}) END"


def _coverage(recall: str, precision: str, typed: bool = False) -> str:
    t = " AND list_contains(m.canons, g.canon)" if typed else ""
    return f"""{GOLD}, {_CMASK},
    names(combo) AS (VALUES {_NAMES}),
    rec AS (SELECT n.combo, g.canon, count(*) AS support, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM cmask m WHERE m.combo = n.combo AND m.doc_id = g.doc_id AND {recall}{t})) AS c FROM gold g, names n GROUP BY 1, 2),
    pre AS (SELECT m.combo, m.canon, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM gold g WHERE m.doc_id = g.doc_id AND {precision}{t})) AS hit FROM cmask m WHERE m.doc_id IN (SELECT doc_id FROM gold) GROUP BY 1, 2),
    cov AS (SELECT combo, canon, coalesce(c, 0) AS c, coalesce(support, 0) - coalesce(c, 0) AS fn, coalesce(hit, 0) AS pred_hit, coalesce(n, 0) - coalesce(hit, 0) AS fp FROM rec FULL JOIN pre USING (combo, canon)),
    tot AS (SELECT combo, CASE WHEN grouping(canon) = 1 THEN 'ALL' ELSE canon END AS canon, sum(c)::BIGINT AS c, sum(fn)::BIGINT AS fn, sum(pred_hit)::BIGINT AS pred_hit, sum(fp)::BIGINT AS fp
      FROM cov GROUP BY GROUPING SETS ((combo, canon), (combo)))"""


_RATED = f"""rp AS (SELECT *, {_ratio('pred_hit', 'pred_hit + fp')} AS p, {_ratio('c', 'c + fn')} AS r FROM {{}}), rated AS (SELECT *, {_f('p', 'r', 1)} AS f1, {_f('p', 'r', 4)} AS f2 FROM rp)"""
_CAUGHT = f"{GOLD}, {_MASK}, caught AS MATERIALIZED (SELECT g.*, EXISTS (SELECT 1 FROM mask m WHERE m.doc_id = g.doc_id AND {_OVER}) AS covered FROM gold g)"
_ENT = """ent AS (SELECT entity_id, arg_min(canon, row(doc_id, "start", detector)) AS canon, arg_min(identifier_class, row(doc_id, "start", detector)) AS identifier_class, bool_and(covered) AS protected FROM caught GROUP BY 1)"""
_LEAKS = f"""{GOLD}, {_MASK}, lk AS (SELECT doc_id, count(*) AS gold, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.doc_id = g.doc_id AND {_CONTAIN})) AS leaked FROM gold g GROUP BY 1),
    leaks AS (SELECT d.doc_id, length(d.text)::BIGINT AS chars, coalesce(leaked, 0) AS leaked, coalesce(gold, 0) AS gold, CASE WHEN coalesce(gold, 0) = 0 THEN 1.0::DOUBLE ELSE (gold - leaked) / gold::DOUBLE END AS recall FROM documents d LEFT JOIN lk USING (doc_id))"""
_PRIORS = f"""{GOLD}, pri AS (SELECT client, canon, CASE canon WHEN 'EMAIL' THEN 1.0::DOUBLE / 1024 WHEN 'PHONE' THEN 1.0::DOUBLE / 4096 WHEN 'ID' THEN 1.0::DOUBLE / 65536 WHEN 'IP' THEN 1.0::DOUBLE / 256 END AS prior FROM (SELECT DISTINCT client, canon FROM gold)),
    priors AS (SELECT * FROM pri WHERE prior IS NOT NULL)"""
_UNITS = """units AS (SELECT doc_id, source AS client, length(text) AS chars FROM documents),
    allp AS (SELECT a.doc_id AS a, b.doc_id AS b, a.client = b.client AS same, -abs(a.chars - b.chars) AS score FROM units a JOIN units b ON a.doc_id < b.doc_id),
    pairs AS (SELECT a, b, same, score FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY a, b) - 1 AS r FROM allp) WHERE same OR (r % 5 = 0 AND r < 200))"""


def _auc(source: str, truth: str, score: str) -> str:
    return f"""SELECT n_pos, n_neg, CASE WHEN n_pos = 0 OR n_neg = 0 THEN 0.5 ELSE w / (2.0::DOUBLE * n_pos * n_neg) END AS auc FROM (
      SELECT (SELECT count(*) FROM {source} WHERE {truth}) AS n_pos, (SELECT count(*) FROM {source} WHERE NOT ({truth})) AS n_neg,
        (SELECT coalesce(sum(CASE WHEN p.{score} > n.{score} THEN 2 WHEN p.{score} = n.{score} THEN 1 ELSE 0 END), 0)::BIGINT FROM {source} p, {source} n WHERE (p.{truth}) AND NOT (n.{truth})) AS w)"""


def _kappa(source: str, a: str, b: str, n: str) -> str:
    return f"""SELECT n, same, CASE WHEN n::DOUBLE * n = xy::DOUBLE THEN 1.0 ELSE (same::DOUBLE * n - xy) / (n::DOUBLE * n - xy) END AS kappa FROM (
      SELECT (SELECT sum({n})::BIGINT FROM {source}) AS n, (SELECT coalesce(sum({n}) FILTER (WHERE {a} = {b}), 0)::BIGINT FROM {source}) AS same,
        (SELECT coalesce(sum(x * y), 0)::DOUBLE FROM (SELECT {a} AS k, sum({n}) AS x FROM {source} GROUP BY 1) JOIN (SELECT {b} AS k, sum({n}) AS y FROM {source} GROUP BY 1) USING (k)) AS xy)"""


_ANN = f"""{GOLD}, {PREDS}, ann AS MATERIALIZED (
    SELECT doc_id, "start", "end", canon AS label, layer_rank, seq, 'gold' AS who, 1.0 AS confidence FROM gold UNION ALL
    SELECT doc_id, "start", "end", canon, layer_rank, seq, 'a1', 1.0 FROM preds WHERE detector <> 'digits' UNION ALL
    SELECT doc_id, "start", "end", canon, layer_rank, seq, 'a2', 1.0 FROM preds WHERE detector <> 'phone')"""


def _label(who: str) -> str:
    return f"""coalesce((SELECT arg_max(a.label, row(a."end" - a."start", a.layer_rank, a.seq)) FROM ann a WHERE a.who = '{who}' AND a.doc_id = s.doc_id AND a."start" <= s.f AND a."end" >= s.t), 'O') AS {who}"""


_SEG = f"""{_ANN}, ed AS (SELECT doc_id, "start" AS pt FROM ann UNION SELECT doc_id, "end" FROM ann UNION SELECT doc_id, 0 FROM ann UNION SELECT doc_id, length(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM ann)),
    sg AS (SELECT doc_id, pt AS f, lead(pt) OVER (PARTITION BY doc_id ORDER BY pt) AS t FROM ed),
    seg AS MATERIALIZED (SELECT s.t - s.f AS len, {_label('gold')}, {_label('a1')}, {_label('a2')} FROM sg s WHERE t IS NOT NULL)"""

_SPAN_COLUMNS = 'doc_id, seq, "start", "end", label, value'

#: What each detector finds in the samples, written down by hand: (doc_id, seq, start, end, label, value).
EXPECTED = {
    "email": [(-5, 0, 63, 69, "EMAIL", "a@b.ru")],
    "phone": [],
    "phone_ru": [(-5, 0, 79, 97, "PHONE", "+7 (912) 345-67-89"), (-5, 1, 102, 117, "PHONE", "8 912 345 67 89")],
    "id16": [],
    "grouped_id": [(-1, 0, 6, 25, "ID", "1234 5678 9012 3456"), (-1, 1, 33, 47, "ID", "7722-4455-8811")],
    "ip": [],
    "secret": [],
    "url": [(-5, 0, 36, 55, "URL", "https://vk.com/id77"), (-7, 0, 137, 159, "URL", "www.example.org/a?b=1.")],
    "numeric_date": [(-1, 0, 54, 64, "DATE", "15.01.2024"), (-1, 1, 69, 75, "DATE", "3/4/99"), (-1, 2, 77, 93, "DATE", "1984-08-08T00:00"), (-7, 0, 69, 79, "DATE", "2024-01-15")],
    "en_date": [
        (-4, 0, 7, 19, "DATE", "last Tuesday"), (-4, 1, 21, 34, "DATE", "two weeks ago"), (-4, 2, 39, 60, "DATE", "the 19th of the month"),
        (-4, 3, 62, 77, "DATE", "March 3rd, 2024"), (-4, 4, 79, 90, "DATE", "12 December"), (-4, 5, 95, 106, "DATE", "December/48"),
    ],
    "ru_date": [
        (-3, 0, 11, 28, "DATE", "в прошлый вторник"), (-3, 1, 30, 46, "DATE", "3 дня тому назад"), (-3, 2, 48, 64, "DATE", "третьего февраля"),
        (-3, 3, 66, 76, "DATE", "12 декабря"), (-3, 4, 79, 93, "DATE", "до Нового года"), (-6, 0, 68, 79, "DATE", "7 лет назад"),
    ],
    "snils": [(-2, 0, 6, 20, "ID", "123-456-789 01")],
    "passport": [(-2, 0, 30, 41, "ID", "4510\t123456")],
    "inn": [(-2, 0, 48, 58, "ID", "7707083893"), (-2, 1, 72, 84, "ID", "500100732259")],
    "handle": [(-5, 0, 8, 19, "URL", "t.me/ivan_p"), (-5, 1, 25, 34, "URL", "@marina.k"), (-5, 2, 36, 55, "URL", "https://vk.com/id77")],
    "patronymic": [(-6, 0, 6, 15, "PERSON", "Маратович"), (-6, 1, 23, 32, "PERSON", "Сергеевна")],
}
#: Patterns as the SQL engine writes them, for the documents; the detectors left out need look-arounds or Cyrillic word edges, and find nothing there.
SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "id16": r"\b[0-9]{16}\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "secret": r"\b[0-9a-f]{32,}\b",
    "url": r"(?:https?://|www\.)[A-Za-z0-9._~/?#=&%:+-]+",
    "grouped_id": r"\b\d{4}[\s-]\d{4}[\s-]\d{2,4}(?:[\s-]\d{2,4})?\b",
    "snils": r"\b\d{3}-\d{3}-\d{3}[ -]\d{2}\b",
    "passport": r"\b\d{4}\s\d{6}\b",
    "numeric_date": r"\b(?:(?:[12][0-9]|3[01]|0?[1-9])[./](?:1[0-2]|0?[1-9])[./][0-9]{2,4}|[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?)\b",
    "en_date": r"(?i)\b(?:yesterday|tomorrow|today|(?:last|next|this)\s+(?:week|month|year)|(?:last|next|this|on)\s+(?:mon|tues|wednes|thurs|fri|satur|sun)day"
    r"|(?:\d{1,3}|a|an|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(?:day|week|month|year)s?\s+ago)\b",
}


def literal(rows: list[tuple], columns: str) -> str:
    """Rows written out as SQL."""
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({columns}))"


def _detector(name: str) -> str:
    parts = []
    if name in SQL_PATTERNS:
        d = DETECTORS[name]
        parts.append(f"SELECT {_SPAN_COLUMNS} FROM ({_spans(Detector(name, d.label, SQL_PATTERNS[name]), 0)})")
    if EXPECTED[name]:
        parts.append(f"SELECT * FROM {literal(EXPECTED[name], _SPAN_COLUMNS)}")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    out = {f"spans_{n}": _detector(n) for n in DETECTORS}
    pub = ", ".join(f"'{x}'" for x in L.PUBLISHABLE)
    out |= {
        "span_union_by_combo": f"WITH {PREDS}, {COMBO} SELECT combo, canon, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM combo GROUP BY 1, 2",
        "safe_label_counts": f"WITH {PREDS} SELECT CASE WHEN upper(label) IN ({pub}) THEN upper(label) ELSE 'OTHER' END AS label, count(*) AS n FROM preds GROUP BY 1",
        "mask_merge": f"WITH {PREDS}, {_PLAIN} SELECT * FROM pm",
        "mask_first_label": f"""WITH {PREDS}, {_islands("p", "preds", "doc_id")} SELECT doc_id, min("start") AS "start", max("end") AS "end", arg_min(label, ord) AS label FROM p_i GROUP BY doc_id, island""",
        "mask_longest_label": f"""WITH {_CMASK} SELECT combo, doc_id, "start", "end", canon, array_to_string(canons, ',') AS canons FROM cmask""",
        "mask_confidence_label": f"""WITH {PREDS}, {_islands("p", "preds", "doc_id")} SELECT doc_id, min("start") AS "start", max("end") AS "end", arg_max(label, ord) FILTER (WHERE ord = first_ord OR confidence > first_conf) AS label FROM p_i GROUP BY doc_id, island""",
        "redacted_text": f"""WITH {_MASK}, x AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS after FROM mask),
          y AS (SELECT x.doc_id, string_agg(substring(d.text, x.after + 1, x."start" - x.after) || '<' || x.canon || '>', '' ORDER BY x."start") AS body, max(x."end") AS last FROM x JOIN documents d USING (doc_id) GROUP BY 1)
          SELECT d.doc_id, CASE WHEN y.doc_id IS NULL THEN d.text ELSE y.body || substring(d.text, y.last + 1) END AS redacted FROM documents d LEFT JOIN y USING (doc_id)""",
        "redaction_rate_by_lang": f"""WITH {PREDS}, {_PLAIN}, x AS (SELECT doc_id, sum("end" - "start") AS masked, count(*) AS n FROM pm GROUP BY 1)
          SELECT lang, n_docs, chars, masked, n_masks, {_ratio('masked', 'chars')} AS rate FROM (SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS chars, coalesce(sum(masked), 0)::BIGINT AS masked, coalesce(sum(n), 0)::BIGINT AS n_masks FROM documents LEFT JOIN x USING (doc_id) GROUP BY 1)""",
        "counts_by_type_and_layer": f"WITH {PREDS} SELECT coalesce(canon, '-') AS canon, coalesce(detector, '-') AS detector, count(*) AS n FROM preds GROUP BY GROUPING SETS ((canon), (detector), ())",
        "offset_validity": f"""WITH {PREDS} SELECT count(*) AS n, count(*) FILTER (WHERE NOT ("start" >= 0 AND "start" < "end" AND "end" <= length(text) AND substring(text, "start" + 1, "end" - "start") = value)) AS invalid FROM preds JOIN documents USING (doc_id)""",
        "coverage_relaxed": f"WITH {_coverage(_OVER, _OVER)}, {_RATED.format('tot')} SELECT * FROM rated",
        "coverage_strict": f"WITH {_coverage(_EXACT, _EXACT)} SELECT * FROM tot",
        "coverage_containment": f"WITH {_coverage(_CONTAIN, _OVER)} SELECT * FROM tot",
        "coverage_typed": f"WITH {_coverage(_OVER, _OVER, True)} SELECT * FROM tot",
        "coverage_typed_strict": f"WITH {_coverage(_EXACT, _EXACT, True)} SELECT * FROM tot",
        "macro_metrics": f"WITH {_coverage(_OVER, _OVER)}, {_RATED.format('cov')} SELECT combo, count(*) AS n_types, avg(f1) AS macro_f1, avg(r) AS macro_r FROM rated WHERE c + fn > 0 GROUP BY 1",
        "leaked_spans_anti": f"""WITH {_CAUGHT} SELECT doc_id, detector, seq, "start", "end", canon FROM caught WHERE NOT covered""",
        "over_redaction_anti": f"""WITH {GOLD}, {_MASK} SELECT m.doc_id, m."start", m."end", m.canon FROM mask m WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.identifier_class = 'direct' AND g.doc_id = m.doc_id AND {_OVER})""",
        "unique_captures": f"""WITH {GOLD}, {PREDS} SELECT canon, count(*) AS n FROM gold g WHERE NOT EXISTS (SELECT 1 FROM preds m WHERE m.detector = 'mail' AND m.doc_id = g.doc_id AND {_OVER}) AND EXISTS (SELECT 1 FROM preds m WHERE m.detector = 'digits' AND m.doc_id = g.doc_id AND {_OVER}) GROUP BY 1""",
        "entity_recall": f"""WITH {_CAUGHT}, {_ENT} SELECT *, {_ratio('protected', 'total')} AS recall FROM (SELECT coalesce(identifier_class, '-') AS identifier_class, coalesce(canon, '-') AS canon, count(*) FILTER (WHERE protected) AS protected, count(*) AS total FROM ent GROUP BY GROUPING SETS ((identifier_class), (canon), ()))""",
        "harm_weighted_recall": f"""WITH {_CAUGHT}, {_ENT}, h AS (SELECT protected, {_case('canon', L.HARM, str(L.DEFAULT_HARM))} AS w FROM ent) SELECT *, {_ratio('got', 'weight')} AS recall FROM (SELECT coalesce(sum(w) FILTER (WHERE protected), 0)::BIGINT AS got, coalesce(sum(w), 0)::BIGINT AS weight FROM h)""",
        "split_headline": f"""WITH {_CAUGHT} SELECT *, {_ratio('c', 'n')} AS recall FROM (SELECT CASE WHEN regexp_extract(client, '[0-9]+')::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS split, count(*) FILTER (WHERE covered) AS c, count(*) AS n FROM caught GROUP BY 1)""",
        "leaks_per_document": f"WITH {_LEAKS} SELECT * FROM leaks",
        "worst_case_leak": f"""WITH {_LEAKS} SELECT min(recall) AS min_recall, quantile_cont(recall, 0.1) AS p10_recall, sum(leaked)::BIGINT AS leaked, sum(gold)::BIGINT AS gold, sum(chars)::BIGINT AS chars, sum(leaked)::BIGINT * 10000.0::DOUBLE / sum(chars)::BIGINT AS leaks_per_10k, arg_min(doc_id, row(recall, -leaked, doc_id)) AS worst_doc FROM leaks""",
        "category_pass": f"""WITH {_CAUGHT} SELECT category, support, fn, fn = 0 AS passed FROM (SELECT {_case('canon', L.CATEGORY | dict.fromkeys(L.NOT_APPLICABLE, 'n/a') | dict.fromkeys(L.SPECIAL, 'special'), "'unmapped'")} AS category, count(*) AS support, count(*) FILTER (WHERE NOT covered) AS fn FROM caught GROUP BY 1)""",
        "residual_tier": f"""WITH {_CAUGHT}, {_ENT}, r AS (SELECT entity_id, bool_and(canon IN ('PHONE', 'ID') AND NOT regexp_matches(value, '[0-9]')) AS o FROM caught WHERE identifier_class = 'direct' AND NOT covered GROUP BY 1)
          SELECT *, CASE WHEN direct > 0 THEN 'RED' WHEN special > 0 THEN 'AMBER' ELSE 'GREEN' END AS tier FROM (SELECT (SELECT count(*) FROM r WHERE NOT o) AS direct, (SELECT count(*) FROM r WHERE o) AS out_of_scope, (SELECT count(*) FROM ent WHERE canon = 'MEDICATION' AND NOT protected) AS special)""",
        "quasi_survivors": f"""WITH {_CAUGHT}, q AS (SELECT client, entity_id, bool_or(NOT covered) AS survives, min(canon) AS canon FROM caught WHERE identifier_class = 'quasi' GROUP BY 1, 2)
          SELECT *, {_ratio('survivors', 'total')} AS rate FROM (SELECT client, count(*) FILTER (WHERE survives) AS survivors, count(*) AS total, coalesce(string_agg(DISTINCT canon, ',' ORDER BY canon) FILTER (WHERE survives), '') AS types FROM q GROUP BY 1)""",
        "expected_matches": f"WITH {_PRIORS} SELECT client, count(*) AS dims, {POPULATION}::DOUBLE * product(prior) AS expected, {POPULATION}::DOUBLE * product(prior) < 1 AS singled_out FROM priors GROUP BY 1",
        "sensitivity_sweep": f"""WITH {_PRIORS}, sc AS (SELECT client, canon AS which FROM priors UNION SELECT client, '*' FROM priors),
          e AS (SELECT s.client, s.which, f.x, {POPULATION}::DOUBLE * product(CASE WHEN s.which IN ('*', p.canon) THEN least(1.0::DOUBLE, p.prior * f.x) ELSE p.prior END) AS expected FROM sc s JOIN priors p USING (client), (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) f(x) GROUP BY 1, 2, 3),
          b AS (SELECT client, {POPULATION}::DOUBLE * product(prior) AS base FROM priors GROUP BY 1)
          SELECT client, min(expected) AS low, max(expected) AS high, bool_and((expected < 1) = (base < 1)) AS robust FROM e JOIN b USING (client) GROUP BY 1""",
        "stride_sample": f"WITH {_UNITS} SELECT a, b, same FROM pairs",
        "confusion_metrics": f"""WITH {_UNITS}, n AS (SELECT count(*) FILTER (WHERE same AND score > -500) AS tp, count(*) FILTER (WHERE NOT same AND score > -500) AS fp, count(*) FILTER (WHERE same AND score <= -500) AS fn, count(*) FILTER (WHERE NOT same AND score <= -500) AS tn FROM pairs),
          r AS (SELECT *, {_ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_ratio('tp', 'tp + fp')} AS p, {_ratio('tp', 'tp + fn')} AS r, {_ratio('tp + fn', 'tp + fp + fn + tn')} AS base_rate FROM n)
          SELECT *, {_f('p', 'r', 1)} AS f1, greatest(base_rate, 1 - base_rate) AS majority FROM r""",
        "roc_auc": f"WITH {_UNITS} {_auc('pairs', 'same', 'score')}",
        "label_auc": f"WITH x AS (SELECT quality = 1 AS good, n_chars FROM labels JOIN documents USING (doc_id)) {_auc('x', 'good', 'n_chars')}",
        "cohen_kappa_labels": f"WITH x AS (SELECT quality AS a, 1 - toxic AS b, 1 AS n FROM labels) {_kappa('x', 'a', 'b', 'n')}",
        "cohen_kappa_segments": f"WITH {_SEG} {_kappa('seg', 'gold', 'a2', 'len')}",
        "fleiss_kappa": f"""WITH {_SEG}, q AS (SELECT sum(len)::BIGINT AS n, sum(len * ((gold = a1)::INT + (gold = a2)::INT + (a1 = a2)::INT))::BIGINT AS same FROM seg),
          s AS (SELECT sum(x * x)::BIGINT AS xx FROM (SELECT k, sum(len)::BIGINT AS x FROM (SELECT len, unnest([gold, a1, a2]) AS k FROM seg) GROUP BY 1)), y AS (SELECT n, same, xx, xx / (9.0::DOUBLE * n * n) AS pe, same / (3.0::DOUBLE * n) AS pa FROM q, s)
          SELECT n, same, xx, CASE WHEN pe = 1 THEN 1.0 ELSE (pa - pe) / (1 - pe) END AS kappa FROM y""",
        "span_f1_pairwise": f"""WITH {_ANN}, pr(i, j) AS (VALUES ('a1', 'a2'), ('a1', 'gold'), ('a2', 'gold')),
          l AS (SELECT i, j, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ann g WHERE g.who = j AND g.doc_id = m.doc_id AND g.label = m.label AND {_OVER})) AS tp FROM ann m JOIN pr ON m.who = i GROUP BY 1, 2),
          r AS (SELECT i, j, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM ann g WHERE g.who = i AND g.doc_id = m.doc_id AND g.label = m.label AND {_OVER})) AS fn FROM ann m JOIN pr ON m.who = j GROUP BY 1, 2)
          SELECT i, j, tp, fp, fn, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT i, j, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, coalesce(fn, 0) AS fn FROM pr LEFT JOIN l USING (i, j) LEFT JOIN r USING (i, j))""",
        "cluster_majority": f"""WITH {_ANN}, {_islands("c", "ann", "doc_id", '"start", "end", who, layer_rank, seq')},
          b AS (SELECT doc_id, island_start, label, count(*) AS n, min(ord) AS o, min("start") AS s, max("end") AS e FROM c_i GROUP BY 1, 2, 3)
          SELECT doc_id, island_start AS cluster_start, arg_max(label, row(n, -o)) AS label, arg_max(s, row(n, -o)) AS "start", arg_max(e, row(n, -o)) AS "end", max(n) AS votes, count(*) = 1 AS unanimous FROM b GROUP BY 1, 2""",
        "nonpii_preservation": f"""WITH {GOLD}, {PREDS}, {_PLAIN}, {_islands("q", "gold", "doc_id")}, gm AS (SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM q_i GROUP BY doc_id, island)
          SELECT *, 1 - (masked - shared) / (chars - pii)::DOUBLE AS kept FROM (SELECT (SELECT sum("end" - "start")::BIGINT FROM pm) AS masked, (SELECT sum("end" - "start")::BIGINT FROM gm) AS pii,
            (SELECT coalesce(sum(least(m."end", g."end") - greatest(m."start", g."start")), 0)::BIGINT FROM pm m JOIN gm g ON m.doc_id = g.doc_id AND {_OVER}) AS shared, (SELECT sum(length(text))::BIGINT FROM documents) AS chars)""",
        "turn_asof": "SELECT a.conv_id, a.turn, coalesce(max(u.turn), -1) AS user_turn FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.role = 'user' AND u.turn <= a.turn WHERE a.role = 'assistant' GROUP BY 1, 2",
        "role_turn_counts": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1",
        "run_islands": """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS x FROM events),
          i AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e), r AS (SELECT user_id, island, event_type, count(*) AS n FROM i GROUP BY 1, 2, 3)
          SELECT event_type, count(*) AS runs, max(n) AS longest, sum(n)::BIGINT AS events FROM r GROUP BY 1""",
        "fixed_windows": 'SELECT doc_id, (s // 1050)::BIGINT AS chunk, s::BIGINT AS "start", least(s + 1200, n)::BIGINT AS "end" FROM (SELECT doc_id, length(text) AS n, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text), 1050) END) AS s FROM documents)',
        "pseudonym_rank": f"""WITH {GOLD} SELECT doc_id, value, dense_rank() OVER (PARTITION BY doc_id ORDER BY f) AS number FROM (SELECT doc_id, trim(value) AS value, min("start") AS f FROM gold WHERE canon = 'EMAIL' GROUP BY 1, 2)""",
        "duplicate_text_hash": "SELECT substring(sha256(text), 1, 12) AS sha, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
        "corpus_fingerprint": """WITH b AS (SELECT lang, doc_id // 1024 AS bucket, count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2),
          t AS (SELECT lang, bucket // 1024 AS bucket, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY bucket)) AS h FROM b GROUP BY 1, 2)
          SELECT lang, sum(n)::BIGINT AS n_docs, substring(sha256(string_agg(h, '' ORDER BY bucket)), 1, 12) AS sha FROM t GROUP BY 1""",
        "manifest_validation": "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra",
        "resume_anti_join": "SELECT lang, count(*) AS todo FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
        "metric_drift_full_outer": f"""WITH {GOLD}, {PREDS}, g AS (SELECT canon, count(*) AS committed FROM gold GROUP BY 1), p AS (SELECT canon, count(*) AS fresh FROM preds GROUP BY 1)
          SELECT canon, coalesce(committed, 0) AS committed, coalesce(fresh, 0) AS fresh, coalesce(fresh, 0) - coalesce(committed, 0) AS drift FROM g FULL JOIN p USING (canon)""",
        "run_variance": "SELECT event_type, count(*) AS n, min(v) AS low, quantile_cont(v, 0.5)::DOUBLE AS median, max(v) AS high, sum(v)::BIGINT AS total, sum(v * v)::BIGINT AS squares FROM (SELECT event_type, round(value * 100)::BIGINT AS v FROM events) GROUP BY 1",
        "registry_latest": "SELECT event_type, arg_max(event_id, row(ts, event_id)) AS event_id, count(*) AS records FROM events GROUP BY 1",
        "located_benchmark_values": f"""WITH {GOLD}, v AS (SELECT DISTINCT doc_id, value FROM gold WHERE canon = 'EMAIL'),
          x AS (SELECT doc_id, value, string_split(lower(text), lower(value)) AS g FROM v JOIN documents USING (doc_id)),
          y AS (SELECT doc_id, value, g, unnest(range(1, len(g))) AS i FROM x)
          SELECT doc_id, value, i - 1 AS seq, (list_sum(list_transform(g[1:i], lambda s: length(s))) + (i - 1) * length(value))::BIGINT AS "start", (list_sum(list_transform(g[1:i], lambda s: length(s))) + i * length(value))::BIGINT AS "end" FROM y""",
        "chunk_boundaries": """WITH RECURSIVE c AS (
            SELECT doc_id, text, length(text) AS n, 0 AS chunk, 0 AS s, CASE WHEN length(text) <= 2500 THEN length(text) END AS e FROM documents WHERE length(text) > 0
            UNION ALL SELECT doc_id, text, n, chunk + CASE WHEN e IS NULL THEN 0 ELSE 1 END,
              CASE WHEN e IS NULL THEN s ELSE greatest(e - 200, s + 1) END,
              CASE WHEN e IS NOT NULL THEN CASE WHEN greatest(e - 200, s + 1) + 2500 >= n THEN n END ELSE s + 833 + coalesce(
                (SELECT length(w) - strpos(reverse(w), reverse(x)) + 1 FROM (SELECT substring(text, s + 834, 1667) AS w), (VALUES (1, chr(10) || chr(10)), (2, chr(10)), (3, '. '), (4, '? '), (5, '! ')) v(k, x)
                 WHERE strpos(reverse(w), reverse(x)) > 0 ORDER BY k LIMIT 1), 1667) END
            FROM c WHERE e IS NULL OR e < n)
          SELECT doc_id, chunk::BIGINT AS chunk, s::BIGINT AS "start", e::BIGINT AS "end" FROM c WHERE e IS NOT NULL""",
        "bootstrap_recall": f"""WITH {_CAUGHT}, k AS (SELECT doc_id, count(*) FILTER (WHERE covered) AS c, count(*) AS n FROM caught GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, c, n FROM k), z AS (SELECT count(*) AS size FROM o),
          d AS (SELECT it, ((((it * 7919 + draw * 104729 + 20260601) * 48271) % 2147483647) * 16807 % 2147483647) % z.size AS ord FROM range(2000) a(it), z, range((SELECT size FROM z)) b(draw)),
          s AS (SELECT it, sum(c)::DOUBLE / sum(n)::DOUBLE AS x FROM d JOIN o USING (ord) GROUP BY 1)
          SELECT (SELECT x FROM s ORDER BY x LIMIT 1 OFFSET 50) AS lo, (SELECT list_sum(list(x ORDER BY x)) / count(*) FROM s) AS mean, (SELECT x FROM s ORDER BY x LIMIT 1 OFFSET 1949) AS hi""",
    }
    return out
