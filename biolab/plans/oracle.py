"""The engine's queries in DuckDB's SQL, as far as SQL can express them. Only tables of values are shared with the Spark side."""

from __future__ import annotations

from biolab.functions import fixed_values as V
from biolab.sources import catalog
from biolab.sources.measurements import NAMES


def q(s) -> str:
    if s is None:
        return "NULL"
    return repr(s) if isinstance(s, (int, float)) else "'" + s.replace("'", "''") + "'"


def arr(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]" + ("::varchar[]" if not xs else "")


def values(name: str, cols: str, rows) -> str:
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(x if isinstance(x, str) and x[:1] in "[{" and not x.startswith("[[") else q(x) for x in r) + ")" for r in rows) + ")"


FLOAT = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def num(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{FLOAT}') THEN TRY_CAST({x} AS DOUBLE) END)"


def pick(i: int, at: str) -> str:
    return f"({arr([n[i] for n in NAMES])})[{at} % {len(NAMES)} + 1]"


M = f"""m0 AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::int AS ord,
 l_quantity::int AS q, abs(round(l_discount * 100))::int AS d, l_partkey, l_suppkey, l_linenumber, o_custkey AS patient_id, o_orderdate::date AS date
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT doc_id, ord, patient_id, date, {pick(0, 'l_partkey')} AS raw_name,
 CASE l_suppkey % 10 WHEN 0 THEN q::varchar WHEN 1 THEN q || '.' || lpad(d::varchar, 2, '0') WHEN 2 THEN q || ',' || d WHEN 3 THEN '<' || q WHEN 4 THEN '>= ' || q || '.5'
 WHEN 5 THEN '1,' || lpad(q::varchar, 3, '0') WHEN 6 THEN ' 1.' || lpad(q::varchar, 3, '0') || ',' || d WHEN 7 THEN q || '.' || lpad(d::varchar, 3, '0') WHEN 8 THEN 'n/a ' || q ELSE '≤' || q END AS raw_value,
 CASE l_linenumber % 4 WHEN 3 THEN '' WHEN 2 THEN {pick(2, 'l_partkey')} ELSE {pick(1, 'l_partkey')} END AS raw_unit FROM m0)"""


def parse(raw: str) -> str:
    """Columns value, ambiguous, strategy of ``raw``, from FROM-clause steps n1 and n2."""
    return f"""n1 AS (SELECT *, trim(regexp_replace(trim({raw}), '^(<=)*(>=)*<*>*≤*≥*', '')) AS p FROM src),
n2 AS (SELECT *, len(p) - len(replace(p, ',', '')) AS nc, len(p) - len(replace(p, '.', '')) AS nd, string_split(p, ',')[-1] AS bc, string_split(p, '.')[-1] AS bd FROM n1),
n3 AS (SELECT *, CASE WHEN nc > 0 AND nd > 0 THEN CASE WHEN len(bc) < len(bd) THEN 'decimal_comma' ELSE 'decimal_dot' END
 WHEN nc > 1 OR nc = 1 AND regexp_full_match(bc, '[0-9]{{3}}') THEN 'thousands_comma' WHEN nc = 1 THEN 'decimal_comma' WHEN nd > 1 THEN 'thousands_dot' WHEN nd = 1 THEN 'decimal_dot' ELSE 'plain' END AS st FROM n2),
n4 AS (SELECT *, CASE st WHEN 'decimal_comma' THEN replace(CASE WHEN nd > 0 THEN replace(p, '.', '') ELSE p END, ',', '.') WHEN 'thousands_comma' THEN replace(p, ',', '')
 WHEN 'thousands_dot' THEN replace(p, '.', '') WHEN 'decimal_dot' THEN replace(p, ',', '') ELSE p END AS txt,
 NOT (nc > 0 AND nd > 0) AND (nc = 1 AND strlen(bc) NOT BETWEEN 1 AND 2 OR nc = 0 AND nd = 1 AND regexp_full_match(bd, '[0-9]{{3}}')) AS amb FROM n3),
num AS (SELECT *, {num('txt')} AS value, CASE WHEN {num('txt')} IS NOT NULL THEN amb END AS ambiguous, CASE WHEN {num('txt')} IS NOT NULL THEN st END AS strategy FROM n4)"""


def unit(raw: str) -> str:
    clean = f"regexp_replace(replace(replace(replace(lower(trim({raw})), '×', 'x'), '*', 'x'), '^', ''), '\\s', '', 'g')"
    return f"CASE {clean} " + " ".join(f"WHEN {q(f)} THEN {q(u)}" for u, forms in V.UNITS for f in forms) + f" ELSE trim({raw}) END"


def comparator(raw: str) -> str:
    return f"replace(replace(coalesce(nullif(regexp_extract(trim({raw}), '^(<=|>=|≤|≥|<|>)', 1), ''), '='), '≤', '<='), '≥', '>=')"


def _alt(words) -> str:
    return "(" + "|".join(w.replace("(", "\\(").replace(")", "\\)") for w in words) + ")"


def name_steps(source: str) -> str:
    spelled = "s"
    for a, b in V.SPELLINGS:
        spelled = f"replace({spelled}, '{a}', '{b}')"
    strip = lambda words, end: f"trim(regexp_replace(s, '{_alt(words)}{end}', ''))"
    steps = [
        "CASE low " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in V.ITALIAN) + " ELSE low END",
        f"regexp_replace(s, '^{_alt(V.SPECIMEN_PREFIXES)}', '')", strip(V.COMMA_SUFFIXES, "$"), strip(V.SPACE_SUFFIXES, "$"), strip([f"({m})" for m in V.METHODS], "$"),
        "CASE WHEN strlen(regexp_extract(s, '\\(([^( ]*)\\)$', 1)) <= 10 THEN trim(regexp_replace(s, '\\(([^( ]*)\\)$', '')) ELSE s END", spelled,
        f"(SELECT CASE WHEN len(k) > 0 AND len(k) < len(w) THEN array_to_string(k, ' ') ELSE s END FROM (SELECT regexp_extract_all(s, '\\S+') AS w, list_filter(regexp_extract_all(s, '\\S+'), lambda x: NOT list_contains({arr(V.NOISE_WORDS)}, x)) AS k))",
        "trim(replace(replace(s, '–', '-'), '—', '-'))",
    ]
    out = [f"s0 AS (SELECT DISTINCT raw_name, lower(trim(raw_name)) AS low, {steps[0].replace('low ', 'lower(trim(raw_name)) ', 1).replace('ELSE low', 'ELSE lower(trim(raw_name))')} AS s FROM {source})"]
    out += [f"s{i} AS (SELECT raw_name, low, {e} AS s FROM s{i - 1})" for i, e in enumerate(steps[1:], 1)]
    return ", ".join(out) + f", names AS (SELECT raw_name, low, s AS norm FROM s{len(steps) - 1})"


def _catalog() -> str:
    taken: dict[str, str] = {}
    for id_, component, display, _, _, aliases, _ in catalog.SEED:
        taken |= dict.fromkeys([x.lower() for x in (id_, component, display, *aliases) if x], id_)
        for x in (id_.replace("_", " "), id_.replace("_", "-")):
            taken.setdefault(x.lower(), id_)
    units = dict((f, u) for u, forms in V.UNITS for f in forms)
    canonical = lambda u: units.get("".join(u.lower().replace("×", "x").replace("*", "x").replace("^", "").split()), u.strip())
    marker = [(i, d, c, arr(u), arr(sorted({x.lower() for x in u} | {canonical(x).lower() for x in u}))) for i, _, d, c, _, _, u in catalog.SEED]
    amb = [(n, i) for n, i, _ in catalog.SEED_AMBIGUOUS]
    cand = [(n, k, i, arr([x.lower() for x in u]), b, a) for n, _, cs in catalog.SEED_AMBIGUOUS for k, (i, u, b, a) in enumerate(cs)]
    return ", ".join([
        values("marker", "id, display_name, category, allowed, forms", marker), values("alias", "alias, id", taken.items()),
        values("amb", "name, default_id", amb), values("cand", "name, k, id, units, below, above", cand),
    ])


PARSED = f"""{M}, src AS (SELECT * FROM m), {parse('raw_value')},
parsed AS (SELECT doc_id, ord, patient_id, date, raw_name, raw_value, raw_unit, value, ambiguous AS number_ambiguous, strategy, {comparator('raw_value')} AS comparator, {unit('raw_unit')} AS unit FROM num)"""

def resolution(parsed: str, source: str, keys: str) -> str:
    """Step ``resolved`` behind the steps ``parsed``; names are those of ``source``."""
    return f"""{parsed}, {name_steps(source)}, {_catalog()},
r0 AS (SELECT p.*, n.low, n.norm, a1.id AS i1, a2.id AS i2, m1.allowed AS al1, m2.allowed AS al2, m1.forms AS f1, m2.forms AS f2, b1.name AS b1, b2.name AS b2, coalesce(b1.default_id, b2.default_id) AS dflt
 FROM parsed p JOIN names n USING (raw_name) LEFT JOIN alias a1 ON a1.alias = n.low LEFT JOIN marker m1 ON m1.id = a1.id LEFT JOIN amb b1 ON b1.name = n.low
 LEFT JOIN alias a2 ON a2.alias = n.norm LEFT JOIN marker m2 ON m2.id = a2.id LEFT JOIN amb b2 ON b2.name = n.norm),
r1 AS (SELECT *, i1 IS NOT NULL AND (b1 IS NOT NULL OR len(al1) = 0 OR unit = '' OR list_contains(f1, lower(unit))) AS u1,
 i2 IS NOT NULL AND norm <> low AND (b2 IS NOT NULL OR len(al2) = 0 OR unit = '' OR list_contains(f2, lower(unit))) AS u2 FROM r0),
r2 AS (SELECT *, CASE WHEN u1 THEN b1 WHEN u2 THEN b2 ELSE coalesce(b1, b2) END AS rule, CASE WHEN u1 THEN i1 WHEN u2 THEN i2 ELSE dflt END AS fallback FROM r1),
r3 AS (SELECT r2.*, (SELECT arg_min(c.id, c.k) FROM cand c WHERE c.name = rule AND (len(c.units) = 0 OR list_contains(c.units, lower(unit))) AND coalesce(value < c.below, true) AND coalesce(value > c.above, true)) AS fit FROM r2),
r4 AS (SELECT *, coalesce(fit, fallback) AS sid, CASE WHEN rule IS NOT NULL THEN CASE WHEN fit IS NOT NULL THEN 'inferred_from_unit' ELSE 'ambiguous' END WHEN u1 THEN 'exact' WHEN u2 THEN 'normalized' END AS confidence,
 CASE WHEN rule IS NOT NULL THEN 'disambiguation' WHEN u1 THEN 'exact_alias' WHEN u2 THEN 'normalized_pipeline' END AS method FROM r3),
r5 AS (SELECT r4.*, display_name, category, CASE WHEN unit <> '' OR list_contains(allowed, '') THEN 'Observed' WHEN len(allowed) = 1 THEN 'Inferred' ELSE 'Missing' END AS unit_status, allowed FROM r4 LEFT JOIN marker ON marker.id = sid),
resolved AS (SELECT {keys}, raw_name, raw_value, value, comparator, CASE WHEN unit = '' AND unit_status = 'Inferred' THEN allowed[1] ELSE unit END AS unit, unit_status,
 sid AS standardized_name, display_name, category, confidence, method, sid IS NOT NULL AS resolved FROM r5)"""


RESOLVED = resolution(PARSED, "m", "doc_id, ord, patient_id, date")

GROUPED = f"""{RESOLVED}, ok AS (SELECT * FROM resolved WHERE value IS NOT NULL),
firsts AS (SELECT *, row_number() OVER w AS rn, first_value(value) OVER w AS v0, first_value(unit) OVER w AS u0, first_value(comparator) OVER w AS c0 FROM ok WHERE resolved WINDOW w AS (PARTITION BY doc_id, standardized_name ORDER BY ord)),
grouped AS (SELECT doc_id, standardized_name, count(*) AS n_readings, bool_and(abs(value - v0) < 0.0001 AND unit = u0 AND comparator = c0) AS agree FROM firsts GROUP BY ALL),
kept AS (SELECT f.*, n_readings FROM firsts f JOIN grouped g USING (doc_id, standardized_name) WHERE rn = 1 AND agree)"""

BANDS = values("band", "sn, un, hl, hh, sl, sh", V.PLAUSIBILITY)
PLAUSIBLE = f"""{GROUPED}, {BANDS}, plaus AS (SELECT k.*, CASE WHEN value < hl OR value > hh THEN 'impossible' WHEN value < sl OR value > sh THEN 'unusual' WHEN hl IS NOT NULL THEN 'ok' END AS plausible
 FROM kept k LEFT JOIN band ON sn = standardized_name AND un = unit)"""

_pct = ["neutrophils_pct", "lymphocytes_pct", "monocytes_pct", "eosinophils_pct", "basophils_pct"]
CROSS = f"""{PLAUSIBLE}, piv AS (SELECT doc_id, coalesce(sum(value) FILTER (standardized_name IN {tuple(_pct)} AND unit = '%'), 0) AS pct_sum, count(*) FILTER (standardized_name IN {tuple(_pct)} AND unit = '%') AS pct_count,
 {', '.join(f"max({w}) FILTER (standardized_name = '{n}') AS {k}_{w[0]}" for k, n in (('tc', 'total_cholesterol'), ('ldl', 'ldl_cholesterol'), ('hdl', 'hdl_cholesterol'), ('tg', 'triglycerides'), ('ratio', 'tc_hdl_ratio')) for w in ('value', 'unit'))} FROM plaus GROUP BY doc_id),
cross1 AS (SELECT *, CASE WHEN tc_u = ldl_u AND tc_u = hdl_u AND tc_u = tg_u THEN ldl_v + hdl_v + tg_v / CASE tc_u WHEN 'mg/dL' THEN 5.0::double WHEN 'mmol/L' THEN 2.2::double END END AS fw,
 CASE WHEN tc_u = hdl_u AND ratio_v IS NOT NULL AND hdl_v > 0 THEN tc_v / hdl_v END AS th FROM piv),
checks AS (SELECT doc_id, pct_sum, pct_count, pct_count >= 3 AND abs(pct_sum - 100) > 5 AS pct_warns, fw AS friedewald, coalesce(CASE WHEN tc_v = 0 THEN fw <> 0 ELSE abs(fw - tc_v) / tc_v * 100 > 15 END, false) AS friedewald_warns,
 th AS tc_hdl, coalesce(CASE WHEN ratio_v = 0 THEN th <> 0 ELSE abs(th - ratio_v) / ratio_v * 100 > 10 END, false) AS tc_hdl_warns FROM cross1)"""

STATUS = f"""{CROSS}, c1 AS (SELECT doc_id, count(*) AS resolved, count(*) FILTER (confidence = 'ambiguous') AS ambiguous, count(*) FILTER (unit_status <> 'Observed') AS unit_gaps,
 count(*) FILTER (plausible = 'impossible') AS impossible, count(*) FILTER (plausible = 'unusual') AS unusual FROM plaus GROUP BY doc_id),
c2 AS (SELECT doc_id, count(*) FILTER (NOT resolved AND value IS NOT NULL) AS unresolved FROM resolved GROUP BY doc_id), c3 AS (SELECT doc_id, count(*) AS conflicts FROM grouped WHERE NOT agree GROUP BY doc_id),
c4 AS (SELECT doc_id, pct_warns::int + friedewald_warns::int + tc_hdl_warns::int AS cross_warnings FROM checks),
c5 AS (SELECT doc_id, coalesce(resolved, 0) AS resolved, unresolved, coalesce(conflicts, 0) AS conflicts, coalesce(ambiguous, 0) AS ambiguous, coalesce(unit_gaps, 0) AS unit_gaps, coalesce(impossible, 0) AS impossible,
 coalesce(unusual, 0) AS unusual, coalesce(cross_warnings, 0) AS cross_warnings FROM c2 LEFT JOIN c1 USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c4 USING (doc_id)),
status AS (SELECT *, CASE WHEN impossible > 0 THEN 'partial_failure' WHEN resolved = 0 OR unresolved > resolved OR conflicts + ambiguous + unit_gaps + unusual + cross_warnings > 0 THEN 'needs_review' ELSE 'success' END AS status,
 resolved = 0 AND unresolved = 0 AS found_nothing, resolved >= 3 AND unresolved < 5 * resolved AS patterns_suffice FROM c5)"""


def redact(x: str) -> str:
    for pattern, sub in V.REDACTIONS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(sub)}, 'g')"
    return x


# ------------------------------------------------------------ running text

REPORT = f"""{M}, rep AS (SELECT doc_id, string_agg(CASE WHEN ord % 3 = 0 THEN raw_name || chr(10) || 'Results: ' || raw_value || ' (' || raw_unit || ')' ELSE raw_name || ': ' || raw_value || ' ' || raw_unit END, chr(10) ORDER BY ord) AS content
 FROM m GROUP BY doc_id)"""


def _layout(k: int, pattern: str) -> str:
    """Matches of one layout with their places: each match is put between two marks, and the lengths of what stands before it are summed."""
    marked = f"string_split(regexp_replace(content, {q(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    start = "list_sum(list_transform(parts[1:i - 1], lambda x: len(replace(x, chr(2), ''))))::bigint"
    return f"""marked{k} AS (SELECT doc_id, {marked} AS parts FROM rep),
hit{k} AS (SELECT doc_id, {start} AS start, split_part(parts[i], chr(2), 1) AS hit FROM marked{k}, unnest(range(2, len(parts) + 1)) AS r(i)),
layout{k} AS (SELECT doc_id, {k} AS layout, start, start + len(hit) AS stop, regexp_extract(hit, {q(pattern)}, ['name', 'cmp', 'value', 'unit']) AS g FROM hit{k})"""


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tokens(report: str) -> str:
    """Step ``tok`` behind the steps ``report``, of which ``rep`` has the texts."""
    return f"""{report}, {_layout(0, '(?m)' + V.HUB)}, {_layout(1, '(?i)' + V.COLON)}, {_layout(2, '(?i)' + V.GENERAL)},
tok AS MATERIALIZED (SELECT doc_id, layout, start, stop, {_bare('g.name')} AS raw_name, g.cmp AS mark, g.value AS raw_value, {_bare('g.unit')} AS raw_unit FROM (SELECT * FROM layout0 UNION ALL SELECT * FROM layout1 UNION ALL SELECT * FROM layout2))"""


def _free(layout: int, taken: str) -> str:
    """Rows of a layout whose start and stop are in no span of ``taken``, by the list of a document's spans: no join but by doc_id."""
    inside = lambda p: f"{p} >= t.start AND {p} < t.stop"
    spans = f"(SELECT doc_id, list({{'start': start, 'stop': stop}}) AS spans FROM {taken} GROUP BY doc_id)"
    hit = f"list_filter(spans, lambda t: {inside('r.start')} OR {inside('r.stop')})"
    return f"(SELECT r.* FROM named r LEFT JOIN {spans} s ON s.doc_id = r.doc_id WHERE layout = {layout} AND coalesce(len({hit}), 0) = 0)"


def readings(report: str, more: str = "") -> str:
    """Steps ``resolved`` and ``readings`` of the texts in ``rep``; ``more`` adds rows of a layout 3, which are resolved too."""
    steps = f"""{tokens(report)}, src AS (SELECT * FROM tok{more}), {parse('raw_value')},
parsed AS (SELECT doc_id, layout, start, stop, raw_name, raw_value, value, {comparator('mark')} AS comparator, {unit('raw_unit')} AS unit FROM num)"""
    return f"""{resolution(steps, 'src', 'doc_id, layout, start, stop')},
named AS MATERIALIZED (SELECT * FROM resolved WHERE value IS NOT NULL AND (resolved OR (strlen(raw_name) >= 2 AND lower(raw_name) NOT IN ({', '.join(map(q, V.STOP_WORDS))})))),
k0 AS (SELECT * FROM named WHERE layout = 0), t0 AS (SELECT doc_id, start, stop FROM k0 WHERE resolved),
k1 AS {_free(1, 't0')}, t1 AS (SELECT * FROM t0 UNION ALL SELECT doc_id, start, stop FROM k1 WHERE resolved), k2 AS {_free(2, 't1')},
readings AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY layout, start) - 1)::int AS ord FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2))"""


TOKENS, READINGS = tokens(REPORT), readings(REPORT)

_COMMAS = "len({0}) - len(replace({0}, ',', ''))"
#: Even documents are written as tables, odd ones as running text; either may be taken for the other.
_EITHER = f"""{M}, written AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Test Name,Result,Units' || chr(10) || string_agg(CASE WHEN contains(raw_name, ',') THEN '"' || raw_name || '"' ELSE raw_name END || ',"' || raw_value || '",' || raw_unit, chr(10) ORDER BY ord)
 ELSE string_agg(raw_name || ': ' || raw_value || ' ' || raw_unit, chr(10) ORDER BY ord) END AS content FROM m GROUP BY doc_id),
lines AS (SELECT *, string_split(content, chr(10)) AS ls, string_split(string_split(content, chr(10))[1], ',') AS fields FROM written),
sniffed AS MATERIALIZED (SELECT doc_id, content, len(ls) >= 2 AND {_COMMAS.format('ls[1]')} >= 2 AND len(list_filter(fields, lambda f: regexp_full_match(trim(f), '[\\p{{L}}\\s]+'))) >= len(fields) // 2
 AND abs({_COMMAS.format("coalesce(ls[2], '')")} - ({_COMMAS.format('ls[1]')})) <= 1 AS delimited FROM lines),
rep AS (SELECT doc_id, content FROM sniffed WHERE NOT delimited)"""
_TABLED = " UNION ALL SELECT doc_id, 3, ord, 0, raw_name, trim(raw_value), trim(raw_value), raw_unit FROM m JOIN sniffed USING (doc_id) WHERE delimited AND doc_id % 2 = 0"
AUTO = readings(_EITHER, _TABLED)


# ------------------------------------------------------------ answered values near their names

PROXIMITY = f"""{PARSED}, page AS (SELECT doc_id, string_agg(raw_name || ': ' || raw_value || ' ' || raw_unit, chr(10) ORDER BY ord) AS content FROM m GROUP BY doc_id),
w0 AS (SELECT doc_id, ord, round(value, 3) AS v, trim(regexp_replace(trim(raw_value), '^(<=|>=|≤|≥|<|>)', '')) AS rest, lower(raw_name) AS low,
 list_filter(regexp_extract_all(lower(raw_name), '\\p{{L}}+'), lambda x: strlen(x) >= 4) AS words FROM parsed),
w AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 0 THEN rest WHEN v = floor(v) THEN v::bigint::varchar ELSE v::varchar END AS written,
 coalesce(list_filter(words, lambda x: strlen(x) = list_max(list_transform(words, lambda y: strlen(y))))[-1], low) AS token FROM w0),
cut AS (SELECT *, regexp_replace(regexp_replace(written, '0+$', ''), '\\.+$', '') AS short FROM w),
variants AS (SELECT doc_id, ord, token, written AS x FROM cut WHERE written <> '' UNION ALL
 SELECT doc_id, ord, token, CASE WHEN contains(written, '.') THEN CASE WHEN short <> written AND short <> '' THEN short END ELSE written || '.0' END FROM cut WHERE written <> ''),
parts AS (SELECT doc_id, ord, token, x, string_split(content, x) AS parts, string_split(lower(content), token) AS named FROM variants JOIN page USING (doc_id) WHERE x IS NOT NULL),
places AS (SELECT doc_id, ord, x, (list_sum(list_transform(parts[1:i], lambda y: strlen(y))) + (i - 1) * strlen(x))::bigint AS p FROM parts, unnest(range(1, len(parts))) AS r(i)),
names_at AS (SELECT doc_id, ord, x, (list_sum(list_transform(named[1:i], lambda y: strlen(y))) + (i - 1) * strlen(token))::bigint AS t, strlen(token) AS n FROM parts, unnest(range(1, len(named))) AS r(i)),
hits AS (SELECT DISTINCT doc_id, ord FROM places JOIN names_at USING (doc_id, ord, x) WHERE t >= p - 200 AND t + n <= p + strlen(x) + 200),
near AS (SELECT w.doc_id, w.ord, written, h.ord IS NOT NULL AS verified FROM w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.ord = w.ord)"""
