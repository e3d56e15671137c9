"""The engine's queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biolab.functions import columns, table_functions
from biolab.functions import fixed_values as V
from biolab.operators import answers, conflicts, longitudinal, output, pages, parse, report, text, validate
from biolab.operators.resolve import parsed, resolve
from biolab.operators.store import Store
from biolab.session import shared_folder
from biolab.sources import catalog, delimited_files, files, tabular
from biolab.sources.measurements import measurements, reports

from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _resolved(spark, d):
    m = measurements(spark, d)
    return resolve(parsed(m))


def _numeric(spark, d):
    return _resolved(spark, d).filter("value is not null")


ID = ["doc_id", "ord"]
TYPICAL = "CASE WHEN ord % 3 = 0 THEN 10.0::double WHEN ord % 3 = 1 THEN 500.0::double ELSE 20000.0::double END"


@query(f"WITH {O.PARSED} SELECT doc_id, ord, raw_value, value, coalesce(number_ambiguous, false) AS number_ambiguous, strategy FROM parsed")
def parse_number(spark, d):
    return parsed(measurements(spark, d)).select(*ID, "raw_value", "value", F.coalesce("number_ambiguous", F.lit(False)).alias("number_ambiguous"), "strategy")


@query(f"""WITH {O.PARSED}, t AS (SELECT *, {TYPICAL} AS mx, trim(regexp_replace(trim(raw_value), '^(<=)*(>=)*<*>*≤*≥*', '')) AS p FROM parsed),
x AS (SELECT *, {O.num("replace(p, ',', '.')")} AS oc, {O.num("replace(p, '.', '')")} AS od FROM t)
SELECT doc_id, ord, CASE WHEN number_ambiguous AND strategy = 'thousands_comma' AND value > 10 * mx AND oc <= 2 * mx THEN oc WHEN number_ambiguous AND strategy = 'decimal_dot' AND value < mx / 100 AND od BETWEEN mx / 10 AND 2 * mx THEN od ELSE value END AS value FROM x""")
def parse_number_hint(spark, d):
    typical = F.when(F.col("ord") % 3 == 0, 10.0).when(F.col("ord") % 3 == 1, 500.0).otherwise(20000.0)
    return measurements(spark, d).select(*ID, columns.parse_number_with_hint(F.col("raw_value"), typical)["value"].alias("value"))


@query(f"WITH {O.M} SELECT doc_id, ord, {O.comparator('raw_value')} AS comparator, trim(regexp_replace(trim(raw_value), '^(<=|>=|≤|≥|<|>)', '')) AS rest FROM m")
def comparator_split(spark, d):
    c = columns.split_comparator(F.col("raw_value"))
    return measurements(spark, d).select(*ID, c["comparator"].alias("comparator"), c["rest"].alias("rest"))


@query(f"WITH {O.M} SELECT doc_id, ord, {O.unit('raw_unit')} AS unit FROM m")
def normalize_unit(spark, d):
    return measurements(spark, d).select(*ID, columns.normalize_unit(F.col("raw_unit")).alias("unit"))


_VARIANTS = """w AS (SELECT raw_name FROM m UNION ALL SELECT 'Serum ' || raw_name || ' (ELISA)' FROM m UNION ALL SELECT raw_name || ', Whole Blood' FROM m UNION ALL SELECT 'screening ' || raw_name || ' – oestrogen anaemia' FROM m)"""


@query(f"WITH {O.M}, {_VARIANTS}, {O.name_steps('w')} SELECT raw_name, norm FROM names")
def normalize_name(spark, d):
    m = measurements(spark, d).select("raw_name")
    forms = F.array("raw_name", F.concat(F.lit("Serum "), "raw_name", F.lit(" (ELISA)")), F.concat("raw_name", F.lit(", Whole Blood")), F.concat(F.lit("screening "), "raw_name", F.lit(" – oestrogen anaemia")))
    return m.distinct().select(F.explode(forms).alias("raw_name")).distinct().select("raw_name", columns.normalize_name(F.col("raw_name")).alias("norm"))


_RES = "doc_id, ord, raw_name, standardized_name, display_name, category, confidence, method, unit, unit_status, resolved"


@query(f"WITH {O.RESOLVED} SELECT {_RES} FROM resolved")
def resolve_full(spark, d):
    return _resolved(spark, d).select(*_RES.split(", "))


@query(f"WITH {O.RESOLVED} SELECT category, count(*) AS n, avg(value) AS mean FROM resolved WHERE method = 'exact_alias' GROUP BY category")
def resolve_exact(spark, d):
    return _resolved(spark, d).filter("method = 'exact_alias'").groupBy("category").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query(f"WITH {O.RESOLVED} SELECT standardized_name, count(*) AS n, count(DISTINCT raw_name) AS n_names FROM resolved WHERE method = 'normalized_pipeline' GROUP BY standardized_name")
def resolve_normalized(spark, d):
    return _resolved(spark, d).filter("method = 'normalized_pipeline'").groupBy("standardized_name").agg(F.count("*").alias("n"), F.countDistinct("raw_name").alias("n_names"))


@query(f"WITH {O.RESOLVED} SELECT doc_id, ord, raw_name, value, unit, standardized_name, confidence FROM resolved WHERE method = 'disambiguation'")
def disambiguate(spark, d):
    return _resolved(spark, d).filter("method = 'disambiguation'").select(*ID, "raw_name", "value", "unit", "standardized_name", "confidence")


@query(f"WITH {O.RESOLVED} SELECT standardized_name, unit_status, unit, count(*) AS n FROM resolved WHERE resolved GROUP BY ALL")
def unit_provenance(spark, d):
    return _resolved(spark, d).filter("resolved").groupBy("standardized_name", "unit_status", "unit").agg(F.count("*").alias("n"))


@query(f"WITH {O.RESOLVED} SELECT doc_id, ord, raw_value FROM resolved WHERE value IS NULL")
def not_numeric(spark, d):
    return _resolved(spark, d).filter("value is null").select(*ID, "raw_value")


@query(f"WITH {O.GROUPED} SELECT f.doc_id, f.standardized_name, f.ord, f.value, f.unit FROM firsts f JOIN grouped g USING (doc_id, standardized_name) WHERE NOT agree")
def conflict_candidates(spark, d):
    n = _numeric(spark, d)
    return conflicts.conflicting(n, conflicts.groups(n)).select("doc_id", "standardized_name", F.explode("candidates").alias("c")).select("doc_id", "standardized_name", "c.ord", "c.value", "c.unit")


@query(f"WITH {O.GROUPED} SELECT doc_id, standardized_name, ord, value, unit, comparator, n_readings FROM kept")
def dedupe_keep_first(spark, d):
    return conflicts.kept(conflicts.groups(_numeric(spark, d))).select("doc_id", "standardized_name", "ord", "value", "unit", "comparator", "n_readings")


@query(f"""WITH {O.GROUPED} SELECT doc_id, standardized_name, count(*) AS n_readings, bool_and(abs(value - v0) < 0.0001 AND unit = u0) AS agree FROM firsts GROUP BY ALL""")
def page_conflicts(spark, d):
    return conflicts.groups(_numeric(spark, d), with_comparator=False).select("doc_id", "standardized_name", "n_readings", "agree")


@query(f"WITH {O.PLAUSIBLE} SELECT doc_id, standardized_name, value, unit, plausible FROM plaus")
def plausibility(spark, d):
    return validate.plausibility(conflicts.kept(conflicts.groups(_numeric(spark, d)))).select("doc_id", "standardized_name", "value", "unit", "plausible")


RANGES = ["4.3 - 5.4", "10-25.5", "<5.0", "> 1.0", "(2.6 - 24.9)", "<= 30", ">=12.5", "normal", "-5", ""]


@query(f"""WITH {O.PARSED}, r AS (SELECT doc_id, ord, value, ord % 2 = 0 AS flagged, {O.arr(RANGES)}[(doc_id + ord) % {len(RANGES)} + 1] AS rr FROM parsed WHERE value IS NOT NULL),
b AS (SELECT *, trim(trim(trim(rr), '()')) AS s FROM r),
c AS (SELECT *, CASE WHEN s LIKE '<%' AND regexp_extract(s, '^[<>]=?\\s*(.*)$', 1) <> '' THEN '-inf'::double WHEN s LIKE '>%' THEN TRY_CAST(regexp_extract(s, '^[<>]=?\\s*(.*)$', 1) AS DOUBLE) ELSE TRY_CAST(nullif(regexp_extract(s, '^([0-9.]+) ?- ?([0-9.]+)$', 1), '') AS DOUBLE) END AS lo,
 CASE WHEN s LIKE '<%' THEN TRY_CAST(regexp_extract(s, '^[<>]=?\\s*(.*)$', 1) AS DOUBLE) WHEN s LIKE '>%' THEN 'inf'::double ELSE TRY_CAST(nullif(regexp_extract(s, '^([0-9.]+) ?- ?([0-9.]+)$', 2), '') AS DOUBLE) END AS hi FROM b)
SELECT doc_id, ord, value, CASE WHEN isfinite(lo) THEN lo END AS lo, CASE WHEN isfinite(hi) THEN hi END AS hi, coalesce((value < lo OR value > hi) AND NOT flagged, false) AS newly_flagged FROM c""")
def reference_range(spark, d):
    pick = F.element_at(F.array(*map(F.lit, RANGES)), ((F.col("doc_id") + F.col("ord")) % len(RANGES) + 1).cast("int"))
    df = parsed(measurements(spark, d)).filter("value is not null").select(*ID, "value", (F.col("ord") % 2 == 0).alias("flagged"), pick.alias("reference_range"))
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c)
    return validate.reference_check(df).select(*ID, "value", finite("lo"), finite("hi"), "newly_flagged")


def _checks(spark, d):
    return validate.cross_checks(conflicts.kept(conflicts.groups(_numeric(spark, d))))


@query(f"WITH {O.CROSS} SELECT doc_id, round(pct_sum, 6) AS pct_sum, pct_count, pct_warns FROM checks WHERE pct_count > 0")
def cbc_sum(spark, d):
    return _checks(spark, d).filter("pct_count > 0").select("doc_id", F.round("pct_sum", 6).alias("pct_sum"), F.col("pct_count").cast("long").alias("pct_count"), "pct_warns")


@query(f"WITH {O.CROSS} SELECT doc_id, round(friedewald, 6) AS friedewald, friedewald_warns FROM checks")
def friedewald(spark, d):
    return _checks(spark, d).select("doc_id", F.round("friedewald", 6).alias("friedewald"), "friedewald_warns")


@query(f"WITH {O.CROSS} SELECT doc_id, round(tc_hdl, 6) AS tc_hdl, tc_hdl_warns FROM checks")
def tc_hdl_ratio(spark, d):
    return _checks(spark, d).select("doc_id", F.round("tc_hdl", 6).alias("tc_hdl"), "tc_hdl_warns")


_STATUS = "doc_id, resolved, unresolved, conflicts, ambiguous, unit_gaps, impossible, unusual, cross_warnings, status, found_nothing"


@query(f"WITH {O.STATUS} SELECT {_STATUS} FROM status")
def document_status(spark, d):
    return validate.document_status(_resolved(spark, d)).select(*_STATUS.split(", "))


@query(f"WITH {O.STATUS} SELECT patterns_suffice, status, count(*) AS n FROM status GROUP BY ALL")
def regex_gate(spark, d):
    return validate.document_status(_resolved(spark, d)).groupBy("patterns_suffice", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {O.PARSED} SELECT doc_id, ord, CASE WHEN value = floor(value) AND abs(value) < 1e6 THEN printf('%.0f', value) ELSE printf('%.2f', round(value::decimal(20, 6), 2)) END AS shown FROM parsed WHERE value IS NOT NULL""")
def display_value(spark, d):
    return parsed(measurements(spark, d)).filter("value is not null").select(*ID, columns.display_value(F.col("value")).alias("shown"))


_SHOWN = lambda v: f"CASE WHEN {v} = floor({v}) AND abs({v}) < 1e6 THEN printf('%.0f', {v}) ELSE printf('%.2f', round({v}::decimal(20, 6), 2)) END"
_TWO = lambda v: f"printf('%.2f', round({v}::decimal(20, 6), 2))"


@query(f"""WITH {O.CROSS} SELECT doc_id, 'skipped' AS "check", ord::bigint AS at, chr(39) || raw_name || chr(39) || ' was left out: ' || chr(39) || raw_value || chr(39) || ' is no number' AS warning FROM resolved WHERE value IS NULL
UNION ALL SELECT doc_id, 'unresolved', ord, chr(39) || raw_name || chr(39) || ' is no known marker' FROM resolved WHERE value IS NOT NULL AND NOT resolved
UNION ALL SELECT doc_id, CASE WHEN agree THEN 'repeated' ELSE 'conflict' END, (SELECT min(ord) FROM firsts f WHERE f.doc_id = g.doc_id AND f.standardized_name = g.standardized_name),
 CASE WHEN agree THEN printf('%s was read %d times with one value; the first is kept', standardized_name, n_readings) ELSE printf('%s was read %d times with different values', standardized_name, n_readings) END FROM grouped g WHERE n_readings > 1
UNION ALL SELECT doc_id, 'plausibility', ord, plausible || ' value: ' || display_name || ' = ' || {_SHOWN('value')} || ' ' || unit || ' (expected ' || {_SHOWN("(CASE plausible WHEN 'impossible' THEN hl ELSE sl END)")} || ' to ' || {_SHOWN("(CASE plausible WHEN 'impossible' THEN hh ELSE sh END)")} || ')'
 FROM plaus JOIN band ON sn = standardized_name AND un = unit WHERE plausible IN ('impossible', 'unusual')
UNION ALL SELECT doc_id, 'sum', 0, 'differential percentages add up to ' || {_TWO('pct_sum')} || ' (' || pct_count || ' markers)' FROM checks WHERE pct_warns
UNION ALL SELECT doc_id, 'friedewald', 0, 'total cholesterol is ' || {_TWO('tc_v')} || ', its parts make ' || {_TWO('friedewald')} FROM checks JOIN cross1 USING (doc_id) WHERE friedewald_warns
UNION ALL SELECT doc_id, 'ratio', 0, 'TC/HDL is given as ' || {_TWO('ratio_v')} || ', the values make ' || {_TWO('tc_hdl')} FROM checks JOIN cross1 USING (doc_id) WHERE tc_hdl_warns""")
def warning_rows(spark, d):
    """All warnings, a row for each."""
    return report.warning_rows(report.assembled(_resolved(spark, d)))


def _envelope_parts(spark, d):
    df = report.assembled(_resolved(spark, d))
    pages_ = F.lit(None).cast("array<struct<page: int, status: string, error: string, marker_count: int>>")
    return df.select(
        "doc_id", "status", "biomarkers", F.col("conflicting").alias("conflicts"), F.col("unknown").alias("unresolved"), F.col("warnings.warning").alias("warnings"), F.concat(F.lit("order-"), "doc_id").alias("source"), F.lit("csv").alias("parser"),
        F.lit(0).cast("long").alias("elapsed_ms"), pages_.alias("page_statuses"),
    )


def _json(**fields: str) -> str:
    """SQL of a JSON object whose null fields are left out; the fields are SQL of JSON texts."""
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + ") || '}'"


_J = lambda c: f"to_json({c})::varchar"
_UNLESS = lambda c, default: f"CASE WHEN {c} <> '{default}' THEN to_json({c})::varchar END"
_SHORT = _json(raw_name=_J("raw_name"), value="value::varchar", unit=_J("unit"))
_MARKER = _json(
    name=_J("raw_name"), standardized_name=_J("standardized_name"), display_name=_J("display_name"), value="value::varchar", unit=_J("unit"), category=_J("category"), resolved="'true'", confidence=_J("confidence"),
    resolution_method=_J("method"), comparator=_UNLESS("comparator", "="), flagged="CASE WHEN plausible <> 'ok' THEN 'true' END", unit_status=_UNLESS("unit_status", "Observed"), raw_value_text=_J("raw_value"), raw_unit=_UNLESS("raw_unit", ""),
)
_RANKED = "list_position(['skipped', 'unresolved', 'repeated', 'conflict', 'plausibility', 'sum', 'friedewald', 'ratio'], \"check\")"
_PARTS = f"""{O.STATUS}, mk AS (SELECT k.*, p.raw_unit, {_SHOWN('k.value')} AS shown FROM plaus k JOIN parsed p USING (doc_id, ord)),
cd AS (SELECT doc_id, standardized_name, arg_min(display_name, ord) AS display_name, arg_min(category, ord) AS category, '[' || string_agg({_SHORT}, ',' ORDER BY ord) || ']' AS candidates,
 string_agg('  ' || {_SHOWN('value')} || ' ' || unit || ' [' || raw_name || ']', chr(10) ORDER BY ord) AS lines FROM firsts JOIN grouped USING (doc_id, standardized_name) WHERE NOT agree GROUP BY doc_id, standardized_name),
wn AS (SELECT doc_id, list(warning ORDER BY {_RANKED}, "at", warning) AS ws FROM ({ORACLES['warning_rows']}) GROUP BY doc_id)"""


@query(f"""WITH {_PARTS}, bm AS (SELECT doc_id, count(*) AS n, '[' || string_agg({_MARKER}, ',' ORDER BY ord) || ']' AS js FROM mk GROUP BY doc_id),
un AS (SELECT doc_id, count(*) AS n, '[' || string_agg({_SHORT}, ',' ORDER BY ord) || ']' AS js FROM resolved WHERE value IS NOT NULL AND NOT resolved GROUP BY doc_id),
cj AS (SELECT doc_id, '[' || string_agg({_json(standardized_name=_J('standardized_name'), display_name=_J('display_name'), category=_J('category'), candidates='candidates')}, ',' ORDER BY standardized_name) || ']' AS js FROM cd GROUP BY doc_id),
x AS (SELECT s.doc_id, s.status, {_json(source=_J("('order-' || s.doc_id)"), biomarkers="coalesce(bm.js, '[]')", unresolved="coalesce(un.js, '[]')", conflicts="cj.js", parse_warnings="coalesce(to_json(ws)::varchar, '[]')")} AS data,
 {_json(elapsed_ms="'0'", markers_found="coalesce(bm.n, 0)::varchar", markers_unresolved="coalesce(un.n, 0)::varchar", document_status=_J('s.status'), parser=_J("'csv'"), catalog_version=_J("'2.0'"))} AS meta
 FROM status s LEFT JOIN bm USING (doc_id) LEFT JOIN un USING (doc_id) LEFT JOIN cj USING (doc_id) LEFT JOIN wn USING (doc_id))
SELECT doc_id, {_json(version=_J("'2'"), status=_J('status'), data='data', metadata='meta')} AS envelope FROM x""")
def json_envelope(spark, d):
    """One JSON text for each document; defaults and empty parts are left out of it."""
    df = _envelope_parts(spark, d)
    return df.select("doc_id", output.envelope(df).alias("envelope"))


@query(f"""WITH {_PARTS}, tw AS (SELECT doc_id, count(*) AS n, greatest(9, max(len(display_name)))::int AS wa, greatest(5, max(len(shown)))::int AS wb, greatest(4, max(len(unit)))::int AS wc, greatest(8, max(len(category)))::int AS wd FROM mk GROUP BY doc_id),
tl AS (SELECT doc_id, string_agg(rtrim(rpad(display_name, wa, ' ') || '  ' || lpad(shown, wb, ' ') || '  ' || rpad(unit, wc, ' ') || '  ' || rpad(category, wd, ' ')), chr(10) ORDER BY ord) AS rows FROM mk JOIN tw USING (doc_id) GROUP BY doc_id),
ct AS (SELECT doc_id, string_agg('conflict: ' || display_name || ' (' || standardized_name || ')' || chr(10) || lines, chr(10) ORDER BY standardized_name) AS bad FROM cd GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN n > 0 THEN concat_ws(chr(10), n || ' biomarkers from order-' || s.doc_id, rtrim(rpad('Biomarker', wa, ' ') || '  ' || lpad('Value', wb, ' ') || '  ' || rpad('Unit', wc, ' ') || '  ' || rpad('Category', wd, ' ')),
 rows, bad, array_to_string(list_transform(ws, lambda w: 'warning: ' || w), chr(10))) ELSE 'No biomarkers found.' END AS shown FROM status s LEFT JOIN tw USING (doc_id) LEFT JOIN tl USING (doc_id) LEFT JOIN ct USING (doc_id) LEFT JOIN wn USING (doc_id)""")
def terminal_table(spark, d):
    """What a terminal shows of each document."""
    return output.terminal(_envelope_parts(spark, d))


@query(f"""WITH {O.STATUS}, x AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'NoInput' WHEN resolved = 0 AND unresolved = 0 THEN 'NoBiomarkersFound' WHEN doc_id % 50 = 1 THEN 'VisionError' WHEN doc_id % 50 = 2 THEN 'IoError' END AS error FROM status)
SELECT doc_id, error, CASE error WHEN 'NoInput' THEN 2 WHEN 'NoBiomarkersFound' THEN 3 WHEN 'VisionError' THEN 4 WHEN 'IoError' THEN 1 ELSE 0 END AS exit_code,
 CASE WHEN error IS NOT NULL THEN '{{"version":"2","status":"error","error":"' || error || '"}}' END AS envelope FROM x""")
def error_rows(spark, d):
    """The error of each document, its exit class and its error envelope; some inputs are blank, and some have other errors."""
    s = validate.document_status(_resolved(spark, d))
    k = F.col("doc_id") % 50
    found = output.outcome(F.when(k == 0, F.lit(" \n")).otherwise("text"), F.col("resolved"), F.col("unresolved"))
    error = F.coalesce(found, F.when(k == 1, "VisionError").when(k == 2, "IoError"))
    s = s.select("doc_id", error.alias("error"))
    return s.select("doc_id", "error", output.exit_code(F.col("error")).alias("exit_code"), F.when(F.col("error").isNotNull(), output.error_envelope(F.col("error"))).alias("envelope"))


@query(f"""WITH {O.AUTO} SELECT doc_id, 'text' AS parser, ord, raw_name, value, unit, standardized_name, confidence FROM readings
UNION ALL SELECT doc_id, 'csv', start::int, raw_name, value, unit, standardized_name, confidence FROM resolved WHERE layout = 3""")
def auto_parse(spark, d):
    """Delimited and running texts of one input, each read by its own reader."""
    m = measurements(spark, d)
    k = F.col("doc_id") % 2
    return parse.auto_parse(reports(m.filter(k == 0), "comma").unionByName(reports(m.filter(k == 1)))).select("doc_id", "parser", "ord", "raw_name", "value", "unit", "standardized_name", "confidence")


# ------------------------------------------------------------ catalog

_OVER = [("tsh", "Thyrotropin", "TSH (3rd gen)", "thyroid", "3016-3", ["tsh3"], ["mIU/L"]), ("lp_a", "Lipoprotein (a)", "Lp(a)", "lipids", "10835-7", ["lpa"], ["nmol/L", "mg/dL"])]


@query("WITH " + O.values("marker", "id, display_name, category, units, alias_count", [(i, n, c, ", ".join(u) or "-", len(a)) for i, _, n, c, _, a, u in catalog.SEED]) + " SELECT id, display_name, category, units, alias_count::int AS alias_count FROM marker ORDER BY id")
def catalog_list(spark, d):
    return catalog.listing(catalog.markers(spark, catalog.SEED)).select("id", "display_name", "category", "units", "alias_count")


@query("WITH " + O.values("marker", "id, category", [(r[0], r[3]) for r in catalog.SEED]) + " SELECT category, count(*) AS n_markers FROM marker GROUP BY category ORDER BY category")
def catalog_categories(spark, d):
    return catalog.categories(catalog.markers(spark, catalog.SEED))


@query("WITH " + O.values("m", "id, display_name, seq", [(r[0], r[2], i) for i, r in enumerate([*catalog.SEED, *_OVER])]) + " SELECT id, arg_max(display_name, seq) AS display_name FROM m GROUP BY id")
def catalog_overlay(spark, d):
    return catalog.markers(spark, [*catalog.SEED, *_OVER]).select("id", "display_name")


def _item(r) -> str:
    keys = {"id": r[0], "display_name": r[2], "component": r[1], "specimen": catalog.SPECIMENS.get(r[0], "serum"), "allowed_units": r[6], "category": r[3], "loinc": r[4], "alias_count": len(r[5])}
    return json.dumps(keys, ensure_ascii=False, separators=(",", ":"))


@query("WITH x(id, item) AS (VALUES " + ", ".join(f"({O.q(r[0])}, {O.q(_item(r))})" for r in catalog.SEED if r[3] == "lipids") + ") SELECT id, item FROM x")
def catalog_json(spark, d):
    """One category of the catalog as JSON."""
    return catalog.listing_json(catalog.markers(spark, catalog.SEED), "lipids")


@query(f"""WITH {O._catalog()}, c AS (SELECT list_sort(list_distinct(list(category) FILTER (category <> ''))) AS categories, count(*) AS biomarker_count FROM marker)
SELECT 'biolab' AS name, '0.2' AS version, ['pdf', 'csv', 'text', 'stdin'] AS input_formats, ['json', 'table'] AS output_formats, biomarker_count, (SELECT count(*) FROM alias) AS alias_count, categories FROM c""")
def descriptor(spark, d):
    return catalog.descriptor(spark, catalog.SEED)


# ------------------------------------------------------------ delimited and running text

@query(f"""WITH {O.M}, r AS (SELECT doc_id, doc_id % 3 AS k, 'Test Name' || s || 'Result' || s || 'Units' || chr(10) || string_agg(CASE WHEN contains(raw_name, s) THEN '"' || raw_name || '"' ELSE raw_name END || s || '"' || raw_value || '"' || s || raw_unit, chr(10) ORDER BY ord) AS content, s
 FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS s FROM m) GROUP BY doc_id, s),
x AS (SELECT doc_id, s, len(string_split(content, chr(10))) AS n_lines, string_split(content, chr(10))[2] AS l2 FROM r)
SELECT doc_id, CASE s WHEN ',' THEN 'comma' WHEN ';' THEN 'semicolon' ELSE 'tab' END AS delimiter, abs(len(l2) - len(replace(l2, s, '')) - 2) <= 1 AS delimited FROM x""")
def csv_sniff(spark, d):
    r = _tables(spark, d)
    first = F.get(F.split("content", "\n"), 0)
    name = F.when(tabular.delimiter(first) == ",", "comma").when(tabular.delimiter(first) == ";", "semicolon").otherwise("tab")
    return r.select("doc_id", name.alias("delimiter"), tabular.looks_delimited(F.col("content")).alias("delimited"))


def _tables(spark, d):
    return reports(measurements(spark, d), ["comma", "semicolon", "tab"])


@query(f"WITH {O.M} SELECT doc_id, ord, raw_name, trim(raw_value) AS raw_value, raw_unit FROM m")
def csv_rows(spark, d):
    return tabular.rows(_tables(spark, d))


@query(f'WITH {O.TOKENS} SELECT doc_id, layout::int AS layout, start, stop AS "end", raw_name, mark, raw_value, raw_unit FROM tok')
def text_tokens(spark, d):
    return text.candidates(reports(measurements(spark, d), "hub"))


@query(f"""WITH {O.TOKENS} SELECT layout::int AS layout, mark, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum("stop" - start)::bigint AS chars FROM tok GROUP BY ALL""")
def tokens_in_sql(spark, d):
    """The matches of running text by the table function, in SQL."""
    table_functions.register(spark)
    reports_ = reports(measurements(spark, d), "hub")
    return spark.sql("SELECT layout, mark, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(`end` - start) AS chars FROM report_tokens(TABLE(SELECT * FROM {reports})) GROUP BY layout, mark", reports=reports_)


@query(f"WITH {O.M} SELECT raw_name, trim(raw_value) AS raw_value, raw_unit, count(*) AS n FROM m GROUP BY ALL")
def csv_files(spark, d):
    """Delimited files by path: all measurements, written with a comment of two lines to each, and read in blocks."""
    path = shared_folder(spark, "csv")
    comment = F.concat(F.lit('see "page", '), "doc_id", F.lit("\nor ask"))
    m = measurements(spark, d).select(F.col("raw_name").alias("Test Name"), F.col("raw_value").alias("Result"), F.col("raw_unit").alias("Units"), comment.alias("Comment"))
    m.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    good, _ = delimited_files.rows(spark, path)
    return good.groupBy("raw_name", "raw_value", "raw_unit").agg(F.count("*").alias("n"))


@query(f"WITH {O.READINGS} SELECT doc_id, ord, layout::int AS layout, raw_name, value, comparator, unit, standardized_name, confidence, resolved FROM readings")
def text_resolved(spark, d):
    r = text.readings(reports(measurements(spark, d), "hub"))
    return r.select("doc_id", "ord", "layout", "raw_name", "value", "comparator", "unit", "standardized_name", "confidence", "resolved")


# ------------------------------------------------------------ pages

def _paged(spark, d):
    """Reports with page breaks, headings and identity numbers made of their keys."""
    m = measurements(spark, d)
    w = Window.partitionBy("doc_id").orderBy("ord")
    n = F.col("doc_id") % 7
    ident = F.concat(F.lit("S"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit("A"))
    before = F.when(F.row_number().over(w) % 4 == 1, F.concat(F.lit("\fPage 1 of 9\nLab Test Result\nJane Roe\n"), ident, F.lit("\nRemarks:\nfine\n\n"))).when((n == 3) & (F.row_number().over(w) % 4 == 3), F.lit("MRN: ABC1234\n")).otherwise("")
    line = F.concat(before, F.concat_ws(" ", "raw_name", "raw_value", "raw_unit"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return m.select("doc_id", "ord", line.alias("line")).groupBy("doc_id").agg(F.array_join(rows, "\n").alias("content"))


_PAGED = f"""{O.M}, pl AS (SELECT doc_id, ord, CASE WHEN ord % 4 = 1 THEN chr(12) || 'Page 1 of 9' || chr(10) || 'Lab Test Result' || chr(10) || 'Jane Roe' || chr(10) || 'S' || lpad(doc_id::varchar, 7, '0') || 'A' || chr(10) || 'Remarks:' || chr(10) || 'fine' || chr(10) || chr(10)
 WHEN doc_id % 7 = 3 AND ord % 4 = 3 THEN 'MRN: ABC1234' || chr(10) ELSE '' END || raw_name || ' ' || raw_value || ' ' || raw_unit AS line FROM m),
paged AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS content FROM pl GROUP BY doc_id),
pg AS (SELECT doc_id, k AS page, trim(string_split(content, chr(12))[k + 1], ' ' || chr(10)) AS text FROM paged, unnest(range(1, len(string_split(content, chr(12))))) AS r(k))"""


@query(f"WITH {_PAGED} SELECT doc_id, page::int AS page, md5(text) AS text_md5 FROM pg")
def pages_split(spark, d):
    return pages.pages(_paged(spark, d)).select("doc_id", "page", F.md5("text").alias("text_md5"))


@query(f"""WITH {_PAGED}, l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM paged), unnest(range(1, len(ls) + 1)) AS r(i))
SELECT doc_id, line_no::int AS line_no, line FROM l WHERE NOT (line LIKE '%Page 1 of 9' OR line IN ('Lab Test Result', 'Jane Roe', 'Remarks:', 'fine') OR regexp_full_match(line, 'S[0-9]{{7}}A'))""")
def clean_lines(spark, d):
    return pages.clean_lines(_paged(spark, d))


def _extractor():
    """Stands for an outside extractor: lines that end in mg/dL are its markers; it fails on pages that start with HDL."""
    def ask(page: str) -> str:
        if page.startswith("HDL"):
            raise ValueError("cannot read this page")
        rows = [line.rsplit(" ", 2) for line in page.splitlines() if line.endswith(" mg/dL") and len(line.split(" ")) > 2]
        return json.dumps([{"name": r[0], "value": r[1], "unit": r[2]} for r in rows])

    return ask


_PAGES_READ = f"""{_PAGED}, pr AS (SELECT *, strlen(text) < 50 OR starts_with(text, 'HDL') AS failed, list_filter(string_split(text, chr(10)), lambda x: ends_with(x, ' mg/dL') AND len(string_split(x, ' ')) > 2) AS hits FROM pg)"""


@query(f"""WITH {_PAGES_READ} SELECT doc_id, page::int AS page, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN strlen(text) < 50 THEN 'page too short' WHEN failed THEN 'cannot read this page' END AS error, CASE WHEN failed THEN 0 ELSE len(hits) END AS marker_count FROM pr""")
def page_path(spark, d):
    """Pages through an injected extractor: their statuses, errors and numbers of markers."""
    return pages.page_statuses(pages.page_results(_paged(spark, d), _extractor))


@query(f"""WITH {_PAGES_READ}, x AS (SELECT doc_id, page, unnest(hits) AS line FROM pr WHERE NOT failed)
SELECT doc_id, page::int AS page, count(*) AS n, count(*) FILTER ({O.num("trim(regexp_replace(string_split(line, ' ')[-2], '^(<=|>=|≤|≥|<|>)', ''))")} IS NOT NULL) AS n_numbers FROM x GROUP BY ALL""")
def page_values(spark, d):
    """Markers of pages that didn't fail, and how many have a number (near its name on the page, as all that have one are here)."""
    m = pages.page_markers(pages.page_results(_paged(spark, d), _extractor))
    return m.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if("verified").alias("n_numbers"))


@query(f"""WITH {O.RESOLVED}, rd AS (SELECT r.doc_id, r.ord, (r.ord - 1) // 4 + 1 AS page, r.raw_name, r.value, p.unit AS u, standardized_name FROM resolved r JOIN parsed p USING (doc_id, ord) WHERE resolved AND r.value IS NOT NULL),
f AS (SELECT *, first_value(value) OVER w AS v0, first_value(u) OVER w AS u0, row_number() OVER w AS rn FROM rd WINDOW w AS (PARTITION BY doc_id, standardized_name ORDER BY ord)),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, standardized_name) AS n FROM f WHERE rn = 1 OR abs(value - v0) >= 0.0001 OR u <> u0)
SELECT doc_id, standardized_name, ord, value, u AS unit, page::int AS page FROM k WHERE n > 1""")
def page_conflict_candidates(spark, d):
    """Conflicts between pages with their candidates: units before inference, repeats of the first left out."""
    m = measurements(spark, d)
    read = resolve(parsed(m).withColumn("raw_unit_norm", F.col("unit"))).withColumn("page", F.floor((F.col("ord") - 1) / 4).cast("int") + 1)
    c = pages.page_conflicts(read).select("doc_id", "standardized_name", F.explode("candidates").alias("c"))
    return c.select("doc_id", "standardized_name", "c.ord", "c.value", "c.unit", "c.page")


_ITEM = "string_split(line, ' ')"
_PAGE_ROWS = f"""{_PAGES_READ}, it0 AS (SELECT doc_id, page, i, hits[i] AS line FROM pr, unnest(range(1, len(hits) + 1)) AS r(i) WHERE NOT failed),
it AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, i)::int AS ord, array_to_string({_ITEM}[1:len({_ITEM}) - 2], ' ') AS raw_name, {_ITEM}[-2] AS raw_value, 'mg/dL' AS unit FROM it0),
read AS (SELECT *, {O.num("trim(regexp_replace(trim(raw_value), '^(<=|>=|≤|≥|<|>)', ''))")} AS value, {O.comparator('raw_value')} AS comparator FROM it), parsed AS (SELECT * FROM read WHERE value IS NOT NULL)"""
#: The steps of ``O.STATUS`` over the pages' readings, whose comparators don't matter.
_PAGE_STATUS = O.STATUS.replace(O.RESOLVED, O.resolution(_PAGE_ROWS, "parsed", "doc_id, ord"), 1).replace(" AND comparator = c0", "")


@query(f"""WITH {_PAGE_STATUS}, pc AS (SELECT doc_id, count(*) FILTER (failed) AS failed_pages FROM pr GROUP BY doc_id), rj AS (SELECT doc_id, count(*) AS rejections FROM read WHERE value IS NULL GROUP BY doc_id)
SELECT doc_id, coalesce(resolved, 0) AS resolved, coalesce(unresolved, 0)::bigint AS unresolved, coalesce(conflicts, 0) AS conflicts, failed_pages, coalesce(rejections, 0) AS rejections,
 CASE WHEN failed_pages > 0 OR coalesce(impossible, 0) > 0 THEN 'partial_failure' WHEN coalesce(rejections, 0) > 0 OR coalesce(status, 'needs_review') <> 'success' THEN 'needs_review' ELSE 'success' END AS status
 FROM pc LEFT JOIN status USING (doc_id) LEFT JOIN rj USING (doc_id)""")
def paged_status(spark, d):
    """The status of paged documents: of the verified readings of their pages, their failed pages and what was rejected."""
    read = pages.page_readings_and_counts(pages.page_results(_paged(spark, d), _extractor))
    s = validate.document_status(resolve(read), with_comparator=False)
    return s.select("doc_id", "resolved", "unresolved", "conflicts", "failed_pages", "rejections", "status")


_DENSE = f"""{_PAGED}, px AS (SELECT doc_id, page, text, string_split(text, chr(10)) AS ls FROM pg),
hl AS (SELECT doc_id, page, i, ls[i] AS line, sum(regexp_matches(ls[i], '(?i)^\\s*(?:{"|".join(V.SECTIONS)})\\s*[:\\-]?\\s*$')::int) OVER (PARTITION BY doc_id, page ORDER BY i) AS part FROM px, unnest(range(1, len(ls) + 1)) AS r(i)),
hs AS (SELECT doc_id, page, part, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS b FROM hl GROUP BY ALL),
hb AS (SELECT doc_id, page, max(part) AS n, list(b ORDER BY part) FILTER (b <> '') AS headed FROM hs GROUP BY ALL),
cut AS (SELECT doc_id, page, text, n, headed, contains(text, chr(10) || chr(10)) AS gaps, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda b: trim(b, ' ' || chr(10))), lambda b: b <> '') AS apart,
 list_reduce(list_transform(ls, lambda l: {{'done': []::varchar[], 'held': l}}), lambda a, x: CASE WHEN a.held <> '' AND strlen(a.held) + strlen(x.held) + 1 > 120 THEN {{'done': list_append(a.done, a.held), 'held': x.held}}
 ELSE {{'done': a.done, 'held': CASE WHEN a.held = '' THEN x.held ELSE a.held || chr(10) || x.held END}} END) AS fold FROM px JOIN hb USING (doc_id, page)),
blocks AS (SELECT doc_id, page, CASE WHEN strlen(text) <= 120 THEN [text] WHEN n > 0 AND len(list_filter(headed, lambda b: strlen(b) > 120)) = 0 THEN headed WHEN gaps AND len(list_filter(apart, lambda b: strlen(b) > 120)) = 0 THEN apart
 ELSE list_filter(list_transform(list_append(fold.done, fold.held), lambda b: trim(b, ' ' || chr(10))), lambda b: b <> '') END AS bs FROM cut)"""


@query(f"WITH {_DENSE} SELECT doc_id, page::int AS page, i::int AS block, bs[i] AS text FROM blocks, unnest(range(1, len(bs) + 1)) AS r(i)")
def dense_split(spark, d):
    return pages.split_dense(pages.pages(_paged(spark, d)), 120).select("doc_id", "page", "block", "text")


@query(f"""WITH {_PAGED} SELECT doc_id, page::int AS page, 'S' || lpad(doc_id::varchar, 7, '0') || 'A' AS patient FROM pg""")
def patient_id(spark, d):
    return pages.pages(_paged(spark, d)).select("doc_id", "page", columns.patient_id(F.col("text")).alias("patient"))


@query("SELECT doc_id, count(DISTINCT id) AS n_ids, arg_min(id, page) AS first_id, count(DISTINCT id) <= 1 AS single FROM (SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn % 5 = 3 AND conv_id % 4 = 0 THEN 'MRN-' || conv_id || '77' ELSE 'AB' || lpad(conv_id::varchar, 6, '0') END AS id FROM conversations) GROUP BY doc_id")
def single_patient(spark, d):
    other = (F.col("turn") % 5 == 3) & (F.col("conv_id") % 4 == 0)
    head = F.when(other, F.concat(F.lit("patient id: mrn-"), "conv_id", F.lit("77 "))).otherwise(F.concat(F.lit("Patient ID # ab"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(" ")))
    return pages.patients(_read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), head.alias("text")))


@query(f"SELECT doc_id, md5({O.redact('text')}) AS redacted_md5 FROM documents")
def redact_pii(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(columns.redact(F.col("text"))).alias("redacted_md5"))


@query("SELECT role, count(*) AS n, count(*) FILTER (x <> text) AS changed, (sum(len(x) - len(replace(x, '<PHONE>', ''))) // 7)::bigint AS phones FROM (SELECT role, text, " + O.redact("text || ' DOB: 1/2/1980 ref no 77-A'") + " AS x FROM conversations) GROUP BY role")
def redaction_counts(spark, d):
    x = columns.redact(F.concat("text", F.lit(" DOB: 1/2/1980 ref no 77-A")))
    df = _read(spark, d, "conversations").select("role", "text", x.alias("x"))
    phones = (F.length("x") - F.length(F.replace("x", F.lit("<PHONE>"), F.lit("")))) / 7
    return df.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("x") != F.col("text")).alias("changed"), F.sum(phones.cast("long")).alias("phones"))


@query("SELECT doc_id, kind, count(*) AS n FROM (SELECT page_id AS doc_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'image' WHEN page_id % 4 = 2 THEN 'text' ELSE 'pdf' END AS kind FROM pages) GROUP BY ALL")
def route_files(spark, d):
    k = F.col("page_id") % 4
    path = F.concat(F.lit("/in/r"), "page_id", F.when(k == 0, ".PDF").when(k == 1, ".jpeg").when(k == 2, ".csv").otherwise(""))
    head = F.when((k == 2) | (k == 3), "%PDF-1.7").cast("binary")
    return _read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), files.route(path, head).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_PAGED} SELECT doc_id, page::int AS page, len(regexp_replace(text, '\\s', '', 'g')) > 50 AS has_text FROM pg")
def text_layer(spark, d):
    return pages.pages(_paged(spark, d)).select("doc_id", "page", files.has_text_layer(F.col("text")).alias("has_text"))


# ------------------------------------------------------------ extractors' answers

def _answers(spark, d):
    """Answers as an extractor gives them, made of measurements: bare lists, keyed, fenced, with talk around; numbers and texts."""
    m = columns.with_number(measurements(spark, d), "raw_value")
    n = F.col("value")
    as_text = F.col("ord") % 2 == 0
    body = F.concat(F.lit('{"name": "'), "raw_name", F.lit('", "value": '), F.when(as_text, F.concat(F.lit('"'), "raw_value", F.lit('"'))).otherwise(F.when(n.isNotNull(), F.format_string("%.3f", n)).otherwise("null")), F.lit(', "unit": "'), "raw_unit", F.lit('"}'))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("ord", body.alias("b")))), lambda x: x["b"])
    a = m.select("doc_id", "ord", body.alias("body")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), ",").alias("rows"))
    k, rows = F.col("doc_id") % 4, F.concat(F.lit("["), "rows", F.lit("]"))
    return a.select("doc_id", F.when(k == 0, rows).when(k == 1, F.concat(F.lit('{"results": '), rows, F.lit("}"))).when(k == 2, F.concat(F.lit("```json\n"), rows, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), rows, F.lit(" done"))).alias("answer"))


def _items(spark, d):
    return _answers(spark, d).select("doc_id", F.posexplode(answers.items(F.col("answer"))).alias("k", "x")).select("doc_id", (F.col("k") + 1).alias("ord"), "x.*")


@query(f"WITH {O.M} SELECT doc_id, ord, raw_name AS name, raw_unit AS unit FROM m")
def llm_json(spark, d):
    return _items(spark, d).select("doc_id", "ord", "name", "unit")


@query(f"""WITH {O.PARSED}, x AS (SELECT *, trim(regexp_replace(trim(raw_value), '^(<=|>=|≤|≥|<|>)', '')) AS rest FROM parsed)
SELECT doc_id, ord, CASE WHEN ord % 2 = 0 THEN {O.num('rest')} ELSE round(value, 3) END AS value, CASE WHEN ord % 2 = 0 THEN comparator ELSE '=' END AS comparator FROM x""")
def llm_coerce(spark, d):
    c = answers.coerced(F.col("value"), F.col("comparator"))
    return _items(spark, d).select("doc_id", "ord", c.alias("c")).select("doc_id", "ord", "c.value", "c.comparator")


@query(f"WITH {O.PROXIMITY} SELECT doc_id, ord, written, verified FROM near")
def verify_proximity(spark, d):
    """Whether each answered value stands near its name in the document's text."""
    c = _items(spark, d).select("doc_id", "ord", "name", answers.coerced(F.col("value"), F.col("comparator"))["written"].alias("written"))
    page = reports(measurements(spark, d))
    return c.join(page, "doc_id").select("doc_id", "ord", "written", answers.near(F.col("content"), F.col("written"), F.col("name")).alias("verified"))


@query("""SELECT doc_id, count(*) FILTER (s = 'ok') AS n_ok, count(*) FILTER (s = 'partial') AS n_partial, count(*) FILTER (s = 'failed') AS n_failed,
CASE WHEN count(*) FILTER (s = 'failed') > 0 THEN 2 WHEN count(*) FILTER (s = 'partial') > 0 THEN 1 ELSE 0 END AS rank FROM (SELECT user_id AS doc_id,
CASE WHEN event_type = 'view' THEN 'partial' WHEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS int) > 90 THEN 'failed' ELSE 'ok' END AS s FROM events) GROUP BY doc_id""")
def page_rollup(spark, d):
    e = _read(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    return answers.page_rollup(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page"), F.when(k > 90, "page too short").alias("error"), (F.col("event_type") == "view").alias("was_split")))


@query(f"""WITH {O.RESOLVED}, seen AS (SELECT doc_id, ord, raw_name, standardized_name, row_number() OVER (PARTITION BY doc_id, coalesce(standardized_name, lower(raw_name)) ORDER BY ord) AS nth FROM resolved)
SELECT doc_id, lower(raw_name) AS name, ord FROM seen WHERE nth = 1 AND standardized_name IS NULL""")
def unresolved_once(spark, d):
    return answers.unresolved_once(_resolved(spark, d)).select("doc_id", F.lower("raw_name").alias("name"), "ord")


# ------------------------------------------------------------ over time

@query(f"WITH {O.RESOLVED} SELECT patient_id, standardized_name, max(date)::varchar AS date, arg_max(value, (date, doc_id, ord)) AS value FROM resolved WHERE resolved AND value IS NOT NULL GROUP BY ALL")
def latest(spark, d):
    n = _numeric(spark, d).filter("resolved")
    return longitudinal.latest_numbers(n, ["patient_id", "standardized_name"], "date", ["value"], "doc_id", "ord").withColumn("date", F.col("date").cast("string"))


@query(f"WITH {O.RESOLVED} SELECT patient_id, standardized_name, date::varchar AS date, doc_id, ord, value FROM resolved WHERE standardized_name IN ('tsh', 'hba1c') AND value IS NOT NULL")
def history(spark, d):
    return longitudinal.history(_numeric(spark, d), ["tsh", "hba1c"]).select("patient_id", "standardized_name", F.col("date").cast("string").alias("date"), "doc_id", "ord", "value")


@query("""WITH l AS (SELECT user_id, event_type, event_id, value, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
r AS (SELECT *, gap // 86400000000 AS days FROM l), s AS (SELECT *, CASE WHEN days > 0 THEN dv / days END AS rate FROM r)
SELECT e.user_id, e.event_type, e.event_id, round(rate, 6) AS rate, round(rate - lag(rate) OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts, e.event_id), 6) AS acceleration FROM s JOIN events e USING (event_id)""")
def trend(spark, d):
    e = _read(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    days = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 86400000000)
    t = longitudinal.trend(e, ["user_id", "event_type"], "ts", "value", "event_id", days)
    return t.select("user_id", "event_type", "event_id", F.round("rate", 6).alias("rate"), F.round("acceleration", 6).alias("acceleration"))


@query(f"""WITH {O.RESOLVED}, x AS (SELECT * FROM resolved WHERE resolved AND value IS NOT NULL AND date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31')
SELECT patient_id, standardized_name, arg_min(value, (date, doc_id, ord)) AS first_value, arg_max(value, (date, doc_id, ord)) AS last_value, arg_max(value, (date, doc_id, ord)) - arg_min(value, (date, doc_id, ord)) AS change, count(*) AS n FROM x GROUP BY ALL""")
def compare(spark, d):
    import datetime

    n = _numeric(spark, d).filter("resolved").withColumn("tie", F.struct("doc_id", "ord"))
    return longitudinal.compare(n, ["patient_id", "standardized_name"], "date", "value", "tie", datetime.date(1994, 1, 1), datetime.date(1996, 12, 31))


@query(f"WITH {O.M} SELECT count(DISTINCT patient_id) AS patients, count(DISTINCT doc_id) AS sessions, count(*) AS records FROM m")
def stats(spark, d):
    return longitudinal.stats(measurements(spark, d))


def _store(spark, d):
    m = measurements(spark, d)
    patients, sessions, markers = longitudinal.store(resolve(parsed(m)), m)
    return patients.withColumn("archived", F.col("archived") | (F.col("id") % 10 == 3)), sessions, markers


_STORE = f"""{O.RESOLVED}, se AS (SELECT doc_id AS id, min(patient_id) AS patient_id, min(date) AS date FROM resolved GROUP BY doc_id),
ex AS (SELECT se.patient_id, 'patient-' || se.patient_id AS slug, se.date, doc_id AS session_id, ord AS id, standardized_name, value, unit FROM resolved JOIN se ON se.id = doc_id WHERE resolved AND value IS NOT NULL AND se.patient_id % 10 <> 3)"""


@query(f"WITH {_STORE} SELECT patient_id, slug, date::varchar AS date, session_id, id, standardized_name, value, unit FROM ex")
def store_export(spark, d):
    return longitudinal.export(*_store(spark, d)).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {_STORE} SELECT patient_id, standardized_name, max(date)::varchar AS date, arg_max(slug, (date, session_id, id)) AS slug, arg_max(session_id, (date, session_id, id)) AS session_id, arg_max(id, (date, session_id, id)) AS id, arg_max(value, (date, session_id, id)) AS value, arg_max(unit, (date, session_id, id)) AS unit FROM ex GROUP BY patient_id, standardized_name")
def store_export_latest(spark, d):
    return longitudinal.export(*_store(spark, d), only_latest=True).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {_STORE} SELECT patient_id, count(DISTINCT standardized_name) AS n_markers, count(*) AS n_values, min(date)::varchar AS first_date, max(date)::varchar AS last_date FROM ex GROUP BY patient_id")
def store_summary(spark, d):
    s = longitudinal.summary(longitudinal.export(*_store(spark, d)))
    return s.select("patient_id", "n_markers", "n_values", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"))


@query(f"WITH {_STORE} SELECT patient_id AS id, 'patient-' || patient_id AS slug, count(*) AS n_sessions, max(date)::varchar AS last_date FROM se WHERE patient_id % 10 <> 3 GROUP BY patient_id")
def store_list(spark, d):
    return longitudinal.listed(*_store(spark, d)[:2]).withColumn("last_date", F.col("last_date").cast("string"))


@query(f"WITH {_STORE} SELECT patient_id, slug, date::varchar AS date, session_id, id, standardized_name, value, unit FROM ex")
def store_snapshots(spark, d):
    """The export of a store on disk after two appends, the second of which has all sessions again, and an archive."""
    s = Store(spark, shared_folder(spark, "store"), buckets=8)
    m = measurements(spark, d)
    patients, sessions, markers = longitudinal.store(resolve(parsed(m)), m)
    none = lambda df, *cols: df.withColumns({c: F.lit(None).cast(k) for c, k in cols})
    patients = none(patients.withColumn("name", F.concat(F.lit("Patient "), "id")), ("sex", "string"), ("dob", "date"))
    sessions, markers = none(sessions, ("provider", "string")), none(markers, ("reference_range", "string"), ("flagged", "boolean"), ("confidence", "string"))
    s.append(patients, sessions.filter("id % 2 = 0"), markers.filter("session_id % 2 = 0"))
    s.append(patients, sessions, markers)
    s.archive(s.patients().filter("id % 10 = 3"))
    return s.export().withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {O.RESOLVED}, {O.BANDS} SELECT doc_id, ord, value, unit, coalesce(value < hl OR value > hh OR value < sl OR value > sh, false) AS flagged FROM resolved LEFT JOIN band ON sn = standardized_name AND un = unit
WHERE standardized_name IN ('tsh', 'hba1c') AND value IS NOT NULL""")
def history_flags(spark, d):
    return longitudinal.out_of_range(longitudinal.history(_numeric(spark, d), ["tsh", "hba1c"])).select("doc_id", "ord", "value", "unit", "flagged")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve every measurement and roll documents up to a review status."""
    return QUERIES["document_status"](spark, sf_dir)
