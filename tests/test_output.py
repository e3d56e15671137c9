"""What documents become, and the queries that SQL can't express, against plain Python."""

import io
import json
import os
import re
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest

from biolab.functions import columns
from biolab.operators import longitudinal, output, pages, parse, report, text, validate
from biolab.operators import resolve as resolution
from biolab.operators.intervals import touches
from biolab.operators.resolve import parsed, resolve
from biolab.plans import registry
from biolab.sources import catalog, files
from biolab.sources.measurements import measurements, reports
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def sql(query):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(query)
    names = [c[0] for c in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def shown(v):
    """Two decimals round half up on the number's decimal text."""
    return f"{v:.0f}" if v == int(v) and abs(v) < 1e6 else str(Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_UP))


@needs_data
def test_envelope_equals_its_parts(spark):
    of = lambda name: registry.QUERIES[name](spark, SF).collect()
    got = {r.doc_id: json.loads(r.envelope) for r in of("json_envelope")}
    status = {r["doc_id"]: r for r in sql(registry.ORACLES["document_status"])}
    assert set(got) == set(status)
    warned, kept, bad, unknown = {}, {}, {}, {}
    for r in sql(f"SELECT * FROM ({registry.ORACLES['warning_rows']})"):
        warned.setdefault(r["doc_id"], []).append(r["warning"])
    for r in sql(registry.ORACLES["dedupe_keep_first"]):
        kept.setdefault(r["doc_id"], []).append((r["ord"], r["standardized_name"], r["value"], r["unit"]))
    for r in sql(registry.ORACLES["conflict_candidates"]):
        bad.setdefault(r["doc_id"], set()).add((r["standardized_name"], r["value"], r["unit"]))
    for r in sql(f"WITH {registry.O.RESOLVED} SELECT doc_id, ord, raw_name, value, unit FROM resolved WHERE NOT resolved AND value IS NOT NULL ORDER BY doc_id, ord"):
        unknown.setdefault(r["doc_id"], []).append({k: r[k] for k in ("raw_name", "value", "unit")})
    for doc, e in got.items():
        d, m = e["data"], e["metadata"]
        assert e["version"] == "2" and e["status"] == m["document_status"] == status[doc]["status"] and d["source"] == f"order-{doc}"
        assert [(b["standardized_name"], b["value"], b["unit"]) for b in d["biomarkers"]] == [k[1:] for k in sorted(kept.get(doc, []))]
        assert {(c["standardized_name"], x["value"], x["unit"]) for c in d.get("conflicts", []) for x in c["candidates"]} == bad.get(doc, set())
        assert d["unresolved"] == unknown.get(doc, []) and sorted(d["parse_warnings"]) == sorted(warned.get(doc, []))
        assert m["markers_found"] == len(d["biomarkers"]) and m["markers_unresolved"] == len(d["unresolved"]) and m["catalog_version"] == "2.0" and m["parser"] == "csv"
        assert "page_statuses" not in m and ("conflicts" in d) == (doc in bad)
        for b in d["biomarkers"]:
            assert b.get("comparator") != "=" and b.get("unit_status") != "Observed" and b.get("flagged", True) and None not in b.values() and b["resolved"] and b["resolution_method"]


@needs_data
def test_terminal_table_equals_a_plain_formatter(spark):
    table = {r.doc_id: r.shown for r in registry.QUERIES["terminal_table"](spark, SF).collect()}
    envelope = {r.doc_id: json.loads(r.envelope)["data"] for r in registry.QUERIES["json_envelope"](spark, SF).collect()}
    for doc, d in envelope.items():
        want = "No biomarkers found."
        if d["biomarkers"]:
            cells = [("Biomarker", "Value", "Unit", "Category"), *((b["display_name"], shown(b["value"]), b["unit"], b["category"]) for b in d["biomarkers"])]
            w = [max(len(c[i]) for c in cells) for i in range(4)]
            lines = [f"{len(d['biomarkers'])} biomarkers from {d['source']}"]
            lines += ["  ".join([a.ljust(w[0]), b.rjust(w[1]), c.ljust(w[2]), e.ljust(w[3])]).rstrip() for a, b, c, e in cells]
            for c in d.get("conflicts", []):
                lines += [f"conflict: {c['display_name']} ({c['standardized_name']})", *(f"  {shown(x['value'])} {x['unit']} [{x['raw_name']}]" for x in c["candidates"])]
            want = "\n".join([*lines, *(f"warning: {w}" for w in d["parse_warnings"])])
        assert table[doc] == want


@needs_data
def test_text_readings_equal_a_plain_sweep(spark):
    """Every span rule over again, one document at a time, from the candidates resolved one by one."""
    r = reports(measurements(spark, SF)).limit(300)
    hub = spark.createDataFrame([(-1, "HbA1c 5.8% ApoB 95 mg/dL LDL 130 mg/dL"), (-2, "Glucose: 92 mg/dL\nTSH 2.5 mIU/L and x 3"), (-3, None), (-4, "")], "doc_id long, content string")
    r = r.unionByName(hub)
    c = text.candidates(r)
    n = columns.parse_number(F.col("raw_value"))
    c = c.select("*", n["value"].alias("value"), columns.normalize_unit(F.col("raw_unit")).alias("unit")).filter("value is not null")
    docs = {}
    for x in text.resolve(c).collect():
        docs.setdefault(x.doc_id, []).append(x)
    want = set()
    for doc, rows in docs.items():
        taken, k = [], 0
        for layout in range(3):
            mine = sorted((x for x in rows if x.layout == layout), key=lambda x: (x.start, x.end))
            now = []
            for x in mine:
                if not x.resolved and (len(x.raw_name.encode()) < 2 or x.raw_name.lower() in text.V.STOP_WORDS):
                    continue
                if any(a <= p < b for a, b in taken for p in (x.start, x.end)):
                    continue
                want.add((doc, k, layout, x.raw_name, x.value, x.standardized_name))
                k += 1
                now += [(x.start, x.end)] * x.resolved
            taken += now
    got = {(x.doc_id, x.ord, x.layout, x.raw_name, x.value, x.standardized_name) for x in text.readings(r).collect()}
    assert got == want and len(want) > 500
    assert [x[5] for x in sorted(got) if x[0] == -1] == ["hba1c", "apolipoprotein_b", "ldl_cholesterol"]


@needs_data
def test_tokens_stand_where_they_say(spark):
    r = reports(measurements(spark, SF)).limit(200)
    content = {x.doc_id: x.content for x in r.collect()}
    rows = text.candidates(r).collect()
    assert len(rows) > 300
    for x in rows:
        part = content[x.doc_id][x.start : x.end]
        assert x.raw_name in part and x.raw_value in part and part.index(x.raw_name) <= part.rindex(x.raw_value) and x.raw_unit in part


@needs_data
def test_dense_blocks_lose_nothing(spark):
    docs = registry._paged(spark, SF)
    whole = {(r.doc_id, r.page): r.text for r in pages.pages(docs).collect()}
    blocks = {}
    for r in sorted(registry.QUERIES["dense_split"](spark, SF).collect(), key=lambda r: (r.doc_id, r.page, r.block)):
        assert len(r.text.encode()) <= 120
        blocks.setdefault((r.doc_id, r.page), []).append(r.text)
    bare = lambda s: re.sub(r"\s", "", s)
    assert set(blocks) == {k for k, t in whole.items() if t.strip()}
    for k, parts in blocks.items():
        assert bare("".join(parts)) == bare(whole[k])
        if len(whole[k].encode()) <= 120:
            assert parts == [whole[k]]


@needs_data
def test_proximity_equals_brute_force(spark):
    content = {r.doc_id: r.content for r in reports(measurements(spark, SF)).collect()}
    names = {(r.doc_id, r.ord): r.raw_name for r in measurements(spark, SF).collect()}
    rows = registry.QUERIES["verify_proximity"](spark, SF).collect()
    assert len(rows) == len(names)
    for r in rows:
        page, name = content[r.doc_id], names[r.doc_id, r.ord].lower()
        words = [w for w in re.split(r"[^\W\d_]+", name)] and re.findall(r"[^\W\d_]+", name)
        token = name
        for w in words:
            if len(w.encode()) >= 4 and (token == name or len(w.encode()) >= len(token.encode())):
                token = w
        near = False
        if r.written:
            cut = r.written.rstrip("0").rstrip(".")
            more = [cut] if "." in r.written and cut not in ("", r.written) else ([] if "." in r.written else [r.written + ".0"])
            for v in [r.written, *more]:
                raw, v = page.encode(), v.encode()
                at = raw.find(v)
                while at >= 0:
                    near |= token.encode() in page.lower().encode()[max(0, at - 200) : at + len(v) + 200]
                    at = raw.find(v, at + len(v))
        assert r.verified == near, (r, page)


def test_each_text_goes_to_its_reader(spark):
    rows = [(1, "Test Name,Result,Units\nHbA1c,5.8,%\nTSH,2.5,mIU/L"), (2, "﻿Test Name;Result;Units\r\nHbA1c;5,8;%\r\n"), (3, "Fasting Glucose 92 mg/dL"), (4, "HbA1c 5,8%"), (5, " \n"), (6, None)]
    got = parse.auto_parse(spark.createDataFrame(rows, "doc_id long, content string")).filter("resolved").collect()
    assert sorted((r.doc_id, r.parser, r.standardized_name, r.value) for r in got) == [
        (1, "csv", "hba1c", 5.8), (1, "csv", "tsh", 2.5), (2, "csv", "hba1c", 5.8), (3, "text", "fasting_glucose", 92.0), (4, "text", "hba1c", 5.8),
    ]


def test_inputs_and_exit_classes(spark):
    assert files.stdin(spark, io.StringIO("HbA1c 5.8%")).collect()[0].source == "stdin"
    with pytest.raises(ValueError, match="NoInput"):
        files.stdin(spark, io.StringIO(" \n"))
    rows = spark.createDataFrame([(None,), ("NoInput",), ("FileNotFound",), ("ParseFailure",), ("PdfConversionError",), ("Other",)], "e string")
    assert [r[0] for r in rows.select(output.exit_code(F.col("e"))).collect()] == [0, 2, 2, 3, 4, 1]


def test_outside_tools_and_images(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1 " + b"word " * 40)
    (tmp_path / "b").write_bytes(b"%PDF-2 short")
    (tmp_path / "c.PNG").write_bytes(b"png")
    found = files.binaries(spark, f"{tmp_path}/*")
    assert sorted((os.path.basename(r.path), r.kind) for r in found.collect()) == [("a.pdf", "pdf"), ("b", "pdf"), ("c.PNG", "image")]
    texts = files.pdf_texts(found, ["cat", "{source}"]).collect()
    assert [os.path.basename(r.path) for r in texts] == ["a.pdf"]  # the other has too little text
    assert files.pdf_texts(found, ["no-such-tool", "{source}"]).count() == 0
    drawn = files.page_images(found, ["sh", "-c", "for i in 2 1; do cp {source} {folder}/page-$i; done"]).collect()
    assert sorted((os.path.basename(r.path), r.page) for r in drawn) == [("a.pdf", 1), ("a.pdf", 2), ("b", 1), ("b", 2), ("c.PNG", 1)]


def test_archived_patients_are_left_out_but_stay(spark):
    m = spark.createDataFrame([(1, 1, 7, "tsh", 2.0, "mIU/L", True), (2, 1, 8, "tsh", 3.0, "mIU/L", True)], "doc_id long, ord int, patient_id long, standardized_name string, value double, unit string, resolved boolean")
    patients, sessions, markers = longitudinal.store(m.withColumn("raw_name", F.lit("TSH")).withColumn("date", F.current_date()))
    patients = longitudinal.archive(patients, [8])
    assert patients.count() == 2
    assert [r.patient_id for r in longitudinal.export(patients, sessions, markers).collect()] == [7]
    assert [r.id for r in longitudinal.listed(patients, sessions).collect()] == [7]


def test_page_markers_are_held_against_their_own_page(spark):
    page = "Glucose 92 mg/dL and more text to make the page long enough to be read"
    docs = spark.createDataFrame([(1, page + "\f" + "Sodium 140 mmol/L " * 4), (2, "short"), (3, "x" * 60)], "doc_id long, content string")

    def start():
        def ask(t):
            if t.startswith("x"):
                raise ValueError("broken")
            return json.dumps({"results": [{"name": "Glucose", "value": 92, "unit": "mg/dL", "flagged": True}, {"name": "Glucose", "value": "n/a", "unit": ""}]})

        return ask

    results = pages.page_results(docs, start)
    got = sorted((r.doc_id, r.page, r.ord, r.value, r.flagged, r.verified) for r in pages.page_markers(results, docs).collect() if r.value is not None)
    assert got == [(1, 1, 1, 92.0, True, True), (1, 2, 3, 92.0, True, False)]
    statuses = {(r.doc_id, r.page): (r.status, r.error, r.marker_count) for r in pages.page_statuses(results, pages.page_markers(results, docs)).collect()}
    assert statuses == {(1, 1): ("ok", None, 2), (1, 2): ("ok", None, 2), (2, 1): ("failed", "page too short", 0), (3, 1): ("failed", "broken", 0)}


def test_overlay_keeps_specimen_and_qualifier(spark, tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[[marker]]\nid = "u_na"\ncomponent = "Sodium"\nspecimen = "urine"\nqualifier = "24h"\ncategory = "kidney"\nallowed_units = ["mmol/L"]\n')
    rows, _ = catalog.entries(str(path))
    row = catalog.markers(spark, rows).filter("id = 'u_na'").collect()[0]
    assert (row.specimen, row.qualifier) == ("urine", "24h")
    item = json.loads(catalog.listing_json(catalog.markers(spark, rows), "kidney").filter("id = 'u_na'").collect()[0]["item"])
    assert list(item) == ["id", "display_name", "component", "specimen", "allowed_units", "category", "loinc", "alias_count"]


def test_measurements_are_not_shuffled_by_name(spark):
    m = spark.createDataFrame([(1, 1, "TSH", "2.5", "mIU/L")], "doc_id long, ord int, raw_name string, raw_value string, raw_unit string")
    plan = resolve(parsed(m))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 3


def test_a_catalog_too_large_to_broadcast(spark, monkeypatch):
    """The same rows by salted joins, with one name on most of them and null names among them."""
    names = ["Haemoglobin Level"] * 60 + ["CRP", "TSH", None, "Nothing Known", "Serum Creatinine", "Protein"] * 5
    m = spark.createDataFrame([(1, i, n, str(i), "mg/L" if i % 2 else "") for i, n in enumerate(names)], "doc_id long, ord int, raw_name string, raw_value string, raw_unit string")
    want = resolve(parsed(m)).orderBy("ord").collect()
    monkeypatch.setattr(resolution, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(resolution, "_made", {})
    df = resolve(parsed(m))
    assert df.orderBy("ord").collect() == want
    assert "_salt" in df._jdf.queryExecution().optimizedPlan().toString()


def test_points_and_spans(spark):
    """Against every pair of rows; ties of starts and ends, empty keys and rows that are spans themselves."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), i, s, s + rng.randint(1, 8), rng.random() < 0.4) for i in range(400) for s in [rng.randint(0, 300)]]
    df = spark.createDataFrame(rows, "doc_id long, i int, start long, end long, span boolean")
    got = {r.i for r in df.withColumn("t", touches(["doc_id"], F.col("span"))).filter("t").collect()}
    spans = [(d, s, e) for d, _, s, e, is_span in rows if is_span]
    assert got == {i for d, i, s, e, _ in rows if any(k == d and (a <= s < b or a <= e < b) for k, a, b in spans)}
    plan = df.withColumn("t", touches(["doc_id"], F.col("span")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan and plan.count("Exchange") == 1


@needs_data
def test_running_text_holds_no_list_of_a_report(spark):
    df = text.readings(spark.createDataFrame([(1, "TSH: 2 mIU/L")], "doc_id long, content string"))
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


@needs_data
def test_one_scan_for_envelope_and_warnings(spark):
    for name in ("json_envelope", "warning_rows", "terminal_table"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2, name  # lines and orders


def test_counters_of_a_batch(spark):
    m = spark.createDataFrame([(1, 1, "TSH", "2.5", "mIU/L"), (2, 1, "TSH", "n/a", ""), (3, 1, "TSH", "600", "mIU/L")], "doc_id long, ord int, raw_name string, raw_value string, raw_unit string")
    df = report.assembled(resolve(parsed(m)))
    df, seen = report.observed(df, "batch", F.when(F.col("found_nothing"), "NoBiomarkersFound"))
    df.write.format("noop").mode("overwrite").save()
    got = seen.get
    assert (got["documents"], got["success"], got["needs_review"], got["partial_failure"], got["exit_0"], got["exit_3"], got["warnings"]) == (3, 1, 1, 1, 2, 1, 2)


def test_documents_that_only_pages_know(spark):
    m = spark.createDataFrame([(1, 1, "TSH", "2.5", "mIU/L")], "doc_id long, ord int, raw_name string, raw_value string, raw_unit string")
    counts = spark.createDataFrame([(1, 0, 1, 0), (2, 1, 0, 0)], "doc_id long, failed_pages long, partial_pages long, rejections long")
    got = {r.doc_id: (r.status, r.resolved, r.failed_pages) for r in validate.document_status(resolve(parsed(m)), counts).collect()}
    assert got == {1: ("needs_review", 1, 0), 2: ("partial_failure", 0, 1)}


@needs_data
def test_status_and_latest_are_hash_aggregates(spark):
    for name in ("document_status", "latest"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan, name


def test_order_keys_order_as_their_parts(spark):
    import datetime
    import itertools

    days = [datetime.date(1, 1, 1), datetime.date(1969, 12, 31), datetime.date(2025, 1, 1), datetime.date(9999, 12, 31)]
    rows = list(itertools.product(days, [-(2**63), -1, 0, 7, 2**63 - 1], [-(2**31), 0, 2**31 - 1]))
    df = spark.createDataFrame(rows[::-1], "d date, a long, b int").withColumn("k", longitudinal.order_key("d", "a", "b"))
    assert [tuple(r)[:3] for r in df.orderBy("k").collect()] == rows and df.select("k").distinct().count() == len(rows)


def test_dense_pages_in_the_jvm(spark):
    """Headed, blank-line and packed pages against the plain function; pages with a line over the limit too."""
    import random

    rng = random.Random(7)
    heads = ["Biochemistry", "HAEMATOLOGY:", "  Lipid -", "Urinalysis", "Lipid panel of today"]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts.append(rng.choice([rng.choice(heads), " ".join(rng.choice(["TSH", "é2.5", "mg/dL", "漢字"]) for _ in range(rng.randint(0, rng.choice([6, 6, 6, 40]))))]))
            parts.append(rng.choice(["\n", "\n", "\n\n", "\n \n", "\n\n\n", "\r\n"]))
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", F.lit(1).alias("page"), "text")
    for limit in (40, 90):
        got = {}
        for r in sorted(pages.split_dense(df, limit).collect(), key=lambda r: (r.doc_id, r.block)):
            got.setdefault(r.doc_id, []).append(r.text)
        assert {i: b for i, t in enumerate(texts) if (b := pages.dense_blocks(t, limit))} == got
    jvm = [t for t in texts if len(t.encode()) > 90 and all(len(x.encode()) <= 90 for x in t.splitlines())]
    kinds = {bool(pages._SECTION.search(t)) for t in jvm}
    assert len(jvm) > 60 and kinds == {True, False}


def test_the_table_function_wants_reports(spark):
    from pyspark.errors import PySparkException

    from biolab.functions import table_functions

    table_functions.register(spark)
    df = spark.createDataFrame([(1, "TSH: 2 mIU/L"), (2, None)], "doc_id int, content string")
    got = spark.sql("SELECT * FROM report_tokens(TABLE({t}))", t=df)
    assert got.schema["doc_id"].dataType.simpleString() == "int" and {tuple(r) for r in got.collect()} == {tuple(r) for r in text.candidates(df).collect()} != set()
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM report_tokens(TABLE({t}))", t=df.drop("content"))
