import json

import pytest
from pyspark.sql import functions as F

from biolab.operators import answers, conflicts, pages, text, validate
from biolab.operators.resolve import parsed, resolve
from biolab.sources import catalog, files, tabular

MEASUREMENT = "doc_id long, ord int, raw_name string, raw_value string, raw_unit string"


def resolved(spark, *rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], MEASUREMENT)
    return resolve(parsed(df))


def names(df):
    return [(r.standardized_name, r.confidence, r.unit, r.unit_status) for r in df.orderBy("doc_id", "ord").collect()]


def test_resolution_order_units_and_ambiguity(spark):
    df = resolved(
        spark, ("LDL", "130", "mg/dl"), ("LDL", "130", "U/L"), ("Haemoglobin Level", "14", ""), ("TSH", "2", ""), ("CRP", "3", "mg/L"), ("CRP", "10", "mg/L"),
        ("CRP", "12", "mg/L"), ("CRP", "3", ""), ("Protein", "70", "g/L"), ("C-Reactive Protein", "9", "mg/L"), ("Nothing Known", "1", "x"), ("TC/HDL Ratio", "3", ""),
    )
    assert names(df) == [
        ("ldl_cholesterol", "exact", "mg/dL", "Observed"), (None, None, "U/L", "Observed"), ("hemoglobin", "normalized", "", "Missing"), ("tsh", "exact", "mIU/L", "Inferred"),
        ("hscrp", "inferred_from_unit", "mg/L", "Observed"), ("hscrp", "ambiguous", "mg/L", "Observed"), ("standard_crp", "inferred_from_unit", "mg/L", "Observed"), ("hscrp", "ambiguous", "", "Missing"),
        ("total_protein", "inferred_from_unit", "g/L", "Observed"), ("hscrp", "inferred_from_unit", "mg/L", "Observed"), (None, None, "x", "Observed"), ("tc_hdl_ratio", "exact", "", "Observed"),
    ]


def test_conflicts_status_and_nothing_found(spark):
    df = resolved(spark, ("LDL", "130", "mg/dL"), ("ldl-c", "130", "mg/dL"), ("HDL", "50", "mg/dL"), ("HDL", "<50", "mg/dL"), ("TSH", "600", "mIU/L"), ("Glucose", "300", "mg/dL"))
    g = conflicts.groups(df)
    assert {r.standardized_name: (r.agree, r.n_readings) for r in g.collect()} == {"ldl_cholesterol": (True, 2), "hdl_cholesterol": (False, 2), "tsh": (True, 1), "fasting_glucose": (True, 1)}
    assert {r.standardized_name: r.agree for r in conflicts.groups(df, False).collect()}["hdl_cholesterol"]
    assert [[c.ord for c in r.candidates] for r in conflicts.conflicting(df, g).collect()] == [[2, 3]]
    s = validate.document_status(df).first()
    assert (s.resolved, s.conflicts, s.impossible, s.unusual, s.status, s.found_nothing) == (3, 1, 1, 1, "partial_failure", False)
    only = resolved(spark, ("HDL", "50", "mg/dL"), ("HDL", "60", "mg/dL"))
    assert validate.document_status(only).first().found_nothing
    fine = resolved(spark, ("LDL", "130", "mg/dL"))
    assert validate.document_status(fine).first().status == "success"


@pytest.mark.parametrize(
    "counts,rank",
    [((0, 3, 0, 0, 0, 0, 0, 0), 1), ((0, 0, 0, 0, 0, 0, 0, 0), 1), ((2, 10, 0, 0, 0, 0, 0, 0), 1), ((10, 2, 0, 0, 0, 0, 0, 0), 0), ((5, 0, 0, 0, 0, 1, 0, 0), 2), ((5, 0, 0, 0, 2, 0, 0, 0), 1), ((5, 0, 0, 0, 0, 0, 0, 1), 1)],
)
def test_status_from_counters(spark, counts, rank):
    keys = ["resolved", "unresolved", "conflicts", "ambiguous", "unit_gaps", "failed_pages", "partial_pages", "rejections"]
    assert spark.range(1).select(validate.assess({k: F.lit(c) for k, c in zip(keys, counts)})).first()[0] == rank


def test_cross_checks(spark):
    df = resolved(
        spark, ("Total Cholesterol", "200", "mg/dL"), ("LDL", "100", "mg/dL"), ("HDL", "50", "mg/dL"), ("Triglycerides", "100", "mg/dL"), ("TC/HDL Ratio", "5", "ratio"),
        ("Neutrophils", "60", "%"), ("Lymphocytes", "30", "%"), ("Monocytes", "2", "%"),
    )
    c = validate.cross_checks(conflicts.kept(conflicts.groups(df))).first()
    assert (c.friedewald, c.friedewald_warns, c.tc_hdl, c.tc_hdl_warns, c.pct_sum, c.pct_warns) == (170.0, False, 4.0, True, 92.0, True)
    zero = resolved(spark, ("Total Cholesterol", "0", "mg/dL"), ("LDL", "1", "mg/dL"), ("HDL", "1", "mg/dL"), ("Triglycerides", "5", "mg/dL"))
    assert validate.cross_checks(conflicts.kept(conflicts.groups(zero))).first().friedewald_warns


def test_catalog_overlay(spark, tmp_path):
    path = tmp_path / "more.toml"
    path.write_text('[[marker]]\nid = "tsh"\ndisplay_name = "TSH 3"\naliases = ["tsh three"]\nallowed_units = ["mIU/L"]\n[[disambiguation]]\nambiguous_name = "Odd"\ndefault_id = "tsh"\n[[disambiguation.candidates]]\nid = "tsh"\nwhen_value_below = 5.0\n')
    rows, amb = catalog.entries(str(path))
    m = {r.id: r.display_name for r in catalog.markers(spark, rows).collect()}
    a = {r.alias: r.id for r in catalog.aliases(spark, rows).collect()}
    assert m["tsh"] == "TSH 3" and a["tsh three"] == "tsh" and a["thyroid stimulating hormone"] == "tsh" and a["ldl cholesterol"] == a["ldl-cholesterol"] == "ldl_cholesterol"
    df = spark.createDataFrame([(1, 1, "odd", "3", ""), (1, 2, "ODD", "7", "")], MEASUREMENT)
    assert [r.confidence for r in resolve(parsed(df), str(path)).orderBy("ord").collect()] == ["inferred_from_unit", "ambiguous"]


def test_running_text(spark):
    report = "HbA1c 5,8%, ApoB 95 mg/dL, LDL 130 mg/dL\nTSH\n  Results: < 0.15 (mIU/L)\n\tnext % Hemoglobin: 14 g/dL and 3 more"
    rows = text.readings(spark.createDataFrame([(1, report), (2, None), (3, "")], "doc_id long, content string")).orderBy("doc_id", "ord").collect()
    got = [(r.standardized_name, r.value, r.comparator, r.unit) for r in rows if r.resolved]
    assert got == [("tsh", 0.15, "<", "mIU/L"), ("hemoglobin", 14.0, "=", "g/dL"), ("hba1c", 5.8, "=", "%"), ("apolipoprotein_b", 95.0, "=", "mg/dL"), ("ldl_cholesterol", 130.0, "=", "mg/dL")]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_delimited_text(spark, sep):
    content = "﻿" + sep.join(["Test Name", "Result", "Units"]) + "\n" + sep.join(['"LDL' + sep + '\nfasting"', "130", "mg/dL"]) + "\n" + sep.join(["HDL", "5,1" if sep != "," else '"5,1"', ""]) + "\n" + sep.join(["", "1", "x"]) + "\n"
    df = spark.createDataFrame([(1, content), (2, f"Name{sep}Value\nx{sep}1")], "doc_id long, content string")
    assert [r[0] for r in df.orderBy("doc_id").select(tabular.looks_delimited(F.col("content"))).collect()] == [True, False]
    got = [(r.raw_name, r.raw_value, r.raw_unit) for r in tabular.rows(df.filter("doc_id = 1")).collect()]
    assert got == [(f"LDL{sep}\nfasting", "130", "mg/dL"), ("HDL", "5,1", "")]


def test_pages_and_cleaning(spark):
    report = "\fPage 1 of 2\nLab Test Result\nJane Roe\nS1234567A\nLDL 130\nRemarks:\nall fine\n\nHDL 50\nSerum Indices: x\f  \fGenerated On: today\nTSH 2"
    df = spark.createDataFrame([(1, report), (2, " \f ")], "doc_id long, content string")
    assert [(r.doc_id, r.page) for r in pages.pages(df).orderBy("doc_id", "page").collect()] == [(1, 1), (1, 2), (2, 1)]
    one = spark.createDataFrame([(1, report.replace("\f", "\n"))], "doc_id long, content string")
    assert [r.line for r in pages.clean_lines(one).orderBy("line_no").collect() if r.line.strip()] == ["LDL 130", "HDL 50", "TSH 2"]
    ids = spark.createDataFrame([(1, 1, "S1234567A"), (1, 2, "s1234567a x"), (2, 1, "MRN 123456"), (2, 2, "MRN 654321"), (3, 1, "none")], "doc_id long, page int, text string")
    assert {r.doc_id: (r.n_ids, r.single) for r in pages.patients(ids).collect()} == {1: (1, True), 2: (2, False), 3: (0, True)}


def test_dense_blocks(spark):
    assert pages.dense_blocks("short", 10) == ["short"]
    assert pages.dense_blocks("aaaa bbbb\nResults:\ncccc dddd", 20) == ["aaaa bbbb", "Results:\ncccc dddd"]
    assert pages.dense_blocks("one one\n\ntwo two", 9) == ["one one", "two two"]
    lines = "\n".join(f"marker {i} {i * 7} mg/dL" for i in range(100))
    blocks = pages.dense_blocks(lines, 300)
    assert all(len(b) <= 300 for b in blocks) and "\n".join(blocks) == lines
    long = " ".join(["word"] * 100) + "é" * 300
    assert all(len(b.encode()) <= 200 for b in pages.dense_blocks(long, 200)) and "".join("".join(pages.dense_blocks(long, 200)).split()) == "".join(long.split())


def test_answers(spark):
    item = '{"name": "Insulin", "value": %s, "unit": "mIU/L"}'
    given = [f"[{item % 5}]", '{"data": [%s]}' % (item % '"<4.10"'), f"```json\n[{item % 5.5}]\n```", f"sure: [{item % 'true'}] bye", "nothing", '{"results": 3}']
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, answer string")
    rows = df.select("doc_id", F.explode_outer(answers.items(F.col("answer"))).alias("x")).orderBy("doc_id")
    got = [(r.c.value, r.c.comparator, r.c.written) for r in rows.select(answers.coerced(F.col("x.value"), F.col("x.comparator")).alias("c")).collect()]
    assert got[:4] == [(5.0, "=", "5"), (4.1, "<", "4.10"), (5.5, "=", "5.5"), (None, "=", None)] and all(v[0] is None for v in got[4:])
    cases = [("Insulin 4.1 mIU/L", "4.10", True), ("Insulin 15 mIU/L", "5", True), ("x" * 300 + " 5 " + "y" * 300 + " Insulin", "5", False), ("Insulin only", "5", False), ("a 5 " + "y" * 300 + " insulin 5", "5", True)]
    near = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, page string, written string, want boolean")
    assert [r.got == r.want for r in near.select(answers.near(F.col("page"), F.col("written"), F.lit("Fasting Insulin")).alias("got"), "want").collect()] == [True] * len(cases)


def test_extractor_slot(spark):
    blocks = spark.createDataFrame([(1, 1, 1, "x" * 60), (1, 2, 1, "short")], "doc_id long, page int, block int, text string")
    got = {r.page: (r.answer, r.error) for r in files.extract(blocks, lambda: lambda t: json.dumps([len(t)])).collect()}
    assert got == {1: ("[60]", None), 2: (None, "page too short")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Résumé\nline")
    assert [r.content for r in files.texts(spark, str(tmp_path)).collect()] == ["Résumé\nline"]
    assert files.literal(spark, "LDL 1").first().source == "text-input"


def test_streaming(spark, tmp_path):
    from biolab.sources.measurements import measurements
    from biolab.streaming import measurements as stream

    m = measurements(spark, "/root/testdata/sf0.001").filter("doc_id < 200")
    m.select("doc_id", "ord", "patient_id", "date", "raw_name", "raw_value", "raw_unit").repartition(3, "doc_id").write.parquet(f"{tmp_path}/in")
    q = stream.write_status(stream.read(spark, f"{tmp_path}/in", 2), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination()
    r = resolve(parsed(m))
    want = validate.document_status(r)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").drop("batch").collect())) == sorted(map(str, want.collect()))
