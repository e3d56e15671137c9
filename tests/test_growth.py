"""How plans grow with their tables: parts by rows, one pass over the lines."""

import pytest

from biolab.operators.store import Store
from biolab.plans import registry
from biolab.sources import measurements as source

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_shares(monkeypatch):
    monkeypatch.setattr(source, "SHARE", 100)


@pytest.mark.parametrize("name", ["csv_rows", "csv_sniff", "clean_lines", "pages_split", "document_status", "regex_gate", "error_rows"])
def test_lines_are_dealt_by_their_number_once(spark, small_shares, name):
    """Parts grow with the rows, and no table is read or dealt by document again."""
    p = plan(registry.QUERIES[name](spark, SF))
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    assert "hashpartitioning(l_orderkey#" in p and f", {n}), REPARTITION_BY_NUM" in p
    assert p.count("lineitem.parquet") == 1 and "Exchange hashpartitioning(doc_id" not in p and "SortMergeJoin" not in p


def test_layouts_by_document(spark):
    """The layout that SQL gives a document, negative ids and missing fields included."""
    rows = [(d, 1, "a;b", "1", u) for d, u in ((0, "x"), (1, "x"), (2, None), (-1, "x"), (-2, ""))] + [(0, 2, None, "2", "y")]
    m = spark.createDataFrame(rows, "doc_id long, ord int, raw_name string, raw_value string, raw_unit string")
    got = {r.doc_id: r.content for r in source.reports(m, ["comma", "semicolon", "tab"]).collect()}
    head = "Test Name\tResult\tUnits\n"
    assert got == {0: 'Test Name,Result,Units\na;b,"1",x\n"2",y', 1: 'Test Name;Result;Units\n"a;b";"1";x', 2: head + 'a;b\t"1"', -1: head + 'a;b\t"1"\tx', -2: head + 'a;b\t"1"\t'}


def resolutions(df):
    """How often a plan looks names up: three tables of rows for each."""
    p = plan(df)
    return (p.count("LocalTableScan") + p.count("Scan ExistingRDD")) / 3


@pytest.mark.parametrize("name, n", [("store_export", 1), ("store_summary", 1), ("store_export_latest", 1), ("store_list", 0), ("page_conflict_candidates", 1)])
def test_names_are_resolved_once(spark, name, n):
    """sessions, patients and first readings need no names of their own."""
    assert resolutions(registry.QUERIES[name](spark, SF)) == n


def test_a_bucket_is_written_by_many_tasks(spark, tmp_path):
    """with few buckets a table of any size went through as few tasks."""
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    people = spark.range(200).selectExpr("id", "concat('p', id) AS slug", "'x' AS name", "'' AS sex", "DATE'2025-01-01' AS dob", "false AS archived", "0L AS seq")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store._put("patients", "b", people)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "store/patients/batch=b/bucket=0").glob("*.parquet"))
    assert len(files) > 1 and spark.read.parquet(f"{tmp_path}/store/patients/batch=b").count() == 200


def test_numbers_of_answers_are_parsed_once(spark):
    """the test for a number and its writing were each a copy of the whole parser."""
    steps = registry._answers(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("+- ")
    writes = [x for x in steps if "format_string" in x]
    assert writes and not any("RLIKE" in x for x in writes)


@pytest.mark.parametrize("name, n", [("paged_status", 3), ("page_path", 2), ("page_values", 3), ("dense_split", 2)])
def test_pages_are_read_once(spark, name, n):
    """statuses, markers and the kinds of dense pages each read the lines, and asked the extractor, again."""
    p = plan(registry.QUERIES[name](spark, SF))
    assert p.count("lineitem.parquet") == 1 and p.count("Exchange hashpartitioning") == n and p.count("ArrowEvalPython") == 1 and "MapInPandas" not in p


def test_counts_on_rows_are_those_of_the_pages(spark):
    """split, failed and empty pages, answers without markers, and markers that aren't on their page, one way and the other."""
    import json

    from biolab.operators import pages, validate
    from biolab.operators.resolve import resolve

    long = "HDL 40 mg/dL and so on for a while, long enough\n\nTSH 2 mIU/L and so on for a while, long enough too\n\nxx"
    texts = ["Glucose 92 mg/dL, a page that is long enough to be read by it\fnothing: a page of words only, which is long enough too", "short", "broken: a page that is long enough to be read, but can't be", long, long + "\fshort", "Glucose 5 mg/dL " * 4, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")

    def start():
        def ask(t):
            if t.startswith("broken"):
                raise ValueError("broken")
            return "none" if t.startswith("nothing") else json.dumps([{"name": n, "value": v, "unit": u} for n, v, u in (("Glucose", 92, "mg/dL"), ("TSH", "2", "mIU/L"), ("HDL", 40, "mg/dL"))])

        return ask

    results = pages.page_results(docs, start, 60)
    markers = pages.page_markers(results)
    statuses = pages.page_statuses(results, markers)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(statuses.fillna("")) == rows(pages.page_statuses(results).fillna("")) and {r.status for r in statuses.collect()} == {"ok", "partial", "failed"}
    assert rows(pages.page_markers(results.drop("text"), docs).select("doc_id", "ord", "verified")) == rows(markers.select("doc_id", "ord", "verified"))
    want = validate.document_status(resolve(pages.page_readings(markers)), pages.page_counts(statuses, markers), with_comparator=False)
    got = validate.document_status(resolve(pages.page_readings_and_counts(results)), with_comparator=False)
    assert rows(got) == rows(want) and got.columns == want.columns and len(rows(got)) == 6


def test_delimited_files_are_read_twice(spark, tmp_path):
    """quotes, first records, records and cut records each read all files again, though no block cut a record."""
    from biolab.sources import delimited_files

    (tmp_path / "a.csv").write_text('Test Name,Result,Units,Comment\nTSH,"2,5",mIU/L,"two\nlines"\nx "y\nz" w,1\n"a"b,"3\n",\n')
    good, bad = delimited_files.rows(spark, str(tmp_path))
    assert plan(good).count("Scan text") == 1 and plan(good).count("MapInArrow") == 1
    assert [(r.raw_name, r.raw_value, r.raw_unit) for r in good.orderBy("ord").collect()] == [("TSH", "2,5", "mIU/L"), ("ab", "3", "")] and not bad.collect()


@pytest.mark.parametrize("name", ["json_envelope", "terminal_table", "warning_rows"])
def test_reports_are_made_where_the_lines_are(spark, small_shares, name):
    """what is made of a line was dealt by (document, marker) and by document again; only the raw lines are dealt."""
    p = plan(registry.QUERIES[name](spark, SF))
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    assert p.count("Exchange hashpartitioning") == 2 and p.count(f", {n}), REPARTITION_BY_NUM") == 2 and p.count("lineitem.parquet") == 1


def test_tasks_that_deal_lines_to_many_parts_read_little(spark, small_shares, tmp_path, monkeypatch):
    """a task held all that it read of lines before it sent it, 18 million at 360 copies, and spilled all of it."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    text = f"{tmp_path}/lines.txt"
    with open(text, "w") as f:
        f.write("x\n" * (3 << 20))
    monkeypatch.setattr(source, "READ_MB", 2, raising=False)
    parts = lambda: spark.read.text(text).rdd.getNumPartitions()
    try:
        few = parts()
        source.measurements(spark, SF)
        assert spark.conf.get(key) == before and parts() == few  # 60 parts need no such thing
        monkeypatch.setattr(source, "UNHELD", 50, raising=False)
        source.measurements(spark, SF)
        assert parts() == 3 > few
        for smaller in ("1m", "1024kb", "1000000"):
            spark.conf.set(key, smaller)
            source.measurements(spark, SF)
            assert spark.conf.get(key) == smaller
    finally:
        spark.conf.set(key, before)
