"""Delimited files by path, named texts, and the store of patients, sessions and markers."""

import csv
import datetime
import io
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from biolab.operators.store import Store, slug
from biolab.sources import delimited_files, files, tabular


def written(path, rows, d=",", end="\n", head=("Test Name", "Result", "Units"), bom=""):
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=d, lineterminator=end)
    w.writerow(head)
    w.writerows(rows)
    path.write_bytes((bom + out.getvalue()).encode())
    return bom + out.getvalue()


def by_path(df):
    return sorted((r.path.rsplit("/", 1)[1], r.ord, r.raw_name, r.raw_value, r.raw_unit) for r in df.collect())


@pytest.mark.parametrize("block", ["300", "40", "128m"])
def test_large_files_are_read_in_blocks(spark, tmp_path, block):
    """Against the reader of whole texts; blocks begin anywhere, some inside a quoted field that is longer than a block."""
    rng = random.Random(3)
    names = ["TSH", "Haemoglobin", 'a "quoted" name', "two\nlines", "three\n\n, lines\n", "x" * 130 + "\n" + "y" * 90, "é漢", ""]
    texts = {}
    for i, (d, end, bom) in enumerate([(",", "\n", ""), (";", "\r\n", "﻿"), ("\t", "\n", "")]):
        rows = [(rng.choice(names), rng.choice(["1.5", "2,5", "", "a\r\nb"]), rng.choice(["mg/dL", "", "µ\n"])) for _ in range(120)]
        texts[f"f{i}.csv"] = written(tmp_path / f"f{i}.csv", rows, d, end, bom=bom)
    texts["none.csv"] = written(tmp_path / "none.csv", [("1", "2", "3")] * 5, head=("a", "b", "c"))
    texts["empty.csv"] = ""
    (tmp_path / "empty.csv").write_text("")
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, content string")
    want = {}
    for r in tabular.rows(docs).collect():
        want.setdefault(r.doc_id, []).append((r.ord, r.raw_name, r.raw_value, r.raw_unit))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        good, bad = delimited_files.rows(spark, str(tmp_path))
        got = {}
        for name, at, *fields in by_path(good):
            got.setdefault(name, []).append((at, *fields))
        if block != "128m":
            assert delimited_files.lines(spark, str(tmp_path)).select("path", "block").distinct().count() > 20
        assert {k: [x[1:] for x in v] for k, v in got.items()} == {k: [x[1:] for x in sorted(v)] for k, v in want.items()}
        assert [(r.path.rsplit("/", 1)[1], r.ord, r.error) for r in bad.collect()] == [("none.csv", 0, "no test name column")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "open.csv").write_text('Test Name,Result,Units\nTSH,2,mIU/L\nLDL,"3,mg/dL\nHDL,4,mg/dL\n')
    good, bad = delimited_files.rows(spark, str(tmp_path))
    assert [r.raw_name for r in good.collect()] == ["TSH"] and [r.error for r in bad.collect()] == ["a quoted field has no end"]


def test_many_blocks_are_not_broadcast(spark, tmp_path, monkeypatch):
    written(tmp_path / "a.csv", [("TSH", str(i), "two\nlines") for i in range(100)])
    want = by_path(delimited_files.rows(spark, str(tmp_path))[0])
    monkeypatch.setattr(delimited_files, "BROADCAST_BLOCKS", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = by_path(delimited_files.rows(spark, str(tmp_path))[0])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x[2:] for x in got] == [x[2:] for x in want] and len(got) == 100


def test_named_texts_and_their_errors(spark, tmp_path):
    (tmp_path / "good.txt").write_text("TSH 2.5 mIU/L é")
    (tmp_path / "bad.txt").write_bytes(b"TSH \xff\xfe 2")
    (tmp_path / "blank.txt").write_text(" \n\t")
    (tmp_path / "none.txt").write_text("")
    paths = [f"{tmp_path}/{n}.txt" for n in ("good", "bad", "blank", "none", "missing")]
    got = {r.source.rsplit("/", 1)[1]: (r.content, r.error) for r in files.named_texts(spark, paths).collect()}
    assert got == {"good.txt": ("TSH 2.5 mIU/L é", None), "bad.txt": (None, "IoError"), "blank.txt": (None, "NoInput"), "none.txt": (None, "NoInput"), "missing.txt": (None, "FileNotFound")}
    assert [r.error for r in files.named_texts(spark, paths[4:]).collect()] == ["FileNotFound"]


# ------------------------------------------------------------ store

def tables(spark, sessions):
    """sessions: (session id, patient id, day, value of tsh)."""
    day = lambda d: datetime.date(2025, 1, d)
    ids = sorted({p for _, p, _, _ in sessions if p is not None})
    people = spark.createDataFrame([(p, f"patient-{p}", f"Patient {p}", "female", day(1), False) for p in ids], "id long, slug string, name string, sex string, dob date, archived boolean")
    s = spark.createDataFrame([(i, p, day(d), "a.pdf", "North Lab") for i, p, d, _ in sessions], "id long, patient_id long, date date, source string, provider string")
    m = spark.createDataFrame([(i, 1, "TSH", "tsh", v, "mIU/L", "0.4 - 4.0", v > 4, "exact") for i, _, _, v in sessions], "session_id long, id long, name string, standardized_name string, value double, unit string, reference_range string, flagged boolean, confidence string")
    return people, s, m


def exported(store, snapshot=None):
    return sorted((r.patient_id, r.session_id, r.value) for r in store.export(snapshot).collect())


def test_store_keeps_its_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    assert store.last() is None and store.export().count() == 0 and store.listed().count() == 0
    assert store.append(*tables(spark, [(1, 10, 2, 1.0), (2, 11, 3, 5.0)])) == 0
    assert store.append(*tables(spark, [(1, 10, 2, 1.0), (2, 11, 3, 9.0)])) == 0  # they are there: nothing happens
    old = store.export(0)
    assert store.append(*tables(spark, [(2, 11, 3, 9.0), (3, 10, 5, 2.0), (None, 10, 5, 2.0), (4, None, 5, 2.0)])) == 1
    assert exported(store) == [(10, 1, 1.0), (10, 3, 2.0), (11, 2, 5.0)] and store.patients().count() == 2
    assert store.archive([10, 99]) == 2 and exported(store) == [(11, 2, 5.0)]
    assert exported(store, 1) == [(10, 1, 1.0), (10, 3, 2.0), (11, 2, 5.0)] and exported(store, 0) == [(10, 1, 1.0), (11, 2, 5.0)]
    assert sorted((r.patient_id, r.value) for r in old.collect()) == [(10, 1.0), (11, 5.0)]  # a reader of before is undisturbed
    assert store.archive([10], False) == 3 and [r.value for r in store.export(only_latest=True).orderBy("patient_id").collect()] == [2.0, 5.0]
    assert [(r.id, r.n_sessions) for r in store.listed().orderBy("id").collect()] == [(10, 2), (11, 1)]
    with pytest.raises(ValueError):
        store.read("markers", 9)
    copy = Store(spark, str(tmp_path / "copy"), buckets=4)
    assert store.backup(copy.path) == 0 and exported(copy) == exported(store)
    assert {r.name: (r.sex, str(r.dob)) for r in copy.patients().collect()}["Patient 10"] == ("female", "2025-01-01")


def test_one_patient_reads_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=8)
    store.append(*tables(spark, [(i, i % 20, 1 + i % 25, float(i)) for i in range(100)]))
    df = store.read("markers", patient=7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and df.count() == 5
    got = store.history(7, ["tsh"]).collect()
    assert [r.session_id for r in got] == sorted((i for i in range(100) if i % 20 == 7), key=lambda i: (1 + i % 25, i)) and got[0].reference_range == "0.4 - 4.0"


def test_two_writers_of_one_snapshot_collide(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append(*tables(spark, [(1, 10, 2, 1.0)]))
    with pytest.raises(AnalysisException):
        store._commit(None, [])


def test_slugs(spark):
    assert spark.range(1).select(slug(F.lit(" Ána  María O'Neil! "))).first()[0] == "ána-maría-o-neil"
