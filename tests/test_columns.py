import pytest
from pyspark.sql import functions as F

from biolab.functions import columns

NUMBERS = [
    ("42", 42.0, False, "plain"), ("-17", -17.0, False, "plain"), ("5.8", 5.8, False, "decimal_dot"), ("5,8", 5.8, False, "decimal_comma"),
    ("1,234", 1234.0, True, "thousands_comma"), ("1,234,567", 1234567.0, False, "thousands_comma"), ("1.234.567", 1234567.0, False, "thousands_dot"),
    ("1,234.56", 1234.56, False, "decimal_dot"), ("1.234,56", 1234.56, False, "decimal_comma"), ("<5", 5.0, False, "plain"), (">100", 100.0, False, "plain"),
    ("<=0.5", 0.5, False, "decimal_dot"), (">=10,5", 10.5, False, "decimal_comma"), ("≤3", 3.0, False, "plain"), ("≥ 7.25", 7.25, False, "decimal_dot"),
    ("< 5", 5.0, False, "plain"), ("1.234", 1.234, True, "decimal_dot"), ("12,3456", 12.3456, True, "decimal_comma"), (" 3 ", 3.0, False, "plain"),
    ("1e3", 1000.0, False, "plain"), ("5d", None, None, None), ("0x1p3", None, None, None), ("", None, None, None), ("  ", None, None, None), ("<", None, None, None), ("abc", None, None, None), (None, None, None, None),
]


def one(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def test_numbers(spark):
    got = one(spark, [(n[0],) for n in NUMBERS], "a string", columns.parse_number(F.col("a")))
    assert [tuple(g) for g in got] == [n[1:] for n in NUMBERS]


def test_hints(spark):
    rows = [("1,234", 10.0), ("1,234", 10000.0), ("1,234", None), ("1.234", 2000.0), ("1.234", 2.0)]
    got = one(spark, rows, "a string, m double", columns.parse_number_with_hint(F.col("a"), F.col("m"))["value"])
    assert got == [1.234, 1234.0, 1234.0, 1234.0, 1.234]


@pytest.mark.parametrize(
    "raw,want",
    [("MG / dl", "mg/dL"), ("µIU/mL", "mIU/mL"), ("K/uL", "x10^9/L"), ("× 10^9 /L", "x10^9/L"), ("10^12/L", "x10^12/L"), ("ug/L", "ng/mL"), ("percent", "%"), (" Odd Unit ", "Odd Unit"), ("", ""), ("sec", "s")],
)
def test_units(spark, raw, want):
    assert one(spark, [(raw,)], "a string", columns.normalize_unit(F.col("a"))) == [want]


def test_names(spark):
    cases = [
        ("Serum Creatinine (Jaffe)", "creatinine"), ("Calcium, Serum", "calcium"), ("Glucose, Fasting", "glucose, fasting"), ("Alanine Aminotransferase (ALT)", "alanine aminotransferase"),
        ("Haemoglobin Level", "hemoglobin"), ("Test", "test"), ("Level Test", "level test"), ("Emoglobina Glicata", "hba1c"), ("Beta–Carotene", "beta-carotene"), ("Thing (a long remark)", "thing (a long remark)"),
        ("eGFR (CKD-EPI 2021)", "egfr"), ("Microalbumin Random", "microalbumin random"), ("Ferritin Plasma", "ferritin"),
    ]
    assert one(spark, [(c[0],) for c in cases], "a string", columns.normalize_name(F.col("a"))) == [c[1] for c in cases]


def test_ranges(spark):
    inf = float("inf")
    cases = [("4.3 - 5.4", 4.3, 5.4), ("4.3-5.4", 4.3, 5.4), ("<5.0", -inf, 5.0), ("> 1.0", 1.0, inf), ("(2.6 - 24.9)", 2.6, 24.9), (">=12", 12.0, inf), ("-5", None, None), ("normal", None, None), ("", None, None), ("<x", None, None), ("1-x", None, None)]
    assert [tuple(r) for r in one(spark, [(c[0],) for c in cases], "a string", columns.parse_reference_range(F.col("a")))] == [c[1:] for c in cases]


def test_redaction_and_patient_ids(spark):
    text = "ID s1234567a, SSN 123-45-6789, DOB: 1/2/1980, MRN: 99-AB, lab no 7, call +65 555 123 4567."
    assert one(spark, [(text,)], "a string", columns.redact(F.col("a"))) == ["ID <ID>, SSN <SSN>, <DOB>, <MRN>, <MRN>, call +<PHONE>."]
    ids = [("x S1234567a y",), ("MRN: abc-123",), ("none here",), ("Patient ID #ab1234",)]
    assert one(spark, ids, "a string", columns.patient_id(F.col("a"))) == ["S1234567A", "ABC-123", None, "AB1234"]


def test_search_forms(spark):
    assert one(spark, [("4.10",), ("5",), ("0.0",), ("4.5",)], "a string", columns.value_variants(F.col("a"))) == [["4.10", "4.1"], ["5", "5.0"], ["0.0", "0"], ["4.5"]]
    assert one(spark, [("Total Insulin-like",), ("TSH",), ("free iron zinc",)], "a string", columns.name_token(F.col("a"))) == ["insulin", "tsh", "zinc"]
    assert one(spark, [(5.0,), (5.25,), (2e6,)], "a double", columns.display_value(F.col("a"))) == ["5", "5.25", "2000000.00"]


def test_trim_is_unicode_white_space(spark):
    from pyspark.sql import functions as F

    from biolab.functions import columns

    for c in [*range(0x100), *range(0x1680, 0x1690), *range(0x180E, 0x1810), *range(0x2000, 0x2070), 0x3000, 0xFEFF]:
        assert (chr(c) in columns.BLANKS) == (chr(c).isspace() and not 0x1C <= c <= 0x1F), hex(c)
    df = spark.createDataFrame([(f" \u3000\t{x}\x85\n\xa0",) for x in ("a b", "", "\ufeffé ", "(x)")], "t string")
    assert df.filter(~columns.trim(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
