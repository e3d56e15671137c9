"""Wordings of a document's warnings, in the order of the checks that give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biolab.functions import columns

#: Checks in order: what a warning is ranked by within its document.
CHECKS = ["skipped", "unresolved", "repeated", "conflict", "plausibility", "sum", "friedewald", "ratio"]


def skipped(raw_name: Column, raw_value: Column) -> Column:
    """A measurement without a number."""
    return F.format_string("'%s' was left out: '%s' is no number", raw_name, raw_value)


def unknown(raw_name: Column) -> Column:
    return F.format_string("'%s' is no known marker", raw_name)


def repeated(marker: Column, n: Column) -> Column:
    return F.format_string("%s was read %d times with one value; the first is kept", marker, n)


def conflict(marker: Column, n: Column) -> Column:
    return F.format_string("%s was read %d times with different values", marker, n)


def out_of_band(plausible: Column, display_name: Column, value: Column, unit: Column) -> Column:
    """A value outside its bands, as of ``validate.with_bands``."""
    hard = plausible == "impossible"
    shown = [columns.display_value(c) for c in (value, F.when(hard, F.col("hard_lo")).otherwise(F.col("soft_lo")), F.when(hard, F.col("hard_hi")).otherwise(F.col("soft_hi")))]
    return F.format_string("%s value: %s = %s %s (expected %s to %s)", plausible, display_name, shown[0], unit, *shown[1:])


def of_document() -> list[tuple[str, str, Column]]:
    """(check, column that says whether it warns, text) of the checks across a document's markers, as of ``validate.cross_checks``."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    return [
        ("sum", "pct_warns", F.format_string("differential percentages add up to %s (%d markers)", two("pct_sum"), "pct_count")),
        ("friedewald", "friedewald_warns", F.format_string("total cholesterol is %s, its parts make %s", two("tc_value"), two("friedewald"))),
        ("ratio", "tc_hdl_warns", F.format_string("TC/HDL is given as %s, the values make %s", two("ratio_value"), two("tc_hdl"))),
    ]
