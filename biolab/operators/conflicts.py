"""Readings of one marker in one document: keep the first where they agree, else report a conflict.

One aggregate over (document, marker) decides; readings are never gathered in lists for that. It carries the first reading as a row,
so Spark sorts for it; where numbers about a group are enough, as for a document's status, ``validate`` has a hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.0001
KEY = ["doc_id", "standardized_name"]


def every_group(rows: DataFrame, with_comparator: bool = True) -> DataFrame:
    """A row for each document and marker, and one for its unresolved rows, whose marker is null.

    It has the first reading, how many readings there are (rows without a number are none) and whether they
    agree. ``with_comparator=False`` is the rule for readings from pages, which doesn't look at comparators.
    """
    rest = [c for c in rows.columns if c not in KEY]
    read = F.col("value").isNotNull()
    unit, mark = F.when(read, F.col("unit")), F.when(read, F.col("comparator"))
    first = F.min_by("value", F.when(read, F.col("ord")))
    same = (F.max("value") - first < TOLERANCE) & (first - F.min("value") < TOLERANCE) & (F.min(unit) == F.max(unit))
    if with_comparator:
        same = same & (F.min(mark) == F.max(mark))
    df = rows.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.when(read, F.col("ord"))).alias("first"), F.count_if(read).alias("n_readings"), same.alias("agree"))
    return df.select(*KEY, "first.*", "n_readings", "agree")


def groups(resolved: DataFrame, with_comparator: bool = True) -> DataFrame:
    """The groups that are readings of a marker."""
    return every_group(resolved.filter("resolved and value is not null"), with_comparator)


def kept(grouped: DataFrame) -> DataFrame:
    return grouped.filter("agree").drop("agree")


def conflicting(resolved: DataFrame, grouped: DataFrame) -> DataFrame:
    """(doc_id, standardized_name, display_name, category, candidates) with all readings of a conflict in order."""
    bad = grouped.filter("not agree").select(*KEY)
    rows = resolved.join(bad, KEY, "left_semi")
    each = F.sort_array(F.collect_list(F.struct("ord", F.col("raw_name").alias("raw_name"), "value", "unit")))
    return rows.groupBy(*KEY).agg(F.first("display_name").alias("display_name"), F.first("category").alias("category"), each.alias("candidates"))
