"""Points against intervals of the same key, by running extremes over sorted rows: no list of intervals, no join of pairs."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def touches(keys: list[str], is_span: Column, start: str = "start", end: str = "end") -> Column:
    """Whether a row's start or its end lies in [start, end) of some row with ``is_span`` and the same keys.

    A point p lies in a span if, of the spans that begin at p or before it, the furthest end is behind p; as well, if of the spans that end behind
    p the first beginning is at p or before it. Rows in order of start answer the one for all starts, rows in order of falling
    end the other for all ends: two sorts within a key's partition, and a number held for each.
    A row with ``is_span`` touches itself.
    """
    by_start = Window.partitionBy(*keys).orderBy(start).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_end = Window.partitionBy(*keys).orderBy(F.desc(end)).rangeBetween(Window.unboundedPreceding, -1)
    furthest = F.max(F.when(is_span, F.col(end))).over(by_start)
    earliest = F.min(F.when(is_span, F.col(start))).over(by_end)
    return F.coalesce(furthest > F.col(start), F.lit(False)) | F.coalesce(earliest <= F.col(end), F.lit(False))
