"""Readings in running text: three layouts in order of trust, and the spans that the trusted ones take.

Spark's regular expressions give no offsets, so texts are searched in Arrow batches; resolving and the
span rule run in the JVM again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biolab.functions import columns
from biolab.functions import fixed_values as V
from biolab.operators.intervals import touches
from biolab.operators.resolve import resolve

LAYOUTS = [re.compile(V.HUB, re.MULTILINE), re.compile(V.COLON, re.IGNORECASE), re.compile(V.GENERAL, re.IGNORECASE)]


def found(text: str | None):
    """(layout, start, end, name, comparator, value, unit) of every match of each layout."""
    for k, layout in enumerate(LAYOUTS):
        for m in layout.finditer(text or ""):
            yield k, m.start(), m.end(), m["name"].strip(), m["cmp"] or "", m["value"], (m["unit"] or "").strip()


def candidates(reports: DataFrame) -> DataFrame:
    """(doc_id, layout, start, end, raw_name, comparator, raw_value, raw_unit) of every match of each layout."""

    def batches(rows):
        for batch in rows:
            out = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for match in found(text):
                    for c, x in zip(out, (doc, *match)):
                        c.append(x)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "layout", "start", "end", "raw_name", "mark", "raw_value", "raw_unit"])

    kind = reports.schema["doc_id"].dataType.simpleString()
    return reports.select("doc_id", "content").mapInArrow(batches, f"doc_id {kind}, layout int, start long, end long, raw_name string, mark string, raw_value string, raw_unit string")


def readings(reports: DataFrame) -> DataFrame:
    """Resolved candidates less those whose start or end lies in a resolved span of an earlier layout, in order of layout and place.

    Unresolved names reserve no span; stop words and single letters are no names.
    """
    c = candidates(reports)
    c = columns.with_number(c, "raw_value", comparator=columns.comparator(F.col("mark")), unit=columns.normalize_unit(F.col("raw_unit"))).filter("value is not null")
    low = F.lower("raw_name")
    r = resolve(c).filter(F.col("resolved") | ((F.octet_length("raw_name") >= 2) & ~low.isin(V.STOP_WORDS)))
    r = r.select("doc_id", "layout", "start", "end", "raw_name", "raw_value", "raw_unit", "value", "comparator", "unit", "unit_status", "standardized_name", "display_name", "category", "confidence", "method", "resolved")
    for layout in (1, 2):
        taken = F.col("resolved") & (F.col("layout") < layout)
        r = r.withColumn("touches", touches(["doc_id"], taken)).filter((F.col("layout") != layout) | ~F.col("touches")).drop("touches")
    order = Window.partitionBy("doc_id").orderBy("layout", "start")
    return r.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), *r.columns[1:])
