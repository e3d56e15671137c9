"""Delimited report texts: recognising them, and reading their rows."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biolab.functions import columns
from biolab.functions import fixed_values as V


def delimiter(first: Column) -> Column:
    tabs, semis, commas = (F.length(first) - F.length(F.replace(first, F.lit(d), F.lit(""))) for d in ("\t", ";", ","))
    return F.when((tabs >= 2) & (tabs >= commas) & (tabs >= semis), "\t").when((semis >= 2) & (semis >= commas), ";").otherwise(",")


def looks_delimited(content: Column) -> Column:
    """At least two lines, two delimiters in the first, half of its fields in letters only, and about as many delimiters in the second."""
    lines = F.split(F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r?\n$", ""), "\r?\n")
    first, second = F.get(lines, 0), F.coalesce(F.get(lines, 1), F.lit(""))
    d = delimiter(first)
    count = lambda c: F.length(c) - F.length(F.replace(c, d, F.lit("")))
    fields = F.split(first, F.concat(F.lit("["), d, F.lit("]")))
    letters = F.size(F.filter(fields, lambda f: columns.trim(f).rlike(r"(?U)^[\p{L}\s]+$")))
    return (F.size(lines) >= 2) & (count(first) >= 2) & (letters >= F.floor(F.size(fields) / 2)) & (F.abs(count(second) - count(first)) <= 1)


def role(headers: list[str], known: list[str]) -> int | None:
    return next((i for i, h in enumerate(headers) if h.lower().strip() in known), None)


def rows(reports: DataFrame) -> DataFrame:
    """(doc_id, ord, raw_name, raw_value, raw_unit) of delimited texts; quotes may hold delimiters and line ends.

    Rows without a name or value are left out; a text without a name or value column has no rows.
    """
    first = F.get(F.split(F.regexp_replace("content", "^﻿", ""), "\r?\n"), 0)

    def batches(source):
        for batch in source:
            out = [[] for _ in range(5)]
            for doc, text, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                reader = csv.reader(io.StringIO((text or "").removeprefix("﻿"), newline=""), delimiter=d)
                head = [h.strip() for h in next(reader, [])]
                at = [role(head, k) for k in (V.NAME_HEADERS, V.VALUE_HEADERS, V.UNIT_HEADERS)]
                if at[0] is None or at[1] is None:
                    continue
                for n, row in enumerate(reader, 1):
                    got = [row[i].strip() if i is not None and i < len(row) else "" for i in at]
                    if got[0] and got[1]:
                        for c, x in zip(out, (doc, n, *got)):
                            c.append(x)
            kinds = [batch.schema.field(0).type, pa.int32(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "ord", "raw_name", "raw_value", "raw_unit"])

    kind = reports.schema["doc_id"].dataType.simpleString()
    return reports.select("doc_id", "content", delimiter(first).alias("d")).mapInArrow(batches, f"doc_id {kind}, ord int, raw_name string, raw_value string, raw_unit string")
