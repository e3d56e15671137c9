"""What a document becomes: a JSON envelope, an error, a table for a terminal; and the exit class of an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biolab.functions import columns

#: Exit classes of errors; all others are 1. A status, whatever it is, exits with 0.
EXIT = {"NoInput": 2, "FileNotFound": 2, "ParseFailure": 3, "NoBiomarkersFound": 3, "VisionError": 4, "PdfConversionError": 4}


def exit_code(error: Column) -> Column:
    """0 without an error, else its class."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in EXIT.items() for x in pair]), error)
    return F.when(error.isNull(), 0).otherwise(F.coalesce(known, F.lit(1)))


def outcome(content: Column, resolved: Column, unresolved: Column) -> Column:
    """The error of a text input, or null: blank input, or nothing found in it, even if there are conflicts."""
    blank = F.coalesce(columns.trim(content) == "", F.lit(True))
    return F.when(blank, "NoInput").when((F.coalesce(resolved, F.lit(0)) == 0) & (F.coalesce(unresolved, F.lit(0)) == 0), "NoBiomarkersFound")


def error_envelope(message: Column) -> Column:
    return F.to_json(F.struct(F.lit("2").alias("version"), F.lit("error").alias("status"), message.alias("error")))


def _some(c: str) -> Column:
    """A list, or null where it is empty, so that JSON leaves it out."""
    return F.when(F.size(c) > 0, F.col(c)).alias(c)


def biomarker() -> Column:
    """A marker of the envelope from a resolved row; defaults are null and left out."""
    have = lambda c: F.col(c)
    return F.struct(
        F.col("raw_name").alias("name"), "standardized_name", "display_name", "value", "unit", "category", "resolved", "confidence", F.col("method").alias("resolution_method"),
        F.when(have("comparator") != "=", have("comparator")).alias("comparator"), "reference_range", F.when(have("flagged"), True).alias("flagged"),
        F.when(have("unit_status") != "Observed", have("unit_status")).alias("unit_status"), "page", "raw_value_text", F.when(have("raw_unit") != "", have("raw_unit")).alias("raw_unit"), "source_text",
    )


def envelope(docs: DataFrame) -> Column:
    """The JSON text of a row with source, status, biomarkers, unresolved, conflicts, warnings, page_statuses, parser and elapsed_ms.

    Empty lists of conflicts and pages are left out, other lists stay.
    """
    none = lambda c: F.coalesce(F.col(c), F.array()).alias(c)
    data = F.struct("source", none("biomarkers"), none("unresolved"), _some("conflicts"), F.coalesce("warnings", F.array().cast("array<string>")).alias("parse_warnings"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    count = lambda c: F.when(size(c) > 0, size(c)).otherwise(0)
    meta = F.struct(
        "elapsed_ms", count("biomarkers").alias("markers_found"), count("unresolved").alias("markers_unresolved"), F.col("status").alias("document_status"),
        _some("page_statuses"), "parser", F.lit("2.0").alias("catalog_version"),
    )
    return F.to_json(F.struct(F.lit("2").alias("version"), "status", data.alias("data"), meta.alias("metadata")))


def _length(k: str):
    return lambda x: F.length(x[k])


def terminal(docs: DataFrame) -> DataFrame:
    """(doc_id, shown): a table of markers, then conflicts and warnings; a notice alone where there is no marker.

    ``docs`` has doc_id, source, biomarkers, conflicts and warnings. Columns are as wide as their widest cell.
    """
    cell = F.transform("biomarkers", lambda b: F.struct(b["display_name"].alias("a"), columns.display_value(b["value"]).alias("b"), b["unit"].alias("c"), b["category"].alias("d")))
    df = docs.withColumn("cells", cell)
    heads = {"a": "Biomarker", "b": "Value", "c": "Unit", "d": "Category"}
    for k, head in heads.items():
        df = df.withColumn(f"w{k}", F.array_max(F.concat(F.array(F.lit(len(head))), F.transform("cells", _length(k)))))
    left = lambda c, k: F.rpad(c, F.col(f"w{k}"), " ")
    line = lambda f: F.rtrim(F.concat_ws("  ", left(f("a"), "a"), F.lpad(f("b"), F.col("wb"), " "), left(f("c"), "c"), left(f("d"), "d")))
    rows = F.concat(F.array(line(lambda k: F.lit(heads[k]))), F.transform("cells", lambda x: line(lambda k: x[k])))
    conflict = F.flatten(F.transform(F.coalesce("conflicts", F.array().cast(docs.schema["conflicts"].dataType)), lambda c: F.concat(
        F.array(F.format_string("conflict: %s (%s)", c["display_name"], c["standardized_name"])),
        F.transform(c["candidates"], lambda x: F.format_string("  %s %s [%s]", columns.display_value(x["value"]), x["unit"], x["raw_name"])),
    )))
    warned = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("warning: "), w))
    full = F.array_join(F.concat(F.array(F.format_string("%d biomarkers from %s", F.size("biomarkers"), "source")), rows, conflict, warned), "\n")
    return df.select("doc_id", F.when(F.coalesce(F.size("biomarkers"), F.lit(0)) > 0, full).otherwise("No biomarkers found.").alias("shown"))
