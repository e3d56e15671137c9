"""A document's whole report in one pass: markers, conflicts, unresolved names, warnings, counters and status.

Rows are brought together by document once. An aggregate by (document, marker) holds the readings of a marker, which are few,
and all checks of a marker are made on its row; an aggregate by document gathers what they give. Every output, from the envelope to a
row for each warning, is a projection of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from biolab.functions import columns
from biolab.operators import output, validate, warnings
from biolab.operators.conflicts import KEY, TOLERANCE

READING = ["ord", "raw_name", "raw_value", "raw_unit", "value", "unit", "comparator", "unit_status", "display_name", "category", "confidence", "method"]


def _warning(check: str, at: Column, text: Column) -> Column:
    return F.struct(F.lit(warnings.CHECKS.index(check)).alias("rank"), at.cast("long").alias("at"), F.lit(check).alias("check"), text.alias("warning"))


def markers(resolved: DataFrame) -> DataFrame:
    """A row for each (doc_id, standardized_name), null for unresolved names: ``first`` reading, n_readings, agree, ``readings`` and ``skipped`` rows in order."""
    read = F.col("value").isNotNull()
    g = resolved.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.when(read, F.struct(*READING)))).alias("readings"), F.sort_array(F.collect_list(F.when(~read, F.struct("ord", "raw_name", "raw_value")))).alias("skipped"),
        F.max("value").alias("most"), F.min("value").alias("least"),
    )
    first = F.get("readings", 0)
    same = F.forall("readings", lambda x: (x["unit"] == F.get("readings", 0)["unit"]) & (x["comparator"] == F.get("readings", 0)["comparator"]))
    agree = (F.col("most") - first["value"] < TOLERANCE) & (first["value"] - F.col("least") < TOLERANCE) & same
    return g.select(*KEY, "readings", "skipped", first.alias("first"), F.size("readings").cast("long").alias("n_readings"), F.coalesce(agree, F.lit(False)).alias("agree"))


def _marker_warnings() -> Column:
    """Warnings of one row of ``markers`` with its bands."""
    f = lambda c: F.col(f"first.{c}")
    named = F.col("standardized_name").isNotNull()
    skipped = F.transform("skipped", lambda x: _warning("skipped", x["ord"], warnings.skipped(x["raw_name"], x["raw_value"])))
    unknown = F.when(~named, F.transform("readings", lambda x: _warning("unresolved", x["ord"], warnings.unknown(x["raw_name"]))))
    one = lambda cond, w: F.when(cond, F.array(w))
    again = named & (F.col("n_readings") > 1)
    same = one(again & F.col("agree"), _warning("repeated", f("ord"), warnings.repeated(F.col("standardized_name"), F.col("n_readings"))))
    other = one(again & ~F.col("agree"), _warning("conflict", f("ord"), warnings.conflict(F.col("standardized_name"), F.col("n_readings"))))
    odd = one(F.col("plausible").isin("impossible", "unusual"), _warning("plausibility", f("ord"), warnings.out_of_band(F.col("plausible"), f("display_name"), f("value"), f("unit"))))
    none = F.array().cast("array<struct<rank: int, at: long, check: string, warning: string>>")
    return F.concat(*[F.coalesce(x, none) for x in (skipped, unknown, same, other, odd)])


def assembled(resolved: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, the counters and status of ``validate.document_status``, biomarkers, conflicting, unknown, warnings) of every document.

    ``warnings`` are structs (rank, at, check, warning) in order. ``page_counts`` as of ``validate.document_status``.
    """
    named = F.col("standardized_name").isNotNull() & (F.col("n_readings") > 0)
    g = markers(resolved)
    g = validate.with_bands(g, F.col("standardized_name"), F.col("first.unit"))
    ok, bad = named & F.col("agree"), named & ~F.col("agree")
    g = g.withColumn("plausible", F.when(ok, validate.band_state(F.col("first.value")))).withColumn("warned", _marker_warnings())
    short = lambda x: F.struct(x["raw_name"].alias("raw_name"), x["value"].alias("value"), x["unit"].alias("unit"))
    conflict = F.struct("standardized_name", F.col("first.display_name").alias("display_name"), F.col("first.category").alias("category"), F.transform("readings", short).alias("candidates"))
    none = lambda kind: F.lit(None).cast(kind)
    flat = g.select(
        "doc_id", "standardized_name", "n_readings", "plausible", "warned", "readings", ok.alias("ok"), bad.alias("bad"), conflict.alias("conflict"), *[F.col(f"first.{c}").alias(c) for c in READING],
        F.coalesce(F.col("plausible") != "ok", F.lit(False)).alias("flagged"), F.lit(True).alias("resolved"), none("string").alias("reference_range"), none("int").alias("page"), none("string").alias("source_text"),
    ).withColumn("raw_value_text", F.col("raw_value"))
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    in_order = lambda cond, x: F.sort_array(F.collect_list(F.when(cond, x)))
    status = validate.counters(F.col("ok"), F.col("bad"), validate.signs())
    df = flat.groupBy("doc_id").agg(
        *status, *validate._cross_inputs(F.col("ok")), F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("ord", output.biomarker().alias("b"))))), lambda x: x["b"]).alias("biomarkers"),
        in_order(F.col("bad"), F.col("conflict")).alias("conflicting"), F.transform(F.flatten(F.collect_list(F.when(F.col("standardized_name").isNull(), F.col("readings")))), short).alias("unknown"),
        F.flatten(F.collect_list("warned")).alias("warned"), count(F.lit(True)).alias("n_groups"),
    ).drop("n_groups")
    df = df.select("*", *validate._cross_results())
    more = [F.when(F.col(flag), _warning(check, F.lit(0), text)) for check, flag, text in warnings.of_document()]
    df = df.withColumn("warnings", F.sort_array(F.concat("warned", F.array_compact(F.array(*more)))))
    return validate.with_status(df, page_counts, "biomarkers", "conflicting", "unknown", "warnings")


def warning_rows(assembled: DataFrame) -> DataFrame:
    """(doc_id, check, at, warning): a row for each warning."""
    return assembled.select("doc_id", F.inline("warnings")).select("doc_id", "check", "at", "warning")


def observed(df: DataFrame, name: str, error: Column | None = None) -> tuple[DataFrame, Observation]:
    """(``df``, counters of the batch): documents by status and by exit class, and warnings, counted while ``df`` is written.

    ``df`` as of ``assembled``; ``error`` is the name of a document's error, or null.
    """
    seen = Observation(name)
    code = output.exit_code(F.lit(None).cast("string") if error is None else error)
    counts = [F.count(F.lit(1)).alias("documents"), *[F.count_if(F.col("status") == s).alias(s) for s in validate.RANK]]
    counts += [F.count_if(code == k).alias(f"exit_{k}") for k in sorted({0, 1, *output.EXIT.values()})]
    return df.observe(seen, *counts, F.sum(F.size("warnings")).alias("warnings")), seen
