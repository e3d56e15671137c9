"""Name resolution against the catalog: exact alias, normalised alias, ambiguous names by unit and value.

Rows are read once and looked up where they are; a name is normalised only if no exact alias settles it. The catalog's tables are made once a
session and broadcast where the number of its names proves them small. Beyond that they are looked up by (name, salt), so that a
name on a third of all rows is split.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biolab.functions import columns
from biolab.sources import catalog


#: Up to so many names of the catalog (a few hundred bytes each) are broadcast.
BROADCAST_NAMES = 200_000
#: Parts that the rows of one name are dealt to where the catalog is too large to broadcast.
SALTS = 32
_made: dict = {}


def parsed(m: DataFrame) -> DataFrame:
    """Adds value, comparator, unit (canonical) and drops nothing; value is null where there is no number."""
    return columns.with_number(m, "raw_value", comparator=columns.split_comparator(F.col("raw_value"))["comparator"], unit=columns.normalize_unit(F.col("raw_unit")))


def _compatible(unit: Column, forms: Column, allowed: Column) -> Column:
    low = F.lower(unit)
    return (F.size(allowed) == 0) | (unit == "") | F.array_contains(forms, low)


def _candidate(candidates: Column, unit: Column, value: Column) -> Column:
    """The id of the first candidate whose unit list and strict bounds hold."""
    fits = F.filter(
        candidates,
        lambda c: ((F.size(c["units"]) == 0) | F.array_contains(F.transform(c["units"], F.lower), F.lower(unit)))
        & F.coalesce(value < c["below"], F.lit(True))
        & F.coalesce(value > c["above"], F.lit(True)),
    )
    return F.get(fits, 0)["id"]


def lookups(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """((name, entry, rule) of every name, (id, display_name, category, allowed_units) of every marker, number of names) of a catalog.

    ``entry`` is the marker that the name is an alias of, with the candidates if the name is ambiguous; ``rule`` the
    ambiguous name's default and candidates. Small tables are made once for a session and a file, as rows of the driver's, which has read the file.
    """
    path = path or os.environ.get("BIOLAB_CATALOG", "none")
    key = (spark.sparkContext.applicationId, path, os.stat(path).st_mtime_ns if path != "none" else 0)
    if key in _made:
        return _made[key]
    rows, amb = catalog.entries(path)
    n = sum(len(r[5]) + 5 for r in rows) + len(amb)
    marker = catalog.markers(spark, rows).select("id", "display_name", "category", "allowed_units", "unit_forms")
    ambiguous = catalog.ambiguous(spark, amb).withColumnRenamed("ambiguous_name", "name")
    alias = catalog.aliases(spark, rows).join(marker, "id").withColumnRenamed("alias", "name")
    entry = F.when(F.col("id").isNotNull(), F.struct("id", "allowed_units", "unit_forms", "candidates")).alias("entry")
    rule = F.when(F.col("default_id").isNotNull(), F.struct("default_id", "candidates")).alias("rule")
    tables = [alias.join(ambiguous, "name", "full").select("name", entry, rule), marker.drop("unit_forms")]
    if n <= BROADCAST_NAMES:
        tables = [spark.createDataFrame(t.collect(), t.schema) for t in tables]
        _made[key] = (*tables, n)
    return (*tables, n)


def _attached(df: DataFrame, key: str, table: DataFrame, of: str, n: int) -> DataFrame:
    """``df`` with the row of ``table`` whose ``of`` equals ``key``, null where there is none."""
    table = table.withColumnRenamed(of, "_of")
    if n <= BROADCAST_NAMES:
        return df.join(F.broadcast(table), F.col(key) == F.col("_of"), "left").drop("_of")
    salt = F.pmod(F.xxhash64(*[columns.quoted(c) for c in df.columns]), F.lit(SALTS)).cast("int")
    table = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", salt).join(table, (F.col(key) == F.col("_of")) & (F.col("_salt") == F.col("_part")), "left").drop("_of", "_salt", "_part")


def resolve(m: DataFrame, path: str | None = None) -> DataFrame:
    """Adds standardized_name, display_name, category, confidence, method, resolved, final unit and unit_status.

    ``m`` has raw_name, value and unit. An exact alias must allow the unit, unless the name is ambiguous; then
    the first candidate that fits decides, and the default is marked ambiguous if none does.
    """
    names, marker, n = lookups(m.sparkSession, path)
    unit, value = F.col("unit"), F.col("value")
    named = lambda e: F.coalesce(e.isNotNull() & (e["candidates"].isNotNull() | _compatible(unit, e["unit_forms"], e["allowed_units"])), F.lit(False))
    df = m.withColumn("low", F.lower(columns.trim(F.col("raw_name"))))
    df = _attached(df, "low", names.select("name", F.col("entry").alias("e1"), F.col("rule").alias("d1")), "name", n)
    df = df.select("*", columns.once(named(F.col("e1")).alias("u1")))
    df = df.select("*", columns.once(F.when(~F.col("u1"), columns.normalize_name(F.col("raw_name"))).alias("norm")))
    df = _attached(df, "norm", names.select("name", F.col("entry").alias("e2"), F.col("rule").alias("d2")), "name", n)
    u1, u2 = F.col("u1"), F.col("u2")
    df = df.select("*", columns.once((~u1 & named(F.col("e2")) & (F.col("norm") != F.col("low"))).alias("u2"), F.coalesce("d1", "d2").alias("d")))
    # the rule and the marker that decide
    plain = F.when(u1, F.col("e1")).when(u2, F.col("e2"))
    df = df.select(*m.columns, "u1", "u2", columns.once(plain["id"].alias("e"), F.when(u1 | u2, plain["candidates"]).otherwise(F.col("d.candidates")).alias("rules"), F.when(~(u1 | u2), F.col("d.default_id")).alias("default_id")))
    df = df.select("*", columns.once(F.when(F.col("rules").isNotNull(), _candidate(F.col("rules"), unit, value)).alias("fit")))
    fit, by_rule = F.col("fit"), F.col("rules").isNotNull()
    confidence = F.when(by_rule, F.when(fit.isNotNull(), "inferred_from_unit").otherwise("ambiguous")).when(u1, "exact").when(u2, "normalized")
    method = F.when(by_rule, "disambiguation").when(u1, "exact_alias").when(u2, "normalized_pipeline")
    df = df.select(*m.columns, columns.once(F.coalesce(fit, "e", "default_id").alias("standardized_name"), confidence.alias("confidence"), method.alias("method")))
    df = _attached(df, "standardized_name", marker, "id", n)
    allowed = F.col("allowed_units")
    status = F.when((unit != "") | F.array_contains(allowed, ""), "Observed").when(F.size(allowed) == 1, "Inferred").otherwise("Missing")
    out = [c for c in m.columns if c != "unit"]
    df = df.select(*out, "unit", "standardized_name", "display_name", "category", "confidence", "method", "allowed_units", columns.once(status.alias("unit_status"), F.col("standardized_name").isNotNull().alias("resolved")))
    final = F.when((unit == "") & (F.col("unit_status") == "Inferred"), F.get(allowed, 0)).otherwise(unit)
    return df.select(*out, final.alias("unit"), "unit_status", "standardized_name", "display_name", "category", "confidence", "method", "resolved")
