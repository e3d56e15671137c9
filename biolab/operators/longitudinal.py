"""Questions over time: latest value, history, trend, comparison, counts; and the store of patients, sessions and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(when: str, major: str, minor: str) -> Column:
    """(date, long, int) as one number of fixed width that orders as they do."""
    whole = lambda c, digits: c.cast(f"decimal({digits}, 0)")
    ten = lambda n: F.lit(str(10**n)).cast(f"decimal({n + 1}, 0)")
    low = (whole(F.col(major), 19) + whole(F.lit("9223372036854775808"), 19)) * ten(10) + whole(F.col(minor), 10) + whole(F.lit(2**31), 10)
    return (whole(F.unix_date(when), 7) * ten(30) + low).cast("decimal(38, 0)")


def latest_numbers(df: DataFrame, keys: list[str], when: str, values: list[str], major: str, minor: str) -> DataFrame:
    """As ``latest`` for values of fixed width, ties in order of a long and an int: one hash aggregate, no sort."""
    last = df.withColumn("_at", order_key(when, major, minor))
    return last.groupBy(*keys).agg(F.max(when).alias(when), *[F.max_by(v, "_at").alias(v) for v in values])


def latest(df: DataFrame, keys: list[str], when: str, values: list[str], tie: str) -> DataFrame:
    """The last row of each key, by ``max_by``: one aggregate, which sorts, as it holds whole rows."""
    last = F.max_by(F.struct(when, *values), F.struct(when, tie))
    return df.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def history(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(F.col("standardized_name").isin(names)).orderBy("patient_id", "standardized_name", "date", "doc_id", "ord")


def trend(df: DataFrame, keys: list[str], when: str, value: str, tie: str, days: Column | None = None) -> DataFrame:
    """Adds rate (change a day since the row before) and acceleration (change of the rate); null without a step in time."""
    w = Window.partitionBy(*keys).orderBy(when, tie)
    gap = F.datediff(when, F.lag(when).over(w)) if days is None else days
    df = df.withColumn("days", gap.cast("long")).withColumn("rate", (F.col(value) - F.lag(value).over(w)) / F.when(F.col("days") > 0, F.col("days")))
    return df.withColumn("acceleration", F.col("rate") - F.lag("rate").over(w))


def compare(df: DataFrame, keys: list[str], when: str, value: str, tie: str, start, end) -> DataFrame:
    """First value on or after ``start`` against the last on or before ``end``."""
    inside = df.filter(F.col(when).between(F.lit(start), F.lit(end)))
    a, b = F.min_by(value, F.struct(when, tie)), F.max_by(value, F.struct(when, tie))
    return inside.groupBy(*keys).agg(a.alias("first_value"), b.alias("last_value"), (b - a).alias("change"), F.count("*").alias("n"))


def stats(df: DataFrame) -> DataFrame:
    """Patients, sessions, records: plain counts of distinct values, which Spark splits into partial aggregates."""
    return df.agg(F.countDistinct("patient_id").alias("patients"), F.countDistinct("doc_id").alias("sessions"), F.count("*").alias("records"))


def store(df: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patients, sessions, markers) of resolved rows with patient_id, doc_id and date: a session is a document.

    ``rows``: the same rows before they were resolved; patients and sessions, which need no names, are made of them.
    """
    rows = df if rows is None else rows
    patients = rows.select(F.col("patient_id").alias("id")).distinct().select("id", F.concat(F.lit("patient-"), "id").alias("slug"), F.lit(False).alias("archived"))
    sessions = rows.groupBy(F.col("doc_id").alias("id")).agg(F.min("patient_id").alias("patient_id"), F.min("date").alias("date"), F.lit("measurements").alias("source"))
    markers = df.filter("resolved and value is not null").select(F.col("doc_id").alias("session_id"), F.col("ord").alias("id"), F.col("raw_name").alias("name"), "standardized_name", "value", "unit")
    return patients, sessions, markers


def archive(patients: DataFrame, ids: list) -> DataFrame:
    """Marks patients as archived; nothing is removed."""
    return patients.withColumn("archived", F.col("archived") | F.col("id").isin(ids))


def listed(patients: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, slug, n_sessions, last_date) of the patients that aren't archived."""
    seen = sessions.groupBy("patient_id").agg(F.count("*").alias("n_sessions"), F.max("date").alias("last_date"))
    kept = patients.filter("not archived").join(seen, F.col("id") == F.col("patient_id"), "left")
    return kept.select("id", "slug", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), "last_date")


def export(patients: DataFrame, sessions: DataFrame, markers: DataFrame, only_latest: bool = False) -> DataFrame:
    """(patient_id, slug, date, session_id, id, standardized_name, value, unit) of patients that aren't archived; the last of each marker if asked."""
    of = sessions.select(F.col("id").alias("session_id"), "patient_id", "date")
    who = patients.filter("not archived").select(F.col("id").alias("patient_id"), "slug")
    # sessions, which are fewer and narrower than markers, go to their patients; markers stay with their sessions
    df = markers.join(of.join(who, "patient_id"), "session_id")
    df = df.select("patient_id", "slug", "date", "session_id", "id", "standardized_name", "value", "unit")
    if not only_latest:
        return df
    return latest(df.withColumn("tie", F.struct("session_id", "id")), ["patient_id", "standardized_name"], "date", ["slug", "session_id", "id", "value", "unit"], "tie")


def summary(exported: DataFrame) -> DataFrame:
    """(patient_id, n_markers, n_values, first_date, last_date) of an export."""
    return exported.groupBy("patient_id").agg(
        F.countDistinct("standardized_name").alias("n_markers"), F.count("*").alias("n_values"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def out_of_range(df: DataFrame) -> DataFrame:
    """Adds ``flagged``: outside the usual or the possible band of the marker in its unit; false without a band."""
    from biolab.operators.validate import plausibility

    return plausibility(df).withColumn("flagged", F.coalesce(F.col("plausible") != "ok", F.lit(False))).drop("plausible")
