"""A store of patients, sessions and markers that keeps its past: append only, with a manifest for each snapshot.

A folder on any file system that Spark knows. ``<table>/batch=<id>/bucket=<n>/`` has the rows of one append, dealt by patient to BUCKETS folders, so
that one patient's questions read one bucket; ``manifests/snapshot=<n>/`` lists the batches that a snapshot is made of. No file is ever
changed: an append writes its batch and then one more manifest, a failed one leaves files that no manifest lists, and a reader of an
older snapshot is undisturbed. Two writers that make the same snapshot collide on its folder, and the later one fails.

Patients are merged when they are read: the last row of a patient counts, and archiving is such a row.

Defined cases: appending sessions that are there changes nothing, whatever else they hold; rows with a null session or patient are refused; an empty
append makes no snapshot; an empty store has no snapshot and reads as empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biolab.operators import longitudinal

BUCKETS = 64
SCHEMAS = {
    "patients": "id long, slug string, name string, sex string, dob date, archived boolean, seq long",
    "sessions": "id long, patient_id long, date date, source string, provider string",
    "markers": "session_id long, id long, patient_id long, name string, standardized_name string, value double, unit string, reference_range string, flagged boolean, confidence string",
}
OWNER = {"patients": "id", "sessions": "patient_id", "markers": "patient_id"}


def slug(name: Column) -> Column:
    """Lower-case words with hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ------------------------------------------------------------ snapshots

    def manifests(self) -> DataFrame:
        """(snapshot, table, batch): a row for each batch of each snapshot."""
        try:
            return self.spark.read.schema("tbl string, batch string, snapshot int").parquet(f"{self.path}/manifests").withColumnRenamed("tbl", "table")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "table string, batch string, snapshot int")

    def last(self) -> int | None:
        """The number of the last snapshot."""
        return self.manifests().agg(F.max("snapshot")).first()[0]

    def batches(self, snapshot: int | None) -> list[tuple[str, str]]:
        """(table, batch) of a snapshot: a name for each append, not for each row."""
        if snapshot is None:
            return []
        found = [(r["table"], r["batch"]) for r in self.manifests().filter(F.col("snapshot") == snapshot).collect()]
        if not found:
            raise ValueError(f"no snapshot {snapshot} in {self.path}")
        return sorted(found)

    def _commit(self, base: int | None, new: list[tuple[str, str]]) -> int:
        now = 0 if base is None else base + 1
        rows = self.spark.createDataFrame(self.batches(base) + new, "tbl string, batch string")
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/manifests/snapshot={now}")
        return now

    def _put(self, table: str, batch: str, df: DataFrame) -> tuple[str, str]:
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        bucket = F.pmod(F.xxhash64(OWNER[table]), F.lit(self.buckets)).cast("int")
        df = df.select(*names).withColumn("bucket", bucket)
        # a bucket's patients are dealt to as many tasks as there are, a patient to one: buckets are few, whatever the table's size
        df.repartition("bucket", OWNER[table]).sortWithinPartitions("bucket", OWNER[table]).write.partitionBy("bucket").parquet(f"{self.path}/{table}/batch={batch}")
        return table, batch

    # ------------------------------------------------------------ reading

    def read(self, table: str, snapshot: int | None = None, patient: int | None = None) -> DataFrame:
        """Rows of a table as of a snapshot (the last one if none is named); of one patient's bucket only if a patient is named."""
        mine = [b for t, b in self.batches(self.last() if snapshot is None else snapshot) if t == table]
        if not mine:
            return self.spark.createDataFrame([], SCHEMAS[table])
        df = self.spark.read.option("basePath", f"{self.path}/{table}").schema(f"{SCHEMAS[table]}, batch string, bucket int").parquet(*[f"{self.path}/{table}/batch={b}" for b in mine])
        if patient is not None:
            bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(patient).cast("long")), F.lit(self.buckets)).cast("int")).first()[0]
            df = df.filter((F.col("bucket") == bucket) & (F.col(OWNER[table]) == patient))
        return df.drop("batch", "bucket")

    def patients(self, snapshot: int | None = None) -> DataFrame:
        """The last row of each patient."""
        rows = self.read("patients", snapshot)
        last = rows.groupBy("id").agg(F.max("seq").alias("seq"))
        return rows.join(last, ["id", "seq"]).drop("seq")

    # ------------------------------------------------------------ writing

    def append(self, patients: DataFrame, sessions: DataFrame, markers: DataFrame) -> int | None:
        """Adds the sessions that aren't there, with their markers, and the patients that are new. Returns the last snapshot."""
        base = self.last()
        here = self.read("sessions", base) if base is not None else None
        new = sessions.filter("id is not null and patient_id is not null").dropDuplicates(["id"])
        if here is not None:
            new = new.join(here.select("id"), "id", "left_anti")
        batch, seq = uuid.uuid4().hex, 0 if base is None else base + 1
        written = [self._put("sessions", batch, new)]
        new = self.spark.read.schema(SCHEMAS["sessions"]).parquet(f"{self.path}/sessions/batch={batch}")  # fixed by now
        if new.isEmpty():
            return base
        of = new.select(F.col("id").alias("session_id"), "patient_id")
        written.append(self._put("markers", batch, markers.drop("patient_id").join(of, "session_id")))
        people = patients.join(new.select(F.col("patient_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
        if base is not None:
            people = people.join(self.read("patients", base).select("id").distinct(), "id", "left_anti")
        written.append(self._put("patients", batch, people.withColumn("seq", F.lit(seq).cast("long"))))
        return self._commit(base, written)

    def archive(self, ids: list[int] | DataFrame, archived: bool = True) -> int | None:
        """Marks patients as archived (or not): one more row for each of them. ``ids``: a few of them, or a table with a column id."""
        base = self.last()
        if base is None or ids == []:
            return base
        ids = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id long")
        rows = self.patients(base).join(ids.select("id").distinct(), "id", "left_semi").withColumn("archived", F.lit(archived)).withColumn("seq", F.lit(base + 1).cast("long"))
        return self._commit(base, [self._put("patients", uuid.uuid4().hex, rows)])

    # ------------------------------------------------------------ questions

    def export(self, snapshot: int | None = None, only_latest: bool = False) -> DataFrame:
        """As of ``longitudinal.export``."""
        snapshot = self.last() if snapshot is None else snapshot
        return longitudinal.export(self.patients(snapshot), self.read("sessions", snapshot), self.read("markers", snapshot).drop("patient_id"), only_latest)

    def listed(self, snapshot: int | None = None) -> DataFrame:
        snapshot = self.last() if snapshot is None else snapshot
        return longitudinal.listed(self.patients(snapshot), self.read("sessions", snapshot))

    def history(self, patient: int, names: list[str], snapshot: int | None = None) -> DataFrame:
        """(date, session_id, id, standardized_name, value, unit, reference_range, flagged) of one patient in order of time; reads one bucket."""
        snapshot = self.last() if snapshot is None else snapshot
        s = self.read("sessions", snapshot, patient).select(F.col("id").alias("session_id"), "date")
        m = self.read("markers", snapshot, patient).filter(F.col("standardized_name").isin(names))
        return m.join(s, "session_id").select("date", "session_id", "id", "standardized_name", "value", "unit", "reference_range", "flagged").orderBy("standardized_name", "date", "session_id", "id")

    def backup(self, path: str, snapshot: int | None = None) -> int | None:
        """A copy of one snapshot as a store of its own."""
        snapshot = self.last() if snapshot is None else snapshot
        if snapshot is None:
            return None
        other, batch = Store(self.spark, path, self.buckets), uuid.uuid4().hex
        rows = {"patients": self.patients(snapshot).withColumn("seq", F.lit(0).cast("long")), "sessions": self.read("sessions", snapshot), "markers": self.read("markers", snapshot)}
        return other._commit(None, [other._put(t, batch, df) for t, df in rows.items()])
