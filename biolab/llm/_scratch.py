"""Tables that cut lineage, in the folder the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Texts are long: more rows than this in an Arrow batch take memory in the JVM and in Python alike.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a folder of our own where it is unset (local runs)."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {KEY} to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="biolab-shared-"))
            atexit.register(shutil.rmtree, _own[0], True)
        named = _own[0]
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of intermediate Parquet tables; ``drop`` frees one that is no longer read.

    Results read from it are lazy, so the folder stays until the driver's JVM ends, which deletes it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
            spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(where)
        system.deleteOnExit(where)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.get(name, df)

    def get(self, name: str, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
