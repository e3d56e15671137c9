"""Session defaults for local runs; a cluster's own session is used as it is."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "biolab", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and as many shuffle partitions as cores."""
    n = cpus or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(n))
        # a generated method over 8000 bytes of bytecode is never compiled by the JVM: such a stage runs faster in smaller pieces
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read_at_most(spark: SparkSession, mb: int) -> None:
    """From now on a task of this session reads at most so many MB of a file; a smaller limit that is set stays."""
    key = "spark.sql.files.maxPartitionBytes"
    size, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", spark.conf.get(key).lower()).groups()
    if int(size) << 10 * " kmgtp".index(unit or " ") > mb << 20:
        spark.conf.set(key, f"{mb}m")


_own: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors share files: under ``spark.checkpoint.dir``, or of our own in local runs without one."""
    key = "spark.checkpoint.dir"
    named = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {key} to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="biolab-engine-"))
            atexit.register(shutil.rmtree, _own[0], True)
        named = _own[0]
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
