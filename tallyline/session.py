"""Session defaults and the shared folder that cut lineage is written to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tallyline", master: str | None = None, shuffle_partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings every operator assumes.

    Shuffle partitions are left to the cluster unless given: adaptive execution
    coalesces small ones, and a 100 TB run wants thousands.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (conf or {}).items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    ship(session)
    return session


_OWN = "spark.tallyline.shared"
_shipped: set[str] = set()
_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application; Spark itself serves the archive."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    target = os.path.join(SparkFiles.getRootDirectory(), f"{name}_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(package):
            for file in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, file)
                archive.write(full, os.path.join(name, os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master may leave it unset: then a folder of this process's own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not named:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tallyline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set(_OWN, named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a finished folder wherever it is stored."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_finished(spark: SparkSession) -> None:
    """Delete all that was written below the shared folder so far; call it when no result is read any more."""
    while _written:
        remove_folder(spark, _written.pop())
