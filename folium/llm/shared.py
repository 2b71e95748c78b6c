"""The folder that driver and executors share, and what is written there."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where this library lies, for Python workers that did not get it on their path.
ROOT = str(Path(__file__).resolve().parents[2])
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, on one machine (as in tests), a temporary folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="folium-"))
        at = f"file://{_own[0]}"
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    # The shuffle files behind it go at once. Without this they go when the driver collects its garbage, and one step's lie beside the next one's.
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path := place(spark, name))
    finally:
        spark.conf.set(CLEANUP, before)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes a table made by keep(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f.startswith(folder(spark).replace("file://", "file:")) or f.startswith(folder(spark)):
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: its input."""
    yield from batches


def trim(spark: SparkSession) -> None:
    """Lets the executors give back memory that nothing uses any more: a task on each core.

    A Python worker drops a broadcast that was destroyed only when its next task begins, and a JVM keeps the heap it took for a
    step's joins until a full collection. Without this, both lie beside what the next step takes.
    """
    n = spark.sparkContext.defaultParallelism
    ready(spark).range(0, n, 1, n).mapInArrow(passed, "id long").select("id", F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
