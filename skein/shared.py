"""Tables in the shared folder, for steps that several later ones read and for loops whose lineage would grow.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` (the folder the cluster shares) and
reading it back, so a lost executor costs a re-read and never a wrong answer. The tables of one
session lie in one folder, which goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BASES: dict[str, str] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table, or a session's folder, where the session is still there to do so."""
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset and everything runs in one process (tests), below a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _BASES:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="skein-")
        _BASES[app] = f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _BASES[app])
    return f"{_BASES[app]}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once a session, so that Python workers can import them anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="skein-"), f"{package.name}.zip")  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, f"{package.name}/{p.relative_to(package)}")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table: computed once, read from there by all that follows, safe if executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` gave and nothing reads any more: a loop's rounds but the last."""
    for table in tables:
        if path := getattr(table, "_stored_at", None):
            remove(table.sparkSession, path)


def summed_before(df: DataFrame, name: str, value: str, by: str, *order: str | Column) -> DataFrame:
    """df with the sum of ``value`` over those rows of the same ``by`` that come before in the given order, 0 for the first.

    Like ``numbered``: rows are dealt into ranges, so that one ``by`` of very many rows is summed by many tasks."""
    ranged = stored(df.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(by, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    own = Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0.0))).join(starts, [by, "_range"])
    return placed.withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with a gapless number from 0 in the given order, without one task for all rows.

    Rows are dealt into ranges and counted; a range's running number goes on from the ranges before it. Only
    one count for each range, as many as there are shuffle partitions, is broadcast."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = ranged.withColumn("_own", own).join(F.broadcast(starts), "_range")
    return placed.withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)
