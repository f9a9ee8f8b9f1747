"""Helpers on the session that several operators need."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """checkpoint() needs a folder: the one the cluster names, else, in local mode, one that goes with the process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="lodestore-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    shared_folder(spark)
    jvm = spark._jvm
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For the jobs run inside: tasks hand at most so many rows at a time to Python; for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ranked_over_all(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their rank, from 1, in the whole table, without a single task that sees all of them.

    Ranges of the order become partitions; a rank is the place in the range plus the sizes of those before.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    keys = [f"_o{k}" for k in range(len(order))]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return dealt.join(before, "_p").withColumn(name, inside + F.col("_b")).drop("_p", "_b", *keys)
