"""Builds that go on where they were stopped, and in which a row that fails does not stop the others.

Rows are dealt to parts by a hash of their key.  Parts are built a few at a time, each wave one job; a part counts when
its marker is there, which comes after its files.  So a build that was killed loses the parts of one wave.  A row whose
function raises an error gets a fallback and the text of the error; failed rows lie in folders of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Build:
    """key, result, error of rows, in a folder that all executors share; the rows of a build do not change while it is open."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        """parts has to be the same for a build that goes on."""
        self.spark, self.path, self.parts = spark, path, parts

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def done(self) -> set[int]:
        """Parts with a marker."""
        fs, Path = self._fs()
        p = Path(f"{self.path}/done-{self.parts}")
        return {int(s.getPath().getName()) for s in fs.listStatus(p)} if fs.exists(p) else set()

    def run(self, rows: DataFrame, key: str, make: Callable[[dict], str], fallback: Callable[[dict], str], at_once: int = 16) -> int:
        """Build the parts that are missing; how many there were.

        make and fallback get a row as a dictionary and return a text.  A fallback that fails stops the build, and so does
        what is no ordinary error (an interrupt, an executor that is lost too often).
        """
        fs, Path = self._fs()

        def f(batches):
            for b in batches:
                keys, results, errors = [], [], []
                for row in b.to_pylist():
                    keys.append(row[key])
                    del row["_part"]
                    try:
                        results.append(make(row))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  any error of a row is noted with it
                        results.append(fallback(row))
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.record_batch([pa.array(b.column("_part")), pa.array([None if k is None else str(k) for k in keys], pa.string()), pa.array(results, pa.string()), pa.array(errors, pa.string())], names=["part", "key", "result", "error"])

        todo = sorted(set(range(self.parts)) - self.done())
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.parts)).cast("int"))
        for i in range(0, len(todo), at_once):
            wave = todo[i : i + at_once]
            made = dealt.where(F.col("_part").isin(wave)).mapInArrow(f, "part int, key string, result string, error string")
            out = made.withColumn("failed", F.col("error").isNotNull()).repartition("part")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "failed").parquet(f"{self.path}/parts-{self.parts}")
            for p in wave:
                fs.create(Path(f"{self.path}/done-{self.parts}/{p}"), True).close()
        return len(todo)

    def _read(self) -> DataFrame:
        rows = self.spark.read.schema("key string, result string, error string, part int, failed boolean").parquet(f"{self.path}/parts-{self.parts}")
        # files of a part without a marker are of a wave that was stopped
        return rows.where(F.col("part").isin(sorted(self.done())))

    def results(self) -> DataFrame:
        """key, result, failed of the parts that are done."""
        return self._read().select("key", "result", "failed")

    def errors(self) -> DataFrame:
        """key, error of the rows that have a fallback, from their own folders."""
        return self._read().where("failed").select("key", "error")
