"""Row-level changes of a table by merge-on-read.

Rows are dealt to buckets by a hash of their key.  A change writes its rows alone, a file for each bucket that it
touches, under a new sequence number; deletions are rows with a mark.  A version is a small JSON file that names,
for each bucket, the sequences that count, and it is moved into place last: readers see whole changes only, and of two
writers of one version one fails.  Reading a bucket with one sequence is a plain scan; with more, the last row of a key wins.
Compaction rewrites the buckets that have many sequences, and no others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

BUCKET, SEQ, GONE = "_bucket", "_seq", "_gone"


class DeltaBank:
    """A table with a key, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 16):
        """buckets counts for a new table; one that is there keeps its number."""
        self.spark, self.path, self.key, self._buckets = spark, path, key, buckets

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, Path = self._fs()
        root = Path(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def log(self, version: int | None = None) -> dict:
        """version, buckets, schema, live (bucket to its sequences, ascending) and note of a version, by default the last."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.path)
        fs, Path = self._fs()
        stream = fs.open(Path(f"{self.path}/log/{found[-1] if version is None else version}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        entry = json.loads(text)
        entry["live"] = {int(b): s for b, s in entry["live"].items()}
        return entry

    def note(self) -> dict[str, int]:
        return self.log()["note"] if self.versions() else {}

    def _move_pointer(self, entry: dict) -> int:
        jvm, (fs, Path) = self.spark._jvm, self._fs()
        made = Path(f"{self.path}/log/_{uuid.uuid4().hex}")
        out = fs.create(made)
        try:
            out.write(json.dumps(entry).encode())
        finally:
            out.close()
        # fails if the version is there: another writer was first
        none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(made), fs.makeQualified(Path(f"{self.path}/log/{entry['version']}.json")), none)
        return entry["version"]

    def _write(self, rows: DataFrame, n_buckets: int, version: int) -> tuple[str, list[int]]:
        """The rows under a new sequence, named by the version it is for; which buckets it has."""
        fs, Path = self._fs()
        seq = f"{version:012d}-{uuid.uuid4().hex[:12]}"
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(n_buckets)).cast("int")
        folder = f"{self.path}/data/{SEQ}={seq}"
        rows.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        return seq, sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(Path(folder)) if s.isDirectory())

    def write(self, rows: DataFrame, note: dict[str, int] | None = None) -> int:
        """rows, whose keys are distinct, as all there is."""
        found = self.versions()
        old = self.log() if found else None
        n = old["buckets"] if old else self._buckets
        seq, touched = self._write(rows.withColumn(GONE, F.lit(False)), n, (found or [0])[-1] + 1)
        note = (old["note"] if old else {}) if note is None else note
        return self._move_pointer({"version": (found or [0])[-1] + 1, "buckets": n, "schema": rows.schema.jsonValue(), "live": {b: [seq] for b in touched}, "note": note})

    def _add(self, rows: DataFrame, note: dict[str, int] | None) -> int:
        old = self.log()
        schema = StructType.fromJson(old["schema"])
        missing = F.lit(None)
        there = {c.lower() for c in rows.columns}
        same = rows.select(*[(F.col(f.name) if f.name.lower() in there else missing).cast(f.dataType).alias(f.name) for f in schema.fields], F.col(GONE))
        seq, touched = self._write(same, old["buckets"], old["version"] + 1)
        live = dict(old["live"])
        for b in touched:
            live[b] = [*live.get(b, []), seq]
        return self._move_pointer(old | {"version": old["version"] + 1, "live": live, "note": old["note"] if note is None else note})

    def upsert(self, rows: DataFrame, note: dict[str, int] | None = None) -> int:
        """Rows, whose keys are distinct, come or replace those of the same key; missing columns become null."""
        return self._add(rows.withColumn(GONE, F.lit(False)), note)

    def delete(self, ids: DataFrame, note: dict[str, int] | None = None) -> int:
        """The rows of these keys go; unknown keys do not matter."""
        return self._add(ids.select(self.key).distinct().withColumn(GONE, F.lit(True)), note)

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, by default the last; of some buckets alone, if they are given."""
        entry = self.log(version)
        schema = StructType.fromJson(entry["schema"])
        live = {b: s for b, s in entry["live"].items() if only is None or b in only}
        names = [f.name for f in schema.fields]

        def scan(wanted: dict[int, list[str]]) -> DataFrame:
            paths = [f"{self.path}/data/{SEQ}={s}/{BUCKET}={b}" for b, ss in sorted(wanted.items()) for s in ss]
            full = StructType([*schema.fields, StructField(GONE, BooleanType()), StructField(SEQ, StringType()), StructField(BUCKET, IntegerType())])
            return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)

        plain = {b: s for b, s in live.items() if len(s) == 1}
        changed = {b: s for b, s in live.items() if len(s) > 1}
        parts = [scan(plain).where(~F.col(GONE)).select(*names)] if plain else []
        if changed:
            # later versions have later names
            last = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc(SEQ)))
            parts.append(scan(changed).withColumn("_n", last).where((F.col("_n") == 1) & ~F.col(GONE)).select(*names))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read_near(self, ids: DataFrame) -> DataFrame:
        """The rows of these keys, from their buckets alone."""
        n = self.log()["buckets"]
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(n)).cast("int")
        wanted = ids.select(self.key).distinct()
        only = [r[0] for r in wanted.select(bucket.alias("b")).distinct().collect()]  # at most as many as buckets
        return self.read(only=only).join(wanted, self.key, "left_semi")

    def compact(self, most: int = 4) -> list[int]:
        """Buckets with more than `most` sequences are written anew, as one; which they were."""
        old = self.log()
        many = sorted(b for b, s in old["live"].items() if len(s) > most)
        if many:
            seq, touched = self._write(self.read(only=many).withColumn(GONE, F.lit(False)), old["buckets"], old["version"] + 1)
            # a bucket of which nothing is left is not live any more
            live = {b: s for b, s in old["live"].items() if b not in many} | {b: [seq] for b in touched}
            self._move_pointer(old | {"version": old["version"] + 1, "live": live})
        return many

    def vacuum(self, keep: int = 2) -> int:
        """Sequences that none of the last `keep` versions names are deleted, and older versions; how many sequences."""
        fs, Path = self._fs()
        found = self.versions()
        named = {s for v in found[-keep:] for ss in self.log(v)["live"].values() for s in ss}
        for v in found[:-keep]:
            fs.delete(Path(f"{self.path}/log/{v}.json"), False)
        gone = [s.getPath() for s in fs.listStatus(Path(f"{self.path}/data")) if s.getPath().getName().split("=")[1] not in named]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
