"""The memory table: rows in Parquet under versioned folders, and the changes a bank goes through.

Changes are functions from DataFrame to DataFrame; Bank writes the result as a new version and moves a pointer,
so readers never see half a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestore.session import ranked_over_all

SCHEMA = "id string, canvas_path string, text string, metadata map<string,string>, image_embedding_path string, text_embedding_path string, access_count long, quality_level int, deleted boolean, ord long"


def last_wins(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The last value of each key at the place of its first."""
    w = Window.partitionBy(key)
    first = rows.withColumn("_first", F.min(order).over(w))
    best = first.withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).where("_n = 1")
    return best.drop("_n", order).withColumnRenamed("_first", order)


def upsert(bank: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace those of the same key."""
    return bank.join(new.select(key), key, "left_anti").unionByName(new)


def insert_new(bank: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Append; a key that is there already is an error when the result is computed."""
    there = new.join(bank.select(key, F.lit(True).alias("_there")), key, "left")
    ok = there.withColumn("_there", F.when(F.col("_there"), F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(False)))
    return bank.unionByName(ok.where(~F.col("_there")).drop("_there"))


def delete(bank: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return bank.join(ids.select(key), key, "left_anti")


def compact(index: DataFrame, store: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Index entries without a stored row, stored rows without an index entry."""
    return index.join(store, key, "left_anti"), store.join(index, key, "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs old(pair, ...) and new(pair, ...) of equal columns become one memory each.

    Tokens behind one another, keys averaged, sources and modalities united, patches added up; the id is
    merged_<new id>.
    """
    o, n = old.alias("o"), new.alias("n")
    mean = F.zip_with("o.key", "n.key", lambda x, y: (x + y) / 2)
    unite = lambda c: F.array_sort(F.array_union(f"o.{c}", f"n.{c}"))
    return o.join(n, F.col("o.pair") == F.col("n.pair")).select(
        F.concat(F.lit("merged_"), F.col("n.id")).alias("id"),
        F.concat("o.tokens", "n.tokens").alias("tokens"),
        mean.alias("key"),
        unite("source").alias("source"),
        unite("modalities").alias("modalities"),
        (F.col("o.num_patches") + F.col("n.num_patches")).alias("num_patches"),
        F.array("o.id", "n.id").alias("merged_from"),
    )


def evicted(bank: DataFrame, limit: int, strategy: str = "oldest", cutoff=None) -> DataFrame:
    """Rows that have to go so that `limit` are left; none if limit is not positive.

    oldest: by created_at; time: first those older than cutoff in listing order, then the oldest;
    importance: by the norm of the key, rounded, then listing order.
    """
    if limit <= 0:
        return bank.limit(0)
    if strategy == "oldest":
        order = [F.col("created_at"), F.col("ord")]
    elif strategy == "time":
        old = F.col("created_at") < cutoff
        order = [(~old).cast("int"), F.when(old, F.col("ord")), F.col("created_at"), F.col("ord")]
    elif strategy == "importance":
        norm = F.sqrt(F.aggregate("key", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        order = [F.round(norm, 6), F.col("ord")]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    spare = bank.count() - limit
    return ranked_over_all(bank, order, "_rank").where(F.col("_rank") <= spare).drop("_rank") if spare > 0 else bank.limit(0)


def statistics(bank: DataFrame, category: str, size: str) -> DataFrame:
    """Count and bytes by category and in all (category null)."""
    return bank.rollup(category).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.grouping(category).alias("all_rows"))


class Bank:
    """A memory table under a folder: version=<n> sub-folders, the highest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def versions(self) -> list[int]:
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/version={found[-1] if version is None else version}")

    def note(self, version: int | None = None) -> dict[str, int]:
        """What was noted with a version, the last one if none is given."""
        found = self.versions()
        version = (found or [0])[-1] if version is None else version
        fs, jvm = self._fs()
        path = f"{self.path}/note={version}"
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(path)):
            return {}
        return {r["name"]: r["value"] for r in self.spark.read.parquet(path).collect()}  # a row for each name

    def write(self, rows: DataFrame, partition_by: str | None = None, note: dict[str, int] | None = None) -> int:
        """rows as the next version, with a note; without one that of the version before stays."""
        found = self.versions()
        n = (found or [0])[-1] + 1
        kept = self.note() if note is None else note
        if kept:
            # before the version itself: a note counts only if its version is complete
            self.spark.createDataFrame(sorted(kept.items()), "name string, value long").write.mode("overwrite").parquet(f"{self.path}/note={n}")
        w = rows.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(f"{self.path}/version={n}")
        return n

    def change(self, f, partition_by: str | None = None, note: dict[str, int] | None = None) -> int:
        """Write f(rows) as the next version."""
        return self.write(f(self.read()), partition_by, note)

    def upsert(self, rows: DataFrame, note: dict[str, int] | None = None, key: str = "id") -> int:
        """New rows replace those of the same key; the whole table is written anew (DeltaBank writes the rows alone)."""
        return self.change(lambda old: upsert(old, rows, key), note=note)

    def clear(self, condition: Column | None = None) -> int:
        return self.change(lambda d: d.limit(0) if condition is None else d.where(~F.coalesce(condition, F.lit(False))))

    def backup(self, path: str) -> None:
        self.read().write.parquet(path)

    def get(self, key: str, name: str = "id") -> DataFrame:
        """The row of an id; KeyError if there is none."""
        row = self.read().where(F.col(name) == key)
        if row.isEmpty():
            raise KeyError(key)
        return row

    def export_array(self, path: str) -> None:
        """The rows as one JSON array in order of ord, over the part files one after another."""
        rows = self.read()
        n = rows.count()
        if not n:
            rows.sparkSession.range(1).select(F.lit("[]").alias("value")).write.mode("overwrite").text(path)
            return
        ranked = ranked_over_all(rows, [F.col("ord")], "_rank")
        line = F.concat(F.when(F.col("_rank") == 1, "[").otherwise(","), F.to_json(F.struct(*[c for c in rows.columns if c != "ord"])), F.when(F.col("_rank") == n, "]").otherwise(""))
        lines = ranked.select("_rank", line.alias("value")).orderBy("_rank")
        lines.select("value").write.mode("overwrite").text(path)

    def export_json(self, path: str) -> None:
        """The rows as JSON lines, in order, a file for each range of the order."""
        self.read().orderBy("ord").drop("ord").write.mode("overwrite").json(path)
