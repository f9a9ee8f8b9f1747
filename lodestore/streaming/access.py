"""Structured Streaming over access events: counts, windows, sessions and the review policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the event files of a folder, with ts as a timestamp that watermarks can use."""
    s = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, window: str, late: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(rows: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """All that is there now, written as Parquet; starting it again goes on from the checkpoint."""
    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()


def into_bank(bank, key: list[str]) -> Callable[[DataFrame, int], None]:
    """Rows of a batch come into a DeltaBank by the text of these columns; a batch that is replayed changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        if batch_id > bank.note().get("batch", -1):
            bank.upsert(batch.withColumn(bank.key, F.to_json(F.struct(*key))), {"batch": batch_id})
            bank.compact(8)

    return put


def each_batch(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class ReviewPolicy:
    """Counts queries batch by batch; at `interval` or more a review comes and counting starts at 0 again.

    The count and the last batch are noted with the bank's version, so a restart goes on from there and a batch that
    is replayed changes nothing.  Only rows that were asked for or that a review demotes are written; a DeltaBank reads
    their buckets alone, but for reviews, which look at all rows.
    """

    def __init__(self, bank, interval: int, threshold: int):
        self.bank, self.interval, self.threshold = bank, interval, threshold

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from lodestore.operators.forgetting import access_counts, reviewed

        note = self.bank.note()
        if batch_id <= note.get("batch", -1):
            return
        ids = batch.select(F.col("user_id").cast("string").alias("id"))
        seen = note.get("seen", 0) + ids.count()
        review = seen >= self.interval
        note = {"batch": batch_id, "seen": 0 if review else seen}

        rows = self.bank.read() if review or not hasattr(self.bank, "read_near") else self.bank.read_near(ids)
        counted = access_counts(rows, ids).withColumn("_old", F.col("quality_level"))
        if review:
            state = reviewed(counted.withColumnRenamed("quality_level", "quality").withColumnRenamed("access_count", "hits"), self.threshold)
            counted = state.drop("demoted").withColumnRenamed("quality", "quality_level").withColumnRenamed("hits", "access_count")
            counted = counted.withColumn("deleted", F.col("quality_level") == 4)
        # rows that nobody asked for and no review demoted stay as they are written
        touched = counted.join(ids.distinct().withColumn("_asked", F.lit(True)), "id", "left").where(F.col("_asked") | (F.col("quality_level") != F.col("_old")))
        self.bank.upsert(touched.drop("_old", "_asked"), note=note)
