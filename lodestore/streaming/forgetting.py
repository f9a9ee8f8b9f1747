"""Frequency forgetting as a keyed stream: hits and level of each memory in the state store.

Accesses (mem_id, step) come in the order of their steps.  A review follows every `interval` steps and demotes what has
at most `threshold` hits by then.  A memory need not be told of a review: its next access says how many there have been
since the last one, and as hits only grow, all of them demote it or none.  So a review costs nothing, and memories that
nobody asks for are reviewed when their state is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestore.operators.forgetting import DELETED

STATE = "hits long, level int, reviews long"
OUT = "mem_id string, level int, reviews long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reviews(StatefulProcessor):
    """Counts the accesses of a memory and applies the reviews between them; gives a row when its level changes."""

    def __init__(self, interval: int, threshold: int):
        self.interval, self.threshold = interval, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        hits, level, reviews = self.memory.get() if self.memory.exists() else (0, 0, 0)
        was = level
        # a number for each review that the batch spans, however many accesses there are
        for number, n in sorted(Counter(r.step // self.interval for r in rows).items()):
            if number > reviews:
                level = min(DELETED, level + number - reviews) if hits <= self.threshold else level
                reviews = number
            hits += n if level < DELETED else 0
        self.memory.update((hits, level, reviews))
        if level != was:
            yield Row(mem_id=key[0], level=level, reviews=reviews)

    def close(self) -> None:
        pass


def demotions(accesses: DataFrame, interval: int, threshold: int) -> DataFrame:
    """mem_id, level, reviews whenever an access finds its memory at another level; accesses(mem_id string, step long) is a stream.

    A late access counts when it comes; it changes no review that is past.
    """
    return accesses.groupBy("mem_id").transformWithState(Reviews(interval, threshold), OUT, "append", "none")


def run(rows: DataFrame, checkpoint: str, path: str) -> None:
    """All that is there now; started again it goes on from the checkpoint."""
    conf = rows.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)


def state(spark: SparkSession, checkpoint: str, memories: DataFrame, steps: int, interval: int, threshold: int) -> DataFrame:
    """mem_id, hits, quality of memories(mem_id) after so many steps: what the state store has, and the reviews since."""
    found = spark.read.format("statestore").option("stateVarName", "memory").load(checkpoint)
    found = found.select(F.col("key.mem_id").alias("mem_id"), F.col("value.hits").alias("hits"), F.col("value.level").alias("level"), F.col("value.reviews").alias("reviews"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    hits, level, since = zero(F.col("hits")), zero(F.col("level")), F.lit(steps // interval) - zero(F.col("reviews"))
    quality: Column = F.when(hits <= threshold, F.least(F.lit(DELETED), level + since)).otherwise(level).cast("int")
    return memories.select("mem_id").join(found, "mem_id", "left").select("mem_id", hits.cast("long").alias("hits"), quality.alias("quality"))
