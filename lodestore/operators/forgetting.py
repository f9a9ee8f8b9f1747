"""Frequency-based forgetting.

Qualities only change at reviews, so the queries between two reviews are one batch job: the first k alive
candidates of each step are counted per memory, and memories with few hits so far lose one level.  Hits add up
over reviews.  Level 4 is deleted.  State is cut by checkpoint() after each review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.session import shared_folder

# Share of the full size at each level, and how images shrink at each.
SIZE_RATIOS = (1.0, 0.5795, 0.3709, 0.00518, 0.0)
LABELS = ("PNG", "WebP-85", "AVIF-50", "AVIF-50@0.5x", "Deleted")
IMAGE_SCALES = (1.0, 0.75, 0.5, 0.25, 0.0)
DELETED = 4


def ratio(quality: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in SIZE_RATIOS]), quality)


def stored_bytes(size: Column, quality: Column) -> Column:
    """Bytes of a memory at its level, truncated row by row; sum it up for the storage of a bank."""
    return F.floor(size * ratio(quality)).cast("long")


def image_scale(quality: Column, mode: str = "compound") -> Column:
    """Scale of a picture at a level: of the picture before ("compound") or of the original ("absolute")."""
    if mode == "absolute":
        return F.get(F.array(*[F.lit(s) for s in IMAGE_SCALES]), quality)
    steps, x = [], 1.0
    for s in IMAGE_SCALES:
        x *= s
        steps.append(x)
    return F.get(F.array(*[F.lit(s) for s in steps]), quality)


def demote(quality: Column) -> Column:
    return F.least(quality + 1, F.lit(DELETED))


def reviewed(state: DataFrame, threshold: int) -> DataFrame:
    """state(mem_id, quality, hits, ...) after a review, with `demoted`."""
    low = (F.col("quality") < DELETED) & (F.col("hits") <= threshold)
    return state.withColumn("demoted", low).withColumn("quality", F.when(low, demote(F.col("quality"))).otherwise(F.col("quality")))


def access_counts(bank: DataFrame, accessed: DataFrame) -> DataFrame:
    """bank(id, access_count, ...) with accessed(id) added up; unknown ids are ignored, repeated ones count."""
    n = accessed.groupBy("id").agg(F.count("*").alias("_n"))
    return bank.join(n, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def effective(candidates: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The first k candidates (query_id, mem_id, rank, sim) of each query that are not deleted, ranked anew."""
    alive = candidates.join(state.where(F.col("quality") < DELETED).select("mem_id", "quality"), "mem_id")
    w = Window.partitionBy("query_id").orderBy("rank", "mem_id")
    return alive.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def simulate(steps: DataFrame, candidates: DataFrame, sizes: DataFrame, interval: int, threshold: int, epochs: int, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Final state(mem_id, size, quality, hits) and snapshots of each review.

    steps(query_id, step): the order of the queries, from 0; candidates(query_id, mem_id, rank); sizes(mem_id, size).
    """
    spark = steps.sparkSession
    shared_folder(spark)
    n = steps.count()
    candidates = candidates.select("query_id", "mem_id", "rank").checkpoint()
    state = sizes.select("mem_id", "size", F.lit(0).alias("quality"), F.lit(0).cast("long").alias("hits")).checkpoint()
    snapshots = None
    at = 0
    while at < n * epochs:
        end = min(at + interval, n * epochs)
        # how often each query comes in this interval
        whole, first, last = (end - at) // n, at % n, (end - 1) % n + 1
        part = (end - at) % n
        inside = F.lit(False) if part == 0 else (((F.col("step") >= first) & (F.col("step") < last)) if first < last else ((F.col("step") >= first) | (F.col("step") < last)))
        times = steps.select("query_id", (F.lit(whole) + inside.cast("int")).alias("times")).where("times > 0")
        hits = effective(candidates, state, k).join(times, "query_id").groupBy("mem_id").agg(F.sum("times").alias("new"))
        state = state.join(hits, "mem_id", "left").select("mem_id", "size", "quality", (F.col("hits") + F.coalesce("new", F.lit(0))).alias("hits"))
        if end % interval == 0:
            after = reviewed(state, threshold).checkpoint()
            shot = after.agg(
                F.lit(end).cast("long").alias("step"),
                F.sum(stored_bytes(F.col("size"), F.col("quality"))).alias("storage_bytes"),
                F.sum((F.col("quality") < DELETED).cast("long")).alias("n_alive"),
                F.sum(F.col("demoted").cast("long")).alias("n_demoted"),
                *[F.sum((F.col("quality") == q).cast("long")).alias(f"level_{q}") for q in range(5)],
            )
            snapshots = shot if snapshots is None else snapshots.unionByName(shot)
            state = after.drop("demoted")
        at = end
    if snapshots is None:
        snapshots = spark.createDataFrame([], "step long, storage_bytes long, n_alive long, n_demoted long, level_0 long, level_1 long, level_2 long, level_3 long, level_4 long")
    return state, snapshots


def storage_curve(snapshots: DataFrame, initial: int, total_steps: int, every: int = 100) -> DataFrame:
    """step, storage_bytes at the start, each `every` steps, each review and the end; flat between reviews."""
    spark = snapshots.sparkSession
    known = snapshots.select("step", "storage_bytes").unionByName(spark.createDataFrame([(0, initial)], "step long, storage_bytes long"))
    marks = spark.range(0, total_steps + 1, every).select(F.col("id").alias("step")).union(spark.createDataFrame([(total_steps,)], "step long")).distinct()
    # ranges of steps: inside a range in order, from range to range by a row for each
    rows = known.join(marks, "step", "full").withColumn("_r", F.floor(F.col("step") / (every * 1000)))
    inside = Window.partitionBy("_r").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("_r").agg(F.max_by("storage_bytes", F.when(F.col("storage_bytes").isNotNull(), F.col("step"))).alias("_end"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_r", F.last("_end", True).over(before).alias("_carried"))
    return rows.join(carried, "_r").select("step", F.coalesce(F.last("storage_bytes", True).over(inside), "_carried").alias("storage_bytes"))
