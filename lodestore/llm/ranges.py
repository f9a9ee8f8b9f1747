"""Documents in ranges of doc_id, each of about the same number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import BLOCKS_PER_PARTITION, LAST, partitions


def bucket_by(key: Column, bounds: list[int]) -> Column:
    """Number of sorted bounds that are not above the key, looked for in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    every = F.array(*[F.lit(x).cast("long") for x in bounds])
    coarse = F.array(*[F.lit(x).cast("long") for x in bounds[::step]])
    full = F.greatest(F.size(F.filter(coarse, lambda x: x <= key)) - 1, F.lit(0)) * step
    return (full + F.size(F.filter(F.slice(every, full + 1, step), lambda x: x <= key))).cast("int")


def in_ranges(docs: DataFrame) -> DataFrame:
    """bucket, key, doc_id, text; buckets are ascending ranges of key, which is doc_id or, for null, the largest."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = BLOCKS_PER_PARTITION * partitions(docs.sparkSession)
    bounds = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n).alias("b")).first()["b"] or []
    return rows.withColumn("bucket", bucket_by(F.col("key"), sorted(set(bounds))))
