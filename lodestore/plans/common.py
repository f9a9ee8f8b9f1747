"""Shared parts of the queries and of the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries of searches: every row whose id this divides, against all rows.
EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as memories: ord, image and text vectors, category and quality."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("image"), F.reverse("embedding").alias("text"), "label", F.pmod("vec_id", F.lit(5)).cast("int").alias("quality"))


def sql_scores(alpha: float, metric: str = "cosine") -> str:
    """CTEs: keys, q, s(query_id, ord, sim, label, quality) for all queries and all keys."""
    mixed = "embedding" if alpha == 1 else f"list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: {alpha} * z[1]::double + {1 - alpha} * z[2]::double)"
    unit = "list_transform(v, lambda x: x / case when n = 0 then 1 else n end)" if metric == "cosine" else "v"
    sim = "round(list_inner_product(q.v, k.v), 9)" if metric != "l2" else "round(-list_distance(q.v, k.v), 9) + 0.0"
    return f"""
with raw as (select vec_id, label, (vec_id % 5)::int quality, list_transform({mixed}, lambda x: x::double) v, list_transform(embedding, lambda x: x::double) e from embeddings),
len as (select *, sqrt(list_inner_product(v, v)) n, sqrt(list_inner_product(e, e)) m from raw),
keys as (select vec_id ord, label, quality, {unit} v from len),
q as (select vec_id query_id, {"list_transform(e, lambda x: x / case when m = 0 then 1 else m end)" if metric == "cosine" else "e"} v from len where vec_id % {EVERY} = 0),
s as (select query_id, ord, {sim} sim, label, quality from q, keys k)"""


def sql_rank(source: str, name: str, k: int, where: str = "true") -> str:
    return f"{name} as (select * from (select * exclude (r), row_number() over (partition by query_id order by sim desc, ord) r from (select *, 0 r from {source} where {where})) where r <= {k})"
