"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.session import shared_folder


#: A key that more than one row in so many has is joined by broadcast; there are at most so many such keys.
SHARES = 1024
#: Rows of a small table that one task takes.
ROWS = 8192


def few(rows: DataFrame, n: int) -> DataFrame:
    """rows, about n of them, in no more partitions than they are worth: each writes its own files in every shuffle."""
    return rows.coalesce(max(1, -(-n // ROWS)))


def joined_evenly(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of table, which has a row for each key and in n how many of the `total` rows have it.

    No task gets all rows of a frequent key: such keys, fewer than SHARES of them, are broadcast.
    """
    often = F.broadcast(table.where(F.col("n") * SHARES > total))
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(table.where(F.col("n") * SHARES <= total), key)).drop("n")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of edges(u, v) that is not itself the smallest of its component, the smallest.

    A star around the smallest neighbour replaces the links of each node, so no step makes more rows than
    there are edges, whatever the degree of a node; the links of a hub are joined without meeting in one task.
    Loops and repeated edges are harmless; an empty table gives an empty one.
    """
    shared_folder(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = _state(now)
    while True:
        n = state[0]
        both = few(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = joined_evenly(both, least, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = few(few(large, n).distinct(), n).checkpoint()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined_evenly(large, down, "u", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        now = few(few(small, n).distinct(), n).checkpoint()
        before, state = state, _state(now)
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
