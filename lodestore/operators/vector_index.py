"""An inverted-file index: keys in lists by their nearest centre, of which a search reads a few.

Centres are fitted by k-means on a bounded sample of the keys; every key is in the list of its nearest centre.
Lists are folders of Parquet files, so a search reads the lists that its queries probe and no others, and a list is
dealt to parts of a bounded number of keys.  With all lists probed the result is that of the exact search.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.operators.retrieval import BLOCK_BYTES, TILE_BYTES, _block_best, _matrix, candidates, ranked

#: Keys, about, that the centres are fitted on; the only bound of the index: all keys are in it.
SAMPLE = 50_000
#: Most lists; a table of the centres goes to every task.
LISTS = 4096
#: Keys of a list that are searched in one task, about.
PART = 16_384


def _centre_distances(m: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """The smaller the nearer."""
    s = m @ centres.T
    return -s if metric in ("cosine", "ip") else (centres * centres).sum(axis=1)[None] - 2 * s


def _nearest(m: np.ndarray, centres: np.ndarray, metric: str, n: int) -> np.ndarray:
    """The numbers of the n nearest centres of each vector, in order; TILE_BYTES of distances at a time."""
    if not centres.shape[1] or not len(m):
        return np.zeros((len(m), 1), np.int32)
    out = np.empty((len(m), n), np.int32)
    step = max(1, TILE_BYTES // (8 * len(centres)))
    for i in range(0, len(m), step):
        d = _centre_distances(m[i : i + step], centres, metric)
        out[i : i + step] = d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


class VectorIndex:
    """Keys (ord, vec) under a folder that all executors share; metric is cosine (unit vectors), ip or l2.

    Changes add sequences: the list files of a key count only if they are of its last change.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, keys: DataFrame, metric: str = "cosine", lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """Fit centres and write every key; lists is by default twice the root of the number of keys."""
        if metric not in ("cosine", "ip", "l2"):
            raise ValueError(f"unknown metric {metric}")
        n = keys.count()
        lists = max(1, min(LISTS, n, 2 * math.isqrt(n) if lists is None else lists))
        share = min(1.0, sample / max(n, 1))
        some = keys.where(F.pmod(F.xxhash64(F.lit("index"), "ord"), F.lit(1 << 30)) < int(share * (1 << 30)))
        vectors = some.select(array_to_vector("vec").alias("features"))
        # cosine is undefined for zero vectors; they are in some list, but no centre is fitted on them
        vectors = vectors.where(F.exists("vec", lambda x: x != 0)) if metric == "cosine" else vectors
        centres = []
        if n and not vectors.isEmpty():
            model = KMeans(k=lists, maxIter=8, seed=seed, distanceMeasure="cosine" if metric == "cosine" else "euclidean").fit(vectors)
            centres = [[float(x) for x in c] for c in model.clusterCenters()]
        rows = [(k, c) for k, c in enumerate(centres)] or [(0, [])]
        self.spark.createDataFrame(rows, "list int, centre array<double>").withColumn("metric", F.lit(metric)).write.mode("overwrite").parquet(f"{self.path}/centres")
        return self._put(keys)

    def _centres(self) -> tuple[np.ndarray, str]:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # LISTS at most
        return np.array([r.centre for r in rows], np.float64), rows[0].metric

    def _put(self, keys: DataFrame) -> VectorIndex:
        centres, metric = self._centres()

        def f(batches):
            for b in batches:
                near = _nearest(_matrix(b.column("vec")), centres, metric, 1)[:, 0]
                yield pa.record_batch([b.column("ord"), b.column("vec"), pa.array(near)], names=["ord", "vec", "list"])

        rows = keys.select(F.col("ord").cast("long").alias("ord"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).mapInArrow(f, "ord long, vec array<double>, list int")
        sizes = rows.groupBy("list").agg((F.floor(F.count("*") / PART) + 1).cast("int").alias("parts"))
        dealt = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int")).drop("parts")
        seq = len(self._sequences())
        dealt.repartition("list", "part").write.partitionBy("list").parquet(f"{self.path}/lists/seq={seq:06d}-{uuid.uuid4().hex[:8]}")
        return self

    def _sequences(self) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(p) else []

    def _note_change(self, ids: DataFrame) -> None:
        """From now on these keys count only where a sequence still to be written has them."""
        ids.select(F.col("ord").cast("long").alias("ord"), F.lit(len(self._sequences())).alias("least")).write.mode("append").parquet(f"{self.path}/changes")

    def add(self, keys: DataFrame) -> VectorIndex:
        """More keys, to the centres that are there; a known ord gets the new vector."""
        self._note_change(keys)
        return self._put(keys)

    def remove(self, ids: DataFrame) -> VectorIndex:
        self._note_change(ids)
        return self

    def keys(self, lists: list[int] | None = None) -> DataFrame:
        """ord, vec, list, part of the keys that count, in all lists or some."""
        found = self._sequences()
        schema = "ord long, vec array<double>, part int, seq string, list int"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/lists").parquet(*[f"{self.path}/lists/{s}" for s in found])
        rows = rows if lists is None else rows.where(F.col("list").isin(lists))
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/changes")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return rows.drop("seq")
        least = self.spark.read.schema("ord long, least int").parquet(f"{self.path}/changes").groupBy("ord").agg(F.max("least").alias("least"))
        rows = rows.join(least, "ord", "left")
        return rows.where(F.substring("seq", 1, 6).cast("int") >= F.coalesce("least", F.lit(0))).select("ord", "vec", "part", "list")

    def search(self, queries: DataFrame, k: int, probes: int, threshold: float | None = None) -> DataFrame:
        """query_id, ord, sim, rank of the k best in the `probes` nearest lists of each of queries(query_id, vec).

        An empty index gives nothing.  The threshold is inclusive and comes after the k.
        """
        centres, metric = self._centres()
        probes = min(probes, len(centres))

        def f(batches):
            for b in batches:
                lists = _nearest(_matrix(b.column("vec")), centres, metric, probes)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * lists.shape[1], pa.int32()), pa.array(lists.ravel(), pa.int32()))
                yield pa.record_batch([b.column("query_id"), b.column("vec"), flat], names=["query_id", "vec", "lists"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).mapInArrow(f, "query_id long, vec array<double>, lists array<int>")
        n = asked.agg(F.count("*"), F.max(F.size("vec"))).first()
        blocks = max(1, -(-n[0] // max(1, BLOCK_BYTES // (8 * max(n[1] or 1, 1)))))
        wanted = [r[0] for r in asked.select(F.explode("lists").alias("list")).distinct().collect()]  # LISTS at most
        rows = self.keys(wanted)
        parts = rows.select(F.col("list").alias("list"), F.col("part").alias("_part")).distinct()
        q = asked.select("query_id", "vec", F.explode("lists").alias("list"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb")).join(F.broadcast(parts), "list").withColumn("part", F.col("_part") + 0).drop("_part")
        keys = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        group = ("list", "part", "qb")
        found = q.groupBy(*group).cogroup(keys.groupBy(*group)).applyInArrow(_block_best(k, metric), "query_id long, ord long, sim double")
        out = ranked(found, k)
        return out if threshold is None else out.where(F.col("sim") >= threshold)

    def recall(self, queries: DataFrame, k: int, probes: int) -> float:
        """The share of the exact k best (of the keys that are in the index) that the search finds."""
        _, metric = self._centres()
        exact = candidates(queries, self.keys().select("ord", "vec"), k, metric).select("query_id", "ord")
        found = self.search(queries, k, probes).select("query_id", "ord", F.lit(1).alias("hit"))
        r = exact.join(found, ["query_id", "ord"], "left").agg(F.count("hit"), F.count("*")).first()
        return r[0] / r[1] if r[1] else 1.0

    def probes_for(self, queries: DataFrame, k: int, least: float = 0.9) -> tuple[int, float]:
        """The first power of two of probes whose recall over these queries is at least so much, and the recall."""
        n = len(self._centres()[0])
        probes = 1
        while True:
            probes = min(probes, n)
            r = self.recall(queries, k, probes)
            if r >= least or probes == n:
                return probes, r
            probes *= 2
