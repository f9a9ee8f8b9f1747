"""What a Python task holds at once does not follow its input."""

import numpy as np
from pyspark.sql import functions as F

from lodestore.operators import retrieval as R
from lodestore.operators import vector_index as X


def test_parts_and_key_blocks_are_bounded(spark, tmp_path, monkeypatch):
    keys = spark.range(60_000).select(F.col("id").alias("ord"), F.array(*[F.rand(k) - 0.5 for k in range(4)]).alias("vec"))
    index = X.VectorIndex(spark, f"{tmp_path}/i").build(keys, lists=2, metric="l2", sample=500)
    sizes = [r["count"] for r in index.keys().groupBy("list", "part").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 25_000
    queries = keys.where("ord % 4000 = 0").withColumnRenamed("ord", "query_id")
    want = {(r.query_id, r.ord) for r in R.candidates(queries, keys, 3, "l2").collect()}
    monkeypatch.setattr(R, "BLOCK_BYTES", 32 << 10)
    _, dealt = R._dealt(queries, keys, ("vec",))
    assert max(r["count"] for r in dealt.groupBy("qb", "kb").count().collect()) < 2 * R.BLOCK_BYTES // 32
    assert {(r.query_id, r.ord) for r in R.candidates(queries, keys, 3, "l2").collect()} == want
    assert {(r.query_id, r.ord) for r in index.search(queries, 3, 2).collect()} == want


def test_nearest_centres_in_slices(monkeypatch):
    r = np.random.default_rng(2)
    m, centres = r.normal(size=(100, 5)), r.normal(size=(30, 5))
    whole = X._centre_distances(m, centres, "l2")
    monkeypatch.setattr(X, "TILE_BYTES", 8 * 30 * 7)
    assert (X._nearest(m, centres, "l2", 1)[:, 0] == whole.argmin(axis=1)).all()
    assert (X._nearest(m, centres, "l2", 4) == np.argsort(whole, axis=1, kind="stable")[:, :4]).all()
    assert X._nearest(m, np.zeros((1, 0)), "l2", 4).shape == (100, 1)
