"""The trained layout scorer and forgetting as a keyed stream."""

import numpy as np
from pyspark.sql import functions as F

from lodestore.operators import forgetting as O
from lodestore.operators import scorer as S
from lodestore.streaming import forgetting as G

LAYERS = (20, 8, 4, 1)


def groups(spark, seed=1, n=40, partitions=4):
    r = np.random.default_rng(seed)
    w = r.normal(size=20)
    rows = []
    for _ in range(n):
        x = r.normal(size=(r.integers(1, 9), 20))
        rows.append((x.tolist(), np.round(1 / (1 + np.exp(-x @ w)), 1).tolist()))
    return spark.createDataFrame(rows, "x array<array<double>>, y array<double>").repartition(partitions)


def test_gradients_by_differences():
    r = np.random.default_rng(2)
    flat, x, y = S.initial(LAYERS), r.normal(size=(7, 20)), np.round(r.random(7), 1)
    _, _, pairs, g1, g2 = S.loss_and_gradient(flat, x, y, LAYERS)
    assert pairs == sum(y[i] != y[j] for i in range(7) for j in range(i))
    for k in r.choice(len(flat), 25, replace=False):
        e = np.zeros_like(flat)
        e[k] = 1e-6
        up, down = S.loss_and_gradient(flat + e, x, y, LAYERS), S.loss_and_gradient(flat - e, x, y, LAYERS)
        assert np.isclose((up[0] - down[0]) / 2e-6, g1[k], atol=1e-5) and np.isclose((up[1] - down[1]) / 2e-6, g2[k], atol=1e-5)


def test_training_does_not_depend_on_partitions(spark):
    one = S.Scorer(LAYERS).fit(groups(spark, partitions=1), steps=12, rate=0.02)
    many = S.Scorer(LAYERS).fit(groups(spark, partitions=7), steps=12, rate=0.02)
    assert np.allclose(one.weights, many.weights, atol=1e-6) and np.allclose(one.losses, many.losses, atol=1e-9)
    assert one.losses[-1] < 0.8 * one.losses[0] and len(one.losses) == 13
    x = np.random.default_rng(3).normal(size=(30, 20))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, x array<double>")
    got = {r.k: r.score for r in one.scores(rows).collect()}
    h = x
    parts = S._unpacked(one.weights, LAYERS)
    for w, b in parts[:-1]:
        h = np.maximum(h @ w + b, 0)
    plain = 1 / (1 + np.exp(-(h @ parts[-1][0] + parts[-1][1])))[:, 0]
    assert np.allclose([got[k] for k in range(30)], plain)


def test_no_groups(spark):
    s = S.Scorer(LAYERS).fit(groups(spark).limit(0), steps=3)
    assert s.losses == [0.0]


def test_hashed_text(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(S.hashed_text(F.col("t"), 16).alias("v"))
    got = [np.array(r.v) for r in df.collect()]
    assert np.isclose(got[0] @ got[0], 1) and sorted(got[0])[-2:] != [0, 0] and not got[1].any() and not got[2].any()


def test_stream_has_the_state_of_the_simulation_after_a_restart(spark, tmp_path):
    r = np.random.default_rng(6)
    users = [f"u{k}" for k in range(30)]
    p = np.r_[np.full(10, 6.0), np.full(20, 0.4)]
    steps = [(k, str(u)) for k, u in enumerate(r.choice(users, 900, p=p / p.sum()))]
    memories = spark.createDataFrame([(u,) for u in users], "mem_id string")
    source, at = f"{tmp_path}/in", f"{tmp_path}/checkpoint"

    def more(low, high):
        spark.createDataFrame([(u, k) for k, u in steps[low:high]], "mem_id string, step long").coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema("mem_id string, step long").option("maxFilesPerTrigger", 1).parquet(source)
        G.run(G.demotions(stream, 150, 3), at, f"{tmp_path}/out")

    more(0, 200)
    more(200, 430)
    go()
    more(430, 900)
    # started again: hits and levels come from the checkpoint
    go()
    got = {x.mem_id: (x.quality, x.hits) for x in G.state(spark, at, memories, 900, 150, 3).collect()}
    sizes = memories.withColumn("size", F.lit(100).cast("long"))
    order = spark.createDataFrame([(k, k) for k, _ in steps], "query_id long, step long")
    cand = spark.createDataFrame([(k, u, 1) for k, u in steps], "query_id long, mem_id string, rank int")
    state, _ = O.simulate(order, cand, sizes, 150, 3, 1, 1)
    assert got == {x.mem_id: (x.quality, x.hits) for x in state.collect()}
    assert {q for q, _ in got.values()} >= {0, 4}
    changes = spark.read.parquet(f"{tmp_path}/out").count()
    assert changes > 0
