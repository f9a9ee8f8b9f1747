"""Operators against plain models."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.operators import evaluation as E
from lodestore.operators import forgetting as G
from lodestore.operators import memory as B
from lodestore.operators import retrieval as R
from lodestore.sources import records as S
from lodestore.streaming import access as A


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "ord long, v array<float>")


def test_top_k_against_numpy(spark):
    r = np.random.default_rng(1)
    v = [(i, x) for i, x in enumerate(r.normal(size=(300, 8)))]
    v += [(300, np.zeros(8)), (301, v[3][1]), (302, v[3][1])]
    df = vectors(spark, v).repartition(5)
    keys = R.keys_of(df, "ord", F.col("v"))
    q = keys.where("ord % 50 = 3 or ord = 300").withColumnRenamed("ord", "query_id")
    m = np.array([x / (np.linalg.norm(x) or 1) for _, x in v]).astype(np.float64)
    for k, over, thr in ((2, 5, 0.1), (3, 0, 0.5), (400, 0, None)):
        got = {}
        for x in R.top_k(q, keys, k, thr, over=over, keep=F.col("ord") != F.col("query_id")).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.ord))
        for i in (3, 53, 103, 300):
            s = np.round(m @ m[i], 6)
            order = sorted(range(len(v)), key=lambda j: (-s[j], j))[: k + over]
            want = [j for j in order if j != i and (thr is None or s[j] >= thr)][:k]
            assert [o for _, o in sorted(got.get(i, []))] == want


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(2)
    keys = R.keys_of(vectors(spark, list(enumerate(r.normal(size=(60, 4))))), "ord", F.col("v"))
    q = keys.withColumnRenamed("ord", "query_id")
    once = sorted(map(tuple, R.candidates(q, keys, 3).collect()))
    monkeypatch.setattr(R, "BLOCK_BYTES", 8 * 4 * 7)
    assert sorted(map(tuple, R.candidates(q, keys, 3).collect())) == once
    assert R.candidates(q.limit(0), keys, 3).collect() == []
    assert R.candidates(q, keys.limit(0), 3).collect() == []


def test_budget_and_recent(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1), (2, 1, 3)], "query_id int, rank int, n int")
    got = {(r.query_id, r["rank"]): r.total_tokens for r in R.within_budget(rows, "n", 10).collect()}
    assert got == {(1, 1): 11, (2, 1): 3}
    t = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "ord long, created_at int")
    got = R.recent(t, 2, files=spark.createDataFrame([(3,)], "ord long")).collect()
    assert [(x.ord, x["rank"]) for x in got] == [(3, 2)]


def test_duplicate_action(spark):
    rows = spark.createDataFrame([(0.85,), (0.70,), (0.69,), (None,)], "s double").select(R.duplicate_action(F.col("s")).alias("a"))
    assert [r.a for r in rows.collect()] == ["REMAIN", "MERGE", "ADD", "ADD"]


def model(steps, cands, sizes, interval, threshold, epochs, k):
    q, hits, shots = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0), []
    n = 0
    for _ in range(epochs):
        for s in steps:
            for m in [m for m in cands.get(s, []) if q[m] < 4][:k]:
                hits[m] += 1
            n += 1
            if n % interval == 0:
                low = [m for m in sizes if q[m] < 4 and hits[m] <= threshold]
                for m in low:
                    q[m] += 1
                shots.append((n, sum(int(sizes[m] * G.SIZE_RATIOS[q[m]]) for m in sizes), sum(x < 4 for x in q.values()), len(low), *[sum(x == v for x in q.values()) for v in range(5)]))
    return q, hits, shots


@pytest.mark.parametrize(("interval", "threshold", "epochs"), [(3, 0, 3), (7, 1, 2), (25, 0, 3), (1000, 0, 1), (2, 0, 2)])
def test_simulation_against_a_loop(spark, interval, threshold, epochs):
    r = random.Random(interval)
    steps = list(range(10, 21))
    cands = {s: r.sample(range(30), 6) for s in steps if s != 13}
    sizes = {m: 100 + 7 * m for m in range(30)}
    state, shots = G.simulate(
        spark.createDataFrame(list(zip(steps, range(len(steps)))), "query_id long, step long"),
        spark.createDataFrame([(s, m, i) for s, c in cands.items() for i, m in enumerate(c)], "query_id long, mem_id long, rank int"),
        spark.createDataFrame(list(sizes.items()), "mem_id long, size long"),
        interval, threshold, epochs,
    )
    q, hits, want = model(steps, cands, sizes, interval, threshold, epochs, 2)
    assert {(x.mem_id, x.quality, x.hits) for x in state.collect()} == {(m, q[m], hits[m]) for m in sizes}
    assert sorted(map(tuple, shots.collect())) == want
    curve = G.storage_curve(shots, sum(sizes.values()), len(steps) * epochs, 10).orderBy("step").collect()
    assert curve[0].storage_bytes == sum(sizes.values())
    assert all(a.storage_bytes >= b.storage_bytes for a, b in zip(curve, curve[1:]))


def test_degradation_scales(spark):
    rows = spark.range(5).select(G.image_scale(F.col("id").cast("int")).alias("c"), G.image_scale(F.col("id").cast("int"), "absolute").alias("a")).collect()
    assert [r.c for r in rows] == [1, 0.75, 0.375, 0.09375, 0] and [r.a for r in rows] == [1, 0.75, 0.5, 0.25, 0]


def test_bank(spark, tmp_path):
    b = B.Bank(spark, f"{tmp_path}/bank")
    rows = spark.createDataFrame([(f"m{i}", i, i) for i in range(6)], "id string, ord long, created_at int")
    b.write(rows)
    b.change(lambda d: B.delete(d, d.where("ord < 2")))
    assert b.versions() == [1, 2] and sorted(r.id for r in b.read().collect()) == ["m2", "m3", "m4", "m5"]
    assert b.read(1).count() == 6
    b.backup(f"{tmp_path}/copy")
    b.clear(F.col("ord") == 3)
    assert b.read().count() == 3 and spark.read.parquet(f"{tmp_path}/copy").count() == 4
    with pytest.raises(Exception, match="duplicate id"):
        B.insert_new(rows, rows.where("ord = 1")).collect()
    assert B.insert_new(rows, rows.where("ord = 1").withColumn("id", F.lit("new"))).count() == 7
    assert [r.id for r in B.evicted(rows, 4).orderBy("ord").collect()] == ["m0", "m1"]
    assert B.evicted(rows, 0).count() == 0 and B.evicted(rows, 10).count() == 0


def test_condition_fingerprints(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1), ("d", 1), ("d", 1)], "c string, x int")
    got = {r.c: r.leader for r in E.condition_groups(E.fingerprints(rows, "c", ["x"]), "c").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_sample_is_stratified_and_whole(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id int, s string")
    got = E.stratified_sample(rows, "s", "id", 30, 1).collect()
    assert len(got) == 30 and sum(r.s == "b" for r in got) == 10


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"dataset": "d", "index": 1}\n\n{"question": "q"}\n')
    assert S.load_records(spark, f"{tmp_path}/a.jsonl").count() == 2
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"dataset": "x"}, {"dataset": "y"}]}))
    assert sorted(r.dataset for r in S.load_records(spark, f"{tmp_path}/b.json").collect()) == ["x", "y"]
    (tmp_path / "c.json").write_text(json.dumps([{"answer": "A", "choices": ["p"]}]))
    assert S.load_records(spark, f"{tmp_path}/c.json").first().choices == ["p"]
    (tmp_path / "m.jsonl").write_text('{"id": "a", "text": "1"}\n{"id": "b", "deleted": true}\n\n{"id": "a", "text": "2"}\n')
    got = S.read_manifest(spark, f"{tmp_path}/m.jsonl").orderBy("ord").collect()
    assert [(r.id, r.text, r.deleted, r.access_count) for r in got] == [("a", "2", False, 0), ("b", None, True, 0)]
    (tmp_path / "l.txt").write_text("(d, train:1, x, y)\nbad\n(d, train:1, z, w)\n(d, 5, q, r)\n(d, t:2, x)\n")
    got = S.read_labels(spark, f"{tmp_path}/l.txt").collect()
    assert [(r.dataset, r["split"], r["index"], r.labels) for r in got] == [("d", "train", "1", ["z", "w"])]
    assert S.read_labels(spark, f"{tmp_path}/l.txt", strict=False).count() == 3
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [(r.ord, list(r.vec)) for r in S.read_npy(spark, f"{tmp_path}/v.npy").orderBy("ord").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]


def test_review_policy_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "event_id long, user_id long").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "user_id", "'v' event_type", "0D value", "'{}' props")
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    b = B.Bank(spark, f"{tmp_path}/bank")
    b.write(spark.createDataFrame([(str(i), 0, 0, False, i) for i in range(4)], "id string, access_count long, quality_level int, deleted boolean, ord long"))
    A.each_batch(A.events(spark, f"{tmp_path}/in/*"), f"{tmp_path}/cp", A.ReviewPolicy(b, 6, 0))
    got = {r.id: (r.access_count, r.quality_level) for r in b.read().collect()}
    assert sum(n for n, _ in got.values()) == 9 and got["3"] == (0, 1)
    A.run_once(A.windowed_counts(A.events(spark, f"{tmp_path}/in/*"), "1 hour", "1 minute"), f"{tmp_path}/cp2", f"{tmp_path}/out")
