"""Row-level changes of banks and indexes."""

import glob
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.operators import retrieval as R
from lodestore.operators.delta import DeltaBank
from lodestore.operators.memory import Bank
from lodestore.operators.vector_index import VectorIndex
from lodestore.streaming.access import ReviewPolicy


def files(path):
    return {p for p in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def rows(spark, *xs):
    return spark.createDataFrame(list(xs), "id string, v int, w array<string>")


def content(bank, **how):
    return sorted((r.id, r.v) for r in bank.read(**how).collect())


def test_a_change_of_one_row_writes_one_bucket(spark, tmp_path):
    bank = DeltaBank(spark, f"{tmp_path}/bank", buckets=8)
    bank.write(rows(spark, *[(f"m{k}", k, ["x"]) for k in range(200)]))
    before = files(f"{tmp_path}/bank")
    bank.upsert(rows(spark, ("m7", 700, None)))
    new = files(f"{tmp_path}/bank") - before
    assert len(new) == 1 and len(before) == 8
    assert content(bank) == sorted((f"m{k}", 700 if k == 7 else k) for k in range(200))
    # buckets without changes are scanned as they are, and one bucket is read for one key
    assert bank.read_near(rows(spark, ("m7", 0, None), ("zz", 0, None))).collect()[0].v == 700
    near = {p.split("_bucket=")[1][0] for p in bank.read_near(rows(spark, ("m7", 0, None))).inputFiles() if "_bucket=" in p}
    assert near == {next(iter(new)).split("_bucket=")[1][0]}
    assert content(bank, version=1) == sorted((f"m{k}", k) for k in range(200))


def test_changes_equal_the_full_rewrite(spark, tmp_path):
    r = np.random.default_rng(3)
    bank, plain = DeltaBank(spark, f"{tmp_path}/bank", buckets=4), {}
    first = {f"m{k}": k for k in range(40)}
    plain |= first
    bank.write(rows(spark, *[(k, v, None) for k, v in first.items()]))
    for step in range(6):
        ids = [f"m{k}" for k in r.choice(60, 7, replace=False)]
        if step % 3 == 2:
            bank.delete(rows(spark, *[(k, None, None) for k in ids]))
            for k in ids:
                plain.pop(k, None)
        else:
            bank.upsert(rows(spark, *[(k, step * 100, ["y"]) for k in ids]))
            plain |= {k: step * 100 for k in ids}
        assert content(bank) == sorted(plain.items())
        if step == 3:
            untouched = {b for b, s in bank.log()["live"].items() if len(s) <= 2}
            live = bank.log()["live"]
            done = bank.compact(2)
            assert set(done) == set(live) - untouched and content(bank) == sorted(plain.items())
            assert all(bank.log()["live"][b] == live[b] for b in untouched)
    bank.compact(1)
    assert all(len(s) == 1 for s in bank.log()["live"].values())
    assert bank.vacuum(1) > 0 and content(bank) == sorted(plain.items()) and len(bank.versions()) == 1


def test_missing_columns_empty_changes_and_two_writers(spark, tmp_path):
    bank = DeltaBank(spark, f"{tmp_path}/bank", buckets=4)
    with pytest.raises(FileNotFoundError):
        bank.read()
    bank.write(rows(spark, ("a", 1, ["x"])))
    bank.upsert(spark.createDataFrame([("b", 2)], "id string, v int"))
    bank.upsert(rows(spark, ("c", 1, None)).limit(0))
    bank.delete(rows(spark, ("a", 0, None)))
    assert [tuple(r) for r in bank.read().collect()] == [("b", 2, None)]
    bank.delete(rows(spark, ("b", 0, None)))
    bank.compact(0)
    assert bank.read().collect() == [] and bank.read().columns == ["id", "v", "w"]
    entry = bank.log()
    with pytest.raises(Exception, match="exist"):
        bank._move_pointer(entry)
    bank.write(rows(spark, ("z", 9, None)))
    assert content(bank) == [("z", 9)]


@pytest.mark.parametrize("kind", [Bank, DeltaBank])
def test_review_policy_on_both_banks(spark, tmp_path, kind):
    bank = kind(spark, f"{tmp_path}/bank")
    bank.write(spark.createDataFrame([(str(k), 0, 0, False) for k in range(30)], "id string, access_count long, quality_level int, deleted boolean"))
    for batch_id in (0, 0, 1, 2, 2):
        ReviewPolicy(bank, 7, 0)(spark.createDataFrame([(1,), (1,), (5,)], "user_id long"), batch_id)
    assert bank.note() == {"batch": 2, "seen": 0}
    got = {r.id: (r.access_count, r.quality_level, r.deleted) for r in bank.read().collect()}
    assert got == {str(k): ((6, 0, False) if k == 1 else (3, 0, False) if k == 5 else (0, 1, False)) for k in range(30)}


def some_keys(spark, n=600, d=12, groups=20, seed=1):
    r = np.random.default_rng(seed)
    v = r.normal(size=(groups, d))[r.integers(0, groups, n)] + 0.4 * r.normal(size=(n, d))
    v[:3] = 0
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    return v, spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "ord long, vec array<double>")


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_index_with_all_lists_is_exact(spark, tmp_path, metric):
    _, keys = some_keys(spark)
    q = keys.where("ord % 50 = 0").withColumnRenamed("ord", "query_id")
    index = VectorIndex(spark, f"{tmp_path}/i").build(keys, metric, lists=9)
    exact = sorted(map(tuple, R.candidates(q, keys, 4, metric).select("query_id", "ord", "sim", "rank").collect()))
    assert sorted(map(tuple, index.search(q, 4, 99).select("query_id", "ord", "sim", "rank").collect())) == exact
    assert index.keys().count() == 600


def test_recall_is_measured_and_lists_are_pruned(spark, tmp_path):
    _, keys = some_keys(spark)
    q = keys.where("ord % 50 = 1").withColumnRenamed("ord", "query_id")
    index = VectorIndex(spark, f"{tmp_path}/i").build(keys, lists=24)
    probes, recall = index.probes_for(q, 5, 0.9)
    assert recall >= 0.9 and probes < 24
    one = q.where("query_id = 51")
    plan = index.search(one, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ = \d+", plan)
    assert {r["list"] for r in index.keys([0, 3]).select("list").distinct().collect()} == {0, 3}


def test_index_changes(spark, tmp_path):
    v, keys = some_keys(spark)
    index = VectorIndex(spark, f"{tmp_path}/i").build(keys.where("ord < 300"), lists=5)
    turned = keys.where("ord between 100 and 110").withColumn("vec", F.transform("vec", lambda x: -x))
    index.add(keys.where("ord >= 300")).add(turned).remove(keys.where("ord % 3 = 0")).add(keys.where("ord = 6"))
    got = {r.ord: r.vec for r in index.keys().collect()}
    want = {k: ((-x if 100 <= k <= 110 else x).tolist()) for k, x in enumerate(v) if k % 3 or k == 6}
    assert got == want and index.keys().count() == len(want)


def test_empty_index(spark, tmp_path):
    _, keys = some_keys(spark)
    index = VectorIndex(spark, f"{tmp_path}/i").build(keys.limit(0))
    assert index.search(keys.withColumnRenamed("ord", "query_id"), 3, 2).collect() == []
