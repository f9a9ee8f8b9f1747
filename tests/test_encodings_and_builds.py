"""Cached encodings and resumable builds."""

import os

import pytest
from pyspark.sql import functions as F

from lodestore.operators.builds import Build
from lodestore.operators.encodings import Counts, EncodingCache, Encoder


def lengths(contents):
    """A stand-in encoder that writes down how many contents it was given."""
    with open(os.environ.get("LODESTORE_TEST_LOG", "/dev/null"), "a") as out:
        out.write("x" * len(contents))
    return [[len(c), c.count("a"), 1.0] for c in contents]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, content string, encoder int")


def test_only_new_contents_are_encoded(spark, tmp_path):
    log = f"{tmp_path}/calls"

    def encode(contents):
        with open(log, "a") as out:
            out.write("x" * len(contents))
        return [[len(c), c.count("a"), 1.0] for c in contents]

    calls = lambda: os.path.getsize(log) if os.path.exists(log) else 0
    e = Encoder("lengths", 3, encode, batch=4)
    cache = EncodingCache(spark, f"{tmp_path}/cache", 4)
    rows = [(f"r{k}", "a" * (k % 10), 0) for k in range(30)] + [("n", None, 0), ("m", None, 0)]
    # ten contents; a null one is as a blank one
    assert cache.refresh(frame(spark, rows), e) == Counts(10, 0, 0) and calls() == 10
    assert cache.refresh(frame(spark, rows), e) == Counts(0, 10, 0) and calls() == 10
    got = {r.id: r.vec for r in cache.vectors(frame(spark, rows), e).collect()}
    assert got == {i: [float(len(c or "")), float((c or "").count("a")), 1.0] for i, c, _ in rows}
    changed = [(i, "b" if i == "r7" else c, 0) for i, c, _ in rows if i not in ("r3", "r13", "r23")]
    assert cache.refresh(frame(spark, changed), e, drop=False) == Counts(1, 10, 0) and calls() == 11
    assert cache.vectors(frame(spark, changed), e).where("vec is null").isEmpty()
    assert cache.refresh(frame(spark, changed), e) == Counts(0, 10, 1) and calls() == 11


def test_sizes_and_missing_sets(spark, tmp_path):
    cache = EncodingCache(spark, f"{tmp_path}/cache", 2)
    rows = frame(spark, [("a", "aa", 0)])
    good, other = Encoder("good", 3, lengths), Encoder("other", 3, lengths)
    cache.refresh(rows, good)
    with pytest.raises(ValueError):
        cache.refresh(rows, Encoder("good", 4, lengths))
    with pytest.raises(Exception, match="gave 3 numbers, not 2"):
        cache.refresh(rows, Encoder("short", 2, lengths))
    with pytest.raises(FileNotFoundError):
        cache.sets(rows, [good, other])
    assert list(cache.sets(rows, [good, other], "skip")) == ["good"]
    more = frame(spark, [("a", "aa", 0), ("b", "new", 0)])
    assert cache.sets(more, [good], "skip") == {}
    assert cache.refresh(rows.limit(0), good) == Counts(0, 0, 1)


def make(row):
    if row["n"] % 7 == 3:
        raise ValueError(f"bad {row['n']}")
    return f"{row['n']}:{row['text']}"


def fallback(row):
    return f"minimal {row['n']}"


def test_failing_rows_have_the_fallback(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}", k) for k in range(50)], "n long, text string, part int")
    b = Build(spark, f"{tmp_path}/b", parts=6)
    assert b.run(rows, "n", make, fallback, at_once=4) == 6
    assert {r.key: (r.result, r.failed) for r in b.results().collect()} == {str(k): (f"minimal {k}", True) if k % 7 == 3 else (f"{k}:t{k}", False) for k in range(50)}
    assert {r.key: r.error for r in b.errors().collect()} == {str(k): f"ValueError: bad {k}" for k in range(50) if k % 7 == 3}
    assert b.run(rows, "n", make, fallback) == 0
    plan = b.errors()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "failed" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_stopped_build_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(60)], "n long, text string")
    whole = Build(spark, f"{tmp_path}/whole", parts=8)
    whole.run(rows, "n", make, fallback, at_once=8)
    b = Build(spark, f"{tmp_path}/b", parts=8)
    stop = rows.withColumn("p", F.pmod(F.xxhash64(F.col("n").cast("string")), F.lit(8))).where("p = 5").first().n

    def killed(row):
        if row["n"] == stop:
            raise SystemExit(3)
        return make(row)

    with pytest.raises(Exception):  # noqa: B017  the job fails
        b.run(rows, "n", killed, fallback, at_once=2)
    assert b.done() == {0, 1, 2, 3}
    seen = b.results().count()
    assert 0 < seen < 60
    assert b.run(rows, "n", make, fallback, at_once=2) == 4
    assert sorted(map(tuple, b.results().collect())) == sorted(map(tuple, whole.results().collect()))


def test_empty_build(spark, tmp_path):
    b = Build(spark, f"{tmp_path}/b", parts=2)
    assert b.run(spark.createDataFrame([], "n long, text string"), "n", make, fallback) == 2
    assert b.results().collect() == [] and b.errors().collect() == []
