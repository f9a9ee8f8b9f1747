"""Large rows go to Python a few at a time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestore.operators.encodings import ROWS
from lodestore.operators.scorer import STEP, Scorer, forward, initial
from lodestore.session import small_batches

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def largest(spark):
    def f(batches):
        for b in batches:
            yield pa.record_batch([[b.num_rows]], names=["n"])

    return spark.range(0, 3000, 1, 1).mapInArrow(f, "n long").agg(F.max("n")).first()[0]


def test_batches_are_small_inside_and_as_before_after(spark):
    before = spark.conf.get(NAME)
    with small_batches(spark, ROWS):
        assert largest(spark) == ROWS
        with small_batches(spark, 10 * ROWS):
            assert largest(spark) == ROWS
    assert spark.conf.get(NAME) == before and largest(spark) == 3000


def test_scores_in_slices(spark):
    layers = (3, 4, 1)
    x = np.random.default_rng(1).normal(size=(2 * STEP + 5, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").coalesce(1)
    s = Scorer(layers, weights=initial(layers))
    got = {r.id: r.score for r in s.scores(rows).collect()}
    want = forward(s.weights, x, layers)[-1][:, 0]
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], want)
    assert s.scores(rows.where("id < 0")).collect() == []
