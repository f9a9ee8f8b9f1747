"""A layout scorer trained on all data: a small network whose gradients are summed where the rows lie.

Each step sends the weights out with the tasks, which add up losses and gradients of their rows, group by group; the
sums meet in a tree, a group of partitions at a time, and one row per group reaches the driver.  Sums are in double, so
how rows are dealt changes the weights by rounding only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from lodestore.session import shared_folder, small_batches

# Layers of the network, weights of the two losses and the margin of the second.
LAYERS = (783, 256, 64, 1)
TEXT_DIMS = 768
MSE_WEIGHT, RANKING_WEIGHT, MARGIN = 0.5, 0.5, 0.05
#: Groups, and rows of scores, that the network sees at once: what a task holds does not follow its input.
STEP = 256


@pandas_udf(ArrayType(DoubleType()))
def _counts(slots: pd.Series, dims: pd.Series) -> pd.Series:
    out = []
    for s, d in zip(slots, dims, strict=True):
        c = np.bincount(np.asarray(s, np.int64), minlength=int(d)).astype(np.float64)
        out.append(c / (np.sqrt(c @ c) or 1.0))
    return pd.Series(out)


def hashed_text(text: Column, dims: int = TEXT_DIMS) -> Column:
    """Words hashed into `dims` counts, of unit length; zeros for a null or empty text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return _counts(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int")), F.lit(dims))


def initial(layers: tuple[int, ...] = LAYERS, seed: int = 1) -> np.ndarray:
    """Weights and biases of all layers, one behind another."""
    r = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([r.normal(0, math.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in zip(layers, layers[1:], strict=False)])


def _unpacked(flat: np.ndarray, layers: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(flat: np.ndarray, x: np.ndarray, layers: tuple[int, ...] = LAYERS) -> list[np.ndarray]:
    """The inputs of each layer, and at the end the scores from 0 to 1."""
    seen = [x]
    parts = _unpacked(flat, layers)
    for k, (w, b) in enumerate(parts):
        z = seen[-1] @ w + b
        seen.append(1 / (1 + np.exp(-z)) if k == len(parts) - 1 else np.maximum(z, 0))
    return seen


def loss_and_gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray, layers: tuple[int, ...] = LAYERS, bounds: np.ndarray | None = None) -> tuple[float, float, int, np.ndarray, np.ndarray]:
    """Squared errors, margin losses and their number of pairs, and the gradients of both sums, over groups bounds[k] : bounds[k + 1] of rows (by default one)."""
    seen = forward(flat, x, layers)
    p = seen[-1][:, 0]
    hinge, pairs, margin = 0.0, 0, np.zeros(len(y))
    for i, j in [(0, len(y))] if bounds is None else zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        better = np.sign(y[i:j, None] - y[None, i:j])
        unequal = np.triu(better != 0, 1)
        lost = np.where(unequal, np.maximum(0.0, MARGIN - better * (p[i:j, None] - p[None, i:j])), 0.0)
        g = np.where(lost > 0, -better, 0.0)
        hinge, pairs = hinge + float(lost.sum()), pairs + int(unequal.sum())
        margin[i:j] = g.sum(axis=1) - g.sum(axis=0)
    grads = []
    for slope in (2 * (p - y), margin):
        d, parts = (slope * p * (1 - p))[:, None], []
        for k, (w, _) in reversed(list(enumerate(_unpacked(flat, layers)))):
            parts.append(np.concatenate([(seen[k].T @ d).ravel(), d.sum(axis=0)]))
            if k:
                d = (d @ w.T) * (seen[k] > 0)
        grads.append(np.concatenate(parts[::-1]))
    return float(((p - y) ** 2).sum()), hinge, pairs, grads[0], grads[1]


SUMS = "part int, squares double, hinge double, rows long, pairs long, g binary"
SUMS_PA = pa.schema([("part", pa.int32()), ("squares", pa.float64()), ("hinge", pa.float64()), ("rows", pa.int64()), ("pairs", pa.int64()), ("g", pa.binary())])


def _sums(data: DataFrame, flat: np.ndarray, layers: tuple[int, ...]) -> tuple[float, float, int, int, np.ndarray]:
    """Losses, counts and gradients (a row for each loss) over all groups of data(x, y)."""

    def row(part: int, s: list) -> pa.RecordBatch:
        return pa.record_batch([[part], [s[0]], [s[1]], [s[2]], [s[3]], [s[4].tobytes()]], schema=SUMS_PA)

    def of_partition(batches):
        total = [0.0, 0.0, 0, 0, np.zeros((2, len(flat)))]
        for b in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            y = b.column("y").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = b.column("x").flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(y), -1)
            sizes = pc.list_value_length(b.column("y")).to_numpy()
            # the rows of a slice at once; pairs are made inside groups
            a, h, n, g1, g2 = loss_and_gradient(flat, x, y, layers, np.concatenate(([0], np.cumsum(sizes))))
            total[0] += a
            total[1] += h
            total[2] += len(y)
            total[3] += n
            total[4][0] += g1
            total[4][1] += g2
        yield row(0, total)

    def added(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        g = np.zeros((2, len(flat)))
        for r in rows:
            g += np.frombuffer(r["g"], np.float64).reshape(2, -1)
        return pa.Table.from_batches([row(0, [math.fsum(r["squares"] for r in rows), math.fsum(r["hinge"] for r in rows), sum(r["rows"] for r in rows), sum(r["pairs"] for r in rows), g])])

    n = max(1, math.isqrt(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = data.mapInArrow(of_partition, SUMS).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(n)))
    rows = found.groupBy("part").applyInArrow(added, SUMS).collect()  # as many as the root of the partitions
    g = np.sum([np.frombuffer(r.g, np.float64).reshape(2, -1) for r in rows], axis=0) if rows else np.zeros((2, len(flat)))
    return math.fsum(r.squares for r in rows), math.fsum(r.hinge for r in rows), sum(r["rows"] for r in rows), sum(r.pairs for r in rows), g


@dataclass
class Scorer:
    layers: tuple[int, ...] = LAYERS
    seed: int = 1
    weights: np.ndarray = field(default=None)
    losses: list[float] = field(default_factory=list)

    def fit(self, groups: DataFrame, steps: int = 20, rate: float = 1e-3) -> Scorer:
        """Train on groups(x array<array<double>>, y array<double>), a row for each group of layouts that compete.

        The loss is half the mean squared error and half the mean margin loss over the pairs of a group with unequal
        labels.  Steps are by Adam over all rows; losses has the loss before each step and at the end.
        """
        with small_batches(groups.sparkSession, STEP):
            return self._fit(groups, steps, rate)

    def _fit(self, groups: DataFrame, steps: int, rate: float) -> Scorer:
        shared_folder(groups.sparkSession)
        data = groups.select("x", "y").where(F.size("y") > 0).checkpoint()
        self.weights = initial(self.layers, self.seed)
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        self.losses = []
        for t in range(1, steps + 2):
            squares, hinge, rows, pairs, g = _sums(data, self.weights, self.layers)
            self.losses.append(MSE_WEIGHT * squares / max(rows, 1) + RANKING_WEIGHT * hinge / max(pairs, 1))
            if t > steps or not rows:
                break
            slope = MSE_WEIGHT * g[0] / rows + RANKING_WEIGHT * g[1] / max(pairs, 1)
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            self.weights = self.weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    def scores(self, rows: DataFrame, x: str = "x") -> DataFrame:
        """rows with `score`; x is an array<double> of the inputs."""
        flat, layers = self.weights, self.layers

        def f(batches):
            for whole in batches:
                for i in range(0, whole.num_rows, STEP):
                    b = whole.slice(i, STEP)
                    m = b.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    yield pa.record_batch([*b.columns, pa.array(forward(flat, m, layers)[-1][:, 0])], names=[*b.schema.names, "score"])

        return rows.mapInArrow(f, rows.withColumn("score", F.lit(0.0)).schema)
