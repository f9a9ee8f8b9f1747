"""Which regions of a picture show something, from summed-area tables.

A picture is its grey values row by row, as bytes.  A table of sums and one of sums of squares give the variance of any
box by four lookups each, so overlapping boxes cost no more than others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType

#: A region with a smaller variance is blank.
BLANK = 100.0


def box_variances(pixels: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Population variances of boxes (left, top, right, bottom; cut at the edges) of a matrix; 0 for empty ones."""
    h, w = pixels.shape
    x = pixels.astype(np.int64)
    table = np.zeros((2, h + 1, w + 1), np.int64)
    table[0, 1:, 1:], table[1, 1:, 1:] = x.cumsum(0).cumsum(1), (x * x).cumsum(0).cumsum(1)
    left, top, right, bottom = np.clip(boxes.T, 0, np.array([[w], [h], [w], [h]]))
    sums = table[:, bottom, right] - table[:, top, right] - table[:, bottom, left] + table[:, top, left]
    n = np.maximum(right - left, 0) * np.maximum(bottom - top, 0)
    # whole numbers up to the last division
    return np.where(n > 0, (sums[1] * n - sums[0] * sums[0]) / np.maximum(n, 1) ** 2, 0.0)


@pandas_udf(ArrayType(BooleanType()))
def valid_regions(pixels: pd.Series, width: pd.Series, boxes: pd.Series) -> pd.Series:
    """For the whole picture, and then for each of the boxes array<struct<left, top, right, bottom>>, whether it is not blank.

    Null for a null picture; a last row that is not whole is filled up with zeros.
    """
    out = []
    for p, w, bs in zip(pixels, width, boxes, strict=True):
        if p is None or pd.isna(w):
            out.append(None)
            continue
        w = int(w)
        flat = np.frombuffer(p, np.uint8)
        rows = -(-len(flat) // w)
        picture = np.zeros(rows * w, np.uint8)
        picture[: len(flat)] = flat
        wanted = [(0, 0, w, rows), *[(b["left"], b["top"], b["right"], b["bottom"]) for b in ([] if bs is None else bs)]]
        out.append((box_variances(picture.reshape(rows, w), np.array(wanted, np.int64)) >= BLANK).tolist())
    return pd.Series(out)
