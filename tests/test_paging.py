"""Tables, ellipses, pages, masks and resampling against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestore.functions import vector as V
from lodestore.functions.pixels import box_variances, valid_regions
from lodestore.operators import paging as P


def shrunk(widths, room, least):
    """One off the widest column at a time."""
    w, total = list(widths), sum(widths)
    if total > room:
        w = [max(int(x * (room / total)), least) for x in w]
        while sum(w) > room:
            w[w.index(max(w))] -= 1
    return w


def test_widths_equal_the_loop(spark):
    r = random.Random(1)
    rows = []
    for k in range(400):
        w = [r.choice([r.randrange(0, 40), r.randrange(0, 900), 60]) for _ in range(r.randrange(1, 12))]
        rows.append((k, w, r.choice([50, 300, 600, 601, 1200])))
    df = spark.createDataFrame(rows, "k int, w array<int>, room int")
    got = {x.k: x.f for x in df.select("k", P.fitted_widths(F.col("w"), F.col("room")).alias("f")).collect()}
    assert got == {k: shrunk(w, room, P.CELL_LEAST) for k, w, room in rows}


def test_column_widths(spark):
    df = spark.createDataFrame([([["ab", "c"], ["abcd"], []],)], "c array<array<string>>")
    assert df.select(P.column_widths(F.col("c"), F.lit(20)).alias("w")).first().w == [56, 26]


def dotted(text, room, advances):
    if room <= 0:
        return ""
    if sum(advances) <= room:
        return text
    room -= 2 * 5.0
    if room <= 0:
        return ""
    n = max(k for k in range(len(text) + 1) if sum(advances[:k]) <= room)
    return text[:n] + ".." if n < len(text) else text


def test_ellipsis_equals_the_longest_prefix(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        t = "".join(r.choice("iwé字x") for _ in range(r.randrange(0, 30)))
        rows.append((k, t, r.randrange(-3, 200), [{"i": 2.0, "w": 9.0, "字": 10.0}.get(c, 5.0) for c in t]))
    df = spark.createDataFrame(rows, "k int, t string, room int, a array<double>")
    got = df.select("k", P.ellipsized(F.col("t"), F.col("room"), F.lit(10)).alias("x"), P.ellipsized(F.col("t"), F.col("room"), F.lit(10), F.col("a")).alias("y")).collect()
    for x in got:
        _, t, room, a = rows[x.k]
        assert x.x == dotted(t, room, [5.0] * len(t)) and x.y == dotted(t, room, a)


def placed(blocks, size, pad, gap):
    """The cursor that goes down the pages."""
    page, y, pieces, heights = 0, pad, [], []

    def turn():
        nonlocal page, y
        heights.append(max(y + pad, 2 * pad))
        page, y = page + 1, pad

    for i, b in enumerate(blocks):
        if b["kind"] == "lines":
            for _ in range(b["n"]):
                if size - pad - y < b["h"]:
                    turn()
                if pieces and pieces[-1][0] == i and pieces[-1][1] == page:
                    pieces[-1][5] += b["h"]
                    pieces[-1][6] += 1
                else:
                    pieces.append([i, page, pad, y, b["w"], b["h"], 1])
                y += b["h"]
        else:
            if size - pad - y < b["h"] + b["caption"]:
                turn()
            pieces.append([i, page, pad + (size - 2 * pad - b["w"]) // 2, y, b["w"], b["h"], 0])
            y += b["h"] + b["caption"]
        y += 0 if b["kind"] == "separator" else gap
    heights.append(max(y + pad, 2 * pad))
    return [tuple(p) for p in pieces], heights


def test_places_equal_the_loop(spark):
    r = random.Random(3)
    kind = "array<struct<kind:string,n:int,h:int,w:int,caption:int>>"
    rows = []
    for k in range(300):
        blocks = []
        for _ in range(r.randrange(0, 9)):
            blocks.append(r.choice([("lines", r.randrange(0, 60), r.choice([12, 25, 180, 400]), 160, 0), ("image", 1, r.randrange(1, 150), r.randrange(1, 160), r.choice([0, 29])), ("separator", 1, r.choice([20, 40]), 160, 0)]))
        rows.append((k, blocks))
    df = spark.createDataFrame(rows, f"k int, b {kind}").select("k", P.paged(F.col("b"), 200, 20, 15).alias("p")).select("k", "p.pieces", "p.heights", P.preserved(F.col("p.pieces"), 2).alias("share"))
    for x in df.collect():
        names = ("kind", "n", "h", "w", "caption")
        pieces, heights = placed([dict(zip(names, b)) for b in rows[x.k][1]], 200, 20, 15)
        assert [tuple(p) for p in x.pieces] == pieces and x.heights == heights
        weight = [(max(p[6], 1), p[1]) for p in pieces]
        assert x.share == (100.0 * sum(w for w, p in weight if p < 2) / sum(w for w, _ in weight) if weight else 100.0)


def test_blocks(spark):
    row = spark.range(1).select(
        P.text_block(F.lit("a" * 50 + "\n \n\tb"), F.lit(20), 200, 20).alias("t"),
        P.image_block(F.lit(400), F.lit(100), F.lit(True), 16, 200, 20).alias("i"),
        P.separator_block("dots", 200, 20).alias("s"),
        P.table_block(F.lit(3), F.array(F.lit(40), F.lit(50)), 14).alias("r"),
    ).first()
    assert tuple(row.t) == ("lines", 4 + 1 + 1, 30, 160, 0)
    assert tuple(row.i) == ("image", 1, 40, 160, 24 + 5)
    assert tuple(row.s) == ("separator", 1, 40, 160, 0) and tuple(row.r) == ("lines", 3, 21 + 16, 90, 0)


def test_masks_from_pixels(spark):
    r = np.random.default_rng(4)
    picture = np.full((20, 30), 128, np.uint8)
    picture[3:9, 5:14] = r.integers(0, 256, (6, 9))
    boxes = [(x, y, x + 10, y + 8) for y in range(-2, 20, 3) for x in range(-3, 30, 4)]
    cut = [picture[max(t, 0) : b, max(l, 0) : q] for l, t, q, b in boxes]
    want = [float(c.var()) if c.size else 0.0 for c in cut]
    assert np.allclose(box_variances(picture, np.array(boxes)), want)
    rows = [(picture.tobytes(), 30, [dict(zip(("left", "top", "right", "bottom"), b)) for b in boxes]), (None, 30, None), (b"", 4, None), (b"\x00\xff\x00", 2, [])]
    df = spark.createDataFrame(rows, "p binary, w int, b array<struct<left:int,top:int,right:int,bottom:int>>")
    got = [x.m for x in df.select(valid_regions("p", "w", "b").alias("m")).collect()]
    # one flag for the whole picture and one for each patch, not one for each token
    assert got[0] == [bool(picture.var() >= 100), *[v >= 100 for v in want]] and len(got[0]) == 1 + len(boxes)
    assert got[1:] == [None, [False], [True]]


def resampled(t, n, mode):
    out = []
    for i in range(n):
        low, high = i * len(t) / n, (i + 1) * len(t) / n
        touched = [k for k in range(len(t)) if k < high and k + 1 > low]
        if mode == "first":
            out.append(t[int(low)])
        elif mode == "max":
            out.append(np.max([t[k] for k in touched], axis=0))
        else:
            out.append(sum(t[k] * (min(k + 1, high) - max(k, low)) for k in touched) / (high - low))
    return np.array(out)


def test_resampling(spark):
    r = np.random.default_rng(5)
    rows = [(k, r.normal(size=(m, 3)).tolist(), [bool(x) for x in r.integers(0, 2, m)]) for k, m in enumerate([1, 2, 3, 5, 7, 12, 16] * 3)]
    df = spark.createDataFrame(rows, "k int, t array<array<double>>, m array<boolean>")
    for n in (1, 3, 5):
        for mode in ("mean", "max", "first"):
            for x in df.select("k", V.resample(F.col("t"), n, mode).alias("a"), V.resample(F.col("t"), n, mode, F.col("m")).alias("b")).collect():
                t, mask = np.array(rows[x.k][1]), np.array(rows[x.k][2])
                assert np.allclose(x.a, resampled(t, n, mode))
                assert (x.b is None) if not mask.any() else np.allclose(x.b, resampled(t[mask], n, mode))
