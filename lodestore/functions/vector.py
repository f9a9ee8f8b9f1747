"""Vector expressions over ARRAY<FLOAT> columns; sums are in double, left to right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once although use may name it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    scaled = lambda v, n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return let(a, lambda v: let(norm(v), lambda n: scaled(v, n)))


def hybrid_key(image: Column, text: Column, alpha: float) -> Column:
    """alpha * image + (1 - alpha) * text, normalised; vectors of unequal size are an error."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    same = F.when(F.size(image) == F.size(text), image).otherwise(F.raise_error(F.lit("embeddings differ in size")).cast("array<float>"))
    return normalize(F.zip_with(same, text, lambda x, y: F.lit(alpha) * x.cast("double") + F.lit(1 - alpha) * y.cast("double")))


def similarity(q: Column, v: Column, metric: str = "cosine") -> Column:
    """cosine and ip: the dot product (of vectors normalised before, for cosine); l2: minus the distance."""
    if metric in ("cosine", "ip"):
        return dot(q, v)
    if metric == "l2":
        d = F.zip_with(q, v, lambda x, y: x.cast("double") - y.cast("double"))
        return -F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    raise ValueError(f"unknown metric {metric}")


def mean_vector(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def mean_pool(tokens: Column) -> Column:
    """Element-wise mean of a matrix given as an array of rows."""
    first = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(tokens, first, lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(tokens))


def ranking_loss(rows: Column, margin: float) -> Column:
    """Mean hinge loss over the pairs of a batch of structs (y, p) with unequal y; null without such a pair."""
    pairs = F.flatten(F.transform(rows, lambda a, i: F.transform(F.filter(F.slice(rows, i + 2, F.size(rows)), lambda b: b["y"] != a["y"]), lambda b: F.greatest(F.lit(0.0), F.lit(margin) - F.signum(a["y"] - b["y"]) * (a["p"] - b["p"])))))
    return let(pairs, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)))


def concat_tokens(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def concat_masks(a: Column, b: Column) -> Column:
    """Both masks behind one another; null unless both are present."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, b))


def valid_tokens(tokens: Column, mask: Column) -> Column:
    """Tokens whose mask is true; all of them without a mask."""
    return F.when(mask.isNull(), tokens).otherwise(F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"]), lambda z: z["t"]))


def age_days(then: Column, now: Column) -> Column:
    """Whole days of elapsed time, not calendar days."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400_000_000))


def time_decay(score: Column, then: Column, now: Column, rate: float) -> Column:
    return score * F.exp(-F.lit(rate) * age_days(then, now))


def is_blank(pixels: Column, least: float = 100.0) -> Column:
    """Whether the population variance of pixel values is below `least`."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    return let(mean, lambda m: F.aggregate(pixels, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(pixels) < least)


def resample(tokens: Column, n: int, mode: str = "mean", mask: Column | None = None) -> Column:
    """A matrix of tokens (an array of rows) brought to n rows; masked tokens do not count, null without a valid one.

    Row i stands for the tokens from i * T / n to (i + 1) * T / n of T.  A token that an edge cuts counts by its share
    in "mean" and wholly in "max"; "first" takes the token in which the row begins.
    """
    if mode not in ("mean", "max", "first"):
        raise ValueError(f"unknown mode {mode}")

    def rows(t: Column) -> Column:
        size = F.size(t)

        def row(i: Column) -> Column:
            low, high = i * size / n, (i + 1) * size / n
            begin = F.floor(low).cast("int")
            if mode == "first":
                return F.transform(F.get(t, begin), lambda x: x.cast("double"))
            inside = F.slice(t, begin + 1, F.ceil(high).cast("int") - begin)
            if mode == "max":
                return F.aggregate(inside, F.transform(F.get(t, begin), lambda x: x.cast("double")), lambda s, r: F.zip_with(s, r, lambda x, y: F.greatest(x, y.cast("double"))))
            # each token times its share of the row
            share = F.transform(inside, lambda r, k: F.transform(r, lambda x: x.cast("double") * (F.least(begin + k + 1, high) - F.greatest((begin + k).cast("double"), low))))
            zero = F.transform(F.get(t, begin), lambda x: F.lit(0.0))
            return F.transform(F.aggregate(share, zero, lambda s, r: F.zip_with(s, r, lambda x, y: x + y)), lambda x: x / (high - low))

        return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row))

    return let(valid_tokens(tokens, F.lit(None).cast("array<boolean>") if mask is None else mask), rows)
