"""Document fingerprints by winnowing.

Hashes of all GRAM-character grams; of every WINDOW consecutive ones the smallest is kept, the rightmost of
equals, with its position.  Two texts that share GRAM + WINDOW - 1 = 23 characters share a kept hash, so the
window is small for every text: short ones keep several hashes too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import BLOCKS_PER_PARTITION, LAST, U, doubled, minimizer, mix, partitions, read_documents

GRAM = 16
WINDOW = 8
#: Characters that are hashed at a time, and characters of the texts that are compared at a time.
SEGMENT = 1 << 17
PART = 1 << 20


def _hashes(points: np.ndarray, gram: int) -> np.ndarray:
    return doubled(mix(points.astype(U) + U(0x7F4A7C15)), 1, gram)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept 32-bit hashes and their positions; one hash of the whole text if it is shorter than a gram."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    points = _points([text])
    if len(points) < gram + window - 1:
        h = _hashes(points, min(gram, len(points)))
        at = _distinct(minimizer(h, min(window, len(h))))
        return (h[at] >> U(32)).astype(np.uint32), at
    found = []
    # a long text in slices that overlap, so that each window is in one
    for s in range(0, len(points) - gram - window + 2, SEGMENT):
        h = _hashes(points[s : s + SEGMENT + gram + window - 2], gram)
        at = _distinct(minimizer(h, window))
        found.append(((h[at] >> U(32)).astype(np.uint32), at + s))
    h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.concatenate(([True], at[1:] != at[:-1]))
    return h[new], at[new]


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _distinct(sorted_array: np.ndarray) -> np.ndarray:
    return sorted_array[np.concatenate(([True], sorted_array[1:] != sorted_array[:-1]))] if len(sorted_array) else sorted_array


def winnow_all(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept hashes and positions of all texts behind one another, and where each text's end, from a leading 0 on."""
    size = np.array([len(t) for t in texts], np.int64)
    usual = (size >= gram + window - 1) & (size <= SEGMENT)
    found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in np.flatnonzero(~usual & (size > 0)).tolist():
        h, at = winnow(texts[k], gram, window)
        found.append((h, at, np.full(len(h), k)))
    which = np.flatnonzero(usual)
    upto = np.cumsum(size[which])
    i = 0
    while i < len(which):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SEGMENT, "right")))
        some = which[i:j]
        ends = np.cumsum(size[some])
        h = _hashes(_points([texts[k] for k in some.tolist()]), gram)
        at = minimizer(h, window)
        edge = np.zeros(len(at) + 1, np.int8)
        edge[ends - size[some]] = 1
        edge[ends - gram - window + 2] -= 1
        at = _distinct(at[np.cumsum(edge[:-1], dtype=np.int8).view(bool)])
        of = np.searchsorted(ends, at, "right")
        found.append(((h[at] >> U(32)).astype(np.uint32), at - (ends - size[some])[of], some[of]))
        i = j
    h, at, of = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return h[order], at[order], np.searchsorted(of[order], np.arange(len(texts) + 1))


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def spelled(h: np.ndarray, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string for each text: hash@position, comma-joined."""
    n, wide = len(h), len(str(int(at.max()))) if len(at) else 1
    cells = np.empty((n, wide + 10), np.uint8)
    raw = h.astype(">u4").view(np.uint8).reshape(n, 4)
    cells[:, 0:8:2], cells[:, 1:8:2], cells[:, 8], cells[:, -1] = _HEX[raw >> 4], _HEX[raw & 15], ord("@"), ord(",")
    use = np.ones(cells.shape, bool)
    for k in range(wide):
        power = 10 ** (wide - 1 - k)
        cells[:, 9 + k] = at // power % 10 + ord("0")
        use[:, 9 + k] = at >= power if power > 1 else True
    use[ends[1:][ends[1:] > ends[:-1]] - 1, -1] = False
    upto = np.concatenate(([0], np.cumsum(use.sum(axis=1))))[ends]
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(cells[use].tobytes())).cast(pa.string())


def encoded(h: np.ndarray, at: np.ndarray) -> str:
    return spelled(h, at, np.array([0, len(h)]))[0].as_py()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the distinct hashes; two empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def likenesses(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Likeness of n pairs: a and b hold the number of the pair above 32 bits of hash, each entry once."""
    both = np.bincount((np.intersect1d(a, b, assume_unique=True) >> U(32)).astype(np.int64), minlength=n)
    every = np.bincount((a >> U(32)).astype(np.int64), minlength=n) + np.bincount((b >> U(32)).astype(np.int64), minlength=n) - both
    return np.where(every > 0, both / np.maximum(every, 1), 1.0)


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n] if n else text


def _bucket(key, bounds: list[int]):
    """Number of bounds that are not above the key, looked for in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    every = F.array(*[F.lit(x).cast("long") for x in bounds])
    coarse = F.array(*[F.lit(x).cast("long") for x in bounds[::step]])
    full = F.greatest(F.size(F.filter(coarse, lambda x: x <= key)) - 1, F.lit(0)) * step
    return (full + F.size(F.filter(F.slice(every, full + 1, step), lambda x: x <= key))).cast("int")


def in_order(docs: DataFrame) -> DataFrame:
    """bucket, look, key, doc_id, text: ranges of doc_id, each with the first row of the one after it (look)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = BLOCKS_PER_PARTITION * partitions(spark)
    cuts = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(cuts))
    rows = rows.withColumn("bucket", _bucket(F.col("key"), bounds))
    starts = sorted((r["bucket"], r["key"]) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect())  # a row for each range
    ahead = spark.createDataFrame([(starts[(k + 1) % len(starts)][1], b) for k, (b, _) in enumerate(starts)], "key long, before int")
    first = rows.join(F.broadcast(ahead), "key").select(F.col("before").alias("bucket"), F.lit(True).alias("look"), "key", "doc_id", "text")
    return rows.select("bucket", F.lit(False).alias("look"), "key", "doc_id", "text").unionByName(first)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SCHEMA_PA = pa.schema(list(zip(COLUMNS, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)))


def _part(ids: pa.ChunkedArray, texts: list[str], gram: int, window: int) -> pa.Table:
    """Rows for all texts but the last, which only follows."""
    m = len(texts) - 1
    new = [edited(t, after) for t, after in zip(texts, texts[1:], strict=False)]
    h, at, ends = winnow_all(texts + new, gram, window)
    cut = ends[m + 1]
    sets = _distinct(np.sort(np.repeat(np.arange(2 * m + 1), np.diff(ends)).astype(U) << U(32) | h))
    low = np.searchsorted(sets, np.array([0, m, 1, m + 1, m + 1, 2 * m + 1]).astype(U) << U(32))
    own, after, edits = (sets[x:y] for x, y in low.reshape(3, 2))
    cols = [
        ids,
        pa.array([len(t) for t in texts[:m]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
        spelled(h[: ends[m]], at[: ends[m]], ends[: m + 1]),
        spelled(h[cut:], at[cut:], ends[m + 1 :] - cut),
        pa.array(likenesses(own, edits - (U(m + 1) << U(32)), m)),
        pa.array(likenesses(own, after - (U(1) << U(32)), m)),
    ]
    return pa.table([c.cast(t) for c, t in zip(cols, SCHEMA_PA.types, strict=True)], schema=SCHEMA_PA)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprint of every text of docs(doc_id, text), of its edited text, and how alike they and the next are.

    Edited: the last quarter of the characters gives way to as many first ones of the next text in ascending
    doc_id order (null last, rows of equal doc_id by text); the first text comes after the last.  Null texts are
    empty; an empty text has an empty fingerprint.  Other columns are ignored.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)

    def f(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("look", "ascending"), ("key", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]))
        look = table.column("look").to_pylist()
        n = look.index(True) if True in look else len(look)
        texts = [t or "" for t in table.column("text").slice(0, n + 1).to_pylist()]
        if not n:
            return SCHEMA_PA.empty_table()
        # the row after the last one; none follows if the range is the whole table and its first row came along as look
        texts += texts[-1:] if len(texts) == n else []
        parts = []
        upto = np.cumsum([len(t) for t in texts])
        i = 0
        while i < n:
            # about as many characters at a time, and the text after them
            j = min(n, max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PART, "right"))))
            parts.append(_part(table.column("doc_id").slice(i, j - i), texts[i : j + 1], gram, window))
            i = j
        return pa.concat_tables(parts)

    return in_order(docs).groupBy("bucket").applyInArrow(f, SCHEMA)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_documents(spark, sf_dir))


QUERIES = {"op6_winnowing": op6_winnowing}
