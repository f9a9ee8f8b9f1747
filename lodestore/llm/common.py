"""Pieces that several of the operators share: blocks of documents, hashing of windows, and minimizers.

Documents are dealt to *blocks* by a hash.  A block is the unit that a Python task sees: what it
has to tell other blocks is first made distinct inside the block, so a string that a third of all rows hold
reaches any one task at most once per block.  Blocks follow spark.sql.shuffle.partitions, so they keep their
size when the cluster is set up for more data.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS_PER_PARTITION = 2
#: Bytes that one numpy pass looks at; bounds the temporaries of a task.
CHUNK = 1 << 20
LAST = np.iinfo(np.int64).max

U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and a stage must not pay for the one before."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    """Half as many as partitions: blocks times buckets is the number of messages."""
    return max(1, partitions(spark) // 2)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def block_of(spark: SparkSession) -> Column:
    """By doc_id and text, so that neither null nor repeated ids make one block larger."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(BLOCKS_PER_PARTITION * partitions(spark))).cast("int")


def in_blocks(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """block, doc_id, text and kept columns as _0, _1, ...: what block operators read, so extra columns cannot clash."""
    return docs.select(block_of(docs.sparkSession).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])


class Texts:
    """The documents of a block, in ascending doc_id order or as they come, as one UTF-8 buffer."""

    def __init__(self, table: pa.Table, ordered: bool = True):
        give_back()
        table = table.drop_columns(["block"]) if "block" in table.column_names else table
        table = table.combine_chunks()
        if ordered:
            order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
            table = table.take(order).combine_chunks()
        self.doc_id = table.column("doc_id")
        #: The other columns, in the same order.
        self.kept = [table.column(c) for c in table.column_names if c not in ("doc_id", "text")]
        #: A null doc_id counts as larger than any other.
        self.key = pc.fill_null(self.doc_id, int(LAST)).to_numpy()
        text = pc.fill_null(table.column("text"), "")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
        self.n = table.num_rows
        if self.n == 0:
            self.bounds, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        text = text.cast(pa.large_string())
        _, offsets, data = text.buffers()
        bounds = np.frombuffer(offsets, np.int64, self.n + 1, text.offset * 8)
        self.bytes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]

    def chunks(self):
        """(first, last) document numbers of runs of about CHUNK bytes; a longer document is a run by itself."""
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.bounds, self.bounds[i] + CHUNK, "right")) - 1)
            yield i, j
            i = j


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with as many underscores before them as keep them apart from those taken, whatever the case."""
    known = {c.lower() for c in taken}
    mark = "_"
    while any((mark + w).lower() in known for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    return x


BASE = 0x9FB21C651E98DF25
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The hash of a window from those of two windows that cover it."""
    return mix(a * U(0x9E3779B97F4A7C15) + b + U(salt))


def doubled(h: np.ndarray, length: int, target: int) -> np.ndarray:
    """From hashes of windows of one length those of a longer one, by doubling; the last step overlaps."""
    while length < target:
        step = min(length, target - length)
        n = len(h) - step
        if n <= 0:
            return h[:0]
        h = joined(h[:n], h[step:], length + step)
        length += step
    return h


def minimizer(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w consecutive hashes the position of the smallest; the rightmost of equals."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    low = U((1 << 28) - 1)
    m = (h & ~low) | (low - (np.arange(n, dtype=U) & low))
    have = 1
    while have < w:
        step = min(have, w - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    at = (low - (m & low)).astype(np.int64)
    if n <= 1 << 28:
        return at
    start = np.arange(n - w + 1, dtype=np.int64)
    return start + (at - start) % (1 << 28)


def among(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_set, x)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == x


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(33)) % U(n)).astype(np.int64)
