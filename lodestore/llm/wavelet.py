"""Token ids in a wavelet matrix per shard.

A shard holds the ids of the documents of one range of doc_id, in ascending order, as one compressed file:
bit-planes from the highest bit down, each with directories for rank and select, and where documents begin.
Below a plane the ids are ordered stably by its bit, so that rank maps a place from plane to plane, and select
maps it back; access, counting and the places of an id take one step for each plane.

File: magic, length of the header, header (JSON: counts, zeros of each plane, ends of the sections), sections
compressed by zstd: doc_ids, lengths, then for each plane its directories and its bits in blocks of BLOCK bytes.
A block is inflated by itself, when a place in it is asked for.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestore.llm.common import read_documents
from lodestore.llm.ranges import in_ranges
from lodestore.llm.tokens import WORD_BPE, encoder
from lodestore.session import run_folder

MAGIC = b"WVM2"
END_ID = 1
#: Bits of a plane for each entry of its rank directory.
STRIDE = 512
#: Ones, or zeros, for each entry of a select directory.
SAMPLE = 4096
#: Bytes of a plane that are compressed together.
BLOCK = 8192
LEVEL = 1
#: Places that are looked up at a time.
AT_ONCE = 4096


class Plane:
    """The bits of a plane in blocks, each inflated when it is first needed."""

    def __init__(self, size: int, inflate):
        self.size, self._inflate, self._blocks = size, inflate, {}

    def _block(self, k: int) -> np.ndarray:
        if k not in self._blocks:
            self._blocks[k] = np.frombuffer(self._inflate(k), np.uint8)
        return self._blocks[k]

    def strides(self, which: np.ndarray) -> np.ndarray:
        """The bytes of some strides, as rows; zeros beyond the end."""
        step = STRIDE // 8
        out = np.zeros((len(which), step), np.uint8)
        of = which * step // BLOCK
        for k in np.flatnonzero(np.bincount(of)).tolist():
            mine = np.flatnonzero(of == k)
            block = self._block(k)
            padded = np.zeros(-(-len(block) // step) * step, np.uint8)
            padded[: len(block)] = block
            out[mine] = padded.reshape(-1, step)[which[mine] - k * (BLOCK // step)]
        return out

    def whole(self) -> np.ndarray:
        return np.concatenate([self._block(k) for k in range(-(-self.size // BLOCK))] or [np.zeros(0, np.uint8)])


class Directory:
    """ranks[i]: ones before stride i; ones, zeros: in which stride every SAMPLE-th one or zero lies."""

    def __init__(self, ranks: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.ranks, self.ones, self.zeros = ranks, ones, zeros

    @classmethod
    def of(cls, packed: np.ndarray) -> Directory:
        step = STRIDE // 8
        whole = np.zeros(-(-len(packed) // step) * step, np.uint8)
        whole[: len(packed)] = packed
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(whole).reshape(-1, step).sum(axis=1, dtype=np.int64))))
        empty = np.arange(len(ranks)) * STRIDE - ranks
        samples = [np.searchsorted(n, np.arange(0, n[-1], SAMPLE), "right") - 1 for n in (ranks, empty)]
        return cls(ranks.astype("<u4"), *[x.astype("<u4") for x in samples])

    def stride_of(self, bit: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In which strides some ones (zeros) lie, and how many of their kind are before those strides."""
        samples = self.ones if bit else self.zeros
        low = samples[which // SAMPLE].astype(np.int64)
        high = np.append(samples[1:], len(self.ranks) - 2)[which // SAMPLE].astype(np.int64)
        before = lambda i: self.ranks[i].astype(np.int64) if bit else i * STRIDE - self.ranks[i].astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            reached = before(middle) <= which
            low, high = np.where(reached, middle, low), np.where(reached, high, middle - 1)
        return low, before(low)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane], zeros: list[int], directories: list[Directory]):
        """planes: highest bit first; zeros: how many of each plane's bits are 0."""
        self.n, self.planes, self.zeros, self.directories = n, planes, zeros, directories

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        levels = max(1, top.bit_length())
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, directories = [], [], []
        for k in range(levels - 1, -1, -1):
            bit = (a >> a.dtype.type(k) & a.dtype.type(1)).astype(bool)
            packed = np.packbits(bit)
            planes.append(Plane(len(packed), lambda k, packed=packed: packed[k * BLOCK : (k + 1) * BLOCK]))
            directories.append(Directory.of(packed))
            low = np.compress(~bit, a)
            zeros.append(len(low))
            a = np.concatenate((low, np.compress(bit, a)))
        return cls(len(ids), planes, zeros, directories)

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each place."""
        out = np.zeros(len(at), np.int64)
        for i in range(0, len(at), AT_ONCE):
            x = at[i : i + AT_ONCE]
            inside = x % STRIDE
            n = self.directories[k].ranks[x // STRIDE].astype(np.int64)
            # at the beginning of a stride the directory says all
            some = np.flatnonzero(inside)
            left = np.clip(inside[some, None] - 8 * np.arange(STRIDE // 8), 0, 8)
            n[some] += np.bitwise_count(self.planes[k].strides(x[some] // STRIDE) & (0xFF00 >> left).astype(np.uint8)).sum(axis=1, dtype=np.int64)
            out[i : i + AT_ONCE] = n
        return out

    def _select(self, k: int, bit: int, which: np.ndarray) -> np.ndarray:
        """Places of some of the ones, or zeros, of plane k, numbered from 0."""
        out = np.zeros(len(which), np.int64)
        for i in range(0, len(which), AT_ONCE):
            x = which[i : i + AT_ONCE]
            stride, before = self.directories[k].stride_of(bit, x)
            bits = np.unpackbits(self.planes[k].strides(stride), axis=1) == bit
            out[i : i + AT_ONCE] = stride * STRIDE + (np.cumsum(bits, axis=1, dtype=np.int16) == (x - before + 1)[:, None]).argmax(axis=1)
        return out

    def access(self, places) -> np.ndarray:
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint32)
        for k in range(len(self.planes)):
            rows = np.concatenate([self.planes[k].strides(at[i : i + AT_ONCE] // STRIDE)[np.arange(len(at[i : i + AT_ONCE])), at[i : i + AT_ONCE] % STRIDE // 8] for i in range(0, len(at), AT_ONCE)] or [np.zeros(0, np.uint8)])
            bit = rows >> (7 - at % 8).astype(np.uint8) & 1
            ones = self._ones(k, at)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
            out = out << np.uint32(1) | bit
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if self.n == 0 or token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            ones = self._ones(k, np.array([start, end]))
            if token >> (len(self.planes) - 1 - k) & 1:
                start, end = (int(x) + self.zeros[k] for x in ones)
            else:
                start, end = start - int(ones[0]), end - int(ones[1])
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in places start to end."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def rank(self, token: int, place: int) -> int:
        return self.count(token, 0, place)

    def _back(self, token: int, at: np.ndarray) -> np.ndarray:
        """From places below the last plane up to places of the ids."""
        for k in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Places of an id, ascending: back up through the planes by select."""
        return self._back(token, np.arange(*self._range(token, start, self.n if end is None else end)))

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0; IndexError if there are fewer."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        return int(self._back(token, np.array([a + k]))[0])

    def decode(self) -> np.ndarray:
        """All ids: the values below a plane are merged by its bits, from the lowest plane up."""
        levels = len(self.planes)
        kind = np.uint16 if levels <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for k in range(levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[k].whole(), count=self.n).view(bool)
            one, zero = np.flatnonzero(bit), np.flatnonzero(~bit)
            up = np.empty_like(a)
            up[zero] = a[: len(zero)]
            up[one] = a[len(zero) :] | kind(1 << (levels - 1 - k))
            a = up
        return a.astype(np.uint32)


def pack_shard(keys: np.ndarray, nulls: int, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    w = WaveletMatrix.build(ids)
    parts = [np.diff(keys.astype(np.int64), prepend=0).tobytes(), lengths.astype("<u4").tobytes()]
    for p, d in zip(w.planes, w.directories, strict=True):
        bits = p.whole().tobytes()
        parts += [d.ranks.tobytes(), d.ones.tobytes(), d.zeros.tobytes(), *[bits[i : i + BLOCK] for i in range(0, len(bits), BLOCK)]]
    zip_ = zstandard.ZstdCompressor(level=LEVEL).compress
    parts = [zip_(p) for p in parts]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    header = json.dumps({"docs": len(keys), "nulls": nulls, "n": w.n, "zeros": w.zeros, "ends": ends}).encode()
    return MAGIC + len(header).to_bytes(4, "little") + header + b"".join(parts)


class Shard:
    """A file read back; directories and blocks are decompressed when they are first asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(data[4:8], "little")
        self.header = json.loads(data[8 : 8 + size])
        self._data, self._at = data, 8 + size
        #: Numbers of the blocks of bits that have been inflated, as (plane, block).
        self.inflated: list[tuple[int, int]] = []

    def _section(self, k: int) -> bytes:
        ends = self.header["ends"]
        return zstandard.ZstdDecompressor().decompress(self._data[self._at + (ends[k - 1] if k else 0) : self._at + ends[k]])

    @property
    def keys(self) -> np.ndarray:
        return np.cumsum(np.frombuffer(self._section(0), "<i8"))

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._section(1), "<u4")

    def matrix(self) -> WaveletMatrix:
        size = -(-self.header["n"] // 8)
        each = 3 + -(-size // BLOCK)
        planes, directories = [], []
        for plane in range(len(self.header["zeros"])):
            first = 2 + plane * each

            def inflate(k: int, plane: int = plane, first: int = first) -> bytes:
                self.inflated.append((plane, k))
                return self._section(first + 3 + k)

            planes.append(Plane(size, inflate))
            directories.append(Directory(*[np.frombuffer(self._section(first + k), "<u4") for k in range(3)]))
        return WaveletMatrix(self.header["n"], planes, self.header["zeros"], directories)


SHARDS = "shard int, n_docs long, n_tokens long, data binary"
SHARDS_PA = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])


def encode_shards(docs: DataFrame, vocabulary: str = WORD_BPE, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """shard, n_docs, n_tokens, data (the file) for ascending ranges of doc_id.

    Null texts are empty and still end with end_id; rows of a null doc_id come last, rows of equal doc_id by
    text.  No documents give no shards.
    """

    def f(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]))
        e = encoder(vocabulary, folder)
        end = np.uint32(end_id).tobytes()
        ids = [e.encode(t or "") + end for t in table.column("text").to_pylist()]
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        data = pack_shard(table.column("key").to_numpy(), table.column("doc_id").null_count, lengths, np.frombuffer(b"".join(ids), "<u4"))
        return pa.table([[table.column("bucket")[0].as_py()], [len(lengths)], [int(lengths.sum())], [data]], schema=SHARDS_PA)

    return in_ranges(docs).groupBy("bucket").applyInArrow(f, SHARDS)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    encode_shards(docs, **options).write.option("compression", "uncompressed").parquet(path)


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with_ids, ids, from the files."""
    files = spark.read.schema(SHARDS).parquet(path)
    # one row for each file
    before = files.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))

    def f(batches):
        for b in batches:
            for data, first in zip(b.column("data"), b.column("before").to_pylist(), strict=True):
                s = Shard(data.as_py())
                ids, lengths, keys = s.matrix().decode().astype("<u4"), s.lengths.astype(np.int64), s.keys
                ends = np.cumsum(lengths)
                starts = ends - lengths
                known = len(keys) - s.header["nulls"]
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64(), mask=np.arange(len(keys)) >= known), pa.array(starts + first), pa.array(lengths), pa.array(crc, pa.int64())]
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.view(np.int32))) if with_ids else pa.nulls(len(keys), pa.list_(pa.int32())))
                yield pa.record_batch(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    rows = files.select("shard", "data").join(before, "shard").select("data", "before").mapInArrow(f, ROWS)
    return rows if with_ids else rows.drop("ids")


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "wavelet")
    write_shards(read_documents(spark, sf_dir), path)
    return read_shards(spark, path, with_ids=False)


QUERIES = {"op3_wavelet_tokens": op3_wavelet_tokens}
