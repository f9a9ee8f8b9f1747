"""Best-fit packing by patterns of lengths, fitted with non-negative least squares.

Documents become pieces of at most SEQUENCE tokens.  The histogram of piece lengths, of SEQUENCE numbers at
most, is all that packing needs to know: patterns of a few lengths that fill a sequence are enumerated,
non-negative least squares finds how often each should be used, the counts are rounded down to what there is,
and what is left is packed best fit, again as patterns.  Pieces then take the places of their length by rank.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestore.llm.common import give_back, partitions, read_documents
from lodestore.llm.tokens import BYTE_BPE, KEPT_PIECES, encoder
from lodestore.session import shared_folder

SEQUENCE = 1024
END_ID = 2
#: Lengths that a pattern of three takes its middle one from; patterns in all are about as many times the lengths.
MIDDLES = 24
STEPS = 400
#: Windows of an order that are planned one after another.
WINDOWS = 16
#: Rows of a file that are ranked within a length in one group.
ROWS = 1 << 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, vocabulary: str = BYTE_BPE, folder: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, with_ids: bool = False, order: tuple[str, ...] = (), kept: int = KEPT_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with_ids, ids: documents cut into pieces; order: long columns to keep; kept: words whose ids a task remembers.

    A document of up to `sequence` ids, its end id among them, is one piece; of a longer one the first piece
    is the shorter one.  A null text is empty and still has its end id.
    """

    def f(batches):
        e = encoder(vocabulary, folder, kept)
        end = np.uint32(end_id).tobytes()
        for b in batches:
            doc, piece, start, length, crc, ids, row = [], [], [], [], [], [], []
            for at, (d, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                raw = memoryview(e.encode(t or "") + end)
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % sequence + 1, n + 1, sequence)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(d)
                    row.append(at)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(raw[4 * x : 4 * y]))
                    if with_ids:
                        ids.append(np.frombuffer(raw[4 * x : 4 * y], "<i4"))
            cols = [pa.array(x, t) for x, t in ((doc, pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
            upto = np.concatenate(([0], np.cumsum(np.array(length, np.int64)))).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))) if with_ids else pa.nulls(len(doc), pa.list_(pa.int32())))
            cols += [b.column(c).take(pa.array(row, pa.int64())) for c in order]
            yield pa.record_batch(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", *order])
        e.rest()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).cast("long") for c in order]).mapInArrow(f, ", ".join([PIECES, *[f"{c} long" for c in order]]))
    return rows if with_ids else rows.drop("ids")


def patterns(lengths: np.ndarray, sequence: int) -> np.ndarray:
    """Rows of up to three lengths, padded with 0, longest first, each the best fit for what is before it."""
    have = np.unique(lengths)
    fit = np.zeros(sequence + 1, np.int64)  # the largest length up to a room
    fit[have] = have
    fit = np.maximum.accumulate(fit)
    found = [np.stack([have, np.zeros_like(have), np.zeros_like(have)], 1)]
    second = fit[sequence - have]
    found.append(np.stack([have, second, np.zeros_like(have)], 1))
    # close partners too, so that no length depends on one other
    for k in range(1, 9):
        room = sequence - have - k
        found.append(np.stack([have, np.where(room > 0, fit[np.maximum(room, 0)], 0), np.zeros_like(have)], 1))
    for q in range(1, MIDDLES + 1):
        middle = fit[(sequence - have) * q // (MIDDLES + 1)]
        third = fit[np.maximum(sequence - have - middle, 0)]
        found.append(np.stack([have, middle, np.where(middle > 0, third, 0)], 1))
    return np.unique(np.sort(np.concatenate(found), axis=1)[:, ::-1], axis=0)


def fitted(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x >= 0 that brings the lengths used by x repeats of each pattern close to the counts.

    Non-negative least squares by accelerated projected gradient steps; a pattern row is its list of lengths.
    Errors count relative to the square root of a length's count.  One more equation asks for no unused room,
    which decides between patterns that fit the counts equally well.
    """
    sequence = len(counts) - 1
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))
    weight[0] = 0
    target = np.append(counts * weight, 0.0)
    room = (1 - rows.sum(axis=1) / sequence) * 4 / np.sqrt(max(counts.sum(), 1.0))
    width = range(rows.shape[1])

    def used(x):
        return np.append(sum(np.bincount(rows[:, k], x, len(counts)) for k in width) * weight, room @ x)

    def back(r):
        return sum((r[:-1] * weight)[rows[:, k]] for k in width) + room * r[-1]

    scale = np.sqrt(np.maximum(sum(weight[rows[:, k]] ** 2 for k in width) + room**2, 1e-12))
    # columns of unit size; their largest singular value by power iteration
    v, norm = np.ones(len(rows)), 1.0
    for _ in range(30):
        u = back(used(v / scale)) / scale
        norm = max(float(np.linalg.norm(u) / np.linalg.norm(v)), 1e-12)
        v = u / max(float(np.linalg.norm(u)), 1e-30)
    x = np.zeros(len(rows))
    y, t = x.copy(), 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y - back(used(y / scale) - target) / scale / (norm * 1.05))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x / scale


@dataclass
class Plan:
    """Patterns and how often each is used: lengths (0: none) and repeats."""

    rows: np.ndarray
    repeats: np.ndarray

    def slots(self) -> dict[str, np.ndarray]:
        """For each place of a pattern: its length, ranks [low, high) that it serves, first sequence, offset."""
        base = np.cumsum(self.repeats) - self.repeats
        offset = np.cumsum(self.rows, axis=1) - self.rows
        p, k = np.nonzero(self.rows)
        length = self.rows[p, k]
        order = np.lexsort((k, p, length))
        p, k, length = p[order], k[order], length[order]
        n = self.repeats[p]
        low = np.cumsum(n) - n
        first = np.flatnonzero(np.diff(length, prepend=-1))
        low = low - np.repeat(low[first], np.diff(np.append(first, len(length)))) if len(length) else low
        return {"length": length, "low": low, "base": base[p], "offset": offset[p, k]}


def plan(counts: np.ndarray, sequence: int = SEQUENCE) -> Plan:
    """Patterns for counts[length] pieces of each length up to `sequence`."""
    return plan_in_order(counts[None], sequence)


def plan_in_order(windows: np.ndarray, sequence: int = SEQUENCE) -> Plan:
    """Patterns for windows[w, length] pieces of the windows of an order, window after window.

    A window uses what it has in well filled patterns and leaves the rest to the next, the last one uses all.  So the
    pieces of a length, taken in order, are never served before they come.
    """
    rows, repeats = [], []
    left = np.zeros(windows.shape[1], np.int64)
    for w, counts in enumerate(windows):
        left = _planned(left + counts.astype(np.int64), sequence, rows, repeats, w == len(windows) - 1)
    width = max((len(r) for r in rows), default=1)
    return Plan(np.array([r + [0] * (width - len(r)) for r in rows], np.int64).reshape(-1, width), np.array(repeats, np.int64))


def _planned(counts: np.ndarray, sequence: int, rows: list, repeats: list, last: bool) -> np.ndarray:
    """Adds patterns for these counts, all of them if this is the last window; what is left of the counts."""

    def use(lengths: list[int], n: int) -> None:
        rows.append(lengths)
        repeats.append(n)
        np.subtract.at(counts, lengths, n)

    if counts[sequence]:
        use([sequence], int(counts[sequence]))
    have = np.flatnonzero(counts[1:]) + 1
    if len(have):
        candidates = patterns(have, sequence)
        x = fitted(candidates, counts.astype(float))
        # best filled first, so that rounding costs the ones that waste most
        for k in np.lexsort((-x, -candidates.sum(axis=1))):
            lengths = [int(v) for v in candidates[k] if v]
            room = min(int(counts[v]) // lengths.count(v) for v in lengths)
            n = min(int(x[k]), room)
            if n > 0 and sum(lengths) >= sequence - sequence // 64:
                use(lengths, n)
    # what is left: best fit decreasing, many equal sequences at a time; before the last window those that are full or nearly
    waits = np.zeros(len(counts), bool)
    while (have := np.flatnonzero(counts)).size and not waits[have].all():
        lengths, left, spare = [], sequence, counts.copy()
        while (fits := have[(have <= left) & (spare[have] > 0)]).size:
            v = int(fits[-1] if lengths else fits[~waits[fits]][-1])
            lengths.append(v)
            spare[v] -= 1
            left -= v
        if last or left <= sequence // 128:
            use(lengths, min(int(counts[v]) // lengths.count(v) for v in set(lengths)))
        else:
            waits[lengths[0]] = True
    return counts


def pack(rows: DataFrame, sequence: int = SEQUENCE, order: tuple[str, ...] = ()) -> DataFrame:
    """The pieces with sequence_id and offset.  Reruns on equal rows agree; equal rows may swap places.

    With order, the names of a file's number and of a row's number in it, sequences are numbered along that order: it
    is planned in WINDOWS windows of files, and the pieces of a length take its places in order.  Without it, pieces
    are in the order of a hash, in one window.
    """
    spark = rows.sparkSession
    window, n = F.lit(0), 1
    if order:
        files = (rows.agg(F.max(order[0])).first()[0] or 0) + 1
        n = min(WINDOWS, files)
        window = F.floor(F.col(order[0]) * n / files).cast("int")
    histogram = rows.groupBy(window.alias("window"), "length").count().collect()  # at most `sequence` rows for each window
    counts = np.zeros((n, sequence + 1), np.int64)
    for r in histogram:
        counts[r["window"], r["length"]] = r["count"]
    found = plan_in_order(counts, sequence).slots()
    places = spark.sparkContext.broadcast(found)  # bounded by the number of patterns
    # ranks within a length: rank within a share of it, plus the sizes of the shares before
    shares = partitions(spark)
    share = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)).cast("long")
    if order:
        share = F.col(order[0]) * (1 << 24) + F.floor(F.col(order[1]) / ROWS)
    keyed = rows.withColumn("share", share)
    sizes = keyed.groupBy("length", "share").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")).drop("count")
    by = [*order[1:], *[c for c in ("doc_id", "piece", "ids_crc32") if c in rows.columns]]
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy(*by)) - 1).join(before, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))

    names = [c for c in rows.columns if c not in order]

    def f(batches):
        s = places.value
        key = s["length"] * (1 << 44) + s["low"]
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            k = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            out = [b.column(c) for c in names] + [pa.array(s["base"][k] + rank - s["low"][k]), pa.array(s["offset"][k])]
            yield pa.record_batch(out, names=[*names, "sequence_id", "offset"])

    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes if c in names] + ["sequence_id long", "offset long"])
    return ranked.select(*names, "rank").mapInArrow(f, schema)


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, order: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text).

    Null texts are empty; repeated rows and null doc_ids are documents of their own; other columns are ignored.
    """
    shared_folder(docs.sparkSession)
    return pack(pieces(docs, sequence=sequence, order=order, **options).checkpoint(), sequence, order)


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # workers hold nothing else here, unlike those of the pipeline
    return pack_documents(read_documents(spark, sf_dir), kept=2 * KEPT_PIECES)


QUERIES = {"op7_pattern_packing": op7_pattern_packing}
