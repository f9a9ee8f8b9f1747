"""SimHash near-duplicates with pigeonring filtering.

The 64 bits are five segments on a ring.  If two fingerprints differ in at most 4 bits, then from some
segment on, the differences of the first l segments sum to at most 4 * l / 5, for every l: the first segment
is equal, the first two differ in at most one bit, and so on.  Equality of the first segment and of one half
of the second (one differing bit leaves a half untouched) is what candidates are grouped by; the chain of
budgets prunes pairs before the full Hamming check.

Only distinct fingerprints are compared, and a group returns a spanning forest of its links, never its
pairs.  Groups above a size are split by further pigeonholes on the bits that are left (five parts for four
differences: one part is equal), at last into blocks that are compared two by two, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import U, read_documents
from lodestore.llm.graph import components, joined_evenly
from lodestore.session import shared_folder

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Members of a group that are compared with each other in one task.
GROUP = 2048
SPLITS = 3
WIDTHS = (13, 13, 13, 13, 12)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FULL = (1 << 64) - 1


def _segments() -> list[int]:
    out, at = [], 0
    for w in WIDTHS:
        out.append(((1 << w) - 1) << at)
        at += w
    return out


SEGMENTS = _segments()


def _parts(mask: int, n: int) -> list[int]:
    bits = [b for b in range(64) if mask >> b & 1]
    cut = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[cut[k] : cut[k + 1]]) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_tree() -> list[tuple[int, int, int, int]]:
    """(level, chain, mask, mask of the parent): which bits the members of a group have in common."""
    level = [(0, i, SEGMENTS[i] | half, 0) for i in range(5) for half in _parts(SEGMENTS[(i + 1) % 5], 2)]
    out = list(level)
    for k in range(1, SPLITS + 1):
        level = [(k, i, m | p, m) for _, i, m, _ in level for p in _parts(FULL & ~m, DISTANCE + 1)]
        out += level
    return out


def fingerprint(text: bytes) -> int:
    words = text.translate(LOWER).split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        h = np.array([xxhash.xxh64_intdigest(line, SEED)], U)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size)
        starts = ends - size
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), U, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the kept string columns."""

    def f(batches):
        for b in batches:
            fps = [_signed(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in b.column("text").cast(pa.binary())]
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.int64()), *[b.column(c) for c in keep]], names=["doc_id", "fp", *keep])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(f, ", ".join(["doc_id long, fp long", *[f"{c} string" for c in keep]]))


def _linked(fp: np.ndarray, chain: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest member that each one is linked with, over any number of steps; end: where its group ends."""
    low, left, right = np.arange(len(fp)), [], []
    order = np.array([[SEGMENTS[(i + k) % 5] for k in range(5)] for i in range(5)], U)
    upto = np.bitwise_or.accumulate(order, axis=1)
    at, d = np.arange(len(fp)), 1
    while len(at := at[at + d < end[at]]):
        a, x = at, fp[at] ^ fp[at + d]
        for k in range(1, 5):
            ok = np.bitwise_count(x & upto[chain[a], k]) <= (k + 1) * DISTANCE // 5
            a, x = a[ok], x[ok]
        left.append(a)
        right.append(a + d)
        d += 1
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            m = np.minimum(low[a], low[b])
            before = low.copy()
            np.minimum.at(low, a, m)
            np.minimum.at(low, b, m)
            low = low[low]
            if (low == before).all():
                break
    return low


def _forest(batches):
    """Links of rows (used, value, part, chain, fp) that come sorted by group."""
    rest = None
    empty = pa.record_batch([pa.array([], pa.int64())] * 2, names=["u", "v"])

    def links(rows, last):
        used, value, part, chain, fp = rows
        if not len(fp):
            return empty, rows
        new = np.flatnonzero(np.concatenate(([True], (used[1:] != used[:-1]) | (value[1:] != value[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.append(new, len(fp)))
        n = len(fp) if last else new[-1]
        end = np.repeat(new + size, size)[:n]
        low = _linked(fp[:n], chain[:n], end)
        far = np.flatnonzero(low != np.arange(n))
        out = pa.record_batch([pa.array(fp[:n][far].view(np.int64)), pa.array(fp[:n][low[far]].view(np.int64))], names=["u", "v"])
        return out, [r[n:] for r in rows]

    for b in batches:
        rows = [b.column(k).to_numpy() for k in ("used", "value", "part", "chain")] + [b.column("fp").to_numpy().view(U)]
        rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        out, rest = links(rows, False)
        yield out
    if rest is not None:
        yield links(rest, True)[0]


def links(distinct: DataFrame) -> DataFrame:
    """u, v: links between fingerprints that differ in at most 4 bits, enough of them to connect what is connected."""
    spark = distinct.sparkSession
    masks = spark.createDataFrame([(k, i, _signed(m), _signed(p)) for k, i, m, p in mask_tree()], "level int, chain int, used long, parent long")
    rows = distinct.select("fp", F.lit(0).cast("long").alias("parent"))
    out = None
    for level in range(SPLITS + 1):
        here = masks.where(F.col("level") == level).drop("level")
        rows = rows.join(F.broadcast(here), "parent").select("fp", "chain", "used", F.col("fp").bitwiseAND(F.col("used")).alias("value"))
        sizes = rows.groupBy("used", "value").agg(F.count("*").alias("n")).where("n > 1")
        small = rows.join(sizes.where(F.col("n") <= GROUP), ["used", "value"]).select("fp", "chain", "used", "value", F.lit("").alias("part"))
        out = small if out is None else out.unionByName(small)
        large = rows.join(sizes.where(F.col("n") > GROUP), ["used", "value"]).checkpoint()
        if large.isEmpty():
            break
        if level == SPLITS:
            n = F.ceil(F.col("n") / (GROUP // 2)).cast("int")
            mine = F.pmod(F.xxhash64("fp"), n).cast("int")
            other = F.explode(F.sequence(F.lit(0), n - 1))
            pairs = large.withColumn("mine", mine).withColumn("other", other)
            part = F.concat_ws("-", F.least("mine", "other"), F.greatest("mine", "other"))
            out = out.unionByName(pairs.select("fp", "chain", "used", "value", part.alias("part")))
        rows = large.select("fp", F.col("used").alias("parent"))
    dealt = out.repartition("used", "value", "part").sortWithinPartitions("used", "value", "part", "fp")
    return dealt.select("used", "value", F.xxhash64("part").alias("part"), "chain", "fp").mapInArrow(_forest, "u long, v long").distinct()


def _rooted(fps: DataFrame, low: Column) -> DataFrame:
    """fp, low (the aggregate of its rows), n (how many rows), root (the smallest fingerprint of its component)."""
    distinct = fps.groupBy("fp").agg(low.alias("low"), F.count("*").alias("n")).checkpoint()
    found = components(links(distinct))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")).checkpoint()


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs(doc_id, text).

    A null or wordless text has fingerprint zero and is linked like any other; a text of one to three words
    is one shingle.  component_id is the smallest doc_id of the component; null doc_ids are passed over in
    it, and a component of null doc_ids alone has null.  Repeated rows stay.
    """
    shared_folder(docs.sparkSession)
    fps = fingerprints(docs).checkpoint()
    named = _rooted(fps, F.min("doc_id"))
    # neither a large component nor a large group of equal fingerprints meets in one task
    least = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    member = joined_evenly(named.select("fp", "root", F.col("n").alias("times")), least, "root", named.count()).select("fp", "component_id", F.col("times").alias("n"))
    return joined_evenly(fps, member, "fp", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_mark() -> Column:
    """A 128-bit name of a row by its doc_id and text, nulls among them."""
    text = F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("n"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("n")), F.lit(":"), text).cast("binary"))


def simhash_survivors(docs: DataFrame) -> DataFrame:
    """mark: row_mark() of one row for each component, that with the smallest doc_id, null last, then mark."""
    shared_folder(docs.sparkSession)
    fps = fingerprints(docs.withColumn("_mark", row_mark()), ("_mark",)).checkpoint()
    named = _rooted(fps, F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_mark")))
    return named.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low._mark").alias("mark"))


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_documents(spark, sf_dir))


QUERIES = {"op10_simhash_pigeonring": op10_simhash_pigeonring}
