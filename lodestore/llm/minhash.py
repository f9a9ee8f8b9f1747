"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has 54 values of 16 bits, in nine chunks of six.  Two signatures that differ in at most 17 values have a chunk
in which at most one value differs (pigeonhole), so each chunk is written down six times, each time without one of its
values: those two share such a key.  Sets of similarity 0.85 differ in 15 % of the values on average; 17 are exceeded by
1 pair in 2,000, and a pair is missed only if every chunk has two errors or more, 1 in 700,000 at the threshold.

Only distinct sets take part.  Similar sets need not be compared all with all, for components are asked for:

1. every member of a key is checked against the key's smallest member, once for each member, and takes its label if they
   are linked.  While there are keys of many members with several labels, members are checked against one member of each
   other label that they meet;
2. what then shares a key and is in different components of the links so far is compared pair by pair: by sizes, signatures
   and bins first, each pair in the first key it shares alone.  Keys of more than BLOCK members are compared block by block.
   If there still are keys of more than CROWD members, each is first checked against the likest one of another component alone;
3. components are those of all links together.

Bins count the shingles of a set by the first bits of their hashes.  Two sets differ in at least as many shingles as their
bins do, so what the bins rule out is never a link.  Of a large group of near copies they leave what is close to the threshold.

Every link is confirmed by the shingle sets themselves, in 64-bit hashes of the shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import U, among, mix, read_documents
from lodestore.llm.graph import components, few, joined_evenly
from lodestore.llm.simhash import LOWER, row_mark
from lodestore.session import shared_folder

SHINGLE = 5
PERCENT = 85
CHUNKS, WIDTH = 9, 6
VALUES = CHUNKS * WIDTH
#: A set of so few shingles is linked with equal ones alone: one more shingle is already too many.
FEW = math.ceil(PERCENT / (100 - PERCENT))
#: Bits of a hash by which bins are told apart, at least and at most; a set has more than half as many bins as shingles between.
BITS = 7, 12
#: Members of a key that are compared in one task; larger keys go block by block, without a change of the result.
BLOCK = 1024
#: Keys of more members in several components are worth another round of checks against single members.
MANY, ROUNDS = 64, 3
#: Of more members still, worth a check of each member against its nearest one.
CROWD = 256
#: Up to so many pairs are broadcast to the sets; more are joined by a shuffle.
FEW_PAIRS = 100_000
#: Shingles of the sets of both sides, pair by pair, that a block of pairs comes to.
WORK = 1 << 22
#: Pairs with one smaller set that meet in a task.
SALT = 128

_seeds = np.random.default_rng(85)
TIMES = _seeds.integers(0, 1 << 63, VALUES, dtype=np.uint64) * U(2) + U(1)
PLUS = _seeds.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def surely(values: int, share: float, risk: float) -> int:
    """The least number that a binomial count exceeds with at most this risk."""
    tail, k = 1.0, -1
    while tail > risk:
        k += 1
        tail = math.fsum(math.comb(values, x) * share**x * (1 - share) ** (values - x) for x in range(k + 1, values + 1))
    return k


#: Signatures of similar sets differ in more values than this once in ten million pairs at the threshold.
FAR = surely(VALUES, 1 - PERCENT / 100, 1e-7)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, U)
    line = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return np.array([xxhash.xxh3_64_intdigest(line)], U)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1]))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), U, n))


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES times 16 bits of the smallest of all hashes, each time under another permutation."""
    least = np.full(VALUES, np.iinfo(U).max, U)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[None, i : i + 2048] * TIMES[:, None] + PLUS[:, None]).min(axis=1), out=least)
    return (mix(least) >> U(48)).astype(np.uint16)


def bins(shingles: np.ndarray) -> np.ndarray:
    """How many shingles begin with the same bits, modulo 256; larger sets are told apart by more bits."""
    bits = min(max(BITS[0], (len(shingles) // 2).bit_length()), BITS[1])
    return np.bincount((shingles >> U(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8)


def _folded(counts: np.ndarray, width: int) -> np.ndarray:
    """The bins that fewer bits give."""
    return counts if counts.shape[-1] == width else counts.reshape(*counts.shape[:-1], width, -1).sum(axis=-1, dtype=np.uint8)


def apart(mine: bytes, theirs: list[bytes]) -> np.ndarray:
    """Shingles that are in one of two sets alone, at least: the sum of the differences of their bins."""
    x, widths, least = np.frombuffer(mine, np.uint8), np.fromiter(map(len, theirs), np.int64, len(theirs)), np.zeros(len(theirs), np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        y = np.frombuffer(b"".join([theirs[k] for k in at.tolist()]), np.uint8).reshape(-1, w)
        n = min(w, len(x))
        # counts modulo 256 differ by their distance on a circle at least
        least[at] = np.abs((_folded(y, n) - _folded(x, n)).view(np.int8).astype(np.int16)).sum(axis=1)
    return least


def _bytes(column: pa.Array):
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary()))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, set (128 bits by which equal sets are found; null for an empty one), sig and bins (null for few shingles)."""

    def f(batches):
        for b in batches:
            sets, sigs, counts, sizes = [], [], [], []
            for t in _bytes(b.column("text")):
                s = shingle_set(t)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) >= FEW else None)
                counts.append(bins(s).tobytes() if len(s) >= FEW else None)
            yield pa.record_batch([b.column("doc_id"), b.column("mark"), pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (sets, sigs, counts)]], names=["doc_id", "mark", "n_shingles", "set", "sig", "bins"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_mark().alias("mark"))
    return rows.mapInArrow(f, "doc_id long, mark string, n_shingles long, set binary, sig binary, bins binary")


def _keys(batches):
    """A key for each chunk and each of its values left out; the number of both in its last six bits."""
    for b in batches:
        sig = np.array([np.frombuffer(s, np.uint16) for s in b.column("sig").to_pylist()], np.uint16).reshape(-1, CHUNKS, WIDTH).astype(U)
        ids = b.column("id")
        for c in range(CHUNKS):
            for j in range(WIDTH):
                h = np.full(len(sig), c * WIDTH + j, U)
                for k in range(WIDTH):
                    if k != j:
                        h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, c, k] + U(1))
                key = (h << U(6)) | U(c * WIDTH + j)
                yield pa.record_batch([pa.array(key.view(np.int64)), ids], names=["key", "id"])


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first key that signatures share row by row, of those in one chunk the first."""
    differ = (a != b).reshape(-1, CHUNKS, WIDTH)
    errors = differ.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    # without an error all keys of the chunk are shared, with one that which leaves it out
    return chunk * WIDTH + differ[np.arange(len(differ)), chunk].argmax(axis=1)


def _pairs_of_group(key: int, id: np.ndarray, label: np.ndarray, size: np.ndarray, side: np.ndarray, sig: np.ndarray, counts: list[bytes]):
    """u, v and shingles of both, pairs across components: of the sides 0 and 1, or of those of side 2 among themselves.

    counts: their bins, if any; pairs that these rule out are left out.
    """
    right = np.flatnonzero(side > 0)
    for x in np.flatnonzero(side != 1).tolist():
        y = right[right > x] if side[x] == 2 else right
        y = y[(label[y] != label[x]) & (100 * np.minimum(size[y], size[x]) >= PERCENT * np.maximum(size[y], size[x]))]
        y = y[(sig[y] != sig[x]).sum(axis=1) <= FAR]
        y = y[first_shared(sig[y], np.broadcast_to(sig[x], (len(y), VALUES))) == key & 63]
        if counts and len(y):
            total = size[y] + size[x]
            y = y[(100 + PERCENT) * (total - apart(counts[x], [counts[k] for k in y.tolist()])) >= 2 * PERCENT * total]
        yield np.full(len(y), id[x]), id[y], size[y] + size[x]


def _groups(batches):
    """Rows that come sorted by key and part, some whole groups at a time: for each group key, ids and what else a pair is judged by."""

    def of(rows: pa.Table, cut: list[int]):
        key = rows.column("key").to_numpy()
        columns = [rows.column(c).to_numpy() for c in ("id", "label", "n_shingles", "side")]
        columns.append(np.array([np.frombuffer(s, np.uint16) for s in rows.column("sig").to_pylist()], np.uint16))
        columns.append(rows.column("bins").to_pylist() if "bins" in rows.column_names else [])
        return [(int(key[i]), *[c[i:j] for c in columns]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    rest = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if rows.num_rows:
            key, part = rows.column("key").to_numpy(), rows.column("part").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))).tolist()
            yield of(rows, cut)
            rest = rows.slice(cut[-1])
    if rest is not None and rest.num_rows:
        yield of(rest, [0, rest.num_rows])


def _compared(batches):
    """Pairs of rows (key, part, side, id, label, n_shingles, sig, bins) that come sorted by key and part, in blocks of about WORK shingles.

    Without the column bins no pair is left out for them.
    """
    block, done = None, 0
    for groups in _groups(batches):
        found = [p for g in groups for p in _pairs_of_group(*g)]
        if found:
            # tasks differ in their first key; what two of them number alike is one larger block
            block = (groups[0][0] & ((1 << 42) - 1)) << 20 if block is None else block
            u, v, work = (np.concatenate(x) for x in zip(*found, strict=True))
            upto = done + np.cumsum(work)
            numbers = block + (upto - work) // WORK
            done = int(upto[-1]) if len(upto) else done
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (numbers, u, v)], names=["block", "u", "v"])


def _nearest(batches):
    """For each row (as of _compared) at most one pair u, v, w (the label of v), d: with the likest signature, d values apart, in another component."""
    for groups in _groups(batches):
        found = [np.zeros((0, 4), np.int64)]
        for key, ids, label, size, side, sig, counts in groups:
            far, other = np.full(len(ids), VALUES + 1), np.zeros(len(ids), np.int64)
            for x, y, _ in _pairs_of_group(key, np.arange(len(ids)), label, size, side, sig, counts):
                if len(y):
                    d = (sig[y] != sig[x]).sum(axis=1)
                    closer = d < far[y]
                    far[y[closer]], other[y[closer]] = d[closer], x[0]
                    if d.min() < far[x[0]]:
                        far[x[0]], other[x[0]] = d.min(), y[d.argmin()]
            at = np.flatnonzero(far <= VALUES)
            found.append(np.stack((ids[at], ids[other[at]], label[other[at]], far[at]), axis=1))
        yield pa.record_batch([pa.array(x) for x in np.concatenate(found).T.copy()], names=["u", "v", "w", "d"])


def _similar(pairs: pa.Table, members: pa.Table) -> pa.Table:
    """The pairs(block, u, v) whose sets, in members(at, id, shingles), are similar."""
    lists = pa.concat_arrays(members.column("shingles").chunks)
    values, ends = lists.flatten().to_numpy().view(U), np.cumsum(lists.value_lengths().to_numpy())
    sets = dict(zip(members.column("id").to_pylist(), np.split(values, ends[:-1]), strict=True))
    u, v = pairs.column("u").to_numpy(), pairs.column("v").to_numpy()
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    keep = np.zeros(len(u), bool)
    cut = np.append(np.flatnonzero(np.diff(u, prepend=u[0] - 1)), len(u))
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        mine, theirs = sets[int(u[i])], [sets[x] for x in v[i:j].tolist()]
        sizes = np.fromiter(map(len, theirs), np.int64, j - i)
        both = np.add.reduceat(among(np.concatenate(theirs), mine), np.cumsum(sizes) - sizes, dtype=np.int64)
        keep[i:j] = 100 * both >= PERCENT * (len(mine) + sizes - both)
    return pa.table({"u": u[keep], "v": v[keep]})


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and shingles (sorted hashes) of the wanted(mark, id)."""

    def f(batches):
        for b in batches:
            sets = [shingle_set(t).view(np.int64) for t in _bytes(b.column("text"))]
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.record_batch([b.column("id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets or [np.zeros(0, np.int64)])))], names=["id", "shingles"])

    rows = docs.select(row_mark().alias("mark"), F.col("text").cast("string").alias("text")).join(wanted, "mark")
    # rows equal in id and text have one mark
    return rows.dropDuplicates(["mark"]).select("id", "text").mapInArrow(f, "id long, shingles array<long>")


def _with_sets(rows: DataFrame, n: int, bodies: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the set of the id in `key`.  Up to FEW_PAIRS rows go to the sets, so that sets that no row asks for stay where they are."""
    sets = bodies.select(F.col("id").alias(key), F.col("shingles").alias(name))
    return sets.join(F.broadcast(rows), key) if n <= FEW_PAIRS else rows.join(sets, key)


def confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The rows of pairs(u, v, w) whose sets are similar; a frequent v is dealt to several tasks, with a copy of its set."""
    pairs = pairs.checkpoint()
    n = pairs.count()
    pairs = few(pairs, n)
    counts = pairs.groupBy("v").agg(F.count("*").alias("n")).withColumn("parts", F.floor(F.col("n") / SALT) + 1)
    left = few(joined_evenly(pairs, counts, "v", n), n).withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts"))).drop("parts")
    left = _with_sets(left, n, bodies, "u", "a")
    copies = few(counts, n).select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = _with_sets(copies, n, bodies, "v", "b")
    both = F.size(F.array_intersect("a", "b"))
    return left.join(right, ["v", "part"]).where(100 * both >= PERCENT * (F.size("a") + F.size("b") - both)).select("u", "v", "w")


def confirmed_in_blocks(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The rows u, v of pairs(block, u, v) whose sets are similar; a block gets the set of each of its members once, in however many pairs it is."""
    pairs = pairs.checkpoint()
    members = pairs.select("block", F.col("u").alias("id")).unionByName(pairs.select("block", F.col("v").alias("id"))).distinct().checkpoint()
    sets = _with_sets(members, members.count(), bodies, "id", "shingles").select(F.col("block").alias("at"), "id", "shingles")
    return pairs.groupBy("block").cogroup(sets.groupBy("at")).applyInArrow(_similar, "u long, v long")


def _linked(labels: DataFrame, n: int, new: DataFrame) -> DataFrame:
    """id, label after new(u, v, w), w the label of v: each u takes the least label of its partners and itself; n: about how many ids.

    Equal labels always mean one component; a component may have several for now, which costs comparisons and no link.
    """
    theirs = few(new, n).groupBy(F.col("u").alias("id")).agg(F.min("w").alias("_l"))
    return few(labels.join(theirs, "id", "left").select("id", F.least("label", F.coalesce("_l", "label")).alias("label")), n).checkpoint()


def _open(entries: DataFrame, n: int, labels: DataFrame) -> DataFrame:
    """key, id, label, members: the rows of the keys whose members have several labels; n: about how many rows there are."""
    rows = few(entries.join(labels, "id").select("key", "id", "label"), n)
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("key", "n", F.col("n").alias("members"))
    return few(joined_evenly(rows, keys, "key", n), n)


def _met(entries: DataFrame, n: int, round: int) -> DataFrame:
    """u, v, w: every member with a member, picked by hash, of each other component that the key's chosen one is in."""
    chosen = entries.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(round)), "id", "label")).alias("c"), F.count("*").alias("n")).select("key", "n", F.col("c.id").alias("v"), F.col("c.label").alias("other"))
    rows = few(joined_evenly(entries.drop("members"), chosen, "key", n).where("label <> other"), n)
    return rows.groupBy(F.col("id").alias("u"), "other").agg(F.min("v").alias("v")).select("u", "v", F.col("other").alias("w"))


def _dealt(entries: DataFrame, many: DataFrame) -> DataFrame:
    """The entries(key, id, label, members), sorted by key and part, with what pairs are judged by; a key of more than BLOCK members in several parts."""
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    whole = entries.where(F.col("members") <= BLOCK).select("key", "id", "label", F.lit(0).alias("part"), F.lit(2).alias("side"))
    large = entries.where(F.col("members") > BLOCK).withColumn("parts", parts).withColumn("mine", mine)
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")
    large = large.select("key", "id", "label", part.alias("part"), F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"))
    rows = whole.unionByName(large).join(many.select("id", "n_shingles", "sig", "bins"), "id")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "side", "id", "label", "n_shingles", "sig", "bins")


def links(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: links between distinct(id, mark, n_shingles, sig, bins), enough of them to connect what is connected."""
    many = distinct.where("sig is not null")
    entries = many.select("id", "sig").mapInArrow(_keys, "key long, id long")
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").checkpoint()
    hubs = few(hubs, hubs.count())
    entries = joined_evenly(entries, hubs, "key", VALUES * many.count()).checkpoint()
    n = entries.count()
    entries = few(entries, n)
    ids = entries.select("id").distinct().checkpoint()
    m = ids.count()
    ids = few(ids, m)
    bodies = _bodies(docs, few(many.join(ids, "id").select("mark", "id"), m)).checkpoint()
    new = confirmed(entries.where("id > hub").groupBy(F.col("id").alias("u")).agg(F.min("hub").alias("v")).withColumn("w", F.col("v")), bodies).checkpoint()
    labels, found = _linked(ids.withColumn("label", F.col("id")), m, new), few(new, m)
    for k in range(ROUNDS):
        entries = _open(entries.select("key", "id"), n, labels).checkpoint()
        n, most = entries.agg(F.count("*"), F.max("members")).first()
        entries = few(entries, n)
        if k == ROUNDS - 1 or (most or 0) <= MANY:
            break
        new = confirmed(_met(entries, n, k), bodies).checkpoint()
        labels, found = _linked(labels, m, new), found.unionByName(few(new, m))
    # pairs are compared one by one across whole components only
    known = components(found.select("u", "v")).select(F.col("node").alias("id"), "root")
    labels = few(ids.join(known, "id", "left").select("id", F.coalesce("root", "id").alias("label")), m)
    entries = _open(entries.select("key", "id"), n, labels).checkpoint()
    n, most = entries.agg(F.count("*"), F.max("members")).first()
    if (most or 0) > CROWD:
        # first each with its nearest: what that connects need not be compared all with all
        near = _dealt(entries, many).mapInArrow(_nearest, "u long, v long, w long, d long").groupBy("u", "w").agg(F.min(F.struct("d", "v")).alias("c"))
        found = found.unionByName(few(confirmed(near.select("u", F.col("c.v").alias("v"), "w"), bodies).checkpoint(), m))
        known = components(found.select("u", "v")).select(F.col("node").alias("id"), "root")
        labels = few(ids.join(known, "id", "left").select("id", F.coalesce("root", "id").alias("label")), m)
        entries = _open(few(entries, n).select("key", "id"), n, labels).checkpoint()
    last = _dealt(entries, many).mapInArrow(_compared, "block long, u long, v long")
    return found.select("u", "v").unionByName(confirmed_in_blocks(last, bodies))


def minhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Rows of equal sets are one component; a null or wordless text has the empty set and is linked with nothing: its
    component_id is its doc_id.  component_id is the smallest doc_id of the component; null doc_ids are passed over in
    it, and a component of null doc_ids alone has null.  kept: doc_id and component_id are the same, null with null too.
    Repeated rows stay; other columns are ignored; an empty table gives an empty one.
    """
    shared_folder(docs.sparkSession)
    rows = signatures(docs).checkpoint()
    full = rows.where("set is not null")
    grouped = full.groupBy("set").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.min("mark").alias("mark"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bins").alias("bins"))
    distinct = grouped.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    found = components(links(distinct, docs))
    named = distinct.join(found.withColumnRenamed("node", "id"), "id", "left").select("set", "low", F.col("n").alias("times"), F.coalesce("root", "id").alias("root")).checkpoint()
    n = named.count()
    named = few(named, n)
    least = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    member = few(joined_evenly(named, least, "root", n).select("set", "component_id", F.col("times").alias("n")), n)
    linked = joined_evenly(full, member, "set", full.count()).select("doc_id", "n_shingles", "component_id")
    out = linked.unionByName(rows.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(read_documents(spark, sf_dir))


QUERIES = {"op11_minhash_multi_index": op11_minhash_multi_index}

#: Sets of shingles, pairs that share one, and what can be reached over the links.
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op11_minhash_multi_index": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i : i + {SHINGLE - 1}], ' ')) g from w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) t(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id u, b.doc_id v, count(*) same from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * same >= {PERCENT} * (a.n + b.n - same)),
r as (select doc_id d, doc_id r from w union select l.v, r.r from r join l on l.u = r.d),
c as (select d doc_id, min(r) component_id from r group by 1)
select c.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, c.doc_id = component_id kept from c left join n using (doc_id)
"""
}
