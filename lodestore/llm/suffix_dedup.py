"""Suffix-array deduplication of byte strings with deep-shallow sorting.

Only the first LENGTH bytes of a suffix matter here, and only suffixes that can be repeated are sorted:

1. every LENGTH-byte string holds the same minimizer (the smallest of its GRAM-byte hashes) wherever it
   occurs, so strings whose minimizer occurs once are unique.  Where documents are read, each is cut into runs
   of string starts with one minimizer; a run's context is the bytes under its strings.  Blocks tell their
   distinct minimizers to buckets by hash and learn which occur elsewhere too;
2. a block sends each distinct context of a repeated minimizer once, to the bucket of the minimizer;
3. a bucket puts equal contexts together first: all strings of a context that is there twice are repeated.
   Of the rest it sorts the suffixes, by multikey quicksort on 8-byte characters to a shallow depth and with
   blind tries below it, and sends back which start a string that has an equal neighbour in the order;
4. blocks drop every byte under such a string.

A minimizer with more than HOT distinct contexts would be one large group: its strings are dealt one by one,
by their own content, and sorted by the same two steps as strings of names (64-bit hashes of their quarters and
of the whole) in place of bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import Texts, U, among, bucket_of, buckets, give_back, in_blocks, minimizer, mix, powers, read_documents, runs
from lodestore.llm.substring_dedup import BACK, BACK_PA, SENT, SENT_PA, answer, firsts, tell, told

LENGTH = 200
GRAM = 48
#: Distinct contexts of one minimizer, over all blocks, that go to one bucket.
HOT = 10_000
#: Characters of 8 bytes that the multikey quicksort looks at before blind tries take over.
SHALLOW = 2
#: Bytes of the documents that are hashed at a time: the arrays of a pass stay in the cache.
SEGMENT = 1 << 17
#: Suffixes that are sorted at a time; a minimizer's are never parted.
BATCH = 1 << 18

_rng = np.random.default_rng(20_231)
BYTE, OTHER = (_rng.integers(1, 1 << 63, 256).astype(U) for _ in range(2))
RUN = np.dtype([("key", "<u8"), ("a", "<u8"), ("b", "<u8"), ("low", "<i4"), ("high", "<i4"), ("seed", "<i4")])


class Slices:
    """Hashes of slices of a buffer from sums of byte values times powers."""

    def __init__(self, buf: np.ndarray, table: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, U)
        np.cumsum(table[buf] * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return (self.total[size:] - self.total[:n]) * self.down[:n]


def segments(bounds: np.ndarray, length: int):
    """(low, high, starts): slices of the documents to hash at a time, and where in them a string may start.

    Whole documents as long as they fit; a longer one comes in slices that overlap, so that each start is in one.
    starts: pairs of a first start and one behind the last, from the slice's beginning.
    """
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SEGMENT, "right")) - 1)
        low, high = int(bounds[i]), int(bounds[j])
        if j == i + 1 and high - low > SEGMENT:
            for s in range(low, high - length + 1, SEGMENT):
                e = min(high, s + SEGMENT + length - 1)
                yield s, e, np.array([[0, e - s - length + 1]])
        else:
            a, b = bounds[i:j] - low, bounds[i + 1 : j + 1] - low - length + 1
            yield low, high, np.stack([a, b], 1)[b > a]
        i = j


def runs_of(buf: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> np.ndarray:
    """RUN rows, by place; low, high (first and last start) and seed count from the beginning of the buffer."""
    out = [np.zeros(0, RUN)]
    for low, high, starts in segments(bounds, length):
        if not len(starts):
            continue
        part = buf[low:high]
        one = Slices(part, BYTE)
        grams = mix(one.grams(gram))
        at = minimizer(grams, length - gram + 1)
        edge = np.zeros(len(at) + 1, np.int8)
        edge[starts[:, 0]] = 1
        edge[starts[:, 1]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        # runs of starts with the same minimizer
        cut = np.flatnonzero((at[1:] != at[:-1]) | (inside[1:] != inside[:-1])) + 1
        a, b = np.concatenate(([0], cut)), np.append(cut, len(at)) - 1
        use = inside[a]
        a, b = a[use], b[use]
        r = np.zeros(len(a), RUN)
        seed = at[a]
        shape = (seed - a).astype(U) * U(0x9E3779B97F4A7C15) + (b - a).astype(U) * U(0xC2B2AE3D27D4EB4F)
        r["key"] = grams[seed]
        r["a"] = mix(one.of(a, b + length) + shape)
        r["b"] = mix(Slices(part, OTHER).of(a, b + length))
        # places of documents of more than 2 GB are not met: a text has fewer bytes
        r["low"], r["high"], r["seed"] = a + low, b + low, seed + low
        out.append(r)
    return np.concatenate(out)


def with_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """block, doc_id, text and runs: RUN rows as bytes, places from the beginning of the text."""

    def f(batches):
        for b in batches:
            texts = Texts(pa.table([pa.nulls(b.num_rows, pa.int64()), b.column("text")], ["doc_id", "text"]), ordered=False)
            r = runs_of(texts.bytes, texts.bounds, length, gram)
            of = np.searchsorted(texts.bounds, r["low"], "right") - 1
            for c in ("low", "high", "seed"):
                r[c] -= texts.bounds[of].astype(np.int32)
            ends = np.searchsorted(of, np.arange(texts.n + 1)) * RUN.itemsize
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(r.tobytes())])
            yield pa.record_batch([*b.columns, found.cast(pa.binary())], names=["block", "doc_id", "text", "runs"])
        give_back()

    return in_blocks(docs).mapInArrow(f, "block int, doc_id long, text string, runs binary")


def told_apart(new: np.ndarray, content) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted entries and which of them begin a class, where hashes that agree are believed only if the bytes do.

    new: which entries differ from the one before by their hashes; content(i): the bytes of an entry.
    """
    lead, seen = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)), {}
    other = np.zeros(len(new), np.int64)
    again = np.flatnonzero(~new)
    for i, k in zip(again.tolist(), lead[again].tolist(), strict=True):
        mine = content(i)
        if mine != content(k):
            known = seen.setdefault(k, {})
            other[i] = known.setdefault(bytes(mine), len(known) + 1)
    order = np.arange(len(new))
    if seen:
        order = np.lexsort((other, lead))
        new = np.concatenate(([True], (lead[order][1:] != lead[order][:-1]) | (other[order][1:] != other[order][:-1])))
    return order, new


class Block:
    """The texts of a block, their runs with places in the block's buffer, and its distinct contexts."""

    def __init__(self, table: pa.Table, length: int):
        self.texts = Texts(table)
        cells = self.texts.kept[0].to_pylist() if self.texts.n else []
        size = np.array([len(x) // RUN.itemsize for x in cells], np.int64)
        r = np.frombuffer(b"".join(cells), RUN)
        begin = np.repeat(self.texts.bounds[:-1], size) if self.texts.n else np.zeros(0, np.int64)
        self.low, self.high = r["low"] + begin, r["high"] + begin
        key, a, b = r["key"].copy(), r["a"].copy(), r["b"]
        off, span = r["seed"] - r["low"], r["high"] - r["low"]
        order = np.lexsort((a, key))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = False
            for x in (key, a, b, off, span):
                y = x[order]
                new[1:] |= y[1:] != y[:-1]
        text, x, y = memoryview(self.texts.bytes), self.low[order].tolist(), (self.high[order] + length).tolist()
        move, new = told_apart(new, lambda i: text[x[i] : y[i]])
        order = order[move]
        #: Of each run the number of its context; contexts are sorted by key.
        self.number = np.zeros(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        one = order[new]
        self.n = len(one)
        self.key, self.a, self.b, self.at, self.off, self.span = key[one], a[one], b[one], self.low[one], off[one], span[one]
        self.twice = np.bincount(self.number, minlength=self.n) > 1 if self.n else np.zeros(0, bool)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers, distinct contexts of each, and whether it occurs twice."""
        first = firsts(self.key)
        n = np.diff(np.append(first, self.n))
        return self.key[first], n, (n > 1) | self.twice[first]

    def split(self, h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts have a repeated minimizer, cold and hot."""
        order = np.argsort(h)
        h, hot = h[order], hot[order]
        first = firsts(self.key)
        mine = self.key[first]
        known = among(mine, h)
        is_hot = known.copy()
        is_hot[known] = hot[np.searchsorted(h, mine[known])] > 0
        n = np.diff(np.append(first, self.n))
        return np.repeat(known & ~is_hot, n), np.repeat(is_hot, n)

    def hot_strings(self, contexts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all strings of these contexts, and their names."""
        use = contexts[self.number]
        at = _ranges(self.low[use], self.high[use] + 1)
        at.sort()
        names = [np.zeros((0, NAMES), U)]
        if len(at):
            for low, high, starts in segments(self.texts.bounds, length):
                x, y = np.searchsorted(at, [low, max(low, high - length + 1)])
                if x < y:
                    names.append(named(self.texts.bytes[low:high], at[x:y] - low, length))
        return at, np.concatenate(names)


NAMES = 5


def named(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Strings of names for the strings at these places: hashes of four quarters and, by another table, of all."""
    one, q = Slices(buf, BYTE), -(-length // 4)
    cut = [0, q, 2 * q, max(0, length - q)]
    return np.stack([*[mix(one.of(at + c, np.minimum(at + c + q, at + length))) for c in cut], mix(Slices(buf, OTHER).of(at, at + length))], 1)


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a[0], a[0] + 1, ..., b[0] - 1, a[1], ..."""
    n = b - a
    if not len(n) or not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def seeds_told(length: int, n_buckets: int):
    def f(table: pa.Table) -> pa.Table:
        h, n, again = Block(table, length).keys()
        return tell(table.column("block")[0].as_py(), h, n_buckets, np.minimum(n, 1 << 30).astype(np.uint32), again.astype(np.uint8))

    return f


def seeds_answered(hot: int):
    def f(table: pa.Table) -> pa.Table:
        """Minimizers that occur twice at least, and whether they are hot."""
        row, (h, n, twice) = told(table.column("data").to_pylist(), [U, np.uint32, np.uint8])
        order = np.argsort(h, kind="stable")
        h, n, row, twice = h[order], n[order], row[order], twice[order]
        first = firsts(h)
        times = np.diff(np.append(first, len(h)))
        total = np.repeat(np.add.reduceat(n.astype(np.int64), first), times) if len(h) else n
        again = np.repeat((times > 1) | (twice[first] > 0), times) if len(h) else times > 0
        return answer(table.column("block").to_pylist(), row[again], h[again], (total[again] > hot).astype(np.uint8))

    return f


def contexts_told(length: int, n_buckets: int):
    def f(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SENT_PA.empty_table()
        c = Block(docs, length)
        block = docs.column("block")[0].as_py()
        cold, hot = c.split(*back_of(back, [U, np.uint8]))
        blocks, buckets, data = [], [], []
        one = np.flatnonzero(cold)
        bucket = bucket_of(c.key[one], n_buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        text = memoryview(c.texts.bytes)
        for q in np.split(order, cut[1:]) if len(order) else []:
            p = one[q]
            head = np.array([0, len(p)], np.int64).tobytes()
            arrays = [x.tobytes() for x in (c.key[p], c.a[p], c.b[p], p, c.off[p].astype(np.int32), c.span[p].astype(np.int32), c.twice[p].astype(np.uint8))]
            data.append(b"".join([head, *arrays, *[text[x:y] for x, y in zip(c.at[p].tolist(), (c.at[p] + c.span[p] + length).tolist(), strict=True)]]))
            blocks.append(block)
            buckets.append(int(bucket[q[0]]))
        if hot.any():
            _, names = c.hot_strings(hot, length)
            order = np.lexsort(names.T[::-1])
            names = names[order]
            first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1))))
            n = np.diff(np.append(first, len(names)))
            t = tell(block, names[first, 0] ^ names[first, NAMES - 1], n_buckets, np.ascontiguousarray(names[first]), np.minimum(n, 2).astype(np.uint8))
            blocks += t.column("block").to_pylist()
            buckets += t.column("bucket").to_pylist()
            data += [np.int64(1).tobytes() + x for x in t.column("data").to_pylist()]
        return pa.table({"block": pa.array(blocks, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "data": pa.array(data, pa.binary())}, schema=SENT_PA)

    return f


def back_of(table: pa.Table, kinds: list) -> list[np.ndarray]:
    return told(table.column("data").to_pylist() if table.num_rows else [], kinds)[1]


def multikey_quicksort(character, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and the first `depth` characters, and for each place the first place of its run of equals.

    character(which, k): the k-th characters of some suffixes.  All open groups are parted at once: each by the
    median of three of its characters into less, equal and greater, of which equal goes on to the next character.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    head = np.concatenate(([True], group[order][1:] != group[order][:-1])) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    level = np.zeros(n, np.int64)
    live = np.flatnonzero(np.bincount(start, minlength=n)[start] > 1) if n and depth else np.zeros(0, np.int64)
    while len(live):
        s = start[live]
        first = firsts(s)
        size = np.diff(np.append(first, len(s)))
        c = character(order[live], level[live])
        x, y, z = c[first], c[first + size // 2], c[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        side = (c > pivot) * np.int8(2) + (c == pivot)
        part = np.repeat(np.arange(len(first)), size) * 3 + side
        move = np.argsort(part, kind="stable")
        order[live] = order[live][move]
        part, level[live] = part[move], (level[live] + (side == 1))[move]
        start[live] = live[np.repeat(firsts(part), np.diff(np.append(firsts(part), len(part))))]
        live = live[(np.bincount(start[live], minlength=n)[start[live]] > 1) & (level[live] < depth)]
    return order, start


def blind_tries(rows, order: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and runs of equals, from those of the shallow step.

    rows(which): the suffixes as rows of `length` units.  A group of suffixes that agree so far goes into a blind
    trie, all groups a level at a time: each suffix is compared with the first of its group only, to the unit
    where they part; those that part at the same depth with the same unit are the groups below, which share that
    prefix.  Suffixes that never part are equal.
    """
    n = len(order)
    live = np.flatnonzero(np.bincount(start, minlength=n)[start] > 1) if n else np.zeros(0, np.int64)
    while len(live):
        s = start[live]
        first = firsts(s)
        head = np.repeat(order[live][first], np.diff(np.append(first, len(s))))
        mine = order[live]
        part = np.full(len(live), length)
        unit, side = np.zeros(len(live), U), np.zeros(len(live), np.int8)
        for i in range(0, len(live), 4096):
            x, y = rows(mine[i : i + 4096]), rows(head[i : i + 4096])
            off = x != y
            k = off.argmax(axis=1)
            t = np.flatnonzero(off[np.arange(len(k)), k])
            k = k[t]
            part[i + t], unit[i + t] = k, x[t, k]
            side[i + t] = np.where(x[t, k] < y[t, k], -1, 1)
        # below the leader: deeper partings come nearer to it
        rank = np.where(side < 0, part, np.where(side > 0, 2 * length - part, length))
        move = np.lexsort((unit, rank, s))
        order[live] = mine[move]
        part, unit, rank = part[move], unit[move], rank[move]
        new = np.ones(len(live), bool)
        new[1:] = (s[1:] != s[:-1]) | (rank[1:] != rank[:-1]) | (unit[1:] != unit[:-1])
        at = np.flatnonzero(new)
        start[live] = live[np.repeat(at, np.diff(np.append(at, len(live))))]
        live = live[(np.bincount(start[live], minlength=n)[start[live]] > 1) & (part < length)]
    return order, start


def deep_shallow(buf: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `at` by group and first `length` bytes, and for each place that of the first equal."""
    chars = -(-length // 8)
    shallow = min(SHALLOW, chars)
    words = np.zeros(len(buf) + 8 * chars, U)
    for i in range(8):
        words[: len(buf) - i] |= buf[i:].astype(U) << U(56 - 8 * i)
    # zeros beyond the string
    masks = np.array([(1 << 64) - (1 << 8 * max(0, 8 * (k + 1) - length)) for k in range(chars)], U)
    order, start = multikey_quicksort(lambda which, k: words[at[which] + 8 * k] & masks[k], group, shallow)
    if length <= 8 * shallow or not len(at):
        return order, start
    view = np.lib.stride_tricks.sliding_window_view(buf, length)
    return blind_tries(lambda which: view[at[which]], order, start, length)


def deep_shallow_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for strings of names."""
    order, start = multikey_quicksort(lambda which, k: names[which, k], np.zeros(len(names), np.int64), SHALLOW)
    return blind_tries(lambda which: names[which], order, start, names.shape[1])


class Bucket:
    """Contexts that blocks have sent, equal ones put together; finds the runs of repeated strings in each."""

    def __init__(self, rows: list[bytes], length: int):
        fields = ((U, []), (U, []), (U, []), (np.int64, []), (np.int32, []), (np.int32, []), (np.uint8, []))
        row, data = [], []
        for r, d in enumerate(rows):
            n, at = int(np.frombuffer(d, np.int64, 2)[1]), 16
            for k, xs in fields:
                xs.append(np.frombuffer(d, k, n, at))
                at += n * np.dtype(k).itemsize
            row.append(np.full(n, r))
            data.append(memoryview(d)[at:])
        key, a, b, number, off, span, twice = (np.concatenate(xs) if xs else np.zeros(0, k) for k, xs in fields)
        self.length, self.data = length, b"".join(data)
        size = span.astype(np.int64) + length
        base = np.concatenate(([0], np.cumsum(size)))[:-1]
        order = np.lexsort((a, key))
        self.row, self.number = (np.concatenate(row) if row else number)[order], number[order]
        key, a, b, off, span, twice, base, size = (x[order] for x in (key, a, b, off, span, twice, base, size))
        n = len(key)
        new = np.ones(n, bool)
        for k, x in enumerate((key, a, b, off, span)):
            new[1:] = x[1:] != x[:-1] if k == 0 else new[1:] | (x[1:] != x[:-1])
        d, x, y = memoryview(self.data), base.tolist(), (base + size).tolist()
        move, new = told_apart(new, lambda i: d[x[i] : y[i]])
        self.row, self.number, key, off, span, twice, base, size = (v[move] for v in (self.row, self.number, key, off, span, twice, base, size))
        #: Of each context the number of its class; classes are sorted by minimizer.
        self.of = np.cumsum(new) - 1
        one = np.flatnonzero(new)
        self.key, self.off, self.span, self.base, self.size = key[one], off[one], span[one].astype(np.int64), base[one], size[one]
        self.weight = np.add.reduceat(1 + twice.astype(np.int64), one) if n else np.zeros(0, np.int64)

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, first start, last start) for each run of repeated strings, by class."""
        all_of = self.weight > 1
        first = firsts(self.key)
        size = np.diff(np.append(first, len(self.key)))
        # a minimizer with one class, or whose classes are all repeated as they are, has nothing to sort
        sort = (size > 1) & (np.minimum.reduceat(self.weight, first) == 1) if len(first) else size > 1
        sort = np.repeat(sort, size)
        whole = np.flatnonzero(all_of & ~sort)
        found = [(whole, np.zeros(len(whole), np.int64), self.span[whole])]
        todo = np.flatnonzero(sort)
        ends = np.append(firsts(self.key[todo])[1:], len(todo)) if len(todo) else np.zeros(0, np.int64)
        upto = np.cumsum(self.span[todo] + 1)
        i = 0
        while i < len(todo):
            done = int(upto[i - 1]) if i else 0
            # whole groups, about a batch of suffixes
            e = int(np.searchsorted(upto[ends - 1], done + BATCH, "right"))
            e = int(ends[max(e - 1, int(np.searchsorted(ends, i, "right")))])
            found.append(self._sorted(todo[i:e]))
            i = e
        c, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(c, kind="stable")
        return c[order], a[order], b[order]

    def _sorted(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf = np.frombuffer(b"".join([self.data[x : x + s] for x, s in zip(self.base[c].tolist(), self.size[c].tolist(), strict=True)]), np.uint8)
        base = np.cumsum(self.size[c]) - self.size[c]
        n = self.span[c] + 1
        rel = _ranges(np.zeros(len(c), np.int64), n)
        of = np.repeat(np.arange(len(c)), n)
        # equal strings have the minimizer at the same place, so suffixes are grouped by minimizer and its offset
        same = np.cumsum(np.concatenate(([True], self.key[c][1:] != self.key[c][:-1])))
        order, start = deep_shallow(buf, base[of] + rel, same[of] * (self.length + 1) + self.off[c][of] - rel, self.length)
        weight = np.bincount(start, self.weight[c][of[order]], len(of))
        hit = np.zeros(len(of), bool)
        hit[order] = weight[start] > 1
        # runs inside a context; contexts lie behind one another with a gap
        mask = np.zeros(len(of) + len(c), bool)
        mask[np.arange(len(of)) + of] = hit
        a, b = runs(mask)
        begin = np.cumsum(n + 1) - (n + 1)
        k = np.searchsorted(begin, a, "right") - 1
        return c[k], a - begin[k], b - 1 - begin[k]


def contexts_answered(length: int):
    def f(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        rows = table.column("data").to_pylist()
        hot = [d[0] == 1 for d in rows]
        out_block, out_data = [], []
        if not all(hot):
            from_block = [b for b, h in zip(blocks, hot, strict=True) if not h]
            bucket = Bucket([d for d, h in zip(rows, hot, strict=True) if not h], length)
            c, a, b = bucket.repeated()
            # every context of a class gets the runs of the class
            x, y = np.searchsorted(c, bucket.of), np.searchsorted(c, bucket.of, "right")
            at = _ranges(x, y)
            member = np.repeat(np.arange(len(bucket.of)), y - x)
            t = answer(from_block, bucket.row[member], bucket.number[member], a[at].astype(np.int32), b[at].astype(np.int32))
            out_block += t.column("block").to_pylist()
            out_data += [np.int64(0).tobytes() + x for x in t.column("data").to_pylist()]
        if any(hot):
            row, (_, names, n) = told([d[8:] for d, h in zip(rows, hot, strict=True) if h], [U, np.dtype((U, NAMES)), np.uint8])
            order, start = deep_shallow_names(names)
            again = np.zeros(len(order), bool)
            again[order] = np.bincount(start, n[order], len(order))[start] > 1
            t = answer([b for b, h in zip(blocks, hot, strict=True) if h], row[again], np.ascontiguousarray(names[again]))
            out_block += t.column("block").to_pylist()
            out_data += [np.int64(1).tobytes() + x for x in t.column("data").to_pylist()]
        return pa.table({"block": pa.array(out_block, pa.int32()), "data": pa.array(out_data, pa.binary())}, schema=BACK_PA)

    return f


def without(length: int, with_text: bool):
    def f(docs: pa.Table, seeds: pa.Table, found: pa.Table) -> pa.Table:
        c = Block(docs, length)
        texts = c.texts
        rows = found.column("data").to_pylist() if found.num_rows else []
        _, (number, low, high) = told([d[8:] for d in rows if d[0] == 0], [np.int64, np.int32, np.int32])
        order = np.argsort(number, kind="stable")
        number, low, high = number[order], low[order], high[order]
        a, b = np.searchsorted(number, c.number), np.searchsorted(number, c.number, "right")
        at = _ranges(a, b)
        place = np.repeat(c.low, b - a)
        begin, end = place + low[at], place + high[at] + length
        hot = [d[8:] for d in rows if d[0] == 1]
        if hot:
            _, (there,) = told(hot, [np.dtype((U, NAMES))])
            at, names = c.hot_strings(c.split(*back_of(seeds, [U, np.uint8]))[1], length)
            kind = np.dtype([(f"n{k}", U) for k in range(NAMES)])
            at = at[np.isin(np.ascontiguousarray(names).view(kind).ravel(), np.ascontiguousarray(there).view(kind).ravel())]
            begin, end = np.append(begin, at), np.append(end, at + length)
        size = len(texts.bytes)
        gone = np.cumsum(np.bincount(begin, minlength=size + 1)[:size] - np.bincount(end, minlength=size + 1)[:size]) > 0
        edge = np.concatenate(([0], np.cumsum(gone, dtype=np.int64)))
        removed = edge[texts.bounds[1:]] - edge[texts.bounds[:-1]]
        out = {k: [] for k in ("n_bytes", "n_spans", "kept_sha256", "kept", "spans")}
        for k, left in enumerate(removed.tolist()):
            x, y = int(texts.bounds[k]), int(texts.bounds[k + 1])
            if left in (0, y - x):
                a = np.arange(min(left, 1))
                b = a + y - x
                rest = b"" if left else texts.bytes[x:y].tobytes()
            else:
                g = gone[x:y]
                a, b = runs(g)
                rest = texts.bytes[x:y][~g].tobytes()
            out["n_bytes"].append(y - x)
            out["n_spans"].append(len(a))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["kept"].append(rest if with_text else None)
            out["spans"].append([{"start": int(s), "end": int(e)} for s, e in zip(a, b, strict=True)] if with_text else None)
        cols = {"doc_id": texts.doc_id, "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        if with_text:
            cols |= {"kept_bytes": pa.array(out["kept"], pa.binary()), "spans": pa.array(out["spans"], SPANS)}
        return pa.table(cols)

    return f


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept_bytes and spans, for every row.

    Each byte under a string of `length` bytes that also starts anywhere else, in the same text or another,
    goes.  A null text is empty; texts shorter than `length` keep everything; rows with equal or null doc_id
    are texts of their own.  Other columns are ignored.
    """
    gram = min(GRAM, (length + 1) // 2) if gram is None else gram
    n_buckets = buckets(docs.sparkSession)
    blocks = with_runs(docs, length, gram)
    grouped = lambda: blocks.groupBy("block")
    seeds = grouped().applyInArrow(seeds_told(length, n_buckets), SENT).groupBy("bucket").applyInArrow(seeds_answered(hot), BACK)
    found = grouped().cogroup(seeds.groupBy("block")).applyInArrow(contexts_told(length, n_buckets), SENT).groupBy("bucket").applyInArrow(contexts_answered(length), BACK)
    back = seeds.select("block", F.lit(0).alias("kind"), "data").unionByName(found.select("block", F.lit(1).alias("kind"), "data"))
    last = without(length, with_text)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary, spans array<struct<start: long, end: long>>" * with_text
    fields = [(k, pa.int64()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("kept_sha256", pa.string())] + [("kept_bytes", pa.binary()), ("spans", SPANS)] * with_text

    def end(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.schema(fields).empty_table()
        kind = back.column("kind").to_numpy() if back.num_rows else np.zeros(0, np.int32)
        out = last(docs, back.filter(pa.array(kind == 0)), back.filter(pa.array(kind == 1)))
        give_back()
        return out

    return grouped().cogroup(back.groupBy("block")).applyInArrow(end, schema)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_documents(spark, sf_dir))


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}

#: Two hexadecimal digits for each byte, as strings can be cut in SQL and blobs cannot.
ORACLE = {
    "op5_suffix_array_dedup": """
with t as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
p as (select doc_id, i, md5(substr(h, 2 * i - 1, 400)) g from t, unnest(range(1, greatest(length(h) // 2 - 198, 1))) r(i)),
again as (select g from p group by g having count(*) > 1),
s as (select doc_id, i, lag(i) over w b, lead(i) over w n from (select doc_id, i from p semi join again using (g)) window w as (partition by doc_id order by i)),
x as (select doc_id, sum(least(200, coalesce(n - i, 200)))::bigint n_removed, count_if(b is null or i - b > 200)::bigint n_spans from s group by 1),
-- what stays before each removed run, and behind the last one
k as (select s.doc_id, i, substr(h, 2 * (coalesce(b + 200, 1)) - 1, 2 * (i - coalesce(b + 200, 1))) part from s join t using (doc_id) where b is null or i - b > 200
  union all select s.doc_id, i + 200, substr(h, 2 * (i + 200) - 1) from s join t using (doc_id) where n is null),
j as (select doc_id, string_agg(part, '' order by i) kept from k group by 1)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256
from t left join x using (doc_id) left join j using (doc_id)
"""
}
