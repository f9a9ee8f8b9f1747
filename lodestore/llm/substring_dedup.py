"""Substring deduplication of word windows by level-wise doubling.

The levels of the usual 13 words are windows of 4, 7 and 13: each about twice as long as the one before.  Only
what is repeated at one length is extended to the next:

1. every full window has a witness of 4 words, the minimizer of the windows of 4 in it.  Per block the distinct
   witnesses go to buckets by hash, which send back those that a second block also has; full windows whose
   witness is not repeated are no candidates any more;
2. the candidates that are left go through the same exchange with witnesses of 7 words;
3. those left then go themselves, each distinct one with the smallest doc_id of its block, and words under a
   window that an earlier document also starts are dropped.

A witness depends on the content of the full window alone, so equal windows are extended from equal witnesses
and no repeat is lost.  Hashes of witnesses only choose candidates; the full windows themselves are compared by
96 bits of the XXH3-128 of their words.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import LAST, Texts, U, among, bucket_of, buckets, doubled, give_back, in_blocks, minimizer, mix, read_documents

WINDOW = 13
#: The first level has windows of this many words at most.
START = 4
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SENT = "block int, bucket int, data binary"
BACK = "block int, data binary"
SENT_PA = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
BACK_PA = pa.schema([("block", pa.int32()), ("data", pa.binary())])


def words_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the documents with one space behind each, where each begins in that line, and for each document the words before it.

    Both arrays have one more entry at the end.
    """
    # a separator behind every document keeps words of neighbours apart
    n_docs = len(bounds) - 1
    out = np.full(len(buf) + n_docs, 0x20, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(n_docs), np.diff(bounds))] = buf
    sep = SEPARATOR[out]
    edge = np.diff(np.concatenate(([1], sep.view(np.int8))))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out[end] = 0x20
    sep[end] = False
    return out[~sep], np.concatenate(([0], np.cumsum(end - start + 1))), np.searchsorted(start, bounds + np.arange(n_docs + 1))


def word_hashes(line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of every word: its length and its bytes, eight at a time, each mixed with those before."""
    start, size = place[:-1], np.diff(place) - 1
    padded = np.concatenate((line, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(line) + 1, "<u8", padded, strides=(1,))
    h, on, at = mix(size.astype(U) + U(0x632BE59BD9B4E019)), np.arange(len(size)), 0
    while len(on):
        left = size[on] - at
        lane = eight[start[on] + at]
        short = left < 8
        lane[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        h[on] = mix(h[on] * U(0x9E3779B97F4A7C15) + lane)
        at += 8
        on = on[left > 8]
    return h


def ladder(n: int) -> list[int]:
    """Lengths of the levels: each twice the one before, or one less; the last is n."""
    out = [n]
    while out[0] > START:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Windows:
    """The full windows of a run of documents that are still candidates, and the hashes of one level's windows."""

    def __init__(self, texts: Texts, i: int, j: int, n: int):
        bounds = texts.bounds[i : j + 1]
        #: All words with one space behind each, where each begins, and for each document the number of words before it.
        line, self.place, self.words = words_of(texts.bytes[bounds[0] : bounds[-1]], bounds - bounds[0])
        self.line, self.grams, self.n, self.level = line.tobytes(), word_hashes(line, self.place), n, 1
        doc = np.repeat(np.arange(j - i), np.diff(self.words))
        # places within a run of documents fit 32 bits
        self.start = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]).astype(np.int32) if len(doc) >= n else np.zeros(0, np.int32)
        self.doc = (doc[self.start] + i).astype(np.int32)

    def extend(self, length: int) -> None:
        """Hashes of windows of this length from those of the level before."""
        self.grams, self.level = doubled(self.grams, self.level, length), length

    def witnesses(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each candidate the window of this length that its content picks: hashes and documents, run by run."""
        self.extend(length)
        at = minimizer(self.grams, self.n - length + 1)[self.start]
        self.first = firsts(at)
        return self.grams[at[self.first]], self.doc[self.first]

    def keep(self, ok: np.ndarray) -> None:
        """Only the candidates of these runs go on."""
        on = np.repeat(ok, np.diff(np.append(self.first, len(self.start))))
        self.start, self.doc = self.start[on], self.doc[on]

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each candidate 64 and 32 bits of the XXH3-128 of its words, which tell it from every other."""
        a, b = self.place[self.start].tolist(), (self.place[self.start + self.n] - 1).tolist()
        digest = b"".join([xxhash.xxh3_128_digest(self.line[x:y]) for x, y in zip(a, b, strict=True)])
        halves = np.frombuffer(digest, ">u8").reshape(-1, 2)
        return halves[:, 0].astype(U), (halves[:, 1] >> U(32)).astype(np.uint32)


def firsts(sorted_array: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_array[1:] != sorted_array[:-1]))) if len(sorted_array) else np.zeros(0, np.int64)


def tell(block: int, h: np.ndarray, n_buckets: int, *more: np.ndarray) -> pa.Table:
    """Rows for the buckets: the arrays, cut by bucket, behind one another."""
    b = bucket_of(h, n_buckets)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order], prepend=-1))
    parts = np.split(order, cut[1:]) if len(order) else []
    data = [np.int64(len(p)).tobytes() + b"".join(a[p].tobytes() for a in (h, *more)) for p in parts]
    return pa.table({"block": pa.array([block] * len(parts), pa.int32()), "bucket": pa.array([int(b[p[0]]) for p in parts], pa.int32()), "data": pa.array(data, pa.binary())}, schema=SENT_PA)


def told(data: list[bytes], kinds: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """The arrays that were sent, concatenated, and for each element the number of its row."""
    parts, row = [[] for _ in kinds], []
    for k, d in enumerate(data):
        n = int(np.frombuffer(d, np.int64, 1)[0])
        at = 8
        for p, kind in zip(parts, kinds, strict=True):
            p.append(np.frombuffer(d, kind, n, at))
            at += n * np.dtype(kind).itemsize
        row.append(np.full(n, k, np.int32))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return join(row, np.int32), [join(p, kind) for p, kind in zip(parts, kinds, strict=True)]


def answer(blocks: list[int], row: np.ndarray, *arrays: np.ndarray) -> pa.Table:
    order = np.argsort(row, kind="stable")
    cut = np.flatnonzero(np.diff(row[order], prepend=-1))
    parts = np.split(order, cut[1:]) if len(order) else []
    data = [np.int64(len(p)).tobytes() + b"".join(a[p].tobytes() for a in arrays) for p in parts]
    return pa.table({"block": pa.array([blocks[row[p[0]]] for p in parts], pa.int32()), "data": pa.array(data, pa.binary())}, schema=BACK_PA)


def survivors(texts: Texts, n: int, backs: list[np.ndarray]) -> list[tuple[int, int, Windows]]:
    """The windows whose witness of every level so far is repeated: in another block, or in two documents here."""
    parts = [(i, j, Windows(texts, i, j, n)) for i, j in texts.chunks()]
    for length, back in zip(ladder(n), backs, strict=False):
        found = [w.witnesses(length) for _, _, w in parts]
        key = np.concatenate([k for k, _ in found] or [np.zeros(0, U)])
        doc = np.concatenate([texts.key[d] for _, d in found] or [np.zeros(0, np.int64)])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        here = key[1:][(key[1:] == key[:-1]) & (doc[1:] != doc[:-1])]
        known = np.sort(np.concatenate((back, here)))
        for (_, _, w), (k, _) in zip(parts, found, strict=True):
            w.keep(among(k, known))
    return parts


def level_told(n: int, level: int, n_buckets: int):
    """The distinct witnesses of a level, of what is left after the levels before."""

    def f(docs: pa.Table, back: pa.Table | None) -> pa.Table:
        if not docs.num_rows:
            return SENT_PA.empty_table()
        found = [w.witnesses(ladder(n)[level])[0] for _, _, w in survivors(Texts(docs), n, levels_of(back, level))]
        h = np.sort(np.concatenate(found or [np.zeros(0, U)]))
        return tell(docs.column("block")[0].as_py(), h[firsts(h)], n_buckets)

    return f


def level_answered(table: pa.Table) -> pa.Table:
    """What two blocks or more have."""
    row, (h,) = told(table.column("data").to_pylist(), [U])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    again = order[same[1:] | same[:-1]]
    return answer(table.column("block").to_pylist(), row[again], h[again])


def levels_of(back: pa.Table | None, n: int) -> list[np.ndarray]:
    """The answers to the first n levels."""
    if back is None or not back.num_rows:
        return [np.zeros(0, U)] * n
    kind = back.column("kind").to_numpy()
    return [back_of(back.filter(pa.array(kind == k)), [U])[0] for k in range(n)]


def local_first(texts: Texts, n: int, backs: list[np.ndarray]):
    """Windows by chunk, of each its number among the distinct ones; of those the hashes and the smallest doc_id."""
    parts = survivors(texts, n, backs)
    found = [w.full() for _, _, w in parts]
    h = np.concatenate([x for x, _ in found] or [np.zeros(0, U)])
    check = np.concatenate([x for _, x in found] or [np.zeros(0, np.uint32)])
    doc = np.concatenate([texts.key[w.doc] for _, _, w in parts] or [np.zeros(0, np.int64)])
    order = np.lexsort((doc, check, h))
    h, check, doc = h[order], check[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))) if len(h) else np.zeros(0, np.int64)
    number = np.zeros(len(h), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    return parts, number, h[first], check[first], doc[first]


def back_of(table: pa.Table, kinds: list) -> list[np.ndarray]:
    return told(table.column("data").to_pylist() if table.num_rows else [], kinds)[1]


def windows_told(n: int, n_buckets: int):
    def f(docs: pa.Table, back: pa.Table | None) -> pa.Table:
        if not docs.num_rows:
            return SENT_PA.empty_table()
        _, _, h, check, doc = local_first(Texts(docs), n, levels_of(back, len(ladder(n)) - 1))
        return tell(docs.column("block")[0].as_py(), h, n_buckets, check, doc, np.arange(len(h), dtype=np.int32))

    return f


def windows_answered(table: pa.Table) -> pa.Table:
    """To each block: the numbers of its windows that a document of another block with a smaller doc_id has."""
    row, (h, check, doc, number) = told(table.column("data").to_pylist(), [U, np.uint32, np.int64, np.int32])
    order = np.lexsort((check, h))
    h, check, doc = h[order], check[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))) if len(h) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(h)))) if len(h) else doc
    late = order[least < doc]
    return answer(table.column("block").to_pylist(), row[late], number[late])


def without(n: int, with_text: bool):
    def f(docs: pa.Table, back: pa.Table) -> pa.Table:
        texts = Texts(docs)
        levels = len(ladder(n)) - 1
        parts, number, _, _, doc = local_first(texts, n, levels_of(back, levels))
        elsewhere = np.zeros(len(doc), bool)
        if back.num_rows:
            elsewhere[back_of(back.filter(pc.equal(back.column("kind"), levels)), [np.int32])[0]] = True
        out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
        at = 0
        for i, j, w in parts:
            mine_at = number[at : at + len(w.start)]
            at += len(mine_at)
            gone = (doc[mine_at] < texts.key[w.doc]) | elsewhere[mine_at]
            starts = w.start[gone]
            total = int(w.words[-1])
            change = np.bincount(starts, minlength=total + 1) - np.bincount(starts + n, minlength=total + 1)[: total + 1]
            kept = np.cumsum(change)[:total] == 0
            for k in range(i, j):
                a, b = int(w.words[k - i]), int(w.words[k - i + 1])
                left = int(kept[a:b].sum())
                whole = w.line[w.place[a] : max(w.place[a], w.place[b] - 1)]
                rest = whole if left == b - a else b" ".join(compress(whole.split(), kept[a:b].tolist()))
                out["n_words"].append(b - a)
                out["n_removed"].append(b - a - left)
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                # a text of which nothing goes keeps its own white space
                out["kept"].append((texts.bytes[texts.bounds[k] : texts.bounds[k + 1]].tobytes() if left == b - a else rest).decode() if with_text else None)
        cols = {"doc_id": texts.doc_id, "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        if with_text:
            cols["kept_text"] = pa.array(out["kept"], pa.string())
        return pa.table(cols | {f"_{k}": c for k, c in enumerate(texts.kept)})

    return f


def asking(grouped: GroupedData, back: DataFrame | None, ask) -> DataFrame:
    """What blocks tell buckets, given the answers so far."""
    if back is None:
        return grouped.applyInArrow(lambda docs: ask(docs, None), SENT)
    return grouped.cogroup(back.groupBy("block")).applyInArrow(lambda docs, back: ask(docs, back), SENT)


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text for every row of docs(doc_id, text).

    keep names further columns of docs that the result carries along, row by row.

    A word goes if a window over it also starts in a document with a smaller doc_id.  A null text has no
    words; a null doc_id counts as the largest; rows with equal doc_id do not count as earlier than each
    other; texts shorter than the window keep everything.  Other columns are ignored.
    """
    spark = docs.sparkSession
    n_buckets = buckets(spark)
    blocks = in_blocks(docs, keep)
    grouped = lambda: blocks.groupBy("block")
    levels = len(ladder(window)) - 1
    back = None
    for level in range(levels + 1):
        ask, reply = (level_told(window, level, n_buckets), level_answered) if level < levels else (windows_told(window, n_buckets), windows_answered)
        asked = asking(grouped(), back, ask)
        found = asked.groupBy("bucket").applyInArrow(reply, BACK).select("block", F.lit(level).alias("kind"), "data")
        back = found if back is None else back.unionByName(found)
    last = without(window, with_text)

    def end(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.schema([*END, *[f for f in docs.schema if f.name.startswith("_")]]).empty_table()
        out = last(docs, back)
        give_back()
        return out

    kinds = dict(blocks.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", _{k} {kinds[f'_{k}']}" for k in range(len(keep)))
    END = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text)
    return grouped().cogroup(back.groupBy("block")).applyInArrow(end, schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(keep)})


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_documents(spark, sf_dir))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}

ORACLE = {
    "op1_substring_dedup": """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
g as (select doc_id, s, md5(array_to_string(ws[s : s + 12], ' ')) g from w, unnest(range(1, greatest(len(ws) - 11, 1))) t(s)),
f as (select g, min(doc_id) d from g group by g),
late as (select g.doc_id, g.s from g join f using (g) where f.d < g.doc_id),
gone as (select distinct doc_id, s + k i from late, unnest(range(13)) t(k)),
r as (select doc_id, list(i) r from gone group by doc_id),
k as (select w.doc_id, ws, list_filter(ws, lambda x, i: not list_contains(coalesce(r, []), i)) kept from w left join r using (doc_id))
select doc_id, len(ws)::bigint n_words, (len(ws) - len(kept))::bigint n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from k
"""
}
