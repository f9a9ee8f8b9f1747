"""Periodic runs of words by the runs theorem.

A run is a maximal stretch of words with a smallest period.  The theorem says that the Lyndon roots of a run are
the longest Lyndon words that start where they start, under the order of the words or under its reverse.  So:

1. suffixes are ranked within their document (prefix doubling, many documents at a time);
2. the longest Lyndon word at a place ends before the next suffix of smaller rank, and under the reverse order
   before the next of greater rank: two candidates for each place;
3. a candidate is extended to both sides by as much as the suffixes (and, of the reversed words, the prefixes) at
   the root and behind it have in common: LCP array and sparse table of range minima.  Documents in which no
   candidate goes on for a few words have no run of the exponent asked for, and no tables are made for them.

A document ends with a sign of its own, smaller than all words, so neither suffixes nor runs cross documents.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import give_back, read_documents
from lodestore.llm.spelling import sql_crc32

#: Words that one numpy pass looks at; a longer document is a pass by itself.
PASS = 1 << 18
#: Parallel jumps before what is left is walked place by place.
JUMPS = 40
WORD = r"[^\x20\x09-\x0D]+"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
OUT_PA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUN), ("collapsed", pa.string())])
OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_ranks(text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of document and content, and the place of each; a document ends with its only 0."""
    n, width = len(text), int(text.max()) + 1
    following = np.append(text[1:], 0)
    following[text == 0] = 0
    key = (doc * width + text) * width + following
    at = np.argsort(key, kind="stable")
    slots, step = np.arange(n), 2
    order, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    s = key[at]
    while len(slots):
        order[slots] = at
        new = np.concatenate(([True], s[1:] != s[:-1]))
        first = slots[np.flatnonzero(new)]
        size = np.diff(np.append(np.flatnonzero(new), len(slots)))
        rank[at] = np.repeat(first, size)
        on = np.repeat(size > 1, size)
        slots, at = slots[on], at[on]
        # equal over `step` words and in one document: the sign at its end is still ahead
        key = rank[at] * n + rank[at + step]
        o = np.argsort(key, kind="stable")
        at, s, step = at[o], key[o], step * 2
    return order, rank


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller rank, or the length.

    All values between a place and its candidate are larger, so a candidate that is larger too may be replaced by
    its own candidate, final or not.
    """
    n = len(rank)
    r, nxt = np.append(rank, -1), np.append(np.arange(1, n + 1), n)
    on = np.flatnonzero(r[nxt[:n]] > rank)
    for _ in range(JUMPS):
        if not len(on):
            return nxt[:n]
        nxt[on] = nxt[nxt[on]]
        on = on[r[nxt[on]] > r[on]]
    # long falls take a jump for each step: from the right, where the candidates are final, at most n steps in all
    values, links = r.tolist(), nxt.tolist()
    for i in on[::-1].tolist():
        j = links[i]
        while values[j] > values[i]:
            j = links[j]
        links[i] = j
    return np.array(links[:n], np.int64)


class Extensions:
    """Longest common extensions of places in the same document: LCP array and sparse table of its minima."""

    def __init__(self, text: np.ndarray, doc: np.ndarray):
        order, self.rank = suffix_ranks(text, doc)
        t, sa, rank = text.tolist(), order.tolist(), self.rank.tolist()
        lcp, h = [0] * len(t), 0
        begins = set(np.flatnonzero(np.diff(doc, prepend=-1)).tolist())  # suffixes of a document are a range of places too
        for i, r in enumerate(rank):
            if r in begins:
                h = 0
                continue
            j = sa[r - 1]
            while t[i + h] == t[j + h]:
                h += 1
            lcp[r] = h
            if h:
                h -= 1
        rows, longest = [np.array(lcp, np.int32)], int(np.bincount(doc).max())
        while 2 << (len(rows) - 1) <= longest:
            half, before = 1 << (len(rows) - 1), rows[-1]
            row = before.copy()
            np.minimum(before[:-half], before[half:], out=row[:-half])
            rows.append(row)
        self.table = np.stack(rows)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, low], self.table[k, high - (1 << k) + 1]).astype(np.int64)


def runs_of(codes: np.ndarray, bounds: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, ...]:
    """doc, start, length and period of all runs of documents codes[bounds[k] : bounds[k + 1]], by doc, start, period."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    text = np.zeros(len(doc), np.int64)
    text[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes + 1
    ends = np.cumsum(sizes + 1) - 1
    _, rank = suffix_ranks(text, doc)
    places = np.arange(len(text))
    found = []
    # the leftmost root of a run goes on for so many words behind its first period
    least = min(max(shortest, exponent * q) - 2 * q + 1 for q in range(1, shortest + 1))
    for behind in (next_smaller(rank), next_smaller(len(rank) - 1 - rank)):
        i = places[behind <= ends[doc]]
        for k in range(max(1, least)):
            i = i[text[i + k] == text[behind[i] + k]]
        found.append((i, behind[i] - i))
    i, p = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(i):
        return (i,) * 4
    chosen = np.zeros(len(sizes), bool)
    chosen[doc[i]] = True
    # the documents with candidates alone: their words, and their words backwards, each with the sign at the end
    some = chosen[doc]
    shift = places - (np.cumsum(some) - 1)
    begin = (ends - sizes)[doc]
    back = np.where(text == 0, places, begin + (ends[doc] - 1 - places))
    small_doc = (np.cumsum(chosen) - 1)[doc[some]]
    ahead, behind = Extensions(text[some], small_doc), Extensions(text[back[some]], small_doc)
    forth = ahead.common(i - shift[i], i + p - shift[i])
    # what is before a place is, backwards, what follows the mirror of the place before it
    before = i > begin[i]
    a = back[i[before] - 1]
    left = np.zeros(len(i), np.int64)
    left[before] = behind.common(a - shift[i[before]], a - p[before] - shift[i[before]])
    start, length = i - left, left + p + forth
    ok = length >= np.maximum(shortest, exponent * p)
    rows = np.unique(np.stack([doc[i][ok], (start - begin[i])[ok], p[ok], length[ok]]), axis=1)
    return rows[0], rows[1], rows[3], rows[2]


def _rows(ids: list, texts: list[bytes], exponent: int, shortest: int) -> pa.RecordBatch:
    split = [t.split() for t in texts]
    sizes = [len(w) for w in split]
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    codes = pa.array([w for ws in split for w in ws], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc, start, length, period = runs_of(codes, bounds, exponent, shortest)
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN.value_type)),
    )
    over = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(over, bounds[doc] + start + period, 1)
    np.add.at(over, bounds[doc] + start + length, -1)
    kept = np.cumsum(over) == 0
    touched = set(doc.tolist())
    out = [b" ".join(compress(w, kept[bounds[k] : bounds[k + 1]].tolist()) if k in touched else w).decode() for k, w in enumerate(split)]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(out, pa.string())], schema=OUT_PA)


def periodic_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed for every row of docs(doc_id, text).

    Runs have `shortest` words and `exponent` (2 at least) periods or more; collapsed is the words joined by one space,
    without those that a run has behind its first period.  A null or wordless text has no runs and an empty collapsed;
    a null doc_id is kept; rows are judged one by one, so repeated rows stay; other columns are ignored.  A task
    holds one pass of documents, or one long document with about 30 words of memory for each of its words.
    """
    if exponent < 2:
        raise ValueError("the theorem is about runs of two periods or more")

    def f(batches):
        for b in batches:
            ids, texts, n = [], [], 0
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if texts and n + len(raw) > 6 * PASS:
                    yield _rows(ids, texts, exponent, shortest)
                    ids, texts, n = [], [], 0
                ids.append(d)
                texts.append(raw)
                n += len(raw)
            if texts:
                yield _rows(ids, texts, exponent, shortest)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(f, OUT)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a document whose CRC-32 of the decimal doc_id is divisible by 10 repeats a part of itself to its end.

    With g the rest of the CRC, word i of n from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    A document without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("_h"))
    rows = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    rows = rows.withColumns({"_n": F.size("_w").cast("long"), "_g": F.floor(F.col("_h") / 10)})
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rest = F.col("_n") - F.col("_a")
    rows = rows.withColumn("_p", (F.lit(1) + F.floor(rest / (F.lit(3) + F.col("_g") % 8))).cast("int"))
    a, n = F.col("_a").cast("int"), F.col("_n").cast("int")
    head = F.slice("_w", F.lit(1), a)
    again = F.flatten(F.array_repeat(F.slice("_w", a + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.concat(head, F.slice(again, F.lit(1), n - a)), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_planted_periods(read_documents(spark, sf_dir)))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))), 1)
    text = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best)).withColumn("lines", F.when(F.size("runs") > 0, F.concat(text, F.lit("\n"))).otherwise(""))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(F.lit(-1000) * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}

#: A run of period q, 2^(k-1) < q <= 2^k, is where a string of 2^k words comes again q words later and not before; strings
#: are named level by level, each from two of the level before.
ORACLE = {
    "op13_periodic_runs": f"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w, {sql_crc32("doc_id::varchar")} h from documents),
a as (select *, len(w) n, h // 10 g, (h // 10) % greatest(len(w), 1) a from d),
p as (select doc_id, case when h % 10 = 0 and n > 0 then list_concat(w[:a], list_transform(range(n - a), lambda i: w[a + i % (1 + (n - a) // (3 + g % 8)) + 1])) else w end w from a),
t as (select doc_id, unnest(w) w, unnest(range(len(w))) i from p),
s as (select 0 k, doc_id, i, md5(w) g from t
  union all select x.k + 1, x.doc_id, x.i, md5(x.g || y.g) from s x join s y on y.doc_id = x.doc_id and y.i = x.i + (1::bigint << x.k)),
n as (select k, doc_id, i, lead(i) over (partition by k, doc_id, g order by i) - i q from s),
o as (select *, i - row_number() over (partition by k, doc_id, q order by i) o from n where q <= (1::bigint << k) and 2 * q > (1::bigint << k)),
r as (select doc_id, min(i) s, max(i) - min(i) + q + (1::bigint << k) l, q from o group by k, doc_id, q, o having max(i) - min(i) + q + (1::bigint << k) >= greatest(6, 4 * q)),
b as (select *, row_number() over (partition by doc_id order by l desc, s, q) nr from r),
f as (select doc_id, count(*) n_runs, max(s) filter (where nr = 1) s, max(l) filter (where nr = 1) l, max(q) filter (where nr = 1) q, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) lines from b group by doc_id),
gone as (select distinct t.doc_id, t.i from t join r on r.doc_id = t.doc_id and t.i >= r.s + r.q and t.i < r.s + r.l),
kept as (select t.doc_id, string_agg(t.w, ' ' order by t.i) c from t anti join gone using (doc_id, i) group by t.doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint n_runs, s::bigint as "start", l::bigint length, q::bigint period, (1000 * l // q)::bigint exponent_milli,
sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(c, '')) collapsed_sha256 from d left join f using (doc_id) left join kept using (doc_id)
"""
}
