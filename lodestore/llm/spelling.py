"""Spelling variants: words one edit apart, by a trie self-join with active-node sets.

Two words one edit apart share what is before the edit and what is behind it.  The place of the edit lies in one of
two halves of the shorter word, so words are dealt to tries by what must then be equal: the first half (edit in
the second), or the last half (edit in the first).  Words of one length meet their equals and those one longer.

In a trie every node has its active nodes: those whose strings are at most one edit away, with the distance.  A
child's active nodes follow from its parent's: the same nodes one further away, their children one further away, and
at the same distance the children by the same letter, with what one more letter reaches.  Terminal nodes that are
active for one another at distance one are the pairs.

A trie with more than GROUP words is split by the same rule: halves of the interval in which the edit may lie.  An
interval of one place is not split; its words differ in two letters at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import read_documents
from lodestore.llm.graph import joined_evenly
from lodestore.session import shared_folder

#: Words of a trie; larger ones are split, without a change of the result.
GROUP = 20_000
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typos are put into runs whose hash this divides.
TYPO = 199
PAIRS_PA = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
PAIRS = "word string, near string, near_n long"


def letter_runs(docs: DataFrame, shortest: int = 6) -> DataFrame:
    """doc_id and run: the maximal runs of letters with `shortest` letters or more, A-Z in lower case.  A null text has none."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"([{LETTERS}]{{{shortest},}})"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(runs).alias("run"))


def with_typos(runs: DataFrame) -> DataFrame:
    """word: the run without one letter if 199 divides the CRC-32 of `<doc_id>:<run>`, else the run; a null doc_id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    k = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % TYPO == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n: the distinct words of `shortest` code points or more that occur at least `least` times."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Trie:
    """A trie of distinct strings; nodes are numbered parents first."""

    def __init__(self, strings: list[str]):
        self.children, self.end = [{}], [-1]
        for k, s in enumerate(strings):
            v = 0
            for c in s:
                w = self.children[v].get(c)
                if w is None:
                    w = self.children[v][c] = len(self.children)
                    self.children.append({})
                    self.end.append(-1)
                v = w
            self.end[v] = k

    def step(self, active: dict[int, int], letter: str) -> dict[int, int]:
        """Active nodes of the child by this letter, from those of its parent."""
        out = {}
        for u, d in active.items():
            below = self.children[u]
            if d == 0:
                out.setdefault(u, 1)
                for w in below.values():
                    out.setdefault(w, 1)
            w = below.get(letter)
            if w is not None:
                out[w] = d if d < out.get(w, 2) else out[w]
                if d == 0:
                    for x in self.children[w].values():
                        out.setdefault(x, 1)
        return out

    def pairs(self):
        """Numbers of strings at distance one, the smaller node first."""
        todo = [(0, {0: 0} | dict.fromkeys(self.children[0].values(), 1))]
        while todo:
            v, active = todo.pop()
            if self.end[v] >= 0:
                for u, d in active.items():
                    if d == 1 and u > v and self.end[u] >= 0:
                        yield self.end[v], self.end[u]
            for letter, w in self.children[v].items():
                todo.append((w, self.step(active, letter)))


def _shared(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def near_in_group(words: list[str], shorter: int, low: int, high: int):
    """Numbers of the pairs whose edit lies in [low, high) of the shorter one, which has `shorter` letters."""
    end = max(0, shorter - high)
    middle = [w[low : len(w) - end] for w in words]
    for a, b in Trie(middle).pairs():
        if min(len(words[a]), len(words[b])) == shorter and low + _shared(middle[a], middle[b]) < high:
            yield a, b


def _joins(batches):
    """Pairs, both ways, of rows (key, word, times, m, low, high) that come sorted by key."""
    rest = None

    def pairs(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        words, times = rows.column("word").to_pylist(), rows.column("times").to_pylist()
        m, low, high = (rows.column(c).to_numpy() for c in ("m", "low", "high"))
        out = [[], [], []]
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i > 1:
                for a, b in near_in_group(words[i:j], int(m[i]), int(low[i]), int(high[i])):
                    for x, y in ((a + i, b + i), (b + i, a + i)):
                        for column, value in zip(out, (words[x], words[y], times[y]), strict=True):
                            column.append(value)
        return pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], schema=PAIRS_PA)

    def bounds_of(rows: pa.Table) -> np.ndarray:
        key = rows.column("key").combine_chunks().dictionary_encode()
        key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
        code = key.indices.to_numpy()
        return np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))

    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        bounds = bounds_of(rows)
        yield pairs(rows, bounds[:-1])
        rest = rows.slice(int(bounds[-2]))
    if rest is not None:
        yield pairs(rest, bounds_of(rest))


def _dealt(rows: DataFrame, intervals: Column) -> DataFrame:
    """Rows (word, times, m) once for each interval of the edit, with the key of what is equal around it."""
    rows = rows.withColumn("i", F.explode(intervals)).select("word", "times", "m", "i.low", "i.high")
    end = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    head, tail = F.substring("word", F.lit(1), F.col("low")), F.substring("word", F.length("word") - end + 1, end)
    return rows.withColumn("key", F.concat_ws(":", "m", "low", "high", head, tail))


def _halves(low: Column, high: Column) -> Column:
    mid = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), mid.alias("high")), F.struct(mid.alias("low"), high.alias("high")))


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, near, near_n: the words of vocab(word, n) that differ by one inserted, deleted or replaced code point, both ways, each pair once."""
    spark = vocab.sparkSession
    shared_folder(spark)
    length = F.length("word")
    rows = vocab.select("word", F.col("n").alias("times"), F.explode(F.array(length, length - 1)).alias("m")).where("m > 0")
    # the first half of a word of m letters has m / 2; one more place behind the last letter
    half = F.floor(F.col("m") / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("m") + 1).alias("high")))
    rows, out = _dealt(rows, F.filter(both, lambda i: i.low < i.high)), None
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
        total = rows.count()
        sized = joined_evenly(rows, sizes, "key", total)
        whole = (F.col("size") <= GROUP) | (F.col("high") - F.col("low") == 1)
        small = sized.where(whole).drop("size")
        out = small if out is None else out.unionByName(small)
        large = sized.where(~whole).checkpoint()
        if large.isEmpty():
            break
        rows = _dealt(large.select("word", "times", "m", "low", "high"), _halves(F.col("low"), F.col("high"))).checkpoint()
    return out.select("key", "word", "times", "m", "low", "high").repartition("key").sortWithinPartitions("key").mapInArrow(_joins, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms(word, form) ends, for words that have a form; counts grow along forms, so there are no circles."""
    now = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")).checkpoint()
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(vocab: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of vocab(word, n), whose words are distinct.

    form is the near word of largest n (ties: the smallest in code-point order) if that is at least ratio times the
    word's, root the end of the chain of forms.  Null words are no words; an empty table gives an empty one; other columns
    are ignored.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    shared_folder(vocab.sparkSession)
    vocab = vocab.select("word", F.col("n").cast("long").alias("n")).where("word is not null").checkpoint()
    near = near_pairs(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = -F.col("best.less") >= ratio * F.col("n")
    found = vocab.join(near, "word", "left").select(
        "word", F.when(form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, -F.col("best.less")).alias("form_n")
    )
    found = found.checkpoint()
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(with_typos(letter_runs(read_documents(spark, sf_dir)))))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}

#: One step of CRC-32 for each of eight bits.
CRC_STEP = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of a text."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda c, b: {CRC_STEP}), 4294967295)"


ORACLE = {
    "op12_spelling_variants": f"""
with recursive r as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) run from documents),
h as (select run, {sql_crc32("coalesce(doc_id::varchar, '') || ':' || run")} h from r where length(run) >= 6),
w as (select case when h % 199 = 0 then run[: (h % length(run))] || run[(h % length(run)) + 2 :] else run end word from h),
v as (select word, count(*) n from w where length(word) >= 6 group by word having count(*) >= 5),
cut as (select word, n, i, word[: i] a, word[i + 2 :] b from v, unnest(range(length(word))) t(i)),
near as (
  select x.word, y.word near, y.n from cut x join cut y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select c.word, v.word, v.n from cut c join v on v.word = c.a || c.b
  union select v.word, c.word, c.n from cut c join v on v.word = c.a || c.b),
best as (select word, count(*) n_near, arg_min(near, (-n, near)) near, max(n) near_n from near group by word),
f as (select v.word, case when near_n >= 5 * n then near end form, n, coalesce(n_near, 0) n_near, case when near_n >= 5 * n then near_n end form_n from v left join best using (word)),
chain as (select word, word root, form up from f union all select chain.word, f.word, f.form from chain join f on f.word = chain.up)
select f.word, f.form, chain.root, f.n::bigint n, f.n_near::bigint n_near, f.form_n::bigint form_n from f join chain on chain.word = f.word and chain.up is null
"""
}
