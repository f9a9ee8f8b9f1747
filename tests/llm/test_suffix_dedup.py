import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestore.llm import suffix_dedup as suffix_dedup_module
from lodestore.llm.suffix_dedup import deep_shallow, multikey_quicksort, runs_of, suffix_dedup


def brute(rows, n):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = []
    for (d, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed=3):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcé \n") for _ in range(n))
    common = [some(60), some(90), "ab" * 40, "a" * 70]
    rows = []
    for d in range(80):
        t = some(r.randrange(0, 120))
        for _ in range(r.randrange(0, 3)):
            t += r.choice(common)[r.randrange(8) :] + some(r.randrange(0, 30))
        rows.append((d, t))
    return rows + [(200, None), (201, ""), (None, common[0]), (None, common[0]), (202, common[1] * 20), (202, common[1] * 20), (203, "z" * 3000), (204, some(3000))]


@pytest.mark.parametrize(("length", "hot"), [(40, 10_000), (40, 5), (17, 10_000), (64, 0), (17, 2)])
def test_against_brute_force(spark, length, hot):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int")
    assert sorted(map(tuple, suffix_dedup(df, length, hot=hot).collect()), key=str) == brute(rows, length)


def test_spans_and_empty(spark):
    df = spark.createDataFrame([(1, "0123456789abcdef"), (2, "x0123456789y")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept_bytes), [tuple(s) for s in r.spans]) for r in suffix_dedup(df, 10, with_text=True).collect()}
    assert got == {1: (b"abcdef", [(0, 10)]), 2: (b"xy", [(1, 11)])}
    assert suffix_dedup(df.limit(0)).collect() == []


def test_deep_shallow_sorts():
    r = np.random.default_rng(1)
    for alphabet, n, length in ((1, 200, 50), (2, 800, 64), (2, 3000, 33), (4, 2000, 17), (200, 500, 100)):
        buf = r.integers(0, alphabet, n + length).astype(np.uint8)
        buf[n // 2 : n // 2 + n // 4] = buf[: n // 4]
        at = r.permutation(n)
        group = r.integers(0, 2, n)
        order, number = deep_shallow(buf, at, group, length)
        keys = [(int(group[i]), buf[at[i] : at[i] + length].tobytes()) for i in order]
        assert keys == sorted(keys)
        assert all((keys[i] == keys[i - 1]) == (number[i] == number[i - 1]) for i in range(1, n))


def test_multikey_quicksort_alone():
    r = np.random.default_rng(2)
    for depth in (1, 2, 3):
        c = r.integers(0, 4, (500, depth)).astype(np.uint64)
        group = r.integers(0, 3, 500)
        order, start = multikey_quicksort(lambda which, k: c[which, k], group, depth)
        keys = [(int(group[i]), *c[i].tolist()) for i in order]
        assert keys == sorted(keys)
        assert [keys.index(k) for k in keys] == start.tolist()


def test_long_text_is_cut_into_slices_that_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup_module, "SEGMENT", 64)
    r = random.Random(8)
    t = "".join(r.choice("abcdefgh") for _ in range(500))
    bounds = np.array([0, 500, 520, 1020])
    data = (t + "x" * 20 + t).encode()
    buf = np.frombuffer(data, np.uint8)
    found = runs_of(buf, bounds, 40, 20)
    starts = sorted(x for a, b in zip(found["low"], found["high"]) for x in range(a, b + 1))
    assert starts == [*range(461), *range(520, 981)]
    for row in found:
        grams = {data[i : i + 20] for i in range(row["low"], row["high"] + 21)}
        assert data[row["seed"] : row["seed"] + 20] in grams


def test_hashes_are_believed_only_if_the_bytes_agree():
    data = [b"a", b"b", b"a", b"c", b"b", b"d", b"d"]
    new = np.array([True, False, False, False, False, True, False])
    order, first = suffix_dedup_module.told_apart(new, lambda i: data[i])
    classes = np.cumsum(first)
    assert sorted(order.tolist()) == list(range(7))
    assert {(a, b) for a in range(7) for b in range(7) if classes[a] == classes[b]} == {(a, b) for a in range(7) for b in range(7) if data[order[a]] == data[order[b]]}


def test_contexts_of_a_block_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(suffix_dedup_module.Slices, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    r = random.Random(6)
    core = "".join(r.choice("abcdefgh") for _ in range(30))
    texts = [core + "xy", core + "xz", core + "xy", core + "xw", core + "xz"]
    rows = []
    for k, t in enumerate(texts):
        b = np.frombuffer(t.encode(), np.uint8)
        rows.append({"block": 0, "doc_id": k, "text": t, "runs": runs_of(b, np.array([0, len(b)]), 24, 12).tobytes()})
    block = suffix_dedup_module.Block(pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("runs", pa.binary())])), 24)
    content = [bytes(block.texts.bytes[a : b + 24]) for a, b in zip(block.low.tolist(), block.high.tolist())]
    pairs = zip(block.number.tolist(), content)
    assert len({c for _, c in zip(block.number.tolist(), content)}) == len(set(pairs)) == block.n
