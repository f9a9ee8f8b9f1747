import hashlib
import random

import numpy as np

from lodestore.llm.winnow import fingerprints, likeness, winnow


def naive(text, gram, window):
    """Winnowing over hashes taken from the operator's own grams, one window at a time."""
    from lodestore.llm.common import U, doubled, mix

    if not text:
        return []
    p = np.array([ord(c) for c in text], np.uint32)
    h = doubled(mix(p.astype(U) + U(0x7F4A7C15)), 1, min(gram, len(p))).tolist()
    w = min(window, len(h))
    kept = set()
    for i in range(len(h) - w + 1):
        low = min(x >> 28 for x in h[i : i + w])
        kept.add(max(j for j in range(i, i + w) if h[j] >> 28 == low))
    return [(h[j] >> 32, j) for j in sorted(kept)]


def test_winnow_keeps_rightmost_minimum():
    r = random.Random(1)
    for n in (0, 1, 3, 4, 5, 11, 12, 200):
        for alphabet in ("a", "ab", "abcdéf"):
            t = "".join(r.choice(alphabet) for _ in range(n))
            h, at = winnow(t, 4, 8)
            assert list(zip(h.tolist(), at.tolist())) == naive(t, 4, 8)


def test_shared_passage_is_found():
    r = random.Random(2)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        p = some(4 + 8 - 1)
        a, b = winnow(some(30) + p + some(20), 4, 8)[0], winnow(some(9) + p + some(40), 4, 8)[0]
        assert len(np.intersect1d(a, b))


def rows_of():
    r = random.Random(4)
    rows = [(d * 3 % 101, "".join(r.choice("abcdé f\n") for _ in range(r.randrange(0, 300)))) for d in range(90)]
    return rows + [(200, None), (201, ""), (None, "zz" * 40), (202, "same"), (202, "same"), (202, "other"), (203, "x" * 50000)]


def test_query_columns(spark):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, 0, True) for d, t in rows], "doc_id long, text string, key int, look boolean")
    got = sorted(map(tuple, fingerprints(df, 4, 8).collect()), key=str)
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        fp = [naive(x, 4, 8) for x in (t, e, after)]
        sets = [{h for h, _ in x} for x in fp]
        near = [len(sets[0] & x) / len(sets[0] | x) if sets[0] | x else 1.0 for x in sets[1:]]
        enc = [",".join(f"{h:08x}@{p}" for h, p in x) for x in fp]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), enc[0], enc[1], *near))
    assert got == sorted(want, key=str)


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    r = fingerprints(df, 2, 2).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints(df.limit(0)).collect() == []
    assert likeness(np.zeros(0), np.array([1])) == 0.0


def test_short_near_copies_share_hashes():
    from lodestore.llm.winnow import edited

    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for n in range(31, 160):
        text = some(n)
        a, b = winnow(text)[0], winnow(edited(text, some(n)))[0]
        assert len(np.intersect1d(a, b)), n
        assert n < 60 or len(a) >= 3
