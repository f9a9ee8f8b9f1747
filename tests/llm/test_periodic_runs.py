import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestore.llm import periodic_runs as m


def brute(words, exponent, shortest):
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= max(shortest, exponent * q) and not any(s <= i and i + length <= s + w and q % r == 0 for (s, r), w in out.items()):
                    out[i, q] = length
            i = max(j, i + 1)
    return sorted((s, w, q) for (s, q), w in out.items())


def collapsed(words, runs):
    return " ".join(w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs))


def some_words(r):
    n = r.randrange(0, 90)
    words = [r.choice("abc") for _ in range(n)]
    for _ in range(r.randrange(0, 3)):
        root = [r.choice("ab") for _ in range(r.randrange(1, 8))]
        at = r.randrange(0, n + 1)
        words[at:at] = (root * r.randrange(3, 8))[r.randrange(0, 3) :]
    return words


@pytest.mark.parametrize(("exponent", "shortest"), [(4, 6), (2, 2), (3, 9)])
def test_runs_against_brute_force(exponent, shortest):
    r = random.Random(exponent)
    docs = [some_words(r) for _ in range(250)] + [[], ["a"], ["a"] * 40, list("ab") * 30, list("abacabad") * 9, list("aab" * 3 + "aac") * 4]
    codes = np.array([ord(w) - 97 for d in docs for w in d])
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    doc, start, length, period = m.runs_of(codes, bounds, exponent, shortest)
    got = [[] for _ in docs]
    for d, *row in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[d].append(tuple(row))
    assert got == [brute(d, exponent, shortest) for d in docs]


def test_next_smaller_with_long_falls():
    r = random.Random(1)
    for rank in ([0, *range(300, 0, -1)], list(range(200)), r.sample(range(500), 500), [0, *range(90, 50, -1), 45, *range(49, 46, -1), *range(44, 0, -1)]):
        a = np.array(rank)
        assert m.next_smaller(a).tolist() == [next((j for j in range(i + 1, len(a)) if a[j] < a[i]), len(a)) for i in range(len(a))]


def planted(d, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if d is None else zlib.crc32(str(d).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(d, text):
    words = planted(d, text)
    runs = brute(words, 4, 6)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (d, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "PASS", 300)
    r = random.Random(4)
    rows = [(d, r.choice([" ", "\n", "\t\v"]).join(some_words(r) or ["é\x00x"])) for d in range(300)]
    rows += [(900, None), (901, ""), (902, " \x0b\x0c "), (None, "ü " * 20), (None, "ü " * 20), (903, "a b " * 3000), (903, "a b " * 3000), (904, "x" * 9000), (-5, "z z z z z z"), (905, "a a " * 8)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, runs int, _n string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, m.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    small = [x for x in rows if len(x[1] or "") < 9000]
    assert [g for g in got if g[0] not in (903, 904)] == sorted((expected(*x) for x in small), key=str)
    assert [g[1:6] for g in got if g[0] == 903 and zlib.crc32(b"903") % 10] == [(1, 0, 6000, 2, 3_000_000)] * 2


def test_empty_table_and_exponent(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.periodic_runs(df).collect() == []
    with pytest.raises(ValueError):
        m.periodic_runs(df, exponent=1)
