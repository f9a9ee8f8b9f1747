import random
import re
import zlib
from collections import Counter

import pytest

from lodestore.llm import spelling as m


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(vocab, ratio=5):
    near = {w: [x for x in vocab if one_edit(w, x)] for w in vocab}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * vocab[w] else None
    out = []
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, vocab[w], len(near[w]), vocab[form[w]] if form[w] else None))
    return sorted(out)


def some_vocabulary(seed, lengths=(1, 12)):
    r = random.Random(seed)
    words = set()
    for _ in range(40):
        w = "".join(r.choice("abéz") for _ in range(r.randrange(*lengths)))
        words.add(w)
        for _ in range(r.randrange(0, 8)):
            k = r.randrange(len(w) + 1)
            words.add(r.choice([w[:k] + r.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + "a" + w[k + 1 :]]) or "a")
    return {w: r.choice([5, 6, 25, 30, 150, 700]) for w in sorted(words)}


@pytest.mark.parametrize("group", [20_000, 3])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP", group)
    vocab = some_vocabulary(group)
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in vocab.items()], "word string, n long, key string, low int")
    assert sorted(map(tuple, m.spelling_variants(df).collect())) == brute(vocab)


def test_tries_alone():
    words = sorted(some_vocabulary(9))
    got = {(words[a], words[b]) for a, b in m.Trie(words).pairs()}
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len({frozenset(p) for p in got})


def expected(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(m.UPPER, m.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    return brute({w: n for w, n in count.items() if n >= 5 and len(w) >= 6})


def test_query(spark, tmp_path):
    r = random.Random(2)
    vocab = [w for w in some_vocabulary(4, (5, 12))] + ["Straße", "STRASSE", "Über×weg", "naïveté", "rosinen"]
    rows = [(d, r.choice([" ", ", ", "1"]).join(r.choice(vocab[: r.randrange(1, len(vocab))]) for _ in range(120))) for d in range(150)]
    rows += [(200, None), (201, ""), (None, "null identity " * 9), (None, "null identity " * 9), (202, "x" * 9000), (203, "longer " * 5000), (204, "sixsix\U0001d400sixsix " * 5)]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, run int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, m.op12_spelling_variants(spark, str(tmp_path)).collect()))
    assert got == expected(rows) and any(x[1] for x in got)


def test_chains(spark):
    vocab = {"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdefg": 200, "abcdefgh": 5000, "abcdegh": 1000, "zzzzzz": 9}
    got = sorted(map(tuple, m.spelling_variants(spark.createDataFrame(list(vocab.items()), "word string, n long")).collect()))
    assert got == brute(vocab)
    assert ("abcdef", "abcdefg", "abcdefgh", 5, 3, 200) in got


def test_empty(spark):
    assert m.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        m.spelling_variants(spark.createDataFrame([], "word string, n long"), ratio=1)
