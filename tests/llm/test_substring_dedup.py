import hashlib
import random
import re

from lodestore.llm.substring_dedup import ladder, substring_dedup


def brute(rows, n):
    words = [[x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for _, t in rows]
    first = {}
    big = 1 << 62
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, big), big if d is None else d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (big if d is None else d):
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed=3):
    r = random.Random(seed)
    vocab = ["a", "bb", "Ccc", "dé", "über", "f."]
    common = [" ".join(r.choice(vocab) for _ in range(40)) for _ in range(3)]
    rows = []
    for d in range(120):
        t = " ".join(r.choice(vocab) for _ in range(r.randrange(0, 60)))
        if r.random() < 0.5:
            t += "\n" + r.choice(common) + "\v " + " ".join(r.choice(vocab) for _ in range(5))
        rows.append((d * 7 % 113, t))
    return rows + [(500, None), (501, ""), (502, "\x0b\x0c  "), (None, common[0]), (None, common[0]), (503, common[1] * 300), (503, common[1] * 300), (504, "x" * 5000), (505, "a " * 4000)]


def test_against_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, b"", 1) for d, t in rows], "doc_id long, text string, data binary, block int")
    for n in (13, 5, 2):
        assert sorted(map(tuple, substring_dedup(df, n).collect()), key=str) == brute(rows, n)


def test_text_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x\n b c d y")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring_dedup(df, 3, with_text=True).collect()}
    assert got == {1: "a b c d e", 2: "x y"}
    assert substring_dedup(df.limit(0)).collect() == []


def test_ladder_doubles():
    assert ladder(13) == [4, 7, 13]
    assert ladder(50) == [4, 7, 13, 25, 50]
    assert ladder(3) == [3]
    assert all(b <= 2 * a for n in range(1, 200) for a, b in zip(ladder(n), ladder(n)[1:]))


def test_long_windows(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup(df, 37).collect()), key=str) == brute(rows, 37)


def test_long_words_with_equal_power_sums(spark):
    """Words of 1,024 letters and more whose sums of powers agree, whatever the base, are different words."""
    for n in (1024, 2048, 8192):
        x = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        y = x.translate(str.maketrans("ab", "ba"))
        tail = " ".join(f"w{k}" for k in range(12))
        for a, b in ((x, y), (y, x)):
            rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")]
            got = sorted(map(tuple, substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
            assert got == brute(rows, 13) and [g[2] for g in got] == [0, 0, 13]
