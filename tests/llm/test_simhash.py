import random

import xxhash

from lodestore.llm.simhash import simhash_components


def brute(rows):
    fps = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for k, (d, t) in enumerate(rows):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (t or "").translate(low)) if x]
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        fps[k] = fp
        out.append((d, f"{fp:016x}"))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                if x != y:
                    parent[x] = y
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, f, least.get(find(k))) for k, (d, f) in enumerate(out)), key=str)


def rows_of(seed=5):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "über", "o", "x1", "no"]
    base = [" ".join(r.choice(words) + str(r.randrange(30)) for _ in range(r.randrange(1, 120))) for _ in range(25)]
    rows = []
    for d in range(160):
        t = r.choice(base).split()
        for _ in range(r.randrange(0, 3)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((d, " \t".join(t)))
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1003, "one"), (1004, "One two"), (None, "lonely text of a kind"), (1005, base[0] * 200)]


def test_against_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    assert sorted(map(tuple, simhash_components(df).collect()), key=str) == brute(rows)


def test_large_groups_are_split(spark, monkeypatch):
    import lodestore.llm.simhash as m

    monkeypatch.setattr(m, "GROUP", 8)
    rows = rows_of(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash_components(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
