import random
import re

import numpy as np
import pytest

from lodestore.llm import minhash as m

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(ASCII)) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(s), least.get(find(k)), d == least.get(find(k))) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def rows_of(seed, groups=12, members=14):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("al", "be", "Ga", "dé", "e") for b in range(40)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randrange(8, 200))]
        for _ in range(r.randrange(1, members)):
            w = list(base)
            # edits in few places leave similarities on both sides of the threshold
            for _ in range(r.randrange(0, 1 + len(w) // 50)):
                w[r.randrange(len(w))] = r.choice(vocab)
            w = w[r.randrange(0, 3) :] + [r.choice(vocab) for _ in range(r.randrange(0, 3))]
            rows.append((r.randrange(10_000), " ".join(w)))
    common = " ".join(r.choice(vocab) for _ in range(60))
    rows += [(20_000 + d, common + " " + " ".join(r.choice(vocab) for _ in range(r.randrange(1, 60)))) for d in range(40)]
    odd = [None, "", " \x0b\x0c ", "one", "One", "a b c d", "A\tb  c d", "a b c d e", "a b c d f", "x" * 9000, "same words " * 2000]
    return rows + [(30_000 + k, t) for k, t in enumerate(odd)] + [(None, "of no id at all here"), (None, rows[0][1]), (None, None), rows[3], rows[3], (40_000, "b c d e f " * 3), (40_001, "b c d e f " * 3 + "b")]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 3), ("MANY", 4), ("SALT", 2)):
            monkeypatch.setattr(m, name, value)
    rows = rows_of(1 + small)
    df = spark.createDataFrame([(d, t, 0, "x", 1) for d, t in rows], "doc_id long, text string, id int, mark string, n int")
    assert sorted(map(tuple, m.minhash_components(df).collect()), key=str) == brute(rows)


def test_blocks_alone(spark, monkeypatch):
    """Without checks against single members, all links come from blocks."""
    monkeypatch.setattr(m, "BLOCK", 3)
    monkeypatch.setattr(m, "ROUNDS", 1)
    rows = rows_of(5, groups=6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, m.minhash_components(df).collect()), key=str) == brute(rows)


def test_guarantee_of_the_index():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 16, (4000, m.VALUES), dtype=np.uint16)
    b = a.copy()
    for k in range(len(b)):
        at = r.choice(m.VALUES, 2 * m.CHUNKS - 1, replace=False)
        b[k, at] ^= np.uint16(1)
    shared = m.first_shared(a, b)
    differ = (a != b).reshape(-1, m.CHUNKS, m.WIDTH)
    for k, s in enumerate(shared):
        c, j = divmod(int(s), m.WIDTH)
        assert differ[k, c].sum() <= 1 and not np.delete(differ[k, c], j).any()
        assert all(differ[k, e].sum() > 1 for e in range(c))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(4)
    off = []
    for _ in range(300):
        x = r.integers(0, 1 << 63, 230, dtype=np.uint64)
        off.append((m.signature(x[:215]) != m.signature(x[15:])).mean())
    # 200 of 230 are shared
    assert abs(np.mean(off) - 30 / 230) < 0.01
    assert m.FAR >= 22


def test_empty_table(spark):
    assert m.minhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_set_goes_to_a_block_once_however_many_pairs_it_is_in(monkeypatch):
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[r.random(200) < 0.93], r.integers(0, 1 << 63, 6, dtype=np.uint64)))) for _ in range(60)]
    sig = [m.signature(base).tobytes()] * 60
    n = [len(x) for x in sets]
    rows = m.pa.record_batch([[7 << 6] * 60, [0] * 60, [2] * 60, list(range(60)), list(range(60)), n, sig], names=["key", "part", "side", "id", "label", "n_shingles", "sig"])
    for work in (1 << 22, 3000):
        monkeypatch.setattr(m, "WORK", work)
        pairs = m.pa.Table.from_batches([*m._compared([rows.slice(0, 25), rows.slice(25)])])
        blocks = pairs.column("block").to_pylist()
        assert pairs.num_rows == sum(100 * min(a, b) >= 85 * max(a, b) for k, a in enumerate(n) for b in n[:k])
        assert len(set(blocks)) == (1 if work > 3000 else -(-sum(n[u] + n[v] for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist())) // work))
        found = []
        for b in set(blocks):
            mine = pairs.filter(m.pa.array([x == b for x in blocks]))
            ids = sorted({*mine.column("u").to_pylist(), *mine.column("v").to_pylist()})
            members = m.pa.table({"at": [b] * len(ids), "id": ids, "shingles": [sets[k].view(np.int64) for k in ids]})
            got = m._similar(mine, members)
            found += zip(got.column("u").to_pylist(), got.column("v").to_pylist())
        want = [(u, v) for u in range(60) for v in range(u + 1, 60) if 100 * (both := len(np.intersect1d(sets[u], sets[v]))) >= 85 * (n[u] + n[v] - both)]
        assert sorted(found) == want and 0 < len(want) < pairs.num_rows


def test_small_tables_have_few_partitions(spark):
    from lodestore.llm.graph import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 7], "u long, v long").repartition(8)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = components(edges)
        assert found.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, found.collect())) == sorted((k + 1, k - k % 7 + 1) for k in range(40) if k % 7)


def test_bins_never_rule_out_a_link():
    r = np.random.default_rng(7)
    for n in (7, 150, 300, 1000, 9000, 1_200_000):
        base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for part in (0.5, 0.8, 0.9, 0.99):
            a = base[r.random(len(base)) < part]
            b = np.unique(np.concatenate((base[r.random(len(base)) < part], r.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
            x, y = m.bins(a).tobytes(), m.bins(b).tobytes()
            differ = len(np.setxor1d(a, b))
            assert m.apart(x, [y, x, y]).tolist() == [k := int(m.apart(y, [x])[0]), 0, k]
            assert k <= differ and (n > 1000 or n < 150 or k > differ / 2)


def test_near_copies_below_the_threshold_are_few_pairs(spark, monkeypatch):
    """Copies of one text, each with edits of its own, share keys with each other but few links."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for d in range(160):
        w = list(base)
        for k in r.sample(range(150), r.randrange(1, 6)):
            w[k] = f"x{r.randrange(10**9)}"
        rows.append((d, " ".join(w)))
    made, confirmed = [], m.confirmed_in_blocks
    monkeypatch.setattr(m, "confirmed_in_blocks", lambda pairs, bodies: (made.append(pairs.count()), confirmed(pairs, bodies))[1])
    got = m.minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert made[0] <= len(rows) < len({x.component_id for x in got}) ** 2 / 2


def test_nearest_makes_a_row_a_member_at_most():
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[r.random(200) < 0.96], r.integers(0, 1 << 63, 4, dtype=np.uint64)))) for _ in range(50)]
    n, sig = [len(x) for x in sets], [m.signature(x) for x in sets]
    label = [k % 5 for k in range(50)]
    for side in ([2] * 50, [k % 2 for k in range(50)]):
        rows = [m.pa.record_batch([[key] * 50, [0] * 50, side, list(range(50)), label, n, [x.tobytes() for x in sig]], names=["key", "part", "side", "id", "label", "n_shingles", "sig"]) for key in range(m.VALUES)]
        pairs = m.pa.Table.from_batches([*m._compared(rows)])
        near = m.pa.Table.from_batches([*m._nearest(rows)])
        far = {}
        for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist()):
            d = int((sig[u] != sig[v]).sum())
            far |= {x: min(d, far.get(x, 99)) for x in (u, v)}
        got = {}
        for x in near.to_pylist():
            assert x["w"] == label[x["v"]] != label[x["u"]] and x["d"] == (sig[x["u"]] != sig[x["v"]]).sum()
            got[x["u"]] = min(x["d"], got.get(x["u"], 99))
        assert got == far and near.num_rows < pairs.num_rows


def test_nearest_first(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("ROUNDS", 1), ("CROWD", 1)):
        monkeypatch.setattr(m, name, value)
    rows = rows_of(3, groups=6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, m.minhash_components(df).collect()), key=str) == brute(rows)
