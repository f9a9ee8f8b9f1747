import random
import zlib

import numpy as np
import pytest

from lodestore.llm.packing import fitted, pack, pack_documents, patterns, plan, plan_in_order
from lodestore.llm.tokens import BYTE_BPE, encoder


def check(counts, sequence):
    p = plan(counts, sequence)
    used = np.zeros(len(counts), np.int64)
    for r, n in zip(p.rows, p.repeats):
        assert 0 < r.sum() <= sequence and n > 0
        for v in r[r > 0]:
            used[v] += n
    assert (used == counts).all()
    return int(p.repeats.sum())


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    r = np.random.default_rng(seed)
    sequence = 256
    counts = np.bincount(np.minimum(r.gamma(1 + seed, 50, 20000).astype(int) + 1, sequence), minlength=sequence + 1)
    total = (counts * np.arange(sequence + 1)).sum()
    assert check(counts, sequence) <= 1.02 * max(total / sequence, counts[sequence // 2 + 1 :].sum()) + 2


def test_plan_edges():
    assert check(np.zeros(9, np.int64), 8) == 0
    assert check(np.array([0, 0, 0, 0, 0, 5, 0, 0, 0]), 8) == 5
    assert check(np.array([0, 1000, 0, 0, 0, 0, 0, 0, 3]), 8) == 128
    one = np.zeros(1025, np.int64)
    one[341], one[683] = 10**9, 10**9
    assert check(one, 1024) <= 1.01 * 10**9


@pytest.mark.parametrize("scale", [1, 20])
def test_windows_keep_the_order_and_cost_few_sequences(scale):
    r = np.random.default_rng(scale)
    lengths = np.minimum(r.gamma(1.3, 330, 1000 * scale).astype(int) + 1, 1024)
    window = np.arange(len(lengths)) * 16 // len(lengths)
    counts = np.zeros((16, 1025), np.int64)
    np.add.at(counts, (window, lengths), 1)
    p, one = plan_in_order(counts, 1024), plan(counts.sum(axis=0), 1024)
    used, upto, at = np.zeros(1025, np.int64), counts.cumsum(axis=0), []
    served = [np.flatnonzero(lengths == v) for v in range(1025)]
    for row, n in zip(p.rows, p.repeats):
        for _ in range(int(n)):
            ranks = []
            for v in row[row > 0]:
                ranks.append(served[v][used[v]])
                used[v] += 1
            at.append(min(ranks))
    assert (used == counts.sum(axis=0)).all() and (used <= upto[-1]).all()
    assert p.repeats.sum() <= 1.01 * one.repeats.sum() + 1
    order = np.argsort(np.argsort(at))
    assert np.corrcoef(order, np.arange(len(at)))[0, 1] >= 0.95


def test_least_squares_is_non_negative_and_close():
    counts = np.zeros(101, np.float64)
    counts[[30, 70, 50]] = 100, 100, 80
    rows = patterns(np.array([30, 50, 70]), 100)
    x = fitted(rows, counts)
    used = sum(np.bincount(rows[:, k], x, 101) for k in range(3))
    assert (x >= 0).all() and np.abs(used - counts)[[30, 50, 70]].max() < 3


def test_query(spark):
    r = random.Random(4)
    e = encoder(BYTE_BPE)
    rows = [(d, " ".join(r.choice(["a", "word", "Ünd", "xyzzy\n"]) for _ in range(r.randrange(0, 60)))) for d in range(150)]
    rows += [(500, None), (501, ""), (None, "null id"), (502, "twice"), (502, "twice"), (503, "q w e " * 3000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, rank int, length int")
    got = pack_documents(df, sequence=32).collect()
    want = []
    for d, t in rows:
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        n = len(ids)
        first = n if n <= 32 else (n - 1) % 32 + 1
        cuts = [0, *range(first, n + 1, 32)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(x[:5]) for x in got), key=str) == sorted(want, key=str)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 32
    assert len(by) <= 1.05 * sum(x.length for x in got) / 32 + 2
    assert pack_documents(df.limit(0)).collect() == []


def test_a_word_goes_to_the_library_once_with_and_without_marks():
    import public_tokenizers

    from lodestore.llm.tokens import Encoder

    e = Encoder(public_tokenizers.path(BYTE_BPE))
    model, asked = e.model, []

    class Counted:
        def tokenize(self, piece):
            asked.append(piece)
            return model.tokenize(piece)

    e.model = Counted()
    texts = ["a Zqxv, Zqxv. Zqxv Zqxv's (Zqxv) 12Zqxv 's ' '' é, é", "a 3rd, 3rd x's, don't. it'll! 'tis"]
    for t in texts:
        assert e.encode(t) == e.whole(t)
    assert asked.count("ĠZqxv") == 1 and asked.count("ĠÃ©") == 1
