import random
import zlib

import numpy as np
import pytest

from lodestore.llm.tokens import BYTE_BPE, WORD_BPE, encoder
from lodestore.llm.wavelet import Shard, WaveletMatrix, pack_shard, read_shards, write_shards


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (7, 3), (600, 50), (5000, 49408), (3000, 70000)])
def test_matrix(n, top):
    r = np.random.default_rng(n)
    ids = np.minimum(r.integers(0, top, n), r.integers(0, top, n)).astype(np.uint32)
    keys = np.sort(r.integers(-5, 1 << 60, 9))
    s = Shard(pack_shard(keys, 2, np.arange(9), ids))
    w = s.matrix()
    assert (s.keys == keys).all() and s.lengths.tolist() == list(range(9)) and s.header["nulls"] == 2
    assert (w.decode() == ids).all()
    if not n:
        assert w.count(0) == 0 and not len(w.occurrences(3))
        return
    at = r.integers(0, n, 200)
    assert (w.access(at) == ids[at]).all()
    for t in [*ids[:20].tolist(), top + 1, 1 << 20]:
        where = np.flatnonzero(ids == t)
        assert (w.occurrences(t) == where).all()
        a, b = sorted(r.integers(0, n + 1, 2).tolist())
        assert w.count(t, a, b) == ((where >= a) & (where < b)).sum() and w.rank(t, b) == (where < b).sum()
        if len(where):
            assert w.select(t, len(where) - 1) == where[-1]


def test_one_place_inflates_one_block_of_a_plane():
    r = np.random.default_rng(4)
    ids = np.minimum(r.integers(0, 49408, 600_000), r.integers(0, 49408, 600_000)).astype(np.uint32)
    ids[r.random(len(ids)) < 0.3] = 7
    data = pack_shard(np.arange(3), 0, np.arange(3), ids)
    where = np.flatnonzero(ids == 7)
    for k in (0, 1, 4095, 4096, len(where) // 2, len(where) - 1):
        s = Shard(data)
        w = s.matrix()
        assert w._back(7, np.array([w._range(7, 0, w.n)[0] + k]))[0] == where[k] == w.select(7, k)
        planes = len(s.header["zeros"])
        # rank looks at two places of a plane, select at one
        assert len(s.inflated) <= 3 * planes < planes * -(-len(ids) // 8 // 8192)
        assert max(np.bincount([p for p, _ in s.inflated])) <= 3
    s = Shard(data)
    assert s.matrix().access([123_456]).tolist() == [ids[123_456]] and sorted(p for p, _ in s.inflated) == list(range(16))
    with pytest.raises(IndexError):
        w.select(7, len(where))
    assert (w.occurrences(7) == where).all() and (Shard(data).matrix().decode() == ids).all()


def weird(r, n):
    return "".join(r.choice(["a", "the ", "é", " ", "\n", "1", "!", "'s", "\t", "漢", "  ", "Ab", "\xa0", "İ", "'re", "<|endoftext|>", "—", "ﬁ", "ª", "word"]) for _ in range(r.randrange(n)))


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_pieces_give_the_ids_of_whole_texts(name):
    r = random.Random(2)
    e = encoder(name)
    for t in ["", " ", "\n\n", " a", "a ", "A b\nC", *(weird(r, 30) for _ in range(3000))]:
        assert e.encode(t) == e.whole(t)


def test_round_trip(spark, tmp_path):
    r = random.Random(3)
    rows = [(d * 5 % 97, weird(r, 60)) for d in range(90)] + [(300, None), (301, ""), (None, "last"), ((1 << 63) - 1, "largest"), ((1 << 63) - 1, "z"), (302, "twice"), (302, "twice"), (303, "long text " * 20000)]
    df = spark.createDataFrame([(d, t, 0, b"") for d, t in rows], "doc_id long, text string, key int, data binary")
    write_shards(df, f"{tmp_path}/x")
    got = sorted(map(tuple, read_shards(spark, f"{tmp_path}/x").collect()), key=lambda x: x[1])
    start, want = 0, []
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        ids = [*encoder(WORD_BPE).tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want
    write_shards(df.limit(0), f"{tmp_path}/y")
    assert read_shards(spark, f"{tmp_path}/y").collect() == []


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_added_tokens_are_found_as_the_library_finds_them(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(public_tokenizers.path(name)), encoder(name)
    end = plain.token_to_id("<|endoftext|>")
    for t in ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|EndOfText|>", "one\n<|endoftext|>two  <|endoftext|", *(weird(random.Random(k), 30) for k in range(500))]:
        ids = np.frombuffer(e.encode(t), "<u4").tolist()
        assert ids == plain.encode(t, add_special_tokens=False).ids
        assert ids.count(end) == t.count("<|endoftext|>")
