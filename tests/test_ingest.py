"""Order-dependent ingest against the loop over the memories."""

import numpy as np
import pytest

from lodestore.operators import ingest as I


def loop(bank, new, remain, merge):
    unit = lambda v: v / (np.sqrt(v @ v) or 1.0)
    keys, out, members = [(o, v) for o, v in bank], [], {o: [o] for o, _ in bank}
    for o, v in new:
        sims = [round(float(unit(k) @ unit(v)), 9) for _, k in keys]
        at = int(np.argmax(sims)) if sims else -1
        sim = sims[at] if sims and sims[at] >= 0 else None
        made = I.NEW + o
        if sim is not None and sim >= remain:
            out.append((o, "REMAIN", keys[at][0], round(sim, 6)))
        elif sim is not None and sim >= merge:
            target, k = keys.pop(at)
            out.append((o, "MERGE", target, round(sim, 6)))
            keys.append((made, (k + v) / 2))
            members[made] = [*members.pop(target), made]
        else:
            out.append((o, "ADD", None, None if sim is None else round(sim, 6)))
            keys.append((made, v))
            members[made] = [made]
    return out, {k: np.round(v, 9).tolist() for k, v in keys}, members


def some_vectors(seed, n, groups, spread, d=8):
    """Groups of vectors around centres, so that merges follow merges; some are repeated."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, d))
    v = centre[r.integers(0, groups, n)] + spread * r.normal(size=(n, d))
    v[r.integers(0, n, n // 10)] = v[r.integers(0, n, n // 10)]
    return v.astype(np.float32).astype(np.float64)


def frame(spark, rows):
    return spark.createDataFrame([(o, [float(x) for x in v]) for o, v in rows], "ord long, vec array<double>")


@pytest.mark.parametrize(("seed", "n", "groups", "spread", "d"), [(1, 2000, 700, 0.3, 32), (2, 30, 4, 0.5, 8)])
def test_same_as_the_loop(spark, seed, n, groups, spread, d):
    v = some_vectors(seed, n, groups, spread, d)
    bank, new = list(enumerate(v[: n // 8])), list(enumerate(v[n // 8 :]))
    decided, keys, rounds = I.ingest(frame(spark, bank), frame(spark, new), 0.95, 0.80)
    want, left, members = loop(bank, new, 0.95, 0.80)
    got = sorted(map(tuple, decided.collect()))
    assert {a for _, a, _, _ in got} == {"ADD", "MERGE", "REMAIN"}
    assert got == want
    assert {r.pos: np.round(r.vec, 9).tolist() for r in keys.collect()} == left
    assert {r.pos: r.members for r in I.lineage(decided).collect()} == {k: m for k, m in members.items() if len(m) > 1 or k >= I.NEW}
    # as many rounds as the longest chain, not as there are memories
    assert rounds <= 60


def test_chain_takes_a_round_for_each_link(spark):
    """Each memory merges with what the one before has made."""
    turn = np.deg2rad(np.array([0, 30, 45, 55, 62, 68]))
    rows = [(k, np.array([np.cos(t), np.sin(t)])) for k, t in enumerate(turn)]
    decided, keys, rounds = I.ingest(frame(spark, rows[:1]), frame(spark, rows[1:]), 0.98, 0.80)
    want, left, _ = loop(rows[:1], rows[1:], 0.98, 0.80)
    assert sorted(map(tuple, decided.collect())) == want and [a for _, a, _, _ in want] == ["MERGE"] * 5
    assert rounds <= 7
    with pytest.raises(RuntimeError):
        I.ingest(frame(spark, rows[:1]), frame(spark, rows[1:]), 0.98, 0.80, most_rounds=2)


def test_empty_sides(spark):
    v = some_vectors(5, 12, 3, 0.2)
    decided, keys, _ = I.ingest(frame(spark, []), frame(spark, list(enumerate(v))))
    assert sorted(map(tuple, decided.collect())) == loop([], list(enumerate(v)), 0.85, 0.7)[0]
    decided, keys, rounds = I.ingest(frame(spark, list(enumerate(v))), frame(spark, []))
    assert decided.collect() == [] and keys.count() == 12 and rounds == 1
