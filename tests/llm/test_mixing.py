import random
import re

import pytest

from lodestore.llm.mixing import PLAN, mix, plan


def shares(sizes, repeat=3):
    """Targets by cutting and sharing anew until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > repeat * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = repeat * sizes[s]
            left -= out[s]
        free -= over
    return out


def rows_of(seed, hot=False):
    r = random.Random(seed)
    rows = [(d, " ".join("w" for _ in range(r.randrange(1, 80))) + "\n\x0b", None if r.random() < 0.1 else ("big" if hot and r.random() < 0.6 else f"s{r.randrange(7)}")) for d in range(400)]
    return rows + [(900, None, "s1"), (901, "", "empty"), (None, "a b c", "s2"), (902, "twice here", "é"), (902, "twice here", "é"), (903, "x " * 900, "tiny"), (904, "z", "one")]


@pytest.mark.parametrize("hot", [False, True])
def test_plan(spark, hot):
    rows = rows_of(3, hot)
    df = spark.createDataFrame([(d, t, s, 5, "x") for d, t, s in rows], "doc_id long, text string, source string, size int, place string")
    got = plan(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = shares(sizes)
    assert len(got) == len(rows)
    taken = {}
    for x in got:
        assert x.size == len(re.findall("[^\x20\x09-\x0d]+", x.text or "")) and x.source_size == sizes[x.source]
        assert x.target == pytest.approx(want[x.source]) and x.taken == x.copies * x.size and 0 <= x.copies <= 3
        taken[x.source] = taken.get(x.source, 0) + x.taken
    largest = {s: max(x.size for x in got if x.source == s) for s in sizes}
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest[s] + 1e-6
    assert sorted(map(str, plan(df.repartition(7)).collect())) == sorted(map(str, got))


def test_positions_follow_the_schedule(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    at = [x.position for x in got]
    assert at == sorted(at) and min(at) >= 0 and max(at) <= 1
    assert len(got) == sum(x.copies for x in plan(df).collect())
    for s in {x.source for x in got if x.target > 50 * 20}:
        mine = [x for x in got if x.source == s]
        slope, half = mine[0].slope, sum(x.size for x in mine if x.position < 0.5) / sum(x.size for x in mine)
        assert half == pytest.approx(0.5 - slope / 4, abs=0.08)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert plan(df).collect() == [] and mix(df).collect() == []


def test_columns_that_clash(spark):
    rows = [(d, "w " * (d % 5), f"s{d % 3}", d, d, d, d, d, "x", "y", d) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _s int, _n int, _m int, _b int, s int, SIZE string, Target string, row int")
    got = plan(df)
    assert {c for c in got.columns if c not in PLAN} == {"doc_id", "text", "source", "_s", "_n", "_m", "_b", "s", "row"}
    assert sorted((x.doc_id, x._s, x.s, x["row"]) for x in got.collect()) == [(d,) * 4 for d in range(60)]
    assert mix(df).count() == sum(x.copies for x in got.collect())


def test_rates_add_up_to_the_same_at_every_time(spark):
    rows = rows_of(7, True)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {(x.source_size, x.target, x.slope) for x in plan(df).collect()}
    assert all(-1 <= s <= 1 for _, _, s in found)
    total = sum(t for _, t, _ in found)
    assert sum(t * s for _, t, s in found) == pytest.approx(0, abs=1e-6 * total)


def test_query_is_what_the_mix_takes(spark, tmp_path, monkeypatch):
    import lodestore.llm.mixing as m

    rows = rows_of(6, True) + [(903, None, "s1"), (903, None, "s1"), (903, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = m.op9_curriculum_mix(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "copies", "place", "first_position", "last_position"]
    seven = got.columns[:7]
    assert sorted(map(str, got.select(seven).collect())) == sorted(map(str, plan(df).select(*seven).collect()))
    at = [(x.doc_id, x.epoch, x.position) for x in m.op9_curriculum_positions(spark, str(tmp_path)).collect()]
    assert [x[2] for x in at] == sorted(x[2] for x in at)
    assert sorted(map(str, at)) == sorted(str((x.doc_id, x.epoch, x.position)) for x in mix(df).collect())
    places = {}
    for d, _, p in at:
        places.setdefault(d, []).append(p)
    for x in got.where("doc_id < 900").collect():
        mine = places.get(x.doc_id)
        want = (round(min(mine), 9), round(max(mine), 9)) if mine else (None, None)
        assert (x.first_position, x.last_position) == (pytest.approx(want[0], abs=2e-9), pytest.approx(want[1], abs=2e-9)) if mine else (None, None)
    # a mix that drops its later epochs shows in taken
    whole = m.mixed
    monkeypatch.setattr(m, "mixed", lambda planned: whole(planned).where("epoch = 0"))
    assert sum(x.taken for x in m.op9_curriculum_mix(spark, str(tmp_path)).collect()) < sum(x.taken for x in got.collect())


def test_sql_agrees(spark):
    import duckdb

    import lodestore.llm.mixing as m

    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, m.op9_curriculum_mix(spark, d).collect()))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert got == sorted(c.sql(m.ORACLE["op9_curriculum_mix"]).fetchall())
