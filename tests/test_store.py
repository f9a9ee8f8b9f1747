"""Token store, filters, reward tables, layouts and JSON against plain models."""

import glob
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.functions import jsonx as J
from lodestore.functions import text as T
from lodestore.functions import vector as V
from lodestore.operators import evaluation as E
from lodestore.operators import layout as L
from lodestore.operators import memory as B
from lodestore.operators import retrieval as R
from lodestore.operators import store as S
from lodestore.sources import records
from lodestore.streaming import access as A


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_tokens_have_defaults_and_ids_are_unique(spark, tmp_path):
    bank = B.Bank(spark, f"{tmp_path}/bank")
    rows = spark.createDataFrame([("a", 1, [[1.0, 2.0]]), ("b", 2, None)], "memory_id string, ord long, tokens array<array<double>>")
    S.save_tokens(bank, rows)
    got = {x.memory_id: x for x in S.by_category(bank, "default").collect()}
    assert (got["a"].compress_mode, got["a"].is_aligned, got["a"].extra, got["a"].tokens, got["a"].valid_mask) == ("none", False, "{}", [[1.0, 2.0]], None)
    with pytest.raises(Exception, match="duplicate id a"):
        S.save_tokens(bank, rows.where("memory_id = 'a'"))
    S.save_tokens(bank, rows.where("memory_id = 'a'").withColumn("category", F.lit("c")), overwrite=True)
    assert [x.memory_id for x in S.by_category(bank, "c").collect()] == ["a"] and S.by_category(bank).count() == 2
    assert bank.get("b", "memory_id").first().ord == 2
    with pytest.raises(KeyError):
        bank.get("z", "memory_id")
    assert json.loads(S.by_category(bank, "c").select(S.meta_json().alias("m")).first().m)["memory_id"] == "a"


def test_lookup_drops_index_entries_without_a_row(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "memory_id string")
    found, index = S.load(ids("a", "b", "c"), ids("a", "d"), ids("a", "b", "d", "b"))
    assert [x.memory_id for x in found.collect()] == ["a"]
    assert sorted(x.memory_id for x in index.collect()) == ["a", "c"]


def test_metadata_paths(spark):
    rows = [(1, '{"a": {"b": 1, "c": true}, "d": "x"}'), (2, '{"a": {"b": "1"}}'), (3, "{}"), (4, None), (5, "broken"), (6, '{"a.b": 1}')]
    df = spark.createDataFrame(rows, "ord long, extra string").withColumn("v", F.try_parse_json("extra"))
    hits = lambda w: [x.ord for x in df.where(R.matches(F.col("v"), w)).orderBy("ord").collect()]
    assert hits({"a.b": 1, "d": "x"}) == [1] and hits({"a.b": 1}) == [1, 2]
    assert hits({"a.c": True}) == [1] and hits({"q.r": 1}) == [] and hits({}) == [1, 2, 3, 4, 5, 6]


def test_delete_by_filter_takes_the_newest_first(spark):
    df = spark.createDataFrame([(f"m{i}", i, i % 7) for i in range(20)], "memory_id string, ord long, created_at int").withColumns({"category": F.lit("c"), "extra": F.lit("{}")})
    left = {x.memory_id for x in S.delete_by_filter(df, start=2, end=5, most=3).collect()}
    gone = sorted((i for i in range(20) if 2 <= i % 7 <= 5), key=lambda i: (-(i % 7), i))[:3]
    assert left == {f"m{i}" for i in range(20)} - {f"m{i}" for i in gone}


def test_replayed_batches_and_restarts_of_the_review_policy(spark, tmp_path):
    bank = B.Bank(spark, f"{tmp_path}/bank")
    bank.write(spark.createDataFrame([("1", 0, 0, False), ("2", 0, 0, False)], "id string, access_count long, quality_level int, deleted boolean"))
    batch = spark.createDataFrame([(1,), (1,), (1,)], "user_id long")
    A.ReviewPolicy(bank, 7, 0)(batch, 0)
    A.ReviewPolicy(bank, 7, 0)(batch, 0)
    assert bank.note() == {"batch": 0, "seen": 3}
    A.ReviewPolicy(bank, 7, 0)(batch, 1)
    assert bank.note() == {"batch": 1, "seen": 6} and bank.read().agg(F.sum("quality_level")).first()[0] == 0
    A.ReviewPolicy(bank, 7, 0)(batch, 2)
    assert bank.note() == {"batch": 2, "seen": 0}
    assert sorted(map(tuple, bank.read().select("id", "access_count", "quality_level").collect())) == [("1", 9, 0), ("2", 0, 1)]
    bank.clear()
    assert bank.note() == {"batch": 2, "seen": 0}


def test_export_array_and_indexes(spark, tmp_path):
    bank = B.Bank(spark, f"{tmp_path}/bank")
    bank.write(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "ord long, text string").repartition(4))
    bank.export_array(f"{tmp_path}/a")
    assert json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/a/part-*")))) == [{"text": f"t{i}"} for i in range(50)]
    bank.clear()
    bank.export_array(f"{tmp_path}/b")
    assert json.loads("".join(open(p).read() for p in glob.glob(f"{tmp_path}/b/part-*"))) == []
    records.write_index(spark.createDataFrame([("a", 0, [1.0])], "id string, ord long, vec array<double>"), f"{tmp_path}/i", "l2")
    assert tuple(records.read_index(spark, f"{tmp_path}/i").first()) == ("a", 0, [1.0], "l2")
    records.write_canvas_manifest(spark.createDataFrame([(7, "x")], "index long, text string"), f"{tmp_path}/m")
    assert [json.loads(x) for p in glob.glob(f"{tmp_path}/m/part-*") for x in open(p)] == [{"index": 7, "canvas": "00007.png", "text": "x"}]


def test_tiles_smaller_than_a_block(spark, monkeypatch):
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 6))
    keys = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "ord long, vec array<double>")
    q = keys.where("ord < 90").withColumnRenamed("ord", "query_id")
    # a tile of one query and of 64 keys at a time
    monkeypatch.setattr(R, "TILE_KEYS", 64)
    monkeypatch.setattr(R, "TILE_BYTES", 8 * 70)
    best = R._block_best(5, "l2")(q.toArrow(), keys.toArrow()).to_pylist()
    want = {i: np.argsort(np.round(np.linalg.norm(v - v[i], axis=1), 9), kind="stable")[:5].tolist() for i in range(90)}
    got = {}
    for x in best:
        got.setdefault(x["query_id"], []).append(x["ord"])
    assert got == want
    assert {(x.query_id, x["rank"]): x.ord for x in R.candidates(q, keys, 5, "l2").collect()} == {(i, k + 1): o for i, w in want.items() for k, o in enumerate(w)}


def test_reward_tables(spark):
    rows = [(1, "grid_wide_a", 0, True, "qq", ["a", "bc"], 0), (1, "grid_wide_a", 1, False, "other", None, 0), (1, "compact_x", 2, True, "", [], 5), (2, "zz_top", 3, False, None, None, None)]
    df = spark.createDataFrame(rows, "pid int, config_hash string, ord long, correct boolean, question string, choices array<string>, canvas_w int")
    assert sorted(map(tuple, E.strategy_accuracy(df, L.STRATEGIES).collect())) == [("compact", 1, 1, 1.0), ("grid", 2, 1, 0.5), ("zz", 1, 0, 0.0)]
    assert sorted(map(tuple, E.reward_table(df).collect())) == [(1, "compact_x", 1.0), (1, "grid_wide_a", 0.0), (2, "zz_top", 0.0)]
    assert sorted(map(tuple, E.block_info(df).collect())) == [(1, 5, True, 5, True), (2, 0, False, 5, True)]
    split = E.train_split(spark.range(57).select(F.col("id").alias("pid")), "pid")
    assert split.where("split = 'train'").count() == 51 and split.count() == 57


def test_json_out_of_responses(spark):
    get = lambda s: one(spark, J.fenced_json(F.lit(s)))
    assert get('```json\n{"a": {"b": 2},}\n``` then {"c": 2}') == '{"b": 2}' and get('```{"a": 1,}```') is None
    assert get('x {"b": 2} ```json\n{"a": 1}\n```') == '{"a": 1}'
    assert get('<think>{"c": 1}</think>[1, 2]') == "[1, 2]" and get("nothing") is None
    ok = lambda s: one(spark, J.valid_response(F.lit(s)))
    assert ok('{"strategy": "grid", "width_class": "wide", "truncation": "odd"}') and not ok('{"strategy": "grid"}') and not ok("no") and not ok('{"strategy": "x", "width_class": "wide"}')


def test_table_rows_and_ranking_loss(spark):
    t = one(spark, T.table_rows(F.array(F.lit("h")), F.array(*[F.array(F.lit("c" * 60)) for _ in range(9)])))
    assert t.headers == ["h"] and len(t.rows) == 8 and t.rows[0] == ["c" * 40]
    assert one(spark, T.markdown_strip(F.lit("a ```x\ny``` `b` **c**"))) == "a [text] b c"
    r = random.Random(4)
    batch = [(r.choice([0.1, 0.5, r.random()]), r.random()) for _ in range(9)]
    pairs = [max(0.0, 0.1 - (1 if a[0] > b[0] else -1) * (a[1] - b[1])) for k, a in enumerate(batch) for b in batch[k + 1 :] if a[0] != b[0]]
    got = spark.createDataFrame([(batch,), ([(1.0, 2.0)],)], "v array<struct<y:double,p:double>>").select(V.ranking_loss(F.col("v"), 0.1).alias("x")).collect()
    assert got[0].x == pytest.approx(sum(pairs) / len(pairs)) and got[1].x is None


def lines(b, width):
    per = max(int(width / (b["font"] * 0.5)), 1)
    return sum(max(-(-len(p) // per), 1) for p in b["text"].split("\n"))


def height(b, width, leading):
    return lines(b, width) * int(b["font"] * leading)


def score(w, h, area, low, high, inside, outside):
    a = w / max(h, 1)
    return 0.6 * min(a, 1 / a) + 0.3 * area / (w * h) + 0.1 * (inside if low <= w <= high and low <= h <= high else outside)


def single(bs, w, leading):
    sizes = [(int(b["w"] * min((w - 30) / b["w"], 1)), int(b["h"] * min((w - 30) / b["w"], 1))) if b["type"] == "image" else (w - 30, height(b, w - 30, leading)) for b in bs]
    return "single_column", w, 15 + sum(h + 10 for _, h in sizes) + 15 - 10, sum(x * y for x, y in sizes)


def shorter(bs, w):
    col, ys, area = (w - 40) // 2, [15, 15], 0
    for b in sorted(bs, key=lambda b: -b["w"] * (b["h"] if b["type"] == "image" else height(b, b["w"], 1.35))):
        k = 0 if ys[0] <= ys[1] else 1
        s = min(col / b["w"], 1)
        x, y = (int(b["w"] * s), max(1, int(b["h"] * s))) if b["type"] == "image" else (col, height(b, col, 1.35))
        ys[k] += y + 10
        area += x * y
    return "two_column", w, max(ys) + 15 - 10, area


def test_best_layout(spark):
    r = random.Random(3)
    some = []
    for _ in range(60):
        bs = []
        for _ in range(r.randrange(1, 7)):
            if r.random() < 0.4:
                bs.append({"type": "image", "role": "figure", "text": None, "w": r.randrange(40, 900), "h": r.randrange(40, 900), "font": 0})
            else:
                bs.append({"type": "text", "role": "context", "text": "x" * r.randrange(1, 3000), "w": 400, "h": 0, "font": r.choice([12, 16, 18])})
        some.append(bs)
    df = spark.createDataFrame([(k, [tuple(b.values()) for b in bs]) for k, bs in enumerate(some)], f"k int, b {L.BLOCKS}")
    got = {x.k: x for x in df.select("k", L.best_layout(F.col("b")).alias("x")).collect()}
    six = {x.k: x.x for x in df.select("k", L.best_of_six(F.col("b")).alias("x")).collect()}
    for k, bs in enumerate(some):
        forms = [single(bs, 640, 1.35), single(bs, 830, 1.35)] + ([shorter(bs, 960)] if len(bs) >= 3 else [])
        best = max(forms, key=lambda f: score(*f[1:], 224, 1344, 1, 0))
        x = got[k].x
        assert (x.name, x.width, x.height) == best[:3] and x.score == pytest.approx(score(*best[1:], 224, 1344, 1, 0))
        # the best of six is at least as good as its single columns
        area = sum(b["w"] * (b["h"] if b["type"] == "image" else height(b, 400, 1.3)) for b in bs)
        side = min(max(int((area * 1.3) ** 0.5), 350), 1200)
        ones = [single(bs, w, 1.3) for w in (side, int(side * 1.3))]
        assert six[k].score >= max(score(*f[1:], 300, 1200, 1.0, 0.7) for f in ones) - 1e-9
        assert six[k].width in (side, int(side * 1.3), int(side * 1.2))
