import math
import random
import zlib

from lodestore.llm.langid import BUCKETS, UNKNOWN, fit, identify, known_language, op8_language_id, subwords, train

VOCAB = {"en": ["the", "thing", "with", "shall", "hand"], "de": ["und", "schlich", "über", "nicht", "keit"], "fr": ["les", "été", "eux", "que", "ment"]}


def rows_of(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for d in range(n):
        a = r.choice(sorted(VOCAB))
        rows.append((d, " ".join(r.choice(VOCAB[a]) + r.choice(VOCAB[a]) for _ in range(r.randrange(3, 60))), a))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = rows_of()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 +- !", "fr"), (1003, "thing shall", None), (None, "thing with the hand", "en"), (1004, "und " * 40000, None), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(d, t, a, True, "z") for d, t, a in rows + odd], "doc_id long, text string, lang string, held_out boolean, lang_pred string")
    got = identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {x.doc_id: x for x in got}
    for d, x in by.items():
        assert 0 <= x.score <= 1 and x.held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0)
    for d in (1000, 1001, 1002):
        assert (by[d].lang_pred, by[d].rejected) == (UNKNOWN, True)
    assert by[1003].lang_pred == "en" and by[None].lang_pred == "en" and by[1004].lang_pred == "de"
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    truth = {d: a for d, _, a in rows}
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    assert sum(x.rejected for x in held) <= 0.03 * len(held)


def test_held_out_labels_are_not_learned_from(spark):
    rows = rows_of(200)
    swap = [(d, t, a if zlib.crc32(str(d).encode()) % 5 else "xx") for d, t, a in rows]
    a, b = (fit(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, swap))
    assert a.langs == b.langs and (a.table == b.table).all()


def test_texts_of_no_language_are_rejected(spark):
    rows = rows_of(600, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df)
    assert 2.0**-15 < model.temperature < 2.0**9 and 0 < model.threshold <= 0.5
    r = random.Random(3)
    gibberish = ["".join(r.choice("qwxzkjvpyb  ") for _ in range(200)) for _ in range(50)]
    other = [" ".join(r.choice(["pöytä", "kissa", "joki", "vuori", "ystävä"]) + r.choice(["lla", "ssa", "ksi"]) for _ in range(30)) for _ in range(50)]
    script = ["слово дом река " * 9, "言葉と家" * 20]
    for text in gibberish + other + script:
        assert model.predict(text)[2], text
    clean = [model.predict(t) for d, t, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert not any(x[2] for x in clean)


def test_known_language_keeps_columns_that_clash(spark):
    rows = rows_of(60)
    df = spark.createDataFrame([(d, t, a, d, "x", False) for d, t, a in rows] + [(99, None, "en", 1, "y", True)], "doc_id long, text string, lang string, _score long, _Held_Out string, __rejected boolean")
    got = known_language(df)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.where("text is not null").collect()))
    assert known_language(df.limit(0)).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(x)[2:] for x in identify(df).collect()] == [(UNKNOWN, 0.0, True)]
    assert identify(df.limit(0)).collect() == []
    assert train([""], ["en"]).predict("abc")[0] == "en"


def test_subwords_mark_word_ends():
    assert len(subwords(b"")) == 0 and len(subwords(b"ab")) == len(subwords(b"AB")) == 5
    assert (subwords(b"ab") == subwords(b"AB")).all()


def plain_prediction(model, text):
    """The language and its probability, subword by subword."""
    if not text or not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0
    raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    c = [0, *[b if 97 <= b <= 122 or b >= 128 else 0 for b in raw], 0, 0]
    total, n = [0.0] * len(model.bias), 0
    for i in range(len(c) - 2):
        keys = []
        if c[i] or c[i + 1]:
            keys.append(c[i] << 8 | c[i + 1] | 1 << 24)
        if c[i + 1]:
            keys.append(c[i] << 16 | c[i + 1] << 8 | c[i + 2])
        for k in keys:
            h = k * 0x9E3779B1 & 0xFFFFFFFF
            row = model.table[(h ^ h >> 15) % BUCKETS]
            total = [x + float(y) for x, y in zip(total, row)]
            n += 1
    z = [(x / n + float(y)) / model.temperature for x, y in zip(total, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    p = [x / sum(e) for x in e]
    k = max(range(len(model.langs)), key=lambda i: p[i])
    return model.langs[k], p[k]


def test_query_against_plain_predictions(spark, tmp_path):
    rows = [*rows_of(150, 9), (900, None, "en"), (901, "", None), (902, "12 !", "de"), (None, "the Über-thing, été", "fr"), (903, "shall und " * 30_000, "en"), (7, "again und", None), (904, "\n\t", "en"), (905, "Ⅻ 漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    model = fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = op8_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted(((d is None, d, *plain_prediction(model, t)) for d, t, _ in rows), key=str)
    for x, (_, d, lang, score) in zip(sorted(((x.doc_id is None, x.doc_id, x.lang_pred, x.score) for x in got), key=str), want):
        assert x[1:3] == (d, lang) and abs(x[3] - score) < 1e-9
