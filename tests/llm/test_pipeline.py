import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from lodestore.llm.langid import fit
from lodestore.llm.tokens import BYTE_BPE, encoder

from .test_mixing import shares
from .test_simhash import brute as simhash_brute


def texts(seed=1, n=160):
    r = random.Random(seed)
    vocab = {"en": ["the", "thing", "with", "shall", "hand"], "de": ["und", "schlich", "über", "nicht", "keit"]}
    rows = []
    for d in range(n):
        lang = r.choice(["en", "de"])
        words = [r.choice(vocab[lang]) + r.choice(vocab[lang]) for _ in range(r.randrange(20, 90))]
        if d % 7 == 0 and rows:
            words += rows[-1][1].split()[:30] if rows[-1][1] else []
        rows.append((d, " ".join(words), lang, f"s{r.randrange(4)}"))
    rows += [(n, rows[3][1], "en", "s0"), (n + 1, "12 34 !", "en", "s1"), (n + 2, None, "de", None), (n + 3, "", "de", "s2")]
    return [(d, t, a, s, len(t) if t is not None else None) for d, t, a, s in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "pattern_packing":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    model = fit(df)
    left = [(d, t) for d, t, *_ in rows if not model.predict(t)[2]]
    assert sorted(x.doc_id for x in seen["language_id"]) == [d for d, _ in left]
    assert {d for d, *_ in rows[:-3]} <= {d for d, _ in left}
    heads = {d: t for (d, t) in left}
    heads = {d: heads[d] for d, _, c in simhash_brute(left) if d == c}
    assert sorted(x.doc_id for x in seen["simhash_near_dedup"]) == sorted(heads)
    first, words = {}, {d: t.split() for d, t in sorted(heads.items())}
    for d, w in words.items():
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    kept = {}
    for d, w in words.items():
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        kept[d] = [x for i, x in enumerate(w) if i not in gone]
    kept = {d: w for d, w in kept.items() if w}
    assert {x.doc_id: x.text.split() for x in seen["substring_dedup"]} == kept
    sizes = {}
    for x in seen["substring_dedup"]:
        sizes[x.source] = sizes.get(x.source, 0) + len(re.findall(r"\S+", x.text))
    want, taken = shares(sizes), {}
    for x in seen["curriculum_mix"]:
        taken[x.source] = taken.get(x.source, 0) + len(kept[x.doc_id])
    assert all(abs(taken.get(s, 0) - want[s]) <= 130 for s in want)
    e, n = encoder(BYTE_BPE), 0
    for x in seen["curriculum_mix"]:
        n += len(e.whole(x.text)) // 4 + 1
    assert sum(x.length for x in seen["pattern_packing"]) == n
    used = {}
    for x in seen["pattern_packing"]:
        used.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for v in used.values():
        at = 0
        for o, m in sorted(v):
            assert o == at
            at += m
        assert at <= 1024


def test_run(spark, tmp_path):
    df = spark.createDataFrame(texts(2, 40), "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 10


def test_mix_order_reaches_packing(spark, tmp_path):
    rows = [(d, "word " * 30, "en", f"s{d % 3}", 150) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mixture(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    written = spark.read.parquet(f"{tmp_path}/mix")
    order = [r.doc_id for r in written.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert order == [r.doc_id for r in corpus_pipeline.mix(docs, weights=corpus_pipeline.WEIGHTS).collect()]
    # all pieces are of one length: along the sequences, each offset is served in the order of the file
    mixed = docs.withColumn("n_chars", F.pmod(F.col("doc_id") * 77, F.lit(300)))
    mixed.repartitionByRange(3, "n_chars").sortWithinPartitions("n_chars").write.parquet(f"{tmp_path}/ordered")
    packed = corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/ordered"), "")
    assert set(packed.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
    places = {}
    for r in packed.collect():
        places.setdefault(r.offset, []).append((r.sequence_id, r.doc_id * 77 % 300))
    for v in places.values():
        at = [x for _, x in sorted(v)]
        assert at == sorted(at)


def test_near_dedup_keeps_one_row_of_each_component(spark):
    r = random.Random(8)
    some = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (some() for _ in range(5))
    rows = [(5, a), (5, b), (2, b), (None, c), (None, d), (None, d), (None, b), (9, e), (None, e), (7, a), (7, a)]
    df = spark.createDataFrame([(k, t, "en", f"s{n}", len(t)) for n, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted([(5, a), (2, b), (None, c), (None, d), (9, e)], key=str)


STRANGE = "doc_id long, text string, lang string, source string, n_chars long, _score string, SIZE long, position string, mark string"


def strange_rows():
    r = random.Random(11)
    some = lambda n: " ".join(r.choice(["thing", "shall", "hand", "with"]) + str(r.randrange(10**5)) for _ in range(n))
    same = some(60)
    rows = [(d, some(r.randrange(1, 80)), "en", f"s{d % 3}") for d in range(40)]
    rows += [(None, some(30), "en", None), (None, some(30), None, "s0"), (None, None, None, None), (50, None, "en", "s1"), (51, "", "en", "s1"), (52, "#$ 12", "en", "s1")]
    rows += [(60, same, "en", "s0"), (60, same, "en", "s0"), (60, some(50), "en", "s2"), (61, same + " more", "en", "s0"), (62, some(60_000), "en", "s0")]
    return [(*x, len(x[1]) if x[1] is not None else None, "a", 7, "b", "c") for x in rows]


def test_each_stage_handles_strange_rows_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame(strange_rows(), STRANGE)
    df.write.parquet(f"{tmp_path}/strange")
    df.limit(0).write.parquet(f"{tmp_path}/empty")
    for name, stage in corpus_pipeline.STAGES:
        last = name == "pattern_packing"
        got = stage(spark, spark.read.parquet(f"{tmp_path}/strange"), "")
        assert last or set(got.columns) == set(corpus_pipeline.COLUMNS)
        rows = got.collect()
        ids = {x.doc_id for x in rows}
        assert name == "curriculum_mix" or (set(range(40)) <= ids and None in ids and {60, 62} <= ids), name
        assert name != "curriculum_mix" or (len(rows) > 10 and ids <= {x[0] for x in strange_rows()})
        if name == "language_id":
            assert not ids & {50, 51, 52}
        if name == "simhash_near_dedup":
            assert sorted(len(x.text or "") for x in rows if x.doc_id == 60) == sorted({len(x[1]) for x in strange_rows() if x[0] == 60})
        assert stage(spark, spark.read.parquet(f"{tmp_path}/empty"), "").collect() == [], name


def test_packed_ids_are_those_of_the_texts(spark, tmp_path):
    df = spark.createDataFrame(strange_rows(), STRANGE).where("doc_id < 40 or doc_id = 62")
    df.write.parquet(f"{tmp_path}/x")
    rows = corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/x"), "").collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x.doc_id, x.piece)):
        assert len(x.ids) == x.length and x.start == len(got.get(x.doc_id, []))
        got.setdefault(x.doc_id, []).extend(x.ids)
    plain = encoder(BYTE_BPE).tokenizer
    assert got == {x[0]: [*plain.encode(x[1], add_special_tokens=False).ids, 2] for x in strange_rows() if x[0] is not None and (x[0] < 40 or x[0] == 62)}


def test_planted_gibberish_goes(spark):
    r = random.Random(5)
    rows = texts(4, 300)
    junk = [(1000 + k, "".join(r.choice("qxzwvkjyp  ") for _ in range(300)), None, "s0", 300) for k in range(20)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.language(spark, df, "").collect()}
    assert kept == {d for d, t, *_ in rows if t and any(map(str.isalpha, t))}
