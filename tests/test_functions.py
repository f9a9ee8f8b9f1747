"""Golden values of the scalar library, derived by hand."""

import pytest
from pyspark.sql import functions as F

from lodestore.functions import jsonx as J
from lodestore.functions import metrics as M
from lodestore.functions import prompt as P
from lodestore.functions import text as T
from lodestore.functions import vector as V


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lit(x):
    return F.lit(x)


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def test_normalisers(spark):
    assert one(spark, T.normalize_answer(lit("don't the_a")), T.normalize_answer_drop(lit("Don't the a")), T.normalize_answer(lit("")), T.normalize_answer(lit(None).cast("string"))) == ("don t the a", "dont", "", None)


def test_scores(spark):
    assert one(spark, M.token_f1(lit("b b b d"), lit("a b b c"), T.normalize_answer_drop))[0] == pytest.approx(4 / 7)
    assert one(spark, M.exact_match(lit("the"), lit("a")), M.token_f1(lit("the"), lit("a"))) == (1.0, 0.0)
    assert one(spark, M.vqa_any(lit("cup."), arr("cup")), M.vqa_soft(lit("cup."), arr("cup"))) == (1.0, pytest.approx(1 / 3))
    assert one(spark, M.anls(lit("kitten"), arr("sitting")), M.anls(lit("abc"), arr("xyz")), M.anls(lit("abc"), arr())) == (pytest.approx(1 - 3 / 7), 0.0, 0.0)


def test_long_f1_equals_short(spark):
    rows = spark.createDataFrame([(1, "b b b d", "a b b c"), (2, "", "x"), (3, None, "x"), (4, "x y", "y x")], "id int, p string, g string")
    got = {r.id: r.f1 for r in M.token_f1_rows(rows, "id", "p", "g", T.normalize_answer_drop).collect()}
    assert got == {1: pytest.approx(4 / 7), 2: 0.0, 3: 0.0, 4: 1.0}


def test_list_answers(spark):
    rows = spark.createDataFrame([(1, ["a b", "c"], ["c", "b"]), (2, ["x"], ["x"]), (3, [], ["x"]), (4, ["x"], []), (5, ["p q", "r"], ["r", "p q"]), (6, ["p"], ["p", "z"])], "id int, p array<string>, g array<string>")
    got = {r.id: (r.em, r.f1) for r in M.list_scores(rows, "id", "p", "g").collect()}
    # "a b" loses its article, so the sets of 1 agree
    assert got == {1: (1.0, 1.0), 2: (1.0, 1.0), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (1.0, 1.0), 6: (0.0, 0.5)}


@pytest.mark.parametrize(
    ("said", "want"),
    [("answer is because", "B"), ("Answer: (c)", "C"), ("so\n**D**\n", "D"), ("either B or (E).", "E"), ("hmm f", "F"), ("xyz", "A"), ("", "A"), ("the answer is d\nB", "B")],
)
def test_last_answer(spark, said, want):
    assert one(spark, T.last_answer(lit(said)))[0] == want


def test_first_letter(spark):
    assert one(spark, T.first_letter(lit("")), T.first_letter(lit("xyz g")), T.first_letter(lit("g"), "A-H", "")) == ("A", "A", "G")


def test_markup(spark):
    assert one(spark, T.markdown_strip(lit("# T\n**b** [x](y) `c` ```\nz\n```")))[0] == "T\nb x c [text]"
    assert one(spark, T.html_escape(lit("<a&'\">")))[0] == "&lt;a&amp;&#x27;&quot;&gt;"
    rows = F.array(arr("1", "2"), arr("3", "4"))
    assert one(spark, T.table_markdown(arr("x", "y"), rows, 1))[0] == "| x | y |\n| --- | --- |\n| 1 | 2 |\n... (2 rows total)"
    assert one(spark, T.recent_summary(arr("a", "b", "c", "d", "e", "f")), T.recent_summary(arr("a")))[:2] == ("b | c | d | e | f", "a")
    p = one(spark, T.pipe_tables(lit("| a | b | c |\n|---|---|---|\nprose")))[0]
    assert p.rows == [["a", "b", "c"]] and p.prose == "prose"


def test_record_blocks(spark):
    make = lambda ctx, ch: one(spark, T.record_blocks(header=[lit("d"), lit("")], labelled=[("Context", lit(ctx))], choices=ch, fallback=lit("raw")))[0]
    assert make("", arr()) == ["d"] and make("x", arr("p", "q")) == ["d", "Context: x", "A. p\nB. q"]
    assert one(spark, T.record_blocks(header=[lit("")], labelled=[], choices=arr(), fallback=lit("r" * 2000)))[0] == ["r" * 1200]


def test_json(spark):
    assert one(spark, J.response_json(lit("<think>{no}</think> a {\"k\": 1} b")))[0] == '{"k": 1}'
    fenced = '```json\n{"strategy": "grid", "width_class": "wide"}\n```'
    assert one(spark, J.config_hash(J.layout_params(lit(fenced))))[0] == "grid_wide_medium_balanced_none_normal"
    assert one(spark, J.layout_params(lit("nothing")))[0] is None
    assert one(spark, J.parse_config_hash(lit("side_by_side_medium_x")))[0] == ("side_by_side", "medium_x")
    cand = arr("c1", "c2")
    assert tuple(one(spark, J.write_decision(lit("no json"), cand))[0])[:2] == ("APPEND", "c1")
    assert tuple(one(spark, J.write_decision(lit("no json"), arr()))[0])[:2] == ("CREATE", None)
    assert tuple(one(spark, J.read_decision(lit('{"action": "RETRIEVE", "canvas_ids": ["c2", "zz"]}'), cand))[0]) == ("RETRIEVE", ["c2"])
    assert tuple(one(spark, J.read_decision(lit('{"action": "DIRECT_ANSWER"}'), cand))[0]) == ("DIRECT_ANSWER", [])
    assert one(spark, J.answers_of(lit('["a", "b"]')), J.answers_of(lit('"x"'))) == (["a", "b"], ["x"])


def test_prompts(spark):
    z = P.zip_paragraphs(arr("t", "u"), F.array(arr("a", "b")))
    assert one(spark, z)[0] == [("t", "a b")]
    assert one(spark, P.query_text(lit("q"), lit(None).cast("string")))[0] == "q"
    assert one(spark, P.canvas_line(lit("c"), lit("t"), lit(2), lit(1), lit(4), lit("s")))[0] == "[c] t (2 items, 25% full): s"


def test_vectors(spark):
    f = lambda *xs: F.array(*[F.lit(float(x)) for x in xs]).cast("array<float>")
    assert one(spark, V.normalize(f(0, 0)), V.normalize(f(3, 4))) == ([0.0, 0.0], [pytest.approx(0.6), pytest.approx(0.8)])
    assert one(spark, V.similarity(f(1, 2), f(4, 6), "l2"))[0] == -5.0
    with pytest.raises(ValueError):
        V.hybrid_key(f(1), f(1), 1.5)
    with pytest.raises(Exception, match="differ in size"):
        one(spark, V.hybrid_key(f(1, 2), f(1), 0.5))
    hour = V.age_days(F.lit("2024-01-01 23:30:00").cast("timestamp_ntz"), F.lit("2024-01-02 00:30:00").cast("timestamp_ntz"))
    assert one(spark, hour)[0] == 0
    assert one(spark, V.mean_pool(F.array(f(1, 2), f(3, 4))), V.valid_tokens(arr("a", "b"), F.array(F.lit(True), F.lit(False))), V.valid_tokens(arr("a"), F.lit(None).cast("array<boolean>"))) == ([2.0, 3.0], ["a"], ["a"])


def test_wrapping_and_tables(spark):
    assert one(spark, T.wrap_words(lit("aa bb cc\n\nabcdefghij"), 5))[0] == ["aa bb", "cc", "", "abcde", "fghij"]
    m = F.array(F.create_map(lit("x"), lit("1"), lit("y"), lit("2")), F.create_map(lit("y"), lit("3")))
    d = one(spark, T.dict_rows(m))[0]
    assert d.headers == ["x", "y"] and d.rows == [["1", "2"], ["", "3"]]
    assert one(spark, T.key_values(F.create_map(lit("k"), lit(5))))[0] == [["k", "5"]]
    assert one(spark, T.content_id(lit("a"), lit("b")) == T.content_id(lit("a"), lit("b")), F.length(T.content_id(lit("a")))) == (True, 20)
    assert one(spark, V.is_blank(arr(250, 251, 250)), V.is_blank(arr(0, 255)))== (True, False)


def test_decisions_need_strict_json(spark):
    from lodestore.functions import jsonx as J

    said = [
        ('{"topic": "{x}", "action": "CREATE"}', "CREATE", None),
        ("{'action': 'CREATE'}", "APPEND", "c1"),
        ('<think>{"action": "NOOP"}</think> so: {"action": "append", "canvas_id": "c2"} ok', "APPEND", "c2"),
        ("nothing", "APPEND", "c1"),
        (None, "APPEND", "c1"),
    ]
    df = spark.createDataFrame([(k, s, ["c1", "c2"]) for k, (s, _, _) in enumerate(said)], "k int, s string, c array<string>")
    got = [tuple(r) for r in df.select("k", J.write_decision(F.col("s"), F.col("c")).alias("d")).select("k", "d.action", "d.canvas_id").orderBy("k").collect()]
    assert got == [(k, a, c) for k, (_, a, c) in enumerate(said)]
    read = df.select(J.read_decision(F.lit("{'action': 'DIRECT_ANSWER'}"), F.col("c")).alias("d")).first().d
    assert (read.action, read.canvas_ids) == ("RETRIEVE", ["c1"])


def test_storage_curve_is_flat_between_reviews(spark):
    from lodestore.operators.forgetting import storage_curve

    shots = spark.createDataFrame([(150, 900), (420, 700), (1001, 5)], "step long, storage_bytes long")
    got = {r.step: r.storage_bytes for r in storage_curve(shots, 1000, 2050, every=1).collect()}
    assert got == {s: 1000 if s < 150 else 900 if s < 420 else 700 if s < 1001 else 5 for s in range(2051)}
