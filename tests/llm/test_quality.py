import random
import re

import pytest

import lodestore.llm.quality as Q
from lodestore.llm.quality import BASE, BIT, CURRENT, POLICIES, ablation, apply_policy, ledger


def brute(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", t)), "n_marks": len(re.findall("[!?]", t)), "n_distinct": len(set(w))}
    failed = sum(BIT[name] for name, rule in Q.RULES if eval(rule, {}, m))
    return m, failed


def rows_of():
    r = random.Random(6)
    vocab = ["a", "bb", "Ça", "|", "##x", "\n", "UPPER", "d\n"]
    rows = [(d, " ".join(r.choice(vocab[: r.randrange(2, 9)]) for _ in range(r.randrange(0, 200)))) for d in range(80)]
    rows += [(d, " ".join(f"w{r.randrange(900)}" for _ in range(120))) for d in range(100, 140)]
    return rows + [(200, None), (201, ""), (202, " \x0b\n"), (None, "x y z x y z"), (203, "same row"), (203, "same row"), (204, "q " * 30000), (205, "one two"), (206, "lone " + "z" * 9000)]


@pytest.mark.parametrize("place", [Q.PLACE, 3])
def test_against_brute_force(spark, monkeypatch, place):
    monkeypatch.setattr(Q, "PLACE", place)
    rows = rows_of() if place > 3 else rows_of()[:-3]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, words int, h string")
    got = apply_policy(ledger(df)).collect()
    want = []
    for d, t in rows:
        m, failed = brute(t)
        want.append((d, *(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed & BASE != 0, failed & BASE == 0 and failed & CURRENT.mask == 0, failed))
    key = lambda x: tuple(map(str, x))
    assert sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept, x.failed) for x in got), key=key) == sorted(want, key=key)


def test_ablation(spark):
    rows = rows_of()[:100]
    led = ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    masks = [x.failed for x in led.collect()]
    got = {(x.version, x.rule): (x.n_kept, x.n_failed_rule, x.n_gained) for x in ablation(led).collect()}
    for p in POLICIES:
        for r in p.rules:
            kept = sum(m & p.mask == 0 for m in masks)
            without = sum(m & (p.mask & ~BIT[r]) == 0 for m in masks)
            assert got[p.version, r] == (kept, sum(m & BIT[r] != 0 for m in masks), without - kept)
    assert len(got) == sum(len(p.rules) for p in POLICIES)


def test_empty(spark):
    assert apply_policy(ledger(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
