import random
import re

from lodestore.llm.licenses import BASE, license_scan, signature_rules


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = signature_rules()
    out = []
    for d, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
        places, base = [], set()
        for p, label in BASE:
            q = p.split()
            at = [i for i in range(len(w)) if w[i : i + len(q)] == q]
            places += at
            base |= {label} if at else set()
        found = set()
        line = f" {' '.join(w)} "
        for r in rules:
            if set(r.keywords) & set(w):
                for m in re.finditer(f"(?<= )(?=((?:{r.pattern})) )", line):
                    s = line[: m.start()].count(" ") - 1
                    found.add((s, s + len(m[1].split(" ")), r.priority, r.label))
        order = sorted(found, key=lambda x: (x[0], -x[1], -x[2], x[3]))
        kept = [x for k, x in enumerate(order) if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] for y in order[:k])]
        best = max([p for _, _, p, _ in kept], default=1 if base else 0)
        out.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[3] for x in kept})), best / 3, [tuple(x) for x in kept]))
    return sorted(out, key=str)


SOME = [
    "Licensed under the Apache License, Version 2.0.",
    "released under the MIT license",
    "This work is licensed under the GNU General Public License, version 3 or any later version.",
    "Licensed under CC BY-NC 4.0.",
    "CC-BY",
    "Creative Commons Attribution-ShareAlike 3.0",
    "Copyright (c) 2001-2004 All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "gnu general public license gnu general public license",
    "CC BY BY cc by",
    "mit licensed",
    "SPDX-License-Identifier: MIT",
    "K apache\n\nLICENSEÉ x",
    "Apache-License 2",
]


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(k, t) for k, t in enumerate(SOME)] + [(100 + k, " ".join(r.choice(["the", "of", "Éa", *SOME]) for _ in range(r.randrange(0, 12)))) for k in range(60)]
    rows += [(900, None), (901, ""), (902, " ,;"), (None, SOME[0]), (0, SOME[0]), (903, "mit license " * 3000), (904, "w " * 20000 + "cc by")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, line string, labels int")
    got = [tuple(x[:-1]) + ([tuple(y) for y in x[-1]],) for x in license_scan(df).collect()]
    for a, b in zip(sorted(got, key=str), brute(rows), strict=True):
        assert a == b
    assert license_scan(df.limit(0)).collect() == []


def test_rules():
    rules = signature_rules()
    assert len(rules) >= 200 and len(set(rules)) == len(rules)
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def example(pattern):
    """A text that the pattern matches: the first branch of every choice, optional parts as well."""
    from re import _parser

    def of(items):
        out = ""
        for kind, v in items:
            name = str(kind)
            if name == "LITERAL":
                out += chr(v)
            elif name == "IN":
                out += chr(v[0][1] if str(v[0][0]) == "LITERAL" else v[0][1][0])
            elif name == "MAX_REPEAT":
                out += of(v[2]) * max(1, v[0])
            elif name == "SUBPATTERN":
                out += of(v[3])
            elif name == "BRANCH":
                out += of(v[1][0])
        return out

    return of(_parser.parse(pattern))


def test_every_rule_is_distinct_and_fires(spark):
    rules = signature_rules()
    assert len({(r.pattern, r.label) for r in rules}) == len({r.pattern for r in rules}) == len(rules) > 400
    texts = [example(r.pattern) for r in rules]
    assert all(re.fullmatch(r.pattern, t) and set(r.keywords) & set(t.split()) for r, t in zip(rules, texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x.doc_id: x for x in license_scan(df).collect()}
    want = {x[0]: x for x in brute(list(enumerate(texts)))}
    for k, r in enumerate(rules):
        assert r.label in got[k].labels.split(",") or any(y.start == 0 and y.end >= len(texts[k].split()) for y in got[k].detections), (r, got[k])
        assert (got[k].labels, [tuple(y) for y in got[k].detections]) == (want[k][6], want[k][8])
