"""Licence scans by ordered signature rules, in DataFrame functions only.

A text is its lower-cased words joined by one space.  Rules are regular expressions over that line, made from
licence families (names, versions) and phrase forms, and of sentences of licence texts and identifiers; each has
keywords, a label and a priority.  A text is looked at only if it holds a hint, and a rule is tried only if one
of its keywords is a word of the text.  A detection that lies inside one of the same or a higher priority is
suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import read_documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, with A-Z still in the text.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Places that count whatever the rules say: phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: A text without any of these holds no phrase of the base and no rule's keyword context.
HINTS = ("licen", "copyright", "cc", "copyleft", "domain", "commons", "reserved", "spdx", "warrant", "permission", "redistribution", "liable", "commercial")

# Licence families as (label, name as a pattern, keyword, versions).
FAMILIES = (
    ("agpl", "gnu affero general public license", "affero", ("3", "3 0")),
    ("gpl", "gnu general public license", "gnu", ("1", "2", "2 0", "3", "3 0")),
    ("lgpl", "gnu (?:lesser|library) general public license", "gnu", ("2", "2 0", "2 1", "3", "3 0")),
    ("gfdl", "gnu free documentation license", "gnu", ("1 1", "1 2", "1 3")),
    ("apache", "apache (?:software )?license", "apache", ("1 0", "1 1", "2", "2 0")),
    ("mit", "(?:mit|x11|expat) licen[cs]e", "mit", ()),
    ("bsd", "(?:(?:new|modified|simplified|original|[234] clause) )?bsd licen[cs]e", "bsd", ("2", "3", "4")),
    ("isc", "isc licen[cs]e", "isc", ()),
    ("mpl", "mozilla public license", "mozilla", ("1 0", "1 1", "2", "2 0")),
    ("epl", "eclipse public license", "eclipse", ("1 0", "2 0")),
    ("cddl", "common development and distribution license", "development", ("1 0", "1 1")),
    ("eupl", "european union public licen[cs]e", "european", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic license", "artistic", ("1 0", "2 0")),
    ("zlib", "zlib(?: libpng)? license", "zlib", ()),
    ("boost", "boost software license", "boost", ("1 0",)),
    ("ofl", "(?:sil )?open font license", "font", ("1 0", "1 1")),
    ("python", "python software foundation license", "python", ("2",)),
    ("postgresql", "postgresql license", "postgresql", ()),
    ("osl", "open software license", "software", ("2 0", "2 1", "3 0")),
    ("afl", "academic free license", "academic", ("2 0", "2 1", "3 0")),
    ("ms-pl", "microsoft public license", "microsoft", ()),
    ("odbl", "open (?:data commons open )?database license", "database", ("1 0",)),
    ("unlicense", "the unlicense", "unlicense", ()),
    ("wtfpl", "do what the fuck you want to public license", "want", ("1", "2")),
    ("cc0", "(?:cc0|cc zero|creative commons zero)", "cc0", ("1 0",)),
    ("cc-by", "(?:cc|creative commons) (?:by|attribution)", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "(?:cc|creative commons) (?:by sa|attribution share ?alike)", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "(?:cc|creative commons) (?:by nc|attribution non ?commercial)", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s?)", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
)
# Forms of a phrase around {0}, the name, and {1}, a version; with their priority.
PLAIN_FORMS = (
    ("{0}", 1),
    ("(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of the )?(?:an? )?{0}", 2),
    ("(?:under|subject to) the (?:terms|conditions) (?:and conditions )?of (?:the )?{0}", 2),
    ("(?:copy|text|version) of (?:the )?{0}", 2),
)
VERSION_FORMS = (
    ("{0} (?:version |v ?)?{1}", 2),
    ("(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of the )?(?:an? )?{0} (?:version |v ?)?{1}", 3),
    ("{0} (?:version |v ?)?{1} or (?:at your option )?(?:any )?later(?: version)?", 3),
)
# Sentences of licence texts and notices, as (label, pattern, keywords, priority).
OTHER = (
    ("copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", ("copyright",), 1),
    ("all-rights-reserved", "all rights reserved", ("reserved",), 1),
    ("some-rights-reserved", "some rights reserved", ("reserved",), 1),
    ("no-rights-reserved", "no rights reserved", ("reserved",), 1),
    ("public-domain", "(?:in|into|to) the public domain", ("domain",), 1),
    ("public-domain", "(?:free of (?:all )?copyright|not (?:subject to|protected by) copyright)", ("copyright",), 1),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("domain",), 3),
    ("cc0", "(?:has|have) waived all copyright and related(?: or neighboring)? rights", ("copyright",), 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission",), 3),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", ("permission",), 2),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", ("permission",), 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution",), 3),
    ("bsd", "redistributions of source code must retain the above copyright notice", ("redistributions",), 2),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", ("redistributions",), 2),
    ("bsd", "neither the name of the copyright holders? nor the names of its contributors", ("copyright",), 2),
    ("bsd", "this software is provided by the copyright holders and contributors as is", ("copyright",), 2),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose", ("permission",), 3),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ("permission",), 2),
    ("apache", "you may not use this file except in compliance with the license", ("compliance",), 3),
    ("apache", "software distributed under the license is distributed on an as is basis", ("license",), 3),
    ("apache", "see the license for the specific language governing permissions and limitations", ("permissions",), 2),
    ("gpl", "this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu",), 3),
    ("lgpl", "this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", ("gnu",), 3),
    ("agpl", "you should have received a copy of the gnu affero general public license", ("affero",), 3),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", ("gnu",), 3),
    ("gpl", "you should have received a copy of the gnu general public license", ("gnu",), 3),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("permission",), 3),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla",), 3),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse",), 3),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("development",), 3),
    ("cc-by", "creative commons attribution [1-4] [05] (?:international|unported|generic)(?: public)? license", ("creative",), 3),
    ("cc-by-sa", "creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic)(?: public)? license", ("creative",), 3),
    ("creative-commons", "licensed under (?:a|the) creative commons", ("creative",), 1),
    ("copyleft", "(?:strong |weak )?copyleft(?: licen[cs]e)?", ("copyleft",), 1),
    ("proprietary", "(?:proprietary and confidential|unauthori[sz]ed (?:copying|use|distribution))[a-z0-9 ]{0,80}copyright", ("proprietary", "unauthorized", "unauthorised"), 2),
    ("fair-use", "(?:fair use|fair dealing) (?:of|under) (?:the )?copyright", ("copyright",), 1),
    ("no-warranty", "(?:without warranty of any kind|without any warranty)", ("warranty",), 1),
    ("no-warranty", "without even the implied warranty of merchantability", ("warranty",), 2),
    ("no-warranty", "disclaims all warranties with regard to this software", ("disclaims",), 1),
    ("no-liability", "in no event shall the (?:authors?|copyright holders?|copyright owners?)(?: or [a-z]+(?: [a-z]+)?)* be liable", ("liable",), 1),
    ("non-commercial", "(?:for )?non ?commercial use only", ("commercial", "noncommercial"), 1),
    ("license-by-mail", "(?:see|read) the (?:accompanying |enclosed )?(?:file )?(?:licen[cs]e|copyright)(?: file| txt| md)?", ("license", "licence", "copyright"), 1),
)
# Short identifiers, as (label, identifier as a pattern).
IDENTIFIERS = (
    ("0bsd", "0bsd"),
    ("afl", "afl [123] [0-9]"),
    ("agpl", "agpl [0-9] 0(?: only| or later)?"),
    ("apache", "apache [12] [01]"),
    ("artistic", "artistic [12] 0(?: perl)?"),
    ("boost", "bsl 1 0"),
    ("bsd", "bsd [1-4] clause(?: clear| patent)?"),
    ("cc-by", "cc by [1-4] [05]"),
    ("cc-by-nc", "cc by nc [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd [1-4] [05]"),
    ("cc-by-sa", "cc by sa [1-4] [05]"),
    ("cc0", "cc0 1 0"),
    ("cddl", "cddl 1 [01]"),
    ("epl", "epl [12] 0"),
    ("eupl", "eupl 1 [012]"),
    ("gfdl", "gfdl 1 [123](?: only| or later)?"),
    ("gpl", "gpl [0-9] 0(?: only| or later)?"),
    ("isc", "isc"),
    ("lgpl", "lgpl [0-9] [01](?: only| or later)?"),
    ("mit", "mit(?: 0)?"),
    ("mpl", "mpl [12] [01](?: no copyleft exception)?"),
    ("ms-pl", "ms pl"),
    ("odbl", "odbl 1 0"),
    ("ofl", "ofl 1 [01]"),
    ("osl", "osl [123] [0-9]"),
    ("postgresql", "postgresql"),
    ("python", "(?:psf 2 0|python 2 0)"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl"),
    ("zlib", "zlib"),
)
#: Other words a family goes by, so that a rule is not missed when its keyword is not in the name's variant.
ALSO = {"cc": ("cc", "creative"), "mit": ("mit", "x11", "expat"), "cc0": ("cc0", "zero")}


@dataclass(frozen=True)
class Rule:
    keywords: tuple[str, ...]
    pattern: str
    label: str
    priority: int


def signature_rules() -> list[Rule]:
    """All rules, ordered by priority, highest first."""
    found = []
    for label, name, keyword, versions in FAMILIES:
        keys = ALSO.get(keyword, (keyword,))
        found += [Rule(keys, form.format(name), label, p) for form, p in PLAIN_FORMS]
        found += [Rule(keys, form.format(name, v), f"{label}-{v.replace(' ', '.')}", p) for v in versions for form, p in VERSION_FORMS]
    found += [Rule(keys, pattern, label, p) for label, pattern, keys, p in OTHER]
    found += [Rule(("spdx",), f"spdx license identifier {pattern}", label, 3) for label, pattern in IDENTIFIERS]
    return sorted(found, key=lambda r: (-r.priority, r.keywords, r.label, r.pattern))


def line_of(text: Column) -> Column:
    """The words of a text joined by one space, A-Z not yet lower-cased."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(line: Column, pattern: Column) -> Column:
    """Numbers of the words of a line (a space before and after) at which the pattern matches.

    A mark is put before each such place; what lies before the n-th mark has as many words as spaces.
    """
    marked = F.regexp_replace(line, F.concat(F.lit("(?<= )(?=(?:"), pattern, F.lit(") )")), F.lit("\u0001"))
    words = F.split(marked, " ")
    return F.filter(F.transform(words, lambda w, i: F.when(w.startswith("\u0001"), i - 1)), lambda i: i.isNotNull())


def _matches(line: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(line, F.concat(F.lit("(?<= )(?=((?:"), pattern, F.lit(")) )")), F.lit(1))


DETECTION = "array<struct<start:int,below:int,priority:int,label:string>>"


def _detections(line: Column, rules: list[Rule]) -> Column:
    table = F.array(*[F.struct(F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority")) for r in rules])
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rules for k in r.keywords})])
    present = F.filter(keywords, lambda k: F.contains(line, F.concat(F.lit(" "), k, F.lit(" "))))
    tried = _let(present, lambda known: F.filter(table, lambda r: F.arrays_overlap(known, r["keywords"])))

    def of(r: Column) -> Column:
        pairs = F.arrays_zip(_starts(line, r["pattern"]).alias("start"), _matches(line, r["pattern"]).alias("found"))
        return F.transform(pairs, lambda x: F.struct(x["start"].alias("start"), (-(x["start"] + F.size(F.split(x["found"], " ")))).alias("below"), (-r["priority"]).alias("priority"), r["label"].alias("label")))

    return F.array_distinct(F.sort_array(F.flatten(F.transform(tried, of)))).cast(DETECTION)


def _kept(detections: Column) -> Column:
    """Detections that no earlier one of the same or a higher priority contains.

    In the order start, longest first, a detection is contained in an earlier one exactly if one of those
    ends at its end or later, so one running maximum of ends for each priority is enough.
    """
    none = F.lit(-1)
    state = F.struct(none.alias("m1"), none.alias("m2"), none.alias("m3"), F.array().cast(DETECTION).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        end, p = -x["below"], -x["priority"]
        most = F.when(p >= 3, a["m3"]).when(p == 2, F.greatest(a["m2"], a["m3"])).otherwise(F.greatest(a["m1"], a["m2"], a["m3"]))
        up = lambda k: F.when(p == k, F.greatest(a[f"m{k}"], end)).otherwise(a[f"m{k}"]).alias(f"m{k}")
        return F.struct(up(1), up(2), up(3), F.when(most >= end, a["kept"]).otherwise(F.concat(a["kept"], F.array(x))).alias("kept"))

    return F.aggregate(detections, state, step, lambda a: a["kept"])


def license_scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections for every row.

    base_labels and labels are empty strings if there are none.  score: 0 without a detection, else from the
    highest priority among kept detections (1/3, 2/3, 1).  A null text has no words.  Repeated rows stay;
    other columns are ignored.
    """
    rules = signature_rules() if rules is None else rules
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), line_of(text).alias("line"))
    low = F.lower("line")
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | F.contains(low, F.lit(h))
    n_words = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    exact = F.concat(F.lit(" "), F.translate("line", UPPER, LOWER), F.lit(" "))
    df = df.select("doc_id", n_words.cast("long").alias("n_words"), F.when(hint, exact).alias("line"))
    some = F.col("line").isNotNull()
    any_base = F.lit("|".join(p for p, _ in BASE))
    labels = F.array(*[F.when(F.contains("line", F.lit(f" {p} ")), F.lit(k)) for p, k in BASE])
    none = F.array().cast(DETECTION)
    df = df.select(
        "doc_id",
        "n_words",
        F.when(some, _starts(F.col("line"), any_base)).otherwise(F.array().cast("array<int>")).alias("at"),
        F.when(some, F.array_compact(labels)).otherwise(F.array().cast("array<string>")).alias("base"),
        F.when(some, _detections(F.col("line"), rules)).otherwise(none).alias("all"),
    )
    df = df.withColumn("kept", F.when(F.size("all") > 0, _kept(F.col("all"))).otherwise(none)).drop("all")
    found = F.array_sort(F.array_distinct(F.concat("base", F.transform("kept", lambda x: x["label"]))))
    best = F.coalesce(F.array_max(F.transform("kept", lambda x: -x["priority"])), F.when(F.size("base") > 0, 1), F.lit(0))
    return df.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(found, ",").alias("labels"),
        (best / 3.0).alias("score"),
        F.transform("kept", lambda x: F.struct(x["start"].alias("start"), (-x["below"]).alias("end"), (-x["priority"]).alias("priority"), x["label"].alias("label"))).alias("detections"),
    )


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_documents(spark, sf_dir)).drop("detections")


QUERIES = {"op4_license_rules": op4_license_rules}
