"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for a document; the ledger keeps its measurements and one long whose bit i says
that rule i failed.  A policy is a version and a set of rules: it is applied to the ledger by a bitwise AND,
and ablations (what a policy would keep without one of its rules) come from counts of the distinct masks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import read_documents

SPACE = "[\\x20\\x09-\\x0D]+"
GRAM = 3
#: Positions are packed below the hash in one long: 24 bits of them.
PLACE = (1 << 24) - 1


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with `words`: words under a 3-word window found twice or more in the text.

    Window hashes are sorted as primitive longs.  Sorted once more with the place in the low bits, equal
    neighbours give the places of repeated windows; should the bits that are left of the hashes make two
    different windows look alike (the counts differ then), membership is tested on the whole hashes.
    """
    n = F.size("words")
    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(GRAM)]))
    df = df.withColumn("h", F.when(n >= GRAM, grams).otherwise(F.array().cast("array<bigint>")))
    df = df.drop("words").withColumn("s", F.sort_array("h"))
    twin = lambda a: F.filter(F.col(a), lambda x, i: F.coalesce(x == F.get(a, i - 1), F.lit(False)) | F.coalesce(x == F.get(a, i + 1), F.lit(False)))
    df = df.withColumn("d", F.when(F.size("s") > 1, twin("s")).otherwise(F.array().cast("array<bigint>"))).drop("s")
    low = F.lit(PLACE).cast("long")
    packed = F.transform("h", lambda x, i: x.bitwiseAND(F.lit(-1 - PLACE).cast("long")).bitwiseOR(i.cast("long")))
    some = F.size("d") > 0
    none = F.array().cast("array<bigint>")
    df = df.withColumn("p", F.when(some & (F.size("h") <= PLACE), F.sort_array(packed)).otherwise(none))
    alike = lambda x, y: F.coalesce(F.shiftright(x, 24) == F.shiftright(y, 24), F.lit(False))
    near = F.filter("p", lambda x, i: alike(x, F.get("p", i - 1)) | alike(x, F.get("p", i + 1)))
    df = df.withColumn("q", F.when(F.size("p") > 0, F.transform(near, lambda x: x.bitwiseAND(low))).otherwise(none)).drop("p")
    exact = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("d", x), i.cast("long"))), lambda x: x.isNotNull())
    df = df.withColumn("q", F.when(~some, none).when(F.size("q") == F.size("d"), F.sort_array("q")).otherwise(exact)).drop("h", "d")
    step = F.transform("q", lambda x, i: F.least(F.lit(GRAM).cast("long"), F.coalesce(x - F.get("q", i - 1), F.lit(GRAM).cast("long"))))
    return df.withColumn("n_repeat_words", F.when(F.size("q") > 0, F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))).drop("q")


#: name, and when a document fails; the place in the list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("upper_case", "100 * n_upper > 60 * word_chars"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("exclamations", "100 * n_marks > 30 * n_words"),
    ("few_distinct", "n_words >= 50 and 100 * n_distinct < 20 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = (
    Policy("v1", ("few_words", "repeated_words")),
    Policy("v2", ("few_words", "repeated_words", "symbols", "duplicate_lines", "upper_case")),
    Policy("v3", tuple(name for name, _ in RULES[:7])),
    Policy("v4", tuple(name for name, _ in RULES)),
)
CURRENT = POLICIES[-1]


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed` for every row of docs(doc_id, text).

    A null text has no words and one empty line.  Repeated rows stay; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    df = df.select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.split("text", "\n").alias("lines"))
    df = df.withColumn("lines", F.filter("lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    df = _repeat_words(df)
    failed = F.lit(0).cast("long")
    for name, rule in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("failed", failed)


def verdict(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept."""
    base = F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & verdict(policy))


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """version, rule, n_kept, n_failed_rule, n_gained: what each policy keeps, and would keep without one rule.

    Works on counts of the distinct masks, of which there are at most 2 ** len(RULES).
    """
    plan = F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(BIT[r]).cast("long").alias("bit")) for p in policies for r in p.rules])
    masks = rows.groupBy("failed").agg(F.count("*").alias("n"))
    hit = masks.select("failed", "n", F.inline(plan))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    under = F.col("failed").bitwiseAND(F.col("mask"))
    return hit.groupBy("version", "rule").agg(
        count(under == 0).alias("n_kept"),
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed_rule"),
        count(under == F.col("bit")).alias("n_gained"),
    )


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read_documents(spark, sf_dir)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op2_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(read_documents(spark, sf_dir)))


QUERIES = {"op2_quality_ledger": op2_quality_ledger, "op2_quality_ablation": op2_quality_ablation}

_FAILED = " + ".join(f"case when {rule} then {BIT[name]} else 0 end" for name, rule in RULES)

_MEASURED = f"""
with t as (select doc_id, coalesce(text, '') text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from t),
g as (select doc_id, s, [ws[s], ws[s + 1], ws[s + 2]] g from w, unnest(range(1, greatest(len(ws) - 1, 1))) t(s)),
again as (select doc_id, g from g group by all having count(*) > 1),
covered as (select distinct g.doc_id, s + k i from g join again using (doc_id, g), unnest([0, 1, 2]) t(k)),
r as (select doc_id, count(*) n from covered group by doc_id),
m as (select w.doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, len(ls)::bigint n_lines,
        (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, len(regexp_extract_all(text, '[A-Z]'))::bigint n_upper,
        len(regexp_extract_all(text, '[!?]'))::bigint n_marks, len(list_distinct(ws))::bigint n_distinct,
        coalesce(r.n, 0)::bigint n_repeat_words from w left join r using (doc_id)),
f as (select *, ({_FAILED})::bigint failed from m)"""

_PLAN = ", ".join(f"('{p.version}', '{r}', {p.mask}, {BIT[r]})" for p in POLICIES for r in p.rules)

ORACLE = {
    "op2_quality_ledger": f"""{_MEASURED}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {BASE}) != 0 base_failed,
  (failed & {BASE}) = 0 and (failed & {CURRENT.mask}) = 0 kept, failed from f
""",
    "op2_quality_ablation": f"""{_MEASURED}
select version, rule, count(*) filter ((failed & mask) = 0) n_kept, count(*) filter ((failed & bit) != 0) n_failed_rule, count(*) filter ((failed & mask) = bit) n_gained
from f, (values {_PLAN}) p(version, rule, mask, bit) group by all
""",
}
