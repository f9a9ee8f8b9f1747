"""Answer scores: exact match, token F1, VQA accuracies, ANLS, list answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.functions.text import normalize_answer, normalize_answer_drop
from lodestore.functions.vector import let


def exact_match(p: Column, g: Column, norm=normalize_answer) -> Column:
    return (norm(p) == norm(g)).cast("double")


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")


def common_tokens(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two token arrays.

    Both sorted arrays of (token, occurrence number) are sets; their intersection counts each pairing once.
    """

    def numbered(a: Column) -> Column:
        s = F.array_sort(a)
        # the occurrence number of a token in a sorted array: its place less that of the first equal one
        return F.transform(s, lambda x, i: F.concat(x, F.lit(" "), (i + 1 - F.array_position(s, x)).cast("string")))

    return F.size(F.array_intersect(numbered(p), numbered(g)))


def token_f1(p: Column, g: Column, norm=normalize_answer) -> Column:
    """0 when no token is shared, also for two empty answers."""
    a, b = tokens(norm(p)), tokens(norm(g))
    n = common_tokens(a, b)
    return F.when(n == 0, F.lit(0.0)).otherwise(2.0 * (n / F.size(a)) * (n / F.size(b)) / (n / F.size(a) + n / F.size(b)))


def any_equal(form: Column, forms: Column) -> Column:
    return F.coalesce(F.exists(forms, lambda a: a == form), F.lit(False)).cast("double")


def share_equal(form: Column, forms: Column) -> Column:
    """A third for each equal form, 1 at most."""
    return F.least(F.lit(1.0), F.size(F.filter(forms, lambda a: a == form)) / 3.0)


def vqa_any(p: Column, answers: Column) -> Column:
    return let(normalize_answer(p), lambda form: any_equal(form, F.transform(answers, normalize_answer)))


def soft_form(a: Column) -> Column:
    return F.trim(F.lower(a))


def soft_prediction(p: Column) -> Column:
    return F.regexp_replace(soft_form(p), r"\.+$", "")


def vqa_soft(p: Column, answers: Column) -> Column:
    """A third for each equal answer, 1 at most; only the prediction loses its final dots."""
    return let(soft_prediction(p), lambda form: share_equal(form, F.transform(answers, soft_form)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    return F.when(x == y, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def similarities(p: Column, answers: Column) -> Column:
    """The similarity to each answer; answers of one form are measured once."""
    def of(forms: Column) -> Column:
        kinds = F.array_distinct(forms)
        return let(F.transform(kinds, lambda a: levenshtein_similarity(p, a)), lambda s: F.transform(forms, lambda a: F.get(s, (F.array_position(kinds, a) - 1).cast("int"))))

    return let(F.transform(answers, soft_form), of)


def anls_of(similarities: Column, least: float = 0.5) -> Column:
    return let(F.array_max(similarities), lambda best: F.when(best >= least, best).otherwise(F.lit(0.0)))


def anls(p: Column, answers: Column, least: float = 0.5) -> Column:
    """The best similarity to an answer, 0 below `least` or without answers."""
    return anls_of(similarities(p, answers), least)


def list_scores(rows: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """key, em, f1 for list answers (arrays of strings).

    One answer each: EM and F1 of the two.  Else EM is set equality of the normalised answers with equal sizes,
    and F1 sums a greedy one-to-one alignment by bag F1 (ties: the larger places first) over the gold answers.
    An empty gold list scores 0; an empty prediction counts as one empty answer.
    """
    base = rows.select(key, F.when(F.size(pred) > 0, F.col(pred)).otherwise(F.array(F.lit(""))).alias("p"), F.col(gold).alias("g"))
    sets = lambda c: F.array_distinct(F.transform(c, normalize_answer_drop))
    em = (F.size("p") == F.size("g")) & (F.array_sort(sets("p")) == F.array_sort(sets("g")))
    pairs = base.select(key, F.posexplode("p").alias("i", "a"), "g").select(key, "i", "a", F.posexplode("g").alias("j", "b"))
    bag = lambda c: F.array_distinct(tokens(normalize_answer_drop(c)))
    a, b = bag(F.col("a")), bag(F.col("b"))
    n = F.size(F.array_intersect(a, b))
    f1 = F.when(n > 0, 2.0 * n / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))
    listed = pairs.select(key, F.struct((-f1).alias("s"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j")).alias("x")).groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    start = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("j"), F.lit(0.0).alias("t"))

    def take(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["i"], x["i"]) & ~F.array_contains(s["j"], x["j"])
        put = lambda k: F.when(free, F.concat(s[k], F.array(x[k]))).otherwise(s[k]).alias(k)
        return F.struct(put("i"), put("j"), F.when(free, s["t"] - x["s"]).otherwise(s["t"]).alias("t"))

    total = listed.select(key, F.aggregate("xs", start, take, lambda s: s["t"]).alias("t"))
    one = (F.size("p") == 1) & (F.size("g") == 1)
    first = lambda c: F.get(F.col(c), F.lit(0))
    none = F.size("g") == 0
    joined = base.join(total, key, "left")
    return joined.select(
        key,
        F.when(none, 0.0).when(one, exact_match(first("p"), first("g"), normalize_answer_drop)).otherwise(em.cast("double")).alias("em"),
        F.when(none, 0.0).when(one, token_f1(first("p"), first("g"), normalize_answer_drop)).otherwise(F.coalesce("t", F.lit(0.0)) / F.size("g")).alias("f1"),
    )


def token_f1_rows(rows: DataFrame, key: str, pred: str, gold: str, norm=normalize_answer) -> DataFrame:
    """key, common, n_pred, n_gold, f1 for long answers: token counts are grouped and joined instead of nested."""
    side = lambda c, n: rows.select(key, F.explode(tokens(norm(F.col(c)))).alias("token")).groupBy(key, "token").agg(F.count("*").alias(n))
    both = side(pred, "np").join(side(gold, "ng"), [key, "token"], "full")
    sums = both.groupBy(key).agg(
        F.sum(F.least(F.coalesce("np", F.lit(0)), F.coalesce("ng", F.lit(0)))).alias("common"),
        F.sum(F.coalesce("np", F.lit(0))).alias("n_pred"),
        F.sum(F.coalesce("ng", F.lit(0))).alias("n_gold"),
    )
    out = rows.select(key).join(sums, key, "left").na.fill(0, ["common", "n_pred", "n_gold"])
    return out.withColumn("f1", F.when(F.col("common") == 0, F.lit(0.0)).otherwise(2.0 * F.col("common") / (F.col("n_pred") + F.col("n_gold"))))
