"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share all tokens by weight, no source gives more than REPEAT times what it has, and what is
cut is shared anew by weight.  Each source has a weight schedule over training time t in [0, 1] that is linear
around its target, and at every t the schedules of all sources come to the same sum; the integral of one is the
demand for the source's tokens up to t.  The tokens of a source lie behind one another, document after document
in the order of a hash, epoch after epoch; inverting the demand at the place of a document gives its position
in training, and a range sort by position gives the mixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestore.llm.common import partitions, read_documents

REPEAT = 3
WEIGHTS = (1, 2, 3)
#: Slopes of the schedules: +0.5 means a source's share grows from half its mean to one and a half times it.
SLOPES = (-0.5, 0.0, 0.5)
WORDS = "[^\\x20\\x09-\\x0D]+"
#: Hexadecimal digits of the hash that name the ranges of a source's order.
DIGITS = 3


def targets(sizes: DataFrame, repeat: int = REPEAT, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """source, source_size, target, slope from (source, source_size), a row for each source.

    A source's rate at t is target * (1 + slope * (2 * t - 1)).  The mean of the slopes, weighted by target, is
    taken off each of them, so that the rates add up to the same at every t.
    Sources by code point, null last, weigh `weights`, repeating.  With sources sorted by cap per weight, the
    capped ones are the first; behind them the rest is shared by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = lambda xs: F.get(F.array(*[F.lit(float(x)) for x in xs]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(xs))))
    s = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), pick(weights).alias("weight"), pick(slopes).alias("slope"))
    s = s.withColumn("cap", F.lit(float(repeat)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    mean = F.try_divide(F.sum(F.col("target") * F.col("slope")).over(everything), F.sum("target").over(everything))
    return s.select("source", "source_size", "target", (F.col("slope") - F.coalesce(mean, F.lit(0.0))).alias("slope"))


PLAN = ("size", "source_size", "target", "copies", "taken", "place", "slope")


def plan(docs: DataFrame, repeat: int = REPEAT, weights: tuple = WEIGHTS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with size, source_size, target, copies, taken, place (words before it in its source), slope.

    A null text has size 0; rows of a null source are a source of their own, the last.  Whole epochs go to
    all documents of a source; the rest of the target to the first ones in the order of md5(doc_id), up to the
    document whose middle lies beyond it.  copies <= repeat.  Repeated rows are documents of their own.  Columns
    of docs under one of these names, whatever the case, give way; all others stay.
    """
    known = {*PLAN, "epoch", "position"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in known and (keep is None or c in keep)]
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    tie = F.xxhash64("text")
    # rows without an id are spread by their texts
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), tie.cast("string"))).cast("binary"))
    # all columns of docs travel in one, so that their names meet no others
    rows = docs.select(F.struct(*kept).alias("row"), size.alias("size"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"), F.col("source").isNull().alias("no_source"), mark.alias("mark"), F.col("doc_id").alias("id"), tie.alias("tie"))
    rows = rows.withColumn("part", F.substring("mark", 1, DIGITS))
    # sizes of the ranges of each source's order; at most 16 ** DIGITS for a source
    ranges = rows.groupBy("s", "no_source", "part").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("s", "no_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("s", "no_source", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    sizes = ranges.groupBy("s", "no_source").agg(F.sum("n").alias("source_size")).select(F.when(~F.col("no_source"), F.col("s")).alias("source"), "source_size")
    found = targets(sizes, repeat, weights).select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_source"), "source_size", "target", "slope")
    starts = starts.join(found, ["s", "no_source"])
    inside = Window.partitionBy("s", "no_source", "part").orderBy("mark", "id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["s", "no_source", "part"])
    rows = rows.withColumn("place", F.col("before") + F.col("inside"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    once_more = (epochs < repeat) & (F.col("place") + F.col("size") / 2.0 < rest)
    rows = rows.withColumn("copies", (epochs + once_more.cast("long")).cast("int"))
    return rows.withColumn("taken", F.col("copies") * F.col("size")).select("row.*", *PLAN)


def position(place: Column, target: Column, slope: Column) -> Column:
    """The time t at which target * (t + slope * (t * t - t)) is `place`."""
    c = F.when(target > 0, F.least(place / target, F.lit(1.0))).otherwise(F.lit(0.0))
    b = 1 - slope
    curve = F.when(c > 0, 2 * c / (b + F.sqrt(F.greatest(b * b + 4 * slope * c, F.lit(0.0))))).otherwise(F.lit(0.0))
    return F.least(F.greatest(curve, F.lit(0.0)), F.lit(1.0))


def mixed(planned: DataFrame) -> DataFrame:
    """One row for each time a row of plan() is taken, with epoch and position, range-sorted by position.

    Rows are sorted by the whole position and show nine digits of it, as far as engines agree.
    """
    rows = planned.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("epoch") * F.col("source_size") + F.col("place")
    rows = rows.withColumn("position", position(at, F.col("target"), F.col("slope")))
    n = partitions(planned.sparkSession)
    rows = rows.repartitionByRange(n, "position", "doc_id", "epoch").sortWithinPartitions("position", "doc_id", "epoch")
    return rows.withColumn("position", F.round("position", 9))


def mix(docs: DataFrame, repeat: int = REPEAT, weights: tuple = WEIGHTS) -> DataFrame:
    """One row for each time a document is taken, with epoch and position, range-sorted by position."""
    return mixed(plan(docs, repeat, weights))


KEY = ("doc_id", "size", "source_size", "target", "copies", "place")
MIX_COLUMNS = ("doc_id", "size", "source_size", "target", "taken", "copies", "place", "first_position", "last_position")


def documents_of_mix(docs: DataFrame) -> DataFrame:
    """The columns of MIX_COLUMNS for every document: taken is what the rows of the mix come to, 0 without one.

    first_position and last_position, to nine digits, are where in training the mix first and last has it; null if
    it does not.  Rows of the mix are put together by KEY; documents that are equal in it share the rows evenly and
    come out as often as they came in.
    """
    planned = plan(docs, keep=("doc_id",)).select(*KEY, "slope")
    found = mixed(planned).groupBy(*KEY).agg(
        F.count_if(F.col("epoch") == 0).alias("rows"),
        F.sum("size").alias("sum"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    )
    found = found.withColumn("taken", F.expr("sum div rows")).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    never = F.lit(None).cast("double")
    none = planned.where("copies = 0").select("*", F.lit(0).cast("long").alias("taken"), never.alias("first_position"), never.alias("last_position"))
    return found.select(*MIX_COLUMNS).unionByName(none.select(*MIX_COLUMNS))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of_mix(read_documents(spark, sf_dir))


def op9_curriculum_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each time a document is taken, in training order."""
    return mixed(plan(read_documents(spark, sf_dir), keep=("doc_id", "source"))).select("doc_id", "source", "size", "epoch", "position")


QUERIES = {"op9_curriculum_mix": op9_curriculum_mix, "op9_curriculum_positions": op9_curriculum_positions}

_COPIES = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5(doc_id::varchar) m from documents),
s as (select source, sum(size)::bigint source_size, (row_number() over (order by source is null, source) - 1) % 3 + 1 k from d group by source),
c as (select *, [1.0::double, 2.0::double, 3.0::double][k] weight, [-0.5::double, 0.0::double, 0.5::double][k] lean, 3.0::double * source_size cap from s),
l as (select *, ((select sum(source_size) from s)::double - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0.0::double))
  / sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) lv from c),
v as (select arg_min(lv, cap / weight) lv from l where cap >= lv * weight),
g as (select source, source_size, lean, least(cap, coalesce((select lv from v) * weight, cap)) target from c),
t as (select *, lean - coalesce((select sum(target * lean) / nullif(sum(target), 0) from g), 0) slope from g),
p as (select d.*, coalesce(sum(size) over (partition by source order by m, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint place from d),
e as (select p.*, source_size, target, slope, case when source_size > 0 then floor(target / source_size) else 0 end::bigint epochs from p join t on p.source is not distinct from t.source),
n as (select *, (epochs + (epochs < 3 and place + size / 2.0 < target - epochs * source_size)::int)::int copies from e)"""

ORACLE = {
    "op9_curriculum_mix": f"""{_COPIES},
a as (select *, case when target > 0 then least(place / target, 1) else 0 end c, case when target > 0 then least(((copies - 1) * source_size + place) / target, 1) else 0 end z from n)
select doc_id, size, source_size, target, copies * size taken, copies, place,
  case when copies > 0 then round(case when c > 0 then 2 * c / (1 - slope + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * c, 0))) else 0 end, 9) end first_position,
  case when copies > 0 then round(case when z > 0 then 2 * z / (1 - slope + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * z, 0))) else 0 end, 9) end last_position from a
""",
    "op9_curriculum_positions": f"""{_COPIES},
a as (select *, case when target > 0 then least((epoch * source_size + place) / target, 1) else 0 end c from n, unnest(range(copies)) t(epoch))
select doc_id, source, size, epoch::int epoch, round(least(greatest(case when c > 0 then 2 * c / (1 - slope + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * c, 0))) else 0 end, 0), 1), 9)::double "position" from a
""",
}
