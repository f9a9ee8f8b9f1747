"""Queries that run a stream to its end, and round trips through the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.operators import memory as B
from lodestore.operators.delta import DeltaBank
from lodestore.plans.common import table
from lodestore.session import run_folder
from lodestore.sources import records as S
from lodestore.streaming import access as A
from lodestore.streaming import forgetting as K


def stream(spark, sf_dir):
    """The events table as a stream, be it one file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    s = spark.readStream.schema(A.EVENT)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        s = s.parquet(f"{sf_dir}/events.parquet")
    else:
        s = s.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(spark, rows, name: str, mode: str):
    """The result table of a stream that has run to its end."""
    at = run_folder(spark, name)
    A.run_once(rows, f"{at}/checkpoint", f"{at}/out", mode)
    return spark.read.parquet(f"{at}/out")


def updated(spark, rows, name: str, key: list[str]):
    """The same, where each batch writes the rows that it changed, and no others, to a bank."""
    at = run_folder(spark, name)
    bank = DeltaBank(spark, f"{at}/bank", "_key")
    bank.write(spark.createDataFrame([], rows.withColumn("_key", F.lit("")).schema))
    A.each_batch(rows, f"{at}/checkpoint", A.into_bank(bank, key), "update")
    return bank.read().drop("_key")


def tumbling(spark, sf_dir):
    w = F.window("ts", "1 day")
    rows = stream(spark, sf_dir).withWatermark("ts", "2 days").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return updated(spark, rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "tumbling", ["start", "event_type"])


def stream_access(spark, sf_dir):
    rows = stream(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last_ts"))
    return updated(spark, rows, "access", ["user_id"])


def late_windows(spark, sf_dir):
    """Closed windows only: those that the watermark has passed by the end."""
    rows = A.windowed_counts(stream(spark, sf_dir), "6 hours", "1 hour")
    return finished(spark, rows, "late", "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


def sessions(spark, sf_dir):
    rows = A.sessions(stream(spark, sf_dir), "30 minutes", "1 hour")
    out = finished(spark, rows, "sessions", "append")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


def jsonl_round_trip(spark, sf_dir):
    """Documents through gzipped JSON lines."""
    at = run_folder(spark, "records")
    table(spark, sf_dir, "documents").write.option("compression", "gzip").json(at)
    back = S.read_jsonl(spark, f"{at}/*.json.gz", "doc_id long, text string, lang string, source string, n_chars long")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "source")


def bank_versions(spark, sf_dir):
    """A bank written, changed twice and read: deletions by source, then an upsert."""
    at = run_folder(spark, "bank")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit(0).alias("v"))
    bank = B.Bank(spark, at)
    bank.write(d)
    bank.change(lambda r: B.delete(r, d.where("source = 'src3'"), "doc_id"))
    new = d.where("doc_id % 10 = 0").withColumn("v", F.lit(1))
    bank.change(lambda r: B.upsert(r, new, "doc_id"))
    return bank.read()


INTERVAL, FEW = 1000, 40


def stream_forgetting(spark, sf_dir):
    """Events as accesses of users, a review every 1,000; the state store is read at the end."""
    at = run_folder(spark, "forgetting")
    rows = stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("mem_id"), F.col("event_id").alias("step"))
    K.run(K.demotions(rows, INTERVAL, FEW), f"{at}/checkpoint", f"{at}/out")
    e = table(spark, sf_dir, "events")
    users = e.select(F.col("user_id").cast("string").alias("mem_id")).distinct()
    return K.state(spark, f"{at}/checkpoint", users, e.count(), INTERVAL, FEW)


QUERIES = {"stream_forgetting": stream_forgetting, "stream_daily_counts": tumbling, "stream_access_counts": stream_access, "stream_late_windows": late_windows, "stream_sessions": sessions, "jsonl_round_trip": jsonl_round_trip, "bank_versions": bank_versions}

ORACLE = {
    "stream_forgetting": f"""with n as (select count(*) // {INTERVAL} reviews from events),
-- hits up to each review; once they are more than a few, they stay so
h as (select u.user_id, r, count(e.event_id) hits from (select distinct user_id from events) u, n, unnest(range(1, reviews + 1)) t(r) left join events e on e.user_id = u.user_id and e.event_id < r * {INTERVAL} group by all),
l as (select user_id, count_if(hits <= {FEW}) down, max(case when r = 4 then hits end) fourth from h group by 1),
a as (select user_id, count(*) hits from events group by 1)
select user_id::varchar mem_id, case when coalesce(down, 0) >= 4 then fourth else a.hits end::bigint hits, least(4, coalesce(down, 0))::int quality from a left join l using (user_id)""",
    "stream_daily_counts": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2",
    "stream_access_counts": "select user_id, count(*) n, max(ts) last_ts from events group by 1",
    "stream_late_windows": """select time_bucket(interval '6 hours', ts)::timestamp as start, event_type, count(*) n from events group by 1, 2
having start + interval '6 hours' <= (select max(ts) from events) - interval '1 hour'""",
    "stream_sessions": """with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval '30 minutes', true)::int fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) s from g),
r as (select user_id, min(ts) as start, max(ts) + interval '30 minutes' as end, count(*) n from s group by user_id, s)
select * from r where "end" <= (select max(ts) from events) - interval '1 hour'""",
    "jsonl_round_trip": "select doc_id, md5(text) digest, lang, source from documents",
    "bank_versions": "select doc_id, source, lang, case when doc_id % 10 = 0 then 1 else 0 end v from documents where doc_id % 10 = 0 or source <> 'src3'",
}
