"""Queries over order-dependent ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestore.functions import vector as V
from lodestore.operators import ingest as I
from lodestore.plans.common import table

#: The embeddings are less alike than those of real memories, so the thresholds are lower than the usual 0.85 and 0.70.
REMAIN, MERGE = 0.45, 0.35


def _name(pos: Column) -> Column:
    return F.when(pos >= I.NEW, F.concat(F.lit("n"), pos - I.NEW)).otherwise(F.concat(F.lit("b"), pos))


def _ingested(spark, sf_dir):
    """The upper half of the labels comes, one by one, to a bank of the lower half."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"), "label")
    return I.ingest(e.where("label < 5"), e.where("label >= 5"), REMAIN, MERGE)


def ingest_decisions(spark, sf_dir):
    decided, _, _ = _ingested(spark, sf_dir)
    return decided.select(F.col("ord").alias("query_id"), "action", _name(F.col("target")).alias("target"), "sim")


def ingested_bank(spark, sf_dir):
    """The keys that are left, with the number of memories in each."""
    decided, keys, _ = _ingested(spark, sf_dir)
    members = I.lineage(decided)
    return keys.join(members, "pos", "left").select(_name(F.col("pos")).alias("key"), F.coalesce(F.size("members"), F.lit(1)).cast("long").alias("n_members"), F.round(V.norm(F.col("vec")), 6).alias("norm"))


QUERIES = {"ingest_decisions": ingest_decisions, "ingested_bank": ingested_bank}

#: The loop itself: a row of the recursion holds all keys in order.
LOOP = f"""
with recursive raw as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings),
unit as (select vec_id, label, v, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) u from raw),
new as (select *, row_number() over (order by vec_id) n from unit where label >= 5),
run as (
  select 0::bigint n, (select list({{'name': 'b' || vec_id, 'size': 1::bigint, 'v': v, 'u': u}} order by vec_id) from unit where label < 5) keys, null::varchar act, null::varchar target, null::double sim, null::bigint query_id
  union all
  select n, case act when 'REMAIN' then keys
    when 'ADD' then list_append(keys, {{'name': 'n' || query_id, 'size': 1::bigint, 'v': v, 'u': u}})
    else list_append(list_filter(keys, lambda k, i: i <> nr), {{'name': 'n' || query_id, 'size': keys[nr].size + 1, 'v': mean, 'u': list_transform(mean, lambda x: x / sqrt(list_inner_product(mean, mean)))}}) end,
    act, case when act <> 'ADD' then keys[nr].name end, case when sim >= 0 then sim end, query_id
  from (select *, list_transform(list_zip(keys[nr].v, v), lambda z: (z[1] + z[2]) / 2) mean, case when sim >= {REMAIN} then 'REMAIN' when sim >= {MERGE} then 'MERGE' else 'ADD' end act
    from (select *, sims[nr] sim from (select *, list_position(sims, list_max(sims)) nr
      from (select new.n, new.vec_id query_id, new.v, new.u, run.keys, list_transform(run.keys, lambda k: round(list_inner_product(k.u, new.u), 9)) sims from run join new on new.n = run.n + 1))))
)"""

ORACLE = {
    "ingest_decisions": f'{LOOP} select query_id, act as "action", target, round(sim, 6) sim from run where n > 0',
    "ingested_bank": f"{LOOP} select k.name as key, k.size n_members, round(sqrt(list_inner_product(k.v, k.v)), 6) as norm from (select unnest(keys) k from run where n = (select max(n) from run))",
}
