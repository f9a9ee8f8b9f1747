"""Queries over the inverted-file index and over row-level changes of a bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.operators import retrieval as R
from lodestore.operators.delta import DeltaBank
from lodestore.operators.vector_index import VectorIndex
from lodestore.plans.common import EVERY, sql_rank, sql_scores, table
from lodestore.plans.retrieval_queries import _out, _sql, sides
from lodestore.session import run_folder

K, LEAST = 5, 0.9


def index_all_lists(spark, sf_dir):
    """With all lists probed the index gives what the exact search gives: every key is in it."""
    q, k, _ = sides(spark, sf_dir, 1)
    index = VectorIndex(spark, run_folder(spark, "index")).build(k, lists=16)
    return _out(index.search(q, K, 16, 0.2))


def index_changes(spark, sf_dir):
    """Half of the keys indexed, the others added, every seventh removed and some of them added again."""
    q, k, _ = sides(spark, sf_dir, 1)
    index = VectorIndex(spark, run_folder(spark, "index")).build(k.where("ord % 2 = 0"), lists=8)
    index.add(k.where("ord % 2 = 1 or ord % 10 = 0")).remove(k.where("ord % 7 = 0")).add(k.where("ord % 14 = 0"))
    return _out(index.search(q, K, 8))


def index_recall(spark, sf_dir):
    """Probes are raised until the measured recall of the stated queries is high enough; then their answers are counted."""
    q, k, _ = sides(spark, sf_dir, 1)
    index = VectorIndex(spark, run_folder(spark, "index")).build(k)
    probes, recall = index.probes_for(q, K, LEAST)
    found = index.search(q, K, probes)
    return found.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_found"), F.lit(recall >= LEAST).alias("recall_reached")).crossJoin(index.keys().agg(F.count("*").alias("n_keys")))


def bank_rows(spark, sf_dir):
    """A bank of documents changed row by row: deletions, replaced rows, new ones, and a compaction in between."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit(0).alias("v"))
    bank = DeltaBank(spark, run_folder(spark, "rows"), "doc_id")
    bank.write(d.where("doc_id % 4 > 0"))
    bank.delete(d.where("source = 'src3'"))
    bank.upsert(d.where("doc_id % 10 = 0").withColumn("v", F.lit(1)))
    bank.compact(2)
    bank.upsert(d.where("doc_id % 20 = 0").withColumn("v", F.lit(2)))
    bank.delete(d.where("doc_id % 50 = 0"))
    return bank.read()


QUERIES = {"index_all_lists": index_all_lists, "index_changes": index_changes, "index_recall": index_recall, "bank_rows": bank_rows}

ORACLE = {
    "index_all_lists": _sql(1, sql_rank("s", "w", K) + ",\n" + sql_rank("w", "t", K, "sim >= 0.2"), "t"),
    "index_changes": f"{sql_scores(1)}, {sql_rank('s', 't', K, 'ord % 7 > 0 or ord % 14 = 0')} select query_id, ord mem_id, r::int as rank, round(sim, {R.SCALE}) sim from t",
    "index_recall": f"select count_if(vec_id % {EVERY} = 0)::bigint n_queries, count_if(vec_id % {EVERY} = 0)::bigint * {K} n_found, true recall_reached, count(*) n_keys from embeddings",
    "bank_rows": "select doc_id, source, lang, case when doc_id % 20 = 0 then 2 when doc_id % 10 = 0 then 1 else 0 end v from documents where doc_id % 50 > 0 and (doc_id % 10 = 0 or doc_id % 4 > 0 and source is distinct from 'src3')",
}
