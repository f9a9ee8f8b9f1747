"""Queries over similarity retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions import vector as V
from lodestore.operators import retrieval as R
from lodestore.plans.common import EVERY, memories, sql_rank, sql_scores, table

ALPHA, K, THRESHOLD = 0.75, 2, 0.1
GRID = (0.0, 0.5, 0.75, 1.0)


def sides(spark: SparkSession, sf_dir: str, alpha: float = ALPHA, metric: str = "cosine") -> tuple[DataFrame, DataFrame, DataFrame]:
    m = memories(spark, sf_dir)
    keys = R.keys_of(m, "ord", F.col("image"), None if alpha == 1 else F.col("text"), alpha, metric)
    q = m.where(F.col("ord") % EVERY == 0)
    queries = R.keys_of(q, "ord", F.col("image"), metric=metric).withColumnRenamed("ord", "query_id")
    return queries, keys, m.select("ord", "label", "quality")


def _out(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("query_id", F.col("ord").alias("mem_id"), F.col("rank").cast("int").alias("rank"), F.round("sim", R.SCALE).alias("sim"), *more)


def _sql(alpha: float, steps: str, last: str, more: str = "", metric: str = "cosine") -> str:
    return f"{sql_scores(alpha, metric)},\n{steps}\nselect query_id, ord mem_id, r::int as rank, round(sim, {R.SCALE}) sim{more} from {last}"


def hybrid_topk(spark, sf_dir):
    q, k, _ = sides(spark, sf_dir)
    return _out(R.top_k(q, k, K, THRESHOLD, over=10))


def window_query(over: int, alpha: float = ALPHA):
    """Self matches take places of the window."""

    def f(spark, sf_dir):
        q, k, _ = sides(spark, sf_dir, alpha)
        return _out(R.top_k(q, k, K, THRESHOLD, over=over, keep=F.col("ord") != F.col("query_id")))

    return f


def forgetting_topk(spark, sf_dir):
    q, k, a = sides(spark, sf_dir)
    alive = (F.col("ord") != F.col("query_id")) & (F.col("quality") < 4)
    return _out(R.top_k(q, k, K, THRESHOLD, over=20, keep=alive, attributes=a), "quality")


def candidates_30(spark, sf_dir):
    q, k, _ = sides(spark, sf_dir)
    rows = R.candidates(q, k, 30).where(F.col("ord") != F.col("query_id")).drop("rank")
    return _out(R.ranked(rows, 30))


def metric_query(metric: str, threshold: float | None):
    def f(spark, sf_dir):
        q, k, _ = sides(spark, sf_dir, 1, metric)
        return _out(R.top_k(q, k, 5, threshold, over=0, metric=metric))

    return f


def category_topk(spark, sf_dir):
    q, k, a = sides(spark, sf_dir, 1)
    return _out(R.by_category(q, k, a, F.col("label") == F.pmod("query_id", F.lit(10)), K, 0.2), "label")


def hybrid_mode(spark, sf_dir):
    q, k, a = sides(spark, sf_dir, 1)
    return _out(R.hybrid_mode(q, k, a, F.col("label") < 7, F.col("quality") < 3, K, 0.2), "label", "quality")


def nearest_action(spark, sf_dir):
    """New memories (every 50th) against the bank of all others."""
    q, k, _ = sides(spark, sf_dir, 1)
    rows = R.nearest(q, k.where(F.col("ord") % EVERY != 0))
    return rows.select("query_id", "neighbour", F.round("sim", R.SCALE).alias("sim"), R.duplicate_action(F.col("sim"), 0.45, 0.40).alias("action"))


def decayed(spark, sf_dir):
    """Scores decay by whole days of age; the order does not change."""
    now = F.lit("2024-02-15 12:00:00").cast("timestamp_ntz")
    born = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("ts").alias("created_at"))
    q, k, _ = sides(spark, sf_dir, 1)
    rows = R.top_k(q, k, 5, THRESHOLD, over=5).join(born, "ord")
    return _out(rows, F.round(V.time_decay(F.col("sim"), F.col("created_at"), now, 0.05), R.SCALE).alias("score"))


def recent_orders(spark, sf_dir):
    """The ten newest orders of 1995 that have lines of three or more; orders without leave gaps in the rank."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderdate").alias("created_at"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("ord"))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return R.recent(o, 10, stamp("1995-01-01"), stamp("1995-12-31"), files=lines).select("ord", "created_at", "rank", "score")


def first_matching(spark, sf_dir):
    """The first 20 events by id whose metadata matches; a missing path does not match."""
    e = table(spark, sf_dir, "events").withColumn("ord", F.col("event_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    return R.first_matching(e, (k == 7) & (F.col("event_type") == "view"), 20).select("event_id", "user_id", "event_type")


def fetch_by_ids(spark, sf_dir):
    """Orders of each customer's list of ids, with ids that do not exist in between."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.array(*[F.col("c_custkey") * k - F.lit(k - 3) for k in (1, 3, 7, 100)]).alias("ids"))
    return R.by_ids(o, c).select("query_id", "rank", F.col("ord").alias("order_id"), "o_totalprice")


def token_budget(spark, sf_dir):
    """Turns of each conversation, newest first, while they fit into 300 words."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.size(F.split(F.trim("text"), r"[ \n]+")).cast("long").alias("n"))
    rows = R.within_budget(c, "n", 300, [F.desc("turn")])
    return rows.select(F.col("query_id").alias("conv_id"), "turn", "n", "cum", "total_tokens")


def ablation_grid(spark, sf_dir):
    """Hit rate and mean score for every alpha and k, from one pass over the vectors."""
    m = memories(spark, sf_dir)
    q, _, _ = sides(spark, sf_dir, 1)
    hits = R.hybrid_grid(q, m.select("ord", *[F.transform(c, lambda x: x.cast("double")).alias(c) for c in ("image", "text")]), GRID, 13).where("sim >= 0.3")
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(k).alias("k")) for a in GRID for k in (1, 2, 3)]))
    asked = q.select("query_id", cells.alias("c")).select("query_id", "c.alpha", "c.k")
    h = hits.select(F.col("alpha").alias("a"), F.col("query_id").alias("qid"), "rank", "sim")
    per = asked.join(h, (F.col("qid") == F.col("query_id")) & (F.col("a") == F.col("alpha")) & (F.col("rank") <= F.col("k")), "left").groupBy("alpha", "k", "query_id").agg(F.count("sim").alias("n"), F.sum("sim").alias("s"))
    cell = per.groupBy("alpha", "k").agg((F.sum((F.col("n") > 0).cast("int")) / F.greatest(F.count("*"), F.lit(1))).alias("hit_rate"), F.round(F.sum("s") / F.sum("n"), R.SCALE).alias("avg_score"))
    return cell.select("alpha", "k", F.round("hit_rate", R.SCALE).alias("hit_rate"), "avg_score")


def retrieval_metrics(spark, sf_dir):
    """Hits, mean and deviation of similarity, subject and topic match, over all queries."""
    q, k, a = sides(spark, sf_dir)
    hits = R.top_k(q, k, 3, 0.25, over=5, keep=F.col("ord") != F.col("query_id"), attributes=a)
    mine = a.select(F.col("ord").alias("query_id"), F.col("label").alias("subject"))
    per = q.select("query_id").join(mine, "query_id").join(hits, "query_id", "left")
    hit = F.col("sim").isNotNull()
    share = lambda c: F.round(F.coalesce(100 * F.sum((hit & c).cast("int")) / F.nullif(F.count("sim"), F.lit(0)), F.lit(0.0)), 4)
    return per.agg(
        F.countDistinct("query_id").alias("n_queries"),
        F.round(100 * F.countDistinct(F.when(hit, F.col("query_id"))) / F.countDistinct("query_id"), 4).alias("hit_pct"),
        F.round(F.coalesce(F.avg("sim"), F.lit(0.0)), R.SCALE).alias("mean_sim"),
        F.round(F.coalesce(F.stddev_pop("sim"), F.lit(0.0)), R.SCALE).alias("std_sim"),
        share(F.col("label") == F.col("subject")).alias("subject_match_pct"),
        share(F.col("label") % 3 == F.col("subject") % 3).alias("topic_match_pct"),
        F.round(F.count("sim") / F.countDistinct("query_id"), 4).alias("avg_hits"),
    )


def overlap(spark, sf_dir):
    """Share of queries whose hit sets agree between two alphas; two empty sets agree."""
    sets = []
    for alpha in (0.75, 1.0):
        q, k, _ = sides(spark, sf_dir, alpha)
        hits = R.top_k(q, k, 2, 0.35, over=5)
        sets.append(q.select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg(F.sort_array(F.collect_set("ord")).alias(f"s{len(sets)}")))
    both = sets[0].join(sets[1], "query_id")
    return both.agg(F.round(100 * F.avg((F.col("s0") == F.col("s1")).cast("int")), 4).alias("overlap_pct"), F.count("*").alias("n_queries"))


def context(spark, sf_dir):
    """The five best memories of each query with their labels; those of label 3 are gone."""
    q, k, a = sides(spark, sf_dir, 1)
    made = R.prepared_context(R.candidates(q, k, 8), a.where("label <> 3"), "label")
    text = F.array_join(F.transform("memories", lambda m: F.concat_ws(":", m["rank"], m["ord"], m["label"])), ",")
    return made.select("query_id", "n_found", F.coalesce(text, F.lit("")).alias("memories"))


def asked_ids(spark, sf_dir):
    """Which of some ids the bank has."""
    _, k, _ = sides(spark, sf_dir, 1)
    return R.exists(k.where("ord % 3 > 0"), k.select((F.col("ord") * 2).alias("ord")), "ord")


QUERIES = {
    "prepared_context": context,
    "existence": asked_ids,
    "hybrid_topk": hybrid_topk,
    "topk_window_5": window_query(5),
    "topk_window_2": window_query(2),
    "topk_window_10": window_query(10),
    "topk_text_only": window_query(5, 0.0),
    "topk_with_forgetting": forgetting_topk,
    "candidates_30": candidates_30,
    "search_cosine": metric_query("cosine", 0.2),
    "search_inner_product": metric_query("ip", 0.2),
    "search_l2": metric_query("l2", None),
    "topk_category_after_window": category_topk,
    "retrieve_hybrid_mode": hybrid_mode,
    "nearest_duplicate_action": nearest_action,
    "time_decay_scores": decayed,
    "recent_with_gaps": recent_orders,
    "metadata_first_k": first_matching,
    "fetch_by_ids": fetch_by_ids,
    "token_budget": token_budget,
    "ablation_grid": ablation_grid,
    "retrieval_metrics": retrieval_metrics,
    "overlap_pct": overlap,
}


def _window_sql(over: int, alpha: float = ALPHA) -> str:
    return _sql(alpha, sql_rank("s", "w", K + over) + ",\n" + sql_rank("w", "t", K, f"ord <> query_id and sim >= {THRESHOLD}"), "t")


def _grid_sql() -> str:
    cells = []
    for alpha in GRID:
        cells.append(f"""select * from ({sql_scores(alpha)}, {sql_rank("s", "w", 13)},
h as (select * from w where sim >= 0.3), per as (select k, q.query_id, count(h.sim) n, sum(h.sim) s from q cross join (values (1), (2), (3)) g(k) left join h on h.query_id = q.query_id and h.r <= k group by all)
select {alpha}::double alpha, k, round(sum((n > 0)::int) / greatest(count(*), 1), {R.SCALE}) hit_rate, round(sum(s) / sum(n), {R.SCALE}) avg_score from per group by k)""")
    return "\nunion all\n".join(cells)


ORACLE = {
    "prepared_context": f"{sql_scores(1)}, {sql_rank('s', 't', 8)} select query_id, count(*) n_found, coalesce(string_agg(r || ':' || ord || ':' || label, ',' order by r) filter (where r <= 5 and label <> 3), '') memories from t group by 1",
    "existence": "select distinct vec_id * 2 ord, vec_id * 2 in (select vec_id from embeddings where vec_id % 3 > 0) there from embeddings",
    "hybrid_topk": _sql(ALPHA, sql_rank("s", "w", K + 10) + ",\n" + sql_rank("w", "t", K, f"sim >= {THRESHOLD}"), "t"),
    "topk_window_5": _window_sql(5),
    "topk_window_2": _window_sql(2),
    "topk_window_10": _window_sql(10),
    "topk_text_only": _window_sql(5, 0.0),
    "topk_with_forgetting": _sql(ALPHA, sql_rank("s", "w", K + 20) + ",\n" + sql_rank("w", "t", K, f"ord <> query_id and quality < 4 and sim >= {THRESHOLD}"), "t", ", quality"),
    "candidates_30": _sql(ALPHA, sql_rank("s", "w", 30) + ",\n" + sql_rank("w", "t", 30, "ord <> query_id"), "t"),
    "search_cosine": _sql(1, sql_rank("s", "w", 5) + ",\n" + sql_rank("w", "t", 5, "sim >= 0.2"), "t"),
    "search_inner_product": _sql(1, sql_rank("s", "w", 5) + ",\n" + sql_rank("w", "t", 5, "sim >= 0.2"), "t", metric="ip"),
    "search_l2": _sql(1, sql_rank("s", "t", 5), "t", metric="l2"),
    "topk_category_after_window": _sql(1, sql_rank("s", "w", 2 * K) + ",\n" + sql_rank("w", "t", K, "label = query_id % 10 and sim >= 0.2"), "t", ", label"),
    "retrieve_hybrid_mode": _sql(1, sql_rank("s", "w", 6 * K) + ",\n" + sql_rank("w", "c", 3 * K, "label < 7 and sim >= 0.2") + ",\n" + sql_rank("c", "t", K, "quality < 3"), "t", ", label, quality"),
    "nearest_duplicate_action": f"""{sql_scores(1)}, {sql_rank("s", "t", 1, f"ord % {EVERY} <> 0")}
select q.query_id, t.ord neighbour, round(t.sim, {R.SCALE}) sim, case when t.sim >= 0.45 then 'REMAIN' when t.sim >= 0.40 then 'MERGE' else 'ADD' end as action
from q left join (select * from t where sim >= 0) t using (query_id)""",
    "time_decay_scores": _sql(1, sql_rank("s", "w", 10) + ",\n" + sql_rank("w", "t", 5, f"sim >= {THRESHOLD}"), "t join events on event_id = ord", f", round(sim * exp(-0.05 * floor((epoch_us(timestamp '2024-02-15 12:00:00') - epoch_us(ts)) / 86400000000)), {R.SCALE}) score"),
    "recent_with_gaps": """
with t as (select o_orderkey ord, o_orderdate created_at, row_number() over (order by o_orderdate desc, o_orderkey)::int as rank from orders
  where o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1995-12-31')
select ord, created_at, rank, 1.0::double score from t where rank <= 10 and ord in (select l_orderkey from lineitem where l_linenumber >= 3)""",
    "metadata_first_k": "select event_id, user_id, event_type from events where (props ->> '$.k')::int = 7 and event_type = 'view' order by event_id limit 20",
    "fetch_by_ids": """
with i as (select c_custkey query_id, unnest([c_custkey, c_custkey * 3, c_custkey * 7, c_custkey * 100]) - unnest([-2, 0, 4, 97]) ord, unnest([0, 1, 2, 3])::int as rank from customer)
select query_id, rank, o_orderkey order_id, o_totalprice from i join orders on o_orderkey = ord""",
    "token_budget": """
with c as (select conv_id, turn, len(string_split_regex(trim(text), '[ \\n]+'))::bigint n from conversations),
r as (select *, sum(n) over (partition by conv_id order by turn desc rows unbounded preceding)::bigint cum from c),
t as (select *, coalesce(min(case when cum > 300 then cum end) over (partition by conv_id), max(cum) over (partition by conv_id))::bigint total_tokens from r)
select * from t where cum <= 300""",
    "ablation_grid": _grid_sql(),
    "retrieval_metrics": f"""{sql_scores(ALPHA)}, {sql_rank("s", "w", 8)}, {sql_rank("w", "t", 3, "ord <> query_id and sim >= 0.25")},
p as (select q.query_id, k.label subject, t.label, t.sim from q join keys k on k.ord = q.query_id left join t on t.query_id = q.query_id)
select count(distinct query_id) n_queries, round(100 * count(distinct case when sim is not null then query_id end) / count(distinct query_id), 4) hit_pct,
round(coalesce(avg(sim), 0), {R.SCALE}) mean_sim, round(coalesce(stddev_pop(sim), 0), {R.SCALE}) std_sim,
round(coalesce(100 * count_if(label = subject) / nullif(count(sim), 0), 0), 4) subject_match_pct,
round(coalesce(100 * count_if(label % 3 = subject % 3) / nullif(count(sim), 0), 0), 4) topic_match_pct, round(count(sim) / count(distinct query_id), 4) avg_hits from p""",
    "overlap_pct": "with "
    + ",\n".join(f"h{n} as ({sql_scores(a)}, {sql_rank('s', 'w', 7)}, {sql_rank('w', 't', 2, 'sim >= 0.35')} select q.query_id, list_sort(list(ord) filter (where ord is not null)) o from q left join t using (query_id) group by all)" for n, a in enumerate((0.75, 1.0)))
    + "\nselect round(100 * avg((coalesce(h0.o, []) = coalesce(h1.o, []))::int), 4) overlap_pct, count(*) n_queries from h0 join h1 using (query_id)",
}
