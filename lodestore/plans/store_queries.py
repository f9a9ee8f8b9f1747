"""Queries over memories with tokens, reward tables, training rows and agent prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import prompt as P
from lodestore.functions import text as T
from lodestore.operators import agent as A
from lodestore.operators import evaluation as E
from lodestore.operators import layout as L
from lodestore.operators import store as S
from lodestore.operators.memory import Bank
from lodestore.plans.analytics_queries import ORACLE as ANALYTICS
from lodestore.plans.analytics_queries import canvas_replay
from lodestore.plans.common import table
from lodestore.plans.layout_queries import _BLOCKS, blocks
from lodestore.session import run_folder

STRATEGIES = L.STRATEGIES


def memories(spark, sf_dir):
    """Embeddings as memories of two tokens each; metadata says from where."""
    e = table(spark, sf_dir, "embeddings")
    extra = F.to_json(F.struct(F.struct((F.col("label") % 3).alias("kind")).alias("origin"), F.concat(F.lit("t"), F.col("vec_id") % 4).alias("tag")))
    return e.select(
        F.concat(F.lit("m"), "vec_id").alias("memory_id"),
        F.concat(F.lit("c"), F.col("label") % 2).alias("category"),
        F.col("vec_id").alias("ord"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("vec_id") * 7919, F.lit(10_007)) * 60).alias("created_at"),
        F.array(F.concat(F.lit("s"), F.col("label") % 3)).alias("source"),
        F.array(F.lit("image"), F.lit("text")).alias("modalities"),
        F.lit(2).alias("total_tokens"),
        F.when(F.col("vec_id") % 5 > 0, extra).alias("extra"),
        F.array("embedding", F.reverse("embedding")).alias("tokens"),
        F.col("embedding").alias("key_embedding"),
    )


MEMORIES = """m as (select 'm' || vec_id memory_id, 'c' || label % 2 category, vec_id ord, make_timestamp((1700000000::bigint + vec_id * 7919 % 10007 * 60) * 1000000) created_at, 's' || label % 3 as source,
case when vec_id % 5 > 0 then label % 3 end kind, case when vec_id % 5 > 0 then 't' || vec_id % 4 end tag from embeddings)"""


def token_store(spark, sf_dir):
    """Memories saved in two versions, the second in place of some of the first, and one category read back."""
    bank = Bank(spark, run_folder(spark, "tokens"))
    rows = memories(spark, sf_dir)
    S.save_tokens(bank, rows.where("ord % 3 > 0").drop("category"))
    S.save_tokens(bank, rows.where("ord % 2 = 0"), overwrite=True)
    found = S.by_category(bank, "c1").unionByName(S.by_category(bank, "default"))
    return S.listing(found).join(found.select("memory_id", "category", "compress_mode", "is_aligned", F.size("tokens").alias("n")), "memory_id").withColumns({c: F.array_join(c, ",") for c in ("source", "modalities")})


def self_healing_load(spark, sf_dir):
    """The index after some ids were asked for whose rows are gone."""
    rows = memories(spark, sf_dir).select("memory_id", "ord")
    found, index = S.load(rows, rows.where("ord % 7 > 0"), rows.where("ord % 2 = 0"))
    return index.select("memory_id", F.lit("index").alias("part")).unionByName(found.select("memory_id", F.lit("found").alias("part")))


def delete_by_filter(spark, sf_dir):
    """What is left when memories of a time and a kind are deleted."""
    end = F.timestamp_seconds(F.lit(1_700_000_000 + 5_000 * 60))
    rows = S.token_rows(memories(spark, sf_dir))
    return S.delete_by_filter(rows, end=end, meta={"origin.kind": 1}).select("memory_id")


def metadata_paths(spark, sf_dir):
    """Dotted paths: all of them have to be there and to agree."""
    m = memories(spark, sf_dir).withColumn("v", F.try_parse_json("extra"))
    hit = lambda w: S.matches(F.col("v"), w)
    return m.select("memory_id", hit({"origin.kind": 2, "tag": "t1"}).alias("both"), hit({"origin.missing": 1}).alias("missing"), hit({}).alias("free"))


def results(spark, sf_dir):
    """Parts as results of layout configurations, some of them evaluated twice."""
    p = table(spark, sf_dir, "part")
    name = F.element_at(F.array(*[F.lit(s) for s in (*STRATEGIES, "odd_one", "figure")]), (F.pmod("p_partkey", F.lit(10)) + 1).cast("int"))
    return p.select(
        F.floor(F.col("p_partkey") / 4).alias("pid"),
        F.concat_ws("_", name, F.when(F.col("p_size") % 2 == 0, "wide").otherwise("narrow"), F.lit("medium_balanced_none_normal")).alias("config_hash"),
        F.col("p_partkey").alias("ord"),
        (F.col("p_size") % 3 == 0).alias("correct"),
        F.col("p_name").alias("question"),
        F.array("p_brand", "p_type").alias("choices"),
        F.when(F.col("p_size") > 40, 640).otherwise(0).alias("canvas_w"),
    )


RESULTS = f"""r as (select p_partkey // 4 pid, {list((*STRATEGIES, "odd_one", "figure"))!r}[p_partkey % 10 + 1] || case when p_size % 2 = 0 then '_wide' else '_narrow' end || '_medium_balanced_none_normal' config_hash,
p_partkey ord, p_size % 3 = 0 correct, length(p_name) + length(p_brand) + length(p_type) chars, p_size > 40 pictured from part)"""


def strategy_accuracy(spark, sf_dir):
    return E.strategy_accuracy(results(spark, sf_dir), STRATEGIES).withColumn("accuracy", F.round("accuracy", 9))


def reward_table(spark, sf_dir):
    return E.reward_table(results(spark, sf_dir))


def block_info(spark, sf_dir):
    return E.block_info(results(spark, sf_dir))


def training_rows(spark, sf_dir):
    """Nested training rows with their split; the ground truth as JSON."""
    r = results(spark, sf_dir)
    info = E.block_info(r)
    problems = info.select("pid", F.concat(F.lit("q"), "pid").alias("question"), F.lit("lay out").alias("system"), F.concat(F.lit("chars "), "total_chars").alias("user"), F.struct("total_chars", "has_image").alias("block_info"))
    rows = E.train_split(E.training_records(problems, E.reward_table(r)), "pid")
    return rows.select("pid", "split", "ability", F.col("prompt")[1]["content"].alias("said"), F.col("reward_model.ground_truth").alias("truth"))


def table_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.concat_ws("-", F.col("l_partkey"), F.repeat(F.lit("x"), 38)).alias("c")).alias("s"))
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s"))
    made = T.table_rows(F.array(F.lit("line"), F.lit("part")), F.transform("s", lambda x: F.array(x["l_linenumber"].cast("string"), x["c"])), 3)
    return g.select("l_orderkey", made.alias("t")).select("l_orderkey", F.array_join("t.headers", ",").alias("headers"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


def agent_prompts(spark, sf_dir):
    """Prompts for writing, reading and laying out."""
    p = table(spark, sf_dir, "part")
    lib = F.when(F.col("p_partkey") % 3 > 0, F.array(F.concat(F.lit("[1] "), "p_type"), F.concat(F.lit("[2] "), "p_brand"))).otherwise(F.array().cast("array<string>"))
    cand = F.array(F.struct(F.col("p_partkey").cast("string").alias("canvas_id"), F.col("p_type").alias("topic"), (F.col("p_size") / 70).alias("score"), F.when(F.col("p_size") > 20, F.col("p_name")).alias("summary")))
    block = F.array(L.block(F.lit("text"), F.lit("question"), F.col("p_name"), F.lit(400), F.lit(0), F.lit(18)), L.block(F.lit("image"), F.lit("figure"), F.lit(None), F.lit(300), F.lit(200), F.lit(0)))
    return p.select("p_partkey", P.write_prompt(lib, F.col("p_name")).alias("w"), P.read_prompt(F.col("p_name"), cand).alias("r"), P.layout_prompt(block).alias("l"))


def record_adapters(spark, sf_dir):
    """Text blocks of a science question, with and without the question, and of a question over passages."""
    p = table(spark, sf_dir, "part")
    c = {"subject": F.col("p_type"), "topic": F.when(F.col("p_size") > 10, F.col("p_brand")), "hint": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), "question": F.col("p_name"), "choices": F.array("p_brand", "p_type"), "lecture": F.when(F.col("p_size") % 3 == 0, F.col("p_name")), "solution": F.lit("")}
    show = lambda b: F.array_join(F.transform(b, lambda x: F.concat_ws("|", x["role"], x["font"].cast("string"), x["text"])), "\n\n")
    return p.select("p_partkey", show(L.science_blocks(**c)).alias("full"), show(L.science_blocks(**{k: v for k, v in c.items() if k not in ("question", "choices", "solution")})).alias("knowledge"), show(L.question_blocks(F.col("p_name"), F.array("p_type", F.lit("")))).alias("passages"))


def layout_features(spark, sf_dir):
    made = F.array(*[F.struct(F.lit(w).alias("tw"), L.single_column(F.col("b"), F.lit(w)).alias("l")) for w in L.WIDTHS.values()])
    rows = blocks(spark, sf_dir).select("doc_id", F.inline(made)).select("doc_id", "tw", L.features(F.col("l")).alias("f"))
    return rows.select("doc_id", "tw", *[F.round(F.col("f")[k], 9).alias(f"f{k}") for k in range(15)])


def canvas_statistics(spark, sf_dir):
    return A.canvas_statistics(canvas_replay(spark, sf_dir), 8)


QUERIES = {
    "token_store": token_store,
    "self_healing_load": self_healing_load,
    "delete_by_filter": delete_by_filter,
    "metadata_paths": metadata_paths,
    "strategy_accuracy": strategy_accuracy,
    "reward_table": reward_table,
    "block_info": block_info,
    "training_rows": training_rows,
    "table_rows": table_rows,
    "agent_prompts": agent_prompts,
    "record_adapters": record_adapters,
    "layout_features": layout_features,
    "canvas_statistics": canvas_statistics,
}

_NL = "chr(10)"
_LAYOUT_HEAD = P.LAYOUT_HEAD.replace("\n", "' || chr(10) || '")
_LAYOUT_END = P.LAYOUT_END.replace("\n", "' || chr(10) || '").replace("{strategies}", ", ".join(STRATEGIES))

ORACLE = {
    "token_store": f"""with {MEMORIES}, a as (select * replace ('default' as category) from m where ord % 3 > 0 and ord % 2 > 0 union all select * from m where ord % 2 = 0)
select memory_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') created_at, source, 'image,text' modalities, 2 total_tokens, category, 'none' compress_mode, false is_aligned, 2 n from a where category in ('c1', 'default')""",
    "self_healing_load": f"with {MEMORIES} select memory_id, 'index' part from m where not (ord % 2 = 0 and ord % 7 = 0) union all select memory_id, 'found' from m where ord % 2 = 0 and ord % 7 > 0",
    "delete_by_filter": f"""with {MEMORIES}, c as (select memory_id from m where kind = 1 and created_at <= make_timestamp((1700000000::bigint + 5000 * 60) * 1000000) order by created_at desc, ord limit 10000)
select memory_id from m where memory_id not in (select memory_id from c)""",
    "metadata_paths": f"with {MEMORIES} select memory_id, coalesce(kind = 2 and tag = 't1', false) as both, false as missing, true as free from m",
    "strategy_accuracy": f"""with {RESULTS}, s as (select correct, case {" ".join(f"when starts_with(config_hash, '{s}') then '{s}'" for s in STRATEGIES)} else split_part(config_hash, '_', 1) end strategy from r)
select strategy, count(*) total, count_if(correct)::bigint correct, round(avg(correct::int), 9) accuracy from s group by 1""",
    "reward_table": f"with {RESULTS} select pid, config_hash, arg_max(correct, ord)::int::double accuracy from r group by 1, 2",
    "block_info": f"with {RESULTS} select pid, arg_min(chars, ord)::bigint total_chars, bool_or(pictured or contains(config_hash, 'figure')) has_image, 5 n_blocks, true has_knowledge from r group by 1",
    "training_rows": f"""with {RESULTS}, t as (select pid, config_hash, arg_max(correct, ord)::int acc from r group by 1, 2),
q as (select pid, string_agg('"' || config_hash || '":' || acc || '.0', ',' order by config_hash) j from t group by 1),
i as (select pid, arg_min(chars, ord)::bigint total_chars, bool_or(pictured or contains(config_hash, 'figure')) has_image from r group by 1),
n as (select i.*, q.j, row_number() over (order by md5(pid || ':42'), pid) k, count(*) over () n from i join q using (pid))
select pid, case when k <= floor(n * 0.9::double) then 'train' else 'val' end split, 'layout' ability, 'chars ' || total_chars said, '{{"qa_table":{{' || j || '}},"block_info":{{"total_chars":' || total_chars || ',"has_image":' || has_image || '}}}}' truth from n""",
    "table_rows": """with r as (select l_orderkey, list(l_linenumber || ',' || (l_partkey || '-' || repeat('x', 38))[1:40] order by l_linenumber, l_partkey || '-') r from lineitem group by 1)
select l_orderkey, 'line,part' headers, array_to_string(r[1:3], ';') as rows from r""",
    "agent_prompts": f"""select p_partkey, '<canvas_library>' || {_NL} || case when p_partkey % 3 > 0 then '[1] ' || p_type || {_NL} || '[2] ' || p_brand else '{P.EMPTY_LIBRARY}' end || {_NL} || '</canvas_library>' || {_NL} || {_NL} || '<new_knowledge>' || {_NL} || p_name || {_NL} || '</new_knowledge>' || {_NL} || {_NL} || 'Decide how to store this knowledge.' w,
'<question>' || p_name || '</question>' || {_NL} || {_NL} || '<candidates>' || {_NL} || '[Canvas #' || p_partkey || '] Topic: "' || p_type || '" | Similarity: ' || printf('%.2f', p_size / 70) || {_NL} || '  Summary: ' || case when p_size > 20 then p_name else 'No summary' end || {_NL} || '</candidates>' || {_NL} || {_NL} || 'Which canvases should be retrieved to answer the question?' r,
'{_LAYOUT_HEAD}' || {_NL} || '  #0 [text/question] ' || length(p_name) || ' chars, font=18' || {_NL} || '  #1 [image/figure] 300x200, ar=1.50' || {_NL} || '{_LAYOUT_END}' l from part""",
    "record_adapters": f"""with x as (select *, 'header|14|[' || p_type || ' / ' || case when p_size > 10 then p_brand else '' end || ']' h, case when p_size % 2 = 0 then 'context|16|Context: ' || p_brand end c, case when p_size % 3 = 0 then 'knowledge|15|Knowledge: ' || p_name end k,
'question|18|Q: ' || p_name || {_NL} || '  A. ' || p_brand || {_NL} || '  B. ' || p_type q from part)
select p_partkey, concat_ws({_NL} || {_NL}, h, c, q, k) "full", concat_ws({_NL} || {_NL}, h, c, k) knowledge, 'question|18|Q: ' || p_name || {_NL} || {_NL} || 'context|15|' || p_type passages from x""",
    "layout_features": f"""with {_BLOCKS}, f as (select doc_id, tw, height h, content_area a, (select count(*) from w where w.doc_id = l.doc_id and w.tw = l.tw) n, (select count_if(img) from w where w.doc_id = l.doc_id and w.tw = l.tw) ni, (select coalesce(sum(w.w * w.h) filter (where not img), 0) from w where w.doc_id = l.doc_id and w.tw = l.tw) ta, (select coalesce(sum(w.w * w.h) filter (where img), 0) from w where w.doc_id = l.doc_id and w.tw = l.tw) ia from l)
select doc_id, tw, round(least(tw / greatest(h, 1), 1 / (tw / greatest(h, 1))), 9)::double f0, round(a / (tw * h::bigint), 9)::double f1, round(tw / 1000, 9)::double f2, round(h / 1000, 9)::double f3, round(tw / h, 9)::double f4, round((tw // 28) * (h // 28) / 2000, 9)::double f5, round(n / 10, 9)::double f6, (tw between 400 and 900 and h between 400 and 900)::int::double f7,
round((tw - 30) / 600, 9)::double f8, 1.0::double f9, round(ta / (tw * h::bigint), 9)::double f10, round(ia / (tw * h::bigint), 9)::double f11, (ni > 0)::int::double f12, 0.0::double f13, round((n - ni) / 6, 9)::double f14 from f""",
    "canvas_statistics": f"with v as ({ANALYTICS['canvas_replay']}) select count(*) n_canvases, sum(n_items)::bigint n_items, count(distinct topic) n_topics, round(100.0 * sum(n_items) / (count(*) * 8), 4)::double utilization_pct from v",
}
