"""Queries over the scalar library: normalisers, scores, extraction, prompts, JSON, markup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestore.functions import jsonx as J
from lodestore.functions import metrics as M
from lodestore.functions import prompt as P
from lodestore.functions import text as T
from lodestore.plans.common import table
from lodestore.session import shared_folder


def turns(spark, sf_dir):
    """Answers of the assistant with the user turn before them."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("pred"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return a.join(u, ["conv_id", "turn"]).withColumn("id", F.concat_ws("-", "conv_id", "turn"))


TURNS = "t as (select a.conv_id, a.turn, a.text pred, u.text gold, concat_ws('-', a.conv_id, a.turn) id from conversations a join conversations u on u.conv_id = a.conv_id and u.turn + 1 = a.turn where a.role = 'assistant' and u.role = 'user')"


def normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("normal"))


def normalize_drop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_answer_drop(F.col("text")).alias("normal"))


#: Articles go where Unicode letters and digits end, which RE2's word boundary does not know.
_ARTICLES = "array_to_string(list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{Nd}}_]+|[^\\p{{L}}\\p{{Nd}}_]+'), lambda w: case when w in ('a', 'an', 'the') then {1} else w end), '')"


def sql_normal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_ARTICLES.format(f'lower({c})', chr(39) + ' ' + chr(39))}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_normal_drop(c: str) -> str:
    low = f"regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"trim(regexp_replace({_ARTICLES.format(low, chr(39) + ' ' + chr(39))}, '\\s+', ' ', 'g'))"


def f1_scores(spark, sf_dir):
    t = turns(spark, sf_dir)
    return M.token_f1_rows(t, "id", "pred", "gold").select("id", "common", "n_pred", "n_gold", F.round("f1", 9).alias("f1"))


def f1_scores_drop(spark, sf_dir):
    t = turns(spark, sf_dir)
    em = t.select("id", M.exact_match(F.col("pred"), F.col("gold"), T.normalize_answer_drop).alias("em"))
    return M.token_f1_rows(t, "id", "pred", "gold", T.normalize_answer_drop).join(em, "id").select("id", "em", F.round("f1", 9).alias("f1"))


def _f1_sql(norm, em: str = "") -> str:
    return f"""with {TURNS}, n as (select id, pred, gold, {norm('pred')} p, {norm('gold')} g from t),
tok as (select id, unnest(list_filter(string_split(p, ' '), lambda x: x <> '')) w, 1 a, 0 b from n union all select id, unnest(list_filter(string_split(g, ' '), lambda x: x <> '')), 0, 1 from n),
c as (select id, w, sum(a) a, sum(b) b from tok group by all), s as (select id, sum(least(a, b))::bigint common, sum(a)::bigint n_pred, sum(b)::bigint n_gold from c group by id)
select n.id, {em or "coalesce(common, 0) common, coalesce(n_pred, 0) n_pred, coalesce(n_gold, 0) n_gold"}, round(case when coalesce(common, 0) = 0 then 0.0 else 2.0 * common / (n_pred + n_gold) end, 9)::double f1 from n left join s using (id)"""


def anls(spark, sf_dir):
    """DuckDB measures Levenshtein distance in bytes, so characters outside ASCII become one sign each here."""
    t = turns(spark, sf_dir)
    t = t.select("id", *[F.regexp_replace(c, r"[^\x00-\x7F]", "?").alias(c) for c in ("pred", "gold")])
    golds = F.array("gold", F.concat(F.lit(" "), F.upper("gold")), F.reverse("pred"))
    # texts are short and distances long work, so the number of tasks follows shuffle partitions, not bytes
    dealt = t.select("id", "pred", golds.alias("golds")).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    s = dealt.select("id", M.similarities(F.col("pred"), F.col("golds")).alias("s"))
    return s.select("id", F.round(F.col("s")[0], 9).alias("similarity"), F.round(M.anls_of(F.col("s")), 9).alias("anls"))


def vqa(spark, sf_dir):
    """The text of each document against those of the two documents after it and two spellings of its own.

    Texts are brought to the forms that count once each, and documents meet by digests of these.
    """
    shared_folder(spark)
    w, mark = F.col("text"), lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    own = [F.concat(w, F.lit(".")), F.concat(F.lit(" "), w)]
    marks = table(spark, sf_dir, "documents").select(
        "doc_id",
        mark(M.soft_prediction(w)).alias("p"),
        mark(M.soft_form(w)).alias("soft"),
        mark(T.normalize_answer(w)).alias("any"),
        *[mark(M.soft_form(c)).alias(f"soft{k}") for k, c in enumerate(own)],
        *[mark(T.normalize_answer(c)).alias(f"any{k}") for k, c in enumerate(own)],
    )
    marks = marks.checkpoint()
    after = lambda k: marks.select((F.col("doc_id") - k).alias("doc_id"), F.col("soft").alias(f"next{k}"), F.col("any").alias(f"near{k}"))
    rows = marks.join(after(1), "doc_id", "left").join(after(2), "doc_id", "left")
    forms = lambda *names: F.array_compact(F.array(*names))
    return rows.select("doc_id", M.share_equal(F.col("p"), forms("next1", "next2", "soft0", "soft1")).alias("soft"), M.any_equal(F.col("any"), forms("near1", "near2", "any0", "any1")).alias("any"))


def answer_letters(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_letter(c).alias("first"), T.first_letter(c, "A-H", "").alias("first_h"), T.last_answer(c).alias("last"))


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_LAST = f"""coalesce(upper(coalesce(
  list_filter(list_transform(list_reverse(string_split({_STRIP.format('text')}, chr(10))), lambda x: coalesce(nullif(regexp_extract({_STRIP.format('x')}, '(?i){T.ANSWER_STATED}', 1), ''),
    nullif(regexp_extract({_STRIP.format('x')}, '{T.ANSWER_ALONE}', 1), ''))), lambda x: x is not null)[1],
  regexp_extract_all({_STRIP.format('text')}, '{T.ANSWER_APART}', 1)[-1])),
  regexp_extract_all(upper(text), '[A-F]')[-1], 'A')"""


def prompts(spark, sf_dir):
    """Prompts of all forms for questions made of parts, with none, one or two memories."""
    b = table(spark, sf_dir, "part")
    choices = F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    hint = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))
    q = F.col("p_name")
    mem = F.slice(F.array(F.struct(F.col("p_type").alias("subject"), F.col("p_brand").alias("topic")), F.struct(F.col("p_brand").alias("subject"), F.col("p_type").alias("topic"))), 1, F.pmod("p_partkey", F.lit(3)).cast("int"))
    users = [P.variant(n, q, choices, hint, mem)["user"].alias(f"v{n}") for n in range(4)]
    science = P.fill("science", hint=hint, question=q, choices=T.format_choices(choices))
    return b.select("p_partkey", P.qa_prompt(q, choices).alias("qa"), *users, science.alias("science"), P.query_text(q, hint).alias("query"), P.memory_text(F.col("p_type"), F.lit(""), q, hint, choices=choices).alias("memory"))


def record_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    choices = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(none)
    return d.select("doc_id", T.record_blocks(header=[F.col("source"), F.lit(""), F.col("lang")], labelled=[("Context", F.col("text")), ("Hint", F.when(F.col("doc_id") % 4 == 0, F.col("lang")))], choices=choices, fallback=F.to_json(F.struct("doc_id", "lang"))).alias("blocks")).select("doc_id", F.array_join("blocks", "\n\n").alias("blocks"), F.size("blocks").alias("n_blocks"))


def json_decisions(spark, sf_dir):
    """Write and read decisions out of responses with thoughts around the JSON, broken ones among them."""
    e = table(spark, sf_dir, "events")
    action = F.element_at(F.array(F.lit("create"), F.lit("APPEND"), F.lit("noop"), F.lit("other")), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    body = F.concat(F.lit('{"action": "'), action, F.lit('", "canvas_id": "c'), F.pmod("event_id", F.lit(5)).cast("string"), F.lit('", "topic": "'), F.col("event_type"), F.lit('"}'))
    said = F.concat(F.lit("<think>{x}\n</think> sure: "), F.when(F.col("event_id") % 7 == 0, F.lit("no idea")).otherwise(body), F.lit(" done"))
    cand = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c1"), F.lit("c3")))
    return e.select("event_id", J.write_decision(said, cand).alias("d")).select("event_id", "d.action", "d.canvas_id", "d.topic")


def metadata_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "int")
    return e.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).cast("long").alias("total"), F.sum((F.coalesce(k == 7, F.lit(False))).cast("long")).alias("sevens"), F.count(F.try_variant_get(v, "$.missing.path", "int")).alias("missing"))


def layout_json(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = F.element_at(F.array(*[F.lit(x) for x in (*J.STRATEGIES, "odd")]), (F.pmod("p_partkey", F.lit(9)) + 1).cast("int"))
    said = F.concat(F.lit("```json\n{\"strategy\": \""), s, F.lit('", "width_class": "'), F.when(F.col("p_size") % 2 == 0, "wide").otherwise(""), F.lit('"}\n```'))
    params = J.layout_params(F.when(F.col("p_partkey") % 11 == 0, F.lit("nothing")).otherwise(said))
    rows = p.select("p_partkey", params.alias("p"))
    h = F.when(F.col("p").isNotNull(), J.config_hash(F.col("p")))
    return rows.select("p_partkey", h.alias("hash"), F.coalesce(J.valid_params(F.col("p")), F.lit(False)).alias("valid"), J.parse_config_hash(h)["strategy"].alias("strategy"), J.parse_config_hash(h)["rest"].alias("rest"))


def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"), F.length(T.html_escape(F.col("html"))).alias("n_escaped"))


def markdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = F.concat(F.lit("## Head\n```\ncode\n```\n**bold** and *it* `x` [name](http://a.b)\n"), F.col("text"))
    return d.select("doc_id", T.markdown_strip(made).alias("text"))


def tables_markdown(spark, sf_dir):
    """Line items of each order as a Markdown table of up to three rows."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_returnflag"]))
    return li.select("l_orderkey", T.table_markdown(F.array(F.lit("line"), F.lit("part"), F.lit("flag")), rows, 3).alias("md"))


def pipe_tables(spark, sf_dir):
    p = T.pipe_tables(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return rows.select("doc_id", F.size("p.rows").alias("n_rows"), F.coalesce(F.aggregate("p.rows", F.lit(0), lambda s, r: s + F.size(r)), F.lit(0)).alias("n_cells"), F.length("p.prose").alias("prose_chars"))


def conversation_summary(spark, sf_dir):
    """The last five turns of each conversation; only those are gathered."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = c.withColumn("n", F.row_number().over(w)).where("n <= 5")
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return last.groupBy("conv_id").agg(T.recent_summary(items).alias("summary")).join(c.groupBy("conv_id").agg(F.count("*").alias("n_items")), "conv_id")


def paragraphs(spark, sf_dir):
    """Context of conversations: titles and sentences zipped, supporting ones kept."""
    c = table(spark, sf_dir, "conversations").withColumn("s", F.struct("turn", "role", F.split("text", "\n").alias("lines")))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    z = P.zip_paragraphs(F.transform("s", lambda x: F.concat(x["role"], x["turn"].cast("string"))), F.transform("s", lambda x: x["lines"]))
    keep = P.supporting(z, F.array(F.lit("user0"), F.lit("assistant1")))
    return g.select("conv_id", P.context(z).alias("context"), P.context(keep, 1000).alias("supporting"))


QUERIES = {
    "normalize_answer": normalize,
    "normalize_answer_drop": normalize_drop,
    "token_f1": f1_scores,
    "em_f1_drop": f1_scores_drop,
    "anls": anls,
    "vqa_accuracy": vqa,
    "answer_letters": answer_letters,
    "prompts": prompts,
    "record_blocks": record_blocks,
    "json_decisions": json_decisions,
    "metadata_json": metadata_json,
    "layout_json": layout_json,
    "page_text": page_text,
    "markdown_strip": markdown,
    "table_markdown": tables_markdown,
    "pipe_tables": pipe_tables,
    "conversation_summary": conversation_summary,
    "paragraph_context": paragraphs,
}

_CH = "concat_ws(chr(10), 'A. ' || p_brand, 'B. ' || p_type, 'C. ' || p_size)"
_HINT = "case when p_partkey % 3 <> 0 then p_type end"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _variant_sql(n: int) -> str:
    intro, mark, end, _ = P.VARIANTS[n]
    before, after = mark.split("{}")
    one = f"{_text(before + '1' + after)} || ' (' || p_type || ' - ' || p_brand || ')'"
    two = f"{_text(before + '2' + after)} || ' (' || p_brand || ' - ' || p_type || ')'"
    head = f"{_text(chr(10).join(intro))} || chr(10) || {one}"
    top = f"case p_partkey % 3 when 1 then {head} || chr(10) || chr(10) || '---' when 2 then {head} || chr(10) || {two} || chr(10) || chr(10) || '---' end"
    return f"concat_ws(chr(10), {top}, {_text(P.TASK)}, 'Context: ' || {_HINT}, 'Question: ' || p_name, 'Options:' || chr(10) || {_CH}, {_text(end)}) v{n}"


_QA = f"{_text(P.QA_HEAD)} || chr(10) || chr(10) || 'Q: ' || p_name || chr(10) || '  A. ' || p_brand || chr(10) || '  B. ' || p_type || chr(10) || '  C. ' || p_size || chr(10) || chr(10) || {_text(P.QA_END)} qa"
_SCIENCE = f"replace(replace(replace({_text(P.TEMPLATES['science'])}, '{{hint}}', coalesce({_HINT}, '')), '{{question}}', p_name), '{{choices}}', {_CH}) science"
_SIM = "case when {0} = {1} then 1.0 else 1.0 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) end"
_RESPONSE = """with e as (select *, case user_id % 4 when 0 then 'create' when 1 then 'APPEND' when 2 then 'noop' else 'other' end act, event_id % 7 <> 0 ok, event_id % 3 <> 0 cand, 'c' || event_id % 5 cid from events)"""

ORACLE = {
    "normalize_answer": f"select doc_id, {sql_normal('text')} as normal from documents",
    "normalize_answer_drop": f"select doc_id, {sql_normal_drop('text')} as normal from documents",
    "token_f1": _f1_sql(sql_normal),
    "em_f1_drop": _f1_sql(sql_normal_drop, "(p = g)::int::double em"),
    "anls": f"""with {TURNS.replace('a.text pred, u.text gold', "regexp_replace(a.text, '[^[:ascii:]]', '?', 'g') pred, regexp_replace(u.text, '[^[:ascii:]]', '?', 'g') gold")}, n as (select id, trim(lower(pred)) p, trim(lower(gold)) g, trim(lower(' ' || upper(gold))) h, trim(lower(reverse(pred))) r from t),
s as (select id, {_SIM.format('p', 'g')} s1, {_SIM.format('p', 'h')} s2, {_SIM.format('p', 'r')} s3 from n)
select id, round(s1, 9)::double similarity, round(case when greatest(s1, s2, s3) >= 0.5 then greatest(s1, s2, s3) else 0.0 end, 9)::double anls from s""",
    "vqa_accuracy": f"""with d as (select doc_id, text w from documents),
r as (select a.doc_id, a.w p, list_filter([b.w, c.w, a.w || '.', ' ' || a.w], lambda x: x is not null) answers from d a left join d b on b.doc_id = a.doc_id + 1 left join d c on c.doc_id = a.doc_id + 2)
select doc_id, least(1.0, len(list_filter(answers, lambda a: trim(lower(a)) = regexp_replace(trim(lower(p)), '\\.+$', ''))) / 3)::double soft,
(len(list_filter(answers, lambda a: {sql_normal('a').replace('lambda w', 'lambda w2').replace('when w in', 'when w2 in').replace('else w end', 'else w2 end')} = {sql_normal('p').replace('lambda w', 'lambda w3').replace('when w in', 'when w3 in').replace('else w end', 'else w3 end')})) > 0)::int::double as any from r""",
    "answer_letters": f"select conv_id, turn, coalesce(nullif(regexp_extract(upper(text), '[A-F]'), ''), 'A') as first, regexp_extract(upper(text), '[A-H]') first_h, {_LAST} as last from conversations",
    "prompts": f"""select p_partkey, {_QA}, {", ".join(map(_variant_sql, range(4)))}, {_SCIENCE},
trim(p_name || ' ' || coalesce({_HINT}, '')) as query, concat_ws(' ', p_type, p_name, {_HINT}, concat_ws(' ', p_brand, p_type, p_size)) as memory from part""",
    "record_blocks": """with r as (select doc_id, list_filter([concat_ws(' | ', source, lang), 'Context: ' || nullif(text, ''), case when doc_id % 4 = 0 then 'Hint: ' || lang end,
case when doc_id % 2 = 0 then 'A. ' || lang || chr(10) || 'B. ' || source end], lambda x: x is not null) b from documents) select doc_id, array_to_string(b, chr(10) || chr(10)) blocks, len(b)::int n_blocks from r""",
    "json_decisions": f"""{_RESPONSE}, a as (select *, case when not ok then case when cand then 'APPEND' else 'CREATE' end when upper(act) in ('CREATE', 'APPEND', 'NOOP') then upper(act) else 'NOOP' end as action from e)
select event_id, action, case when action = 'APPEND' then case when ok and cand and cid in ('c1', 'c3') then cid when cand then 'c1' end end canvas_id, case when ok then event_type end topic from a""",
    "metadata_json": "select event_type, count((props ->> '$.k')::int) n, sum((props ->> '$.k')::int)::bigint total, count_if((props ->> '$.k')::int = 7)::bigint sevens, 0::bigint missing from events group by 1",
    "layout_json": """with p as (select p_partkey, ['single_column', 'two_column', 'side_by_side', 'compact', 'emphasis', 'grid', 'text_wrap', 'panoramic', 'odd'][p_partkey % 9 + 1] s, case when p_size % 2 = 0 then 'wide' else 'medium' end w, p_partkey % 11 <> 0 ok from part)
select p_partkey, case when ok then s || '_' || w || '_medium_balanced_none_normal' end hash, ok and s <> 'odd' valid, case when ok and s <> 'odd' then s else case when ok then '' end end strategy,
case when ok and s <> 'odd' then w || '_medium_balanced_none_normal' else case when ok then '' end end rest from p""",
    "page_text": """select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as text,
length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'))::int n_escaped from pages""",
    "markdown_strip": r"""with m as (select doc_id, '## Head' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '**bold** and *it* `x` [name](http://a.b)' || chr(10) || text t from documents)
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '```[\s\S]*?```', '[text]', 'g'), '`([^`]+)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g') as text from m""",
    "table_markdown": """with r as (select l_orderkey, list('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |' order by l_linenumber, l_partkey, l_returnflag) r from lineitem group by 1)
select l_orderkey, concat_ws(chr(10), '| line | part | flag |', '| --- | --- | --- |', array_to_string(r[1:3], chr(10)), case when len(r) > 3 then '... (' || len(r) || ' rows total)' end) md from r""",
    "pipe_tables": r"""with l as (select doc_id, string_split(text, chr(10)) l from documents),
p as (select doc_id, list_filter(list_transform(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 4), lambda x: list_transform(string_split(trim(regexp_replace(trim(x), '^\||\|$', '', 'g')), '|'), lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: not regexp_matches(c, '^[- ]*$'))) > 0) r,
list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) < 4) t from l)
select doc_id, len(r)::int n_rows, coalesce(list_sum(list_transform(r, lambda x: len(x))), 0)::int n_cells, length(array_to_string(t, chr(10)))::int prose_chars from p""",
    "conversation_summary": "with g as (select conv_id, list(text order by turn) t from conversations group by 1) select conv_id, array_to_string(t[greatest(len(t) - 4, 1):], ' | ')[1:200] summary, len(t)::bigint n_items from g",
    "paragraph_context": """with p as (select conv_id, turn, role || turn title, replace(text, chr(10), ' ') as text from conversations),
z as (select conv_id, list('[' || title || ']' || chr(10) || text[1:500] order by turn) c, list('[' || title || ']' || chr(10) || case when length(text) > 300 then text[1:300] || '...' else text end order by turn) filter (where title in ('user0', 'assistant1')) s from p group by 1)
select conv_id, array_to_string(c, chr(10) || chr(10)) as context, coalesce(array_to_string(s, chr(10) || chr(10)), '') supporting from z""",
}
