"""Queries over cached encodings, resumable builds, pages, masks, resampling and the trained scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import vector as V
from lodestore.functions.pixels import valid_regions
from lodestore.operators import layout as L
from lodestore.operators import paging as P
from lodestore.operators.builds import Build
from lodestore.operators.encodings import EncodingCache, Encoder
from lodestore.operators.scorer import STEP, Scorer, hashed_text
from lodestore.plans.common import table
from lodestore.plans.layout_queries import blocks
from lodestore.session import run_folder, small_batches


def _numbers(contents: list[str]) -> list[list[float]]:
    return [[len(c), c.count("a")] for c in contents]


NUMBERS = Encoder("numbers", 2, _numbers)


def cached_encodings(spark, sf_dir):
    """Contents encoded, kept and dropped: of two thirds of the documents, again, and of all with a tenth of them changed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    cache = EncodingCache(spark, run_folder(spark, "encodings"))
    some = d.where("id % 3 > 0")
    changed = d.withColumn("content", F.when(F.col("id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    counts = [cache.refresh(x, NUMBERS) for x in (some, some, changed)]
    return spark.createDataFrame([(k + 1, c.encoded, c.kept, c.dropped) for k, c in enumerate(counts)], "run int, encoded long, kept long, dropped long")


def encoding_sets(spark, sf_dir):
    """The vectors of every document from the cache."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    cache = EncodingCache(spark, run_folder(spark, "encodings"))
    cache.refresh(d, NUMBERS)
    found = cache.sets(d, [NUMBERS, Encoder("absent", 3, _numbers)], "skip")["numbers"]
    return found.select(F.col("id").alias("doc_id"), F.col("vec")[0].cast("long").alias("n_chars"), F.col("vec")[1].cast("long").alias("n_a"))


def _head(row: dict) -> str:
    words = row["text"].split(" ")
    if len(words) < 60:
        raise ValueError(f"only {len(words)} words")
    return f"{len(words)}:{words[0]}"


def _minimal(row: dict) -> str:
    return f"minimal:{row['doc_id']}"


def resumable_build(spark, sf_dir):
    """A build over all documents, short ones of which fail and have the fallback, with the errors beside it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    build = Build(spark, run_folder(spark, "build"), parts=8)
    build.run(d, "doc_id", _head, _minimal)
    return build.results().join(build.errors(), "key", "left").select(F.col("key").cast("long").alias("doc_id"), "result", "failed", "error")


def table_widths(spark, sf_dir):
    """Column widths of tables of four columns in a room of 600."""
    p = table(spark, sf_dir, "part")
    w = F.array(*[c.cast("int") for c in (F.col("p_size") * 9, F.length("p_name") * 9, F.pmod(F.col("p_partkey") * 37, F.lit(500)), F.length("p_type") * 12)])
    return p.select("p_partkey", F.array_join(P.fitted_widths(w, F.lit(600)), ",").alias("widths"))


def ellipsized(spark, sf_dir):
    """Words of documents cut to cells of several widths."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.ellipsized(F.coalesce("text", F.lit("")), F.pmod(F.col("doc_id") * 7, F.lit(900)).cast("int"), F.lit(15)).alias("cell"))


SIZE, PAD, SPACE = 640, 20, 15


def paged_documents(spark, sf_dir):
    """Places of a heading, the text, a picture and a separator of each document on square pages."""
    d = table(spark, sf_dir, "documents")
    w, h = F.lit(100) + F.pmod(F.col("doc_id") * 131, F.lit(900)), F.lit(80) + F.pmod(F.col("doc_id") * 173, F.lit(700))
    made = F.array(P.text_block(F.concat_ws(" ", "source", "lang"), F.lit(24), SIZE, PAD), P.text_block(F.coalesce("text", F.lit("")), F.lit(16), SIZE, PAD), P.image_block(w, h, F.col("doc_id") % 2 == 0, 16, SIZE, PAD), P.separator_block("line", SIZE, PAD))
    rows = d.select("doc_id", P.paged(made, SIZE, PAD, SPACE).alias("p"))
    rows = rows.select("doc_id", F.size("p.heights").alias("n_pages"), F.element_at("p.heights", -1).alias("last_height"), F.round(P.preserved(F.col("p.pieces"), 2), 6).alias("preserved"), F.inline("p.pieces"))
    return rows.select("doc_id", "n_pages", "last_height", "preserved", "block", "page", "y", "h", "lines")


def valid_masks(spark, sf_dir):
    """Texts as pictures of 32 bytes a row: whether the whole and each square of 32 show something."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("p"))
    n = F.ceil(F.octet_length("p") / 1024).cast("int")
    box = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.lit(0).alias("left"), (k * 32).alias("top"), F.lit(32).alias("right"), (k * 32 + 32).alias("bottom")))
    m = d.select("doc_id", valid_regions("p", F.lit(32), F.when(n > 0, box)).alias("m"))
    return m.select("doc_id", F.array_join(F.transform("m", lambda x: x.cast("int").cast("string")), "").alias("mask"))


def resampled_tokens(spark, sf_dir):
    """Sixteen tokens of four numbers brought to five, in three ways."""
    e = table(spark, sf_dir, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4))
    out = None
    for mode in ("mean", "max", "first"):
        part = e.select("vec_id", F.lit(mode).alias("mode"), F.posexplode(V.resample(tokens, 5, mode)).alias("row", "v"))
        out = part if out is None else out.unionByName(part)
    return out.select("vec_id", "mode", "row", *[F.round(F.col("v")[k], 6).alias(f"v{k}") for k in range(4)])


def layout_scorer(spark, sf_dir):
    """A scorer trained on the single columns of all documents in three widths: layouts scored, and whether the loss fell."""
    made = F.array(*[L.single_column(F.col("b"), F.lit(w)) for w in L.WIDTHS.values()])
    rows = blocks(spark, sf_dir).select("doc_id", made.alias("ls"), hashed_text(F.element_at("b", 1)["text"]).alias("t"))
    x = F.transform("ls", lambda l: F.concat("t", L.features(l)))
    groups = rows.select("doc_id", x.alias("x"), F.transform("ls", L.quality_score).alias("y"))
    scorer = Scorer().fit(groups.select("x", "y"), steps=3)
    # inputs are large: they are made and scored a few at a time, and only scores are kept
    with small_batches(spark, STEP):
        scored = scorer.scores(groups.select("doc_id", F.explode("x").alias("x"))).select("doc_id", "score").checkpoint()
    fell = scorer.losses[-1] < scorer.losses[0]
    return scored.groupBy("doc_id").agg(F.count("*").alias("n_layouts"), F.min(F.col("score").between(0, 1)).alias("in_range")).withColumn("loss_fell", F.lit(fell))


QUERIES = {
    "cached_encodings": cached_encodings,
    "encoding_sets": encoding_sets,
    "resumable_build": resumable_build,
    "table_widths": table_widths,
    "ellipsized_cells": ellipsized,
    "paged_documents": paged_documents,
    "valid_masks": valid_masks,
    "resampled_tokens": resampled_tokens,
    "layout_scorer": layout_scorer,
}

_LINES = "list_sum(list_transform(string_split({0}, chr(10)), lambda p: case when regexp_matches(p, '\\S') then ceil(length(p) / {1}) else 1 end))::int"
_WIDE = SIZE - 2 * PAD

ORACLE = {
    "cached_encodings": """with a as (select distinct coalesce(text, '') t from documents where doc_id % 3 > 0),
b as (select distinct case when doc_id % 10 = 0 and text is not null then text || '!' else coalesce(text, '') end t from documents),
n as (select (select count(*) from a) a, (select count(*) from b) b, (select count(*) from a join b using (t)) same)
select 1::int run, a encoded, 0::bigint kept, 0::bigint dropped from n union all select 2, 0, a, 0 from n union all select 3, b - same, same, a - same from n""",
    "encoding_sets": "select doc_id, length(coalesce(text, ''))::bigint n_chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')))::bigint n_a from documents",
    "resumable_build": """with w as (select doc_id, string_split(text, ' ') w from documents)
select doc_id, case when len(w) >= 60 then len(w) || ':' || w[1] else 'minimal:' || doc_id end as "result", len(w) < 60 failed, case when len(w) < 60 then 'ValueError: only ' || len(w) || ' words' end as "error" from w""",
    "table_widths": f"""with w as (select p_partkey, [p_size * 9, length(p_name) * 9, p_partkey * 37 % 500, length(p_type) * 12] w from part),
s as (select p_partkey, case when list_sum(w) <= 600 then w else list_transform(w, lambda x: greatest(floor(x * (600 / list_sum(w))), {P.CELL_LEAST})) end::bigint[] w from w),
c as (select p_partkey, w, case when list_sum(w) > 600 then (select max(c) from range(0, 601) t(c) where list_sum(list_transform(w, lambda x: least(x, c))) <= 600) end c from s),
m as (select p_partkey, w, c, 600 - list_sum(list_transform(w, lambda x: least(x, c))) more, len(list_filter(w, lambda x: x > c)) n from c)
select p_partkey, array_to_string(case when c is null then w else list_transform(w, lambda x, i: case when x <= c then x when len(list_filter(w[1:i], lambda y: y > c)) > n - more then c + 1 else c end) end::bigint[], ',') widths from m""",
    "ellipsized_cells": """with r as (select doc_id, coalesce(text, '') t, (doc_id * 7 % 900)::int room from documents)
select doc_id, case when room > 0 and length(t) * 7.5::double <= room then t when room - 15 <= 0 then '' else t[1:floor((room - 15) / 7.5::double)::int] || '..' end cell from r""",
    "paged_documents": f"""with recursive d as (select doc_id, concat_ws(' ', source, lang) t, coalesce(text, '') x, 100 + doc_id * 131 % 900 w, 80 + doc_id * 173 % 700 h from documents),
i as (select *, least({_WIDE} / w, {SIZE // 2} / h, 1.0) s from d),
b as (select doc_id, 0 block, {_LINES.format("t", _WIDE // 12)} n, 36 h, 0 cap, {SPACE} behind from i
  union all select doc_id, 1, {_LINES.format("x", _WIDE // 8)}, 24, 0, {SPACE} from i
  union all select doc_id, 2, 1, floor(h * s)::int, case when doc_id % 2 = 0 then 29 else 0 end, {SPACE} from i
  union all select doc_id, 3, 1, 20, 0, 0 from i),
u as (select doc_id, block, h, cap, case when k = n - 1 then behind else 0 end behind, row_number() over (partition by doc_id order by block, k) r from b, unnest(range(n)) t(k)),
-- one line, picture or separator after another: where it lies and how far the cursor is then
p as (select doc_id, 0::bigint r, null::int block, 0 page, {PAD} y, 0 h, {PAD} foot, null::int closed from documents
  union all select p.doc_id, u.r, u.block, case when {SIZE - PAD} - foot < u.h + u.cap then page + 1 else page end, case when {SIZE - PAD} - foot < u.h + u.cap then {PAD} else foot end, u.h,
    case when {SIZE - PAD} - foot < u.h + u.cap then {PAD} else foot end + u.h + u.cap + u.behind, null from p join u on u.doc_id = p.doc_id and u.r = p.r + 1),
g as (select doc_id, block, page, min(y)::int y, case when block < 2 then sum(h) else max(h) end::int h, case when block < 2 then count(*) else 0 end::int as lines from p where r > 0 group by doc_id, block, page),
l as (select doc_id, max(page) + 1 n_pages, arg_max(foot, r) + {PAD} last_height from p group by 1),
k as (select doc_id, round(100.0::double * sum(case when page < 2 then greatest(lines, 1) else 0 end) / sum(greatest(lines, 1)), 6)::double preserved from g group by 1)
select doc_id, n_pages::int n_pages, last_height::int last_height, preserved, block::int block, page::int page, y, h, lines from g join l using (doc_id) join k using (doc_id)""",
    "valid_masks": """with h as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
o as (select doc_id, list_concat(regexp_extract_all(h, '..'), list_transform(range((ceil(length(h) / 64) * 32 - length(h) / 2)::bigint), lambda z: '00')) o from h),
p as (select doc_id, unnest(range(len(o))) k, ('0x' || unnest(o))::int v from o),
m as (select doc_id, k // 1024 box, (var_pop(v) >= 100)::int::varchar m from p group by 1, 2),
w as (select doc_id, (var_pop(v) >= 100)::int::varchar m from p group by 1)
select h.doc_id, coalesce(w.m, '0') || coalesce((select string_agg(m.m, '' order by box) from m where m.doc_id = h.doc_id), '') mask from h left join w using (doc_id)""",
    "resampled_tokens": """with t as (select vec_id, k, d, embedding[k * 4 + d + 1]::double x from embeddings, unnest(range(16)) a(k), unnest(range(4)) b(d)),
r as (select *, row, row * 16 / 5 low, (row + 1) * 16 / 5 high from t, unnest(range(5)) c(row)),
i as (select * from r where k < high and k + 1 > low),
v as (select vec_id, 'mean' as "mode", row, d, sum(x * (least(k + 1, high) - greatest(k, low))) / (16 / 5) x from i group by all
  union all select vec_id, 'max', row, d, max(x) from i group by all union all select vec_id, 'first', row, d, arg_min(x, k) from i group by all)
select vec_id, "mode", row::int as row, """ + ", ".join(f"round(max(x) filter (where d = {k}), 6) v{k}" for k in range(4)) + " from v group by all",
    "layout_scorer": "select doc_id, 3::bigint n_layouts, true in_range, true loss_fell from documents",
}
