"""Queries over layout geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.operators import layout as L
from lodestore.plans.common import table


def blocks(spark, sf_dir):
    """Documents as records: a header, the text as context or knowledge, up to three pictures."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None)
    n = F.pmod("doc_id", F.lit(4))
    im = lambda k: F.when(n >= k, L.block(F.lit("image"), F.lit("figure"), none, 120 + F.pmod(F.col("doc_id") * (k + 6), F.lit(400)), 90 + F.pmod(F.col("doc_id") * (k + 10), F.lit(380)), F.lit(0)))
    text = lambda role, t, font: L.block(F.lit("text"), role, t, F.lit(400), F.lit(0), F.lit(font))
    return d.select(
        "doc_id",
        F.array_compact(
            F.array(
                text(F.lit("header"), F.concat_ws(" ", "source", "lang"), 14),
                text(F.when(F.col("doc_id") % 2 == 0, "knowledge").otherwise("context"), F.col("text"), 12),
                im(1),
                text(F.lit("question"), F.substring("text", -90, 90), 16),
                im(2),
                im(3),
            )
        ).alias("b"),
    )


def candidates(spark, sf_dir):
    """All strategies and widths with size, fill and scores."""
    rows = blocks(spark, sf_dir)
    out = None
    for s in L.STRATEGIES:
        made = F.array(*[F.struct(F.lit(w).alias("width_class"), L.generate(s, F.col("b"), w).alias("l")) for w in L.WIDTHS])
        part = rows.select("doc_id", F.inline(made))
        part = part.select("doc_id", "width_class", "l.name", "l.width", "l.height", F.size("l.placed").alias("n_placed"), L.properties(F.col("l")).alias("p"), F.round(L.fit_score(F.col("l")), 9).alias("fit"), F.round(L.quality_score(F.col("l")), 9).alias("quality"))
        part = part.select("doc_id", "width_class", "name", "width", "height", "n_placed", "p.content_area", F.round("p.utilization", 9).alias("utilization"), "fit", "quality")
        out = part if out is None else out.unionByName(part)
    return out


def single_columns(spark, sf_dir):
    """Single columns in three widths."""
    made = F.array(*[F.struct(F.lit(w).alias("tw"), L.single_column(F.col("b"), F.lit(w)).alias("l")) for w in L.WIDTHS.values()])
    rows = blocks(spark, sf_dir).select("doc_id", F.inline(made))
    p = L.properties(F.col("l"))
    return rows.select("doc_id", "tw", F.col("l.height").alias("height"), p["content_area"].alias("content_area"), F.round(L.fit_score(F.col("l")), 6).alias("fit"))


def best(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", L.best_layout(F.col("b")).alias("x")).select("doc_id", "x.name", "x.width", "x.height", F.round(F.col("x.score") + 1e-10, 9).alias("score"))


def preprocessed(spark, sf_dir):
    b = L.preprocess(F.col("b"), "small", "question_first", "heavy", "compact")
    rows = blocks(spark, sf_dir).select("doc_id", F.posexplode(b).alias("pos", "x"))
    return rows.select("doc_id", "pos", "x.role", "x.w", "x.h", "x.font", F.length("x.text").alias("n_chars"))


def parameter_quality(spark, sf_dir):
    """Quality estimates of all parameter choices for every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("int").alias("chars"), (F.col("doc_id") % 2 == 0).alias("img"), (F.col("doc_id") % 3 == 0).alias("know"))
    grid = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(w).alias("width_class"), F.lit(t).alias("truncation"), F.lit(f).alias("font_profile")) for s in L.STRATEGIES for w in L.WIDTHS for t in ("none", "heavy") for f in L.FONT_OFFSETS])
    rows = d.select("doc_id", "chars", "img", "know", F.explode(grid).alias("p"))
    return rows.select("doc_id", "p.strategy", "p.width_class", "p.truncation", "p.font_profile", F.round(L.quality_from_params(F.col("p"), F.col("chars"), F.col("img"), F.col("know")), 9).alias("quality"))


def sizes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.lit(100) + F.pmod(F.col("p_partkey") * 131, F.lit(4000))).cast("int").alias("w"), (F.lit(80) + F.pmod(F.col("p_partkey") * 173, F.lit(5200))).cast("int").alias("h"))


SIZES = "z as (select p_partkey, (100 + p_partkey * 131 % 4000)::int w, (80 + p_partkey * 173 % 5200)::int h from part)"


def slices(spark, sf_dir):
    s = sizes(spark, sf_dir).select("p_partkey", "w", "h", L.slices(F.col("w"), F.col("h")).alias("s"), L.estimated_tokens(F.col("w"), F.col("h")).alias("estimate"))
    last = F.element_at("s.boxes", -1)
    return s.select("p_partkey", "s.cols", "s.rows", F.col("s.tokens").cast("int").alias("tokens"), F.col("estimate").cast("int").alias("estimate"), last["x"].alias("last_x"), last["y"].alias("last_y"))


def image_sizes(spark, sf_dir):
    s = sizes(spark, sf_dir)
    t = L.tall_sections(F.col("w"), F.col("h"))
    return s.select("p_partkey", L.measured_image(F.col("w"), F.col("h")).alias("m"), F.size(t).alias("sections"), F.element_at(t, -1)["bottom"].alias("foot"), L.align(F.col("w"), 28).alias("low"), L.align(F.col("w"), 28, True).alias("up")).select("p_partkey", "m.w", "m.h", "sections", "foot", "low", "up")


def tiles(spark, sf_dir):
    s = sizes(spark, sf_dir).select("p_partkey", "w", "h", L.tile_grid(F.col("w"), F.col("h")).alias("g"))
    return s.select("p_partkey", "g.cols", "g.rows", F.element_at(L.tile_boxes(F.col("g")), -1)["top"].alias("last_top"))


def stacked(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", L.stacked_patches(F.col("b")).alias("patches"))


QUERIES = {"tile_grid": tiles, "stacked_patches": stacked, "layout_candidates": candidates, "layout_single_column": single_columns, "layout_best": best, "layout_preprocess": preprocessed, "layout_parameter_quality": parameter_quality, "canvas_slices": slices, "image_sizes": image_sizes}

_IMG = "struct_pack(img := true, w := (120 + doc_id * {0} % 400)::int, h := (90 + doc_id * {1} % 380)::int, t := null::varchar, f := 0)"
_TXT = "struct_pack(img := false, w := 400, h := 0, t := {0}, f := {1})"
_BLOCKS = f"""d as (select doc_id, unnest(list_filter([{_TXT.format("source || ' ' || lang", 14)}, {_TXT.format("text", 12)}, case when doc_id % 4 >= 1 then {_IMG.format(7, 11)} end, {_TXT.format("text[-90:]", 16)},
case when doc_id % 4 >= 2 then {_IMG.format(8, 12)} end, case when doc_id % 4 >= 3 then {_IMG.format(9, 13)} end], lambda x: x is not null)) b from documents),
w as (select doc_id, tw, b.img img, case when b.img then floor(b.w * least((tw - 30) / b.w, 1.0)) else tw - 30 end w,
case when b.img then floor(b.h * least((tw - 30) / b.w, 1.0)) else list_sum(list_transform(string_split(b.t, chr(10)), lambda p: greatest(ceil(length(p) / floor((tw - 30) / (b.f * 0.5))), 1))) * floor(b.f * 1.3) end h from d, (values (480), (640), (860)) x(tw)),
l as (select doc_id, tw, (sum(h + 10) + 15 + 15 - 10)::int height, sum(w * h)::bigint content_area from w group by 1, 2)"""

_D = _BLOCKS.split(",\nw as")[0].replace("d as (select doc_id, unnest(list_filter(", "dl as (select doc_id, list_filter(").replace("is not null)) b from documents)", "is not null) bs from documents)")


def _text_height(width: str) -> str:
    return f"list_sum(list_transform(string_split(b.t, chr(10)), lambda p: greatest(ceil(length(p) / floor({width} / (b.f * 0.5))), 1))) * floor(b.f * 1.35::double)"


#: Blocks with their number, single columns, and two columns filled block by block, the largest first.
_BEST = f"""with recursive {_D}, d as (select doc_id, unnest(bs) b, generate_subscripts(bs, 1) i from dl),
s as (select doc_id, tw, i, case when b.img then floor(b.w * least((tw - 30) / b.w, 1.0)) else tw - 30 end w, case when b.img then floor(b.h * least((tw - 30) / b.w, 1.0)) else {_text_height("(tw - 30)")} end h from d, (values (640), (830)) x(tw)),
k as (select doc_id, row_number() over (partition by doc_id order by b.w * (case when b.img then b.h else {_text_height("b.w")} end) desc, i) n, case when b.img then floor(b.w * least(460 / b.w, 1.0)) else 460 end w, case when b.img then greatest(1, floor(b.h * least(460 / b.w, 1.0))) else {_text_height("460")} end h from d),
g as (select doc_id, 0::bigint n, 15::double l, 15::double r, 0::double a from documents union all
  select g.doc_id, k.n, case when l <= r then l + k.h + 10 else l end, case when l <= r then r else r + k.h + 10 end, a + k.w * k.h from g join k on k.doc_id = g.doc_id and k.n = g.n + 1),
f as (select doc_id, case tw when 640 then 1 else 2 end o, 'single_column' as name, tw width, sum(h + 10) + 20 height, sum(w * h) a from s group by doc_id, tw
  union all select doc_id, 3, 'two_column', 960, greatest(l, r) + 5, a from g where n >= 3 qualify row_number() over (partition by doc_id order by n desc) = 1),
v as (select *, 0.6::double * least(width / height, height / width) + 0.3::double * (a / (width * height)) + 0.1::double * (width between 224 and 1344 and height between 224 and 1344)::int score from f)"""

ORACLE = {
    "tile_grid": f"""with {SIZES}, g as (select i, j from range(1, 13) a(i), range(1, 13) b(j) where i * j <= 12),
d as (select p_partkey, i, j, abs(w / h - i / j) d, w::double * h > 0.5 * 448 * 448 * i * j filled from z, g),
b as (select *, row_number() over (partition by p_partkey order by i * j, i) n from (select *, min(d) over (partition by p_partkey) m from d) where d = m),
f as (select p_partkey, i, j, row_number() over (partition by p_partkey order by case when n = 1 or filled then n else 0 end desc) r from b)
select p_partkey, i::int as cols, j::int as rows, ((j - 1) * 448)::int last_top from f where r = 1""",
    "layout_best": f"{_BEST} select doc_id, name, width::int width, height::int height, round(score + 1e-10::double, 9) score from v qualify row_number() over (partition by doc_id order by score desc, o) = 1",
    "stacked_patches": f"""with {_BLOCKS.split(",\nw as")[0]},
w as (select doc_id, case when b.img then floor(b.h * least(600 / b.w, 320 / b.h, 1.0)) else list_sum(list_transform(string_split(b.t, chr(10)), lambda p: greatest(ceil(length(p) / floor(600 / (b.f * 0.5))), 1))) * floor(b.f * 1.3) end h from d)
select doc_id, greatest(1, ceil((40 + sum(h + 15)) / 640))::int patches from w group by 1""",
    "layout_single_column": f"""with {_BLOCKS} select doc_id, tw, height, content_area, round(0.6 * least(tw / greatest(height, 1), 1 / (tw / greatest(height, 1))) + 0.3 * content_area / greatest(tw * height::bigint, 1) + 0.1 * (height between 224 and 1344)::int, 6) fit from l""",
    "layout_preprocess": """with r as (select doc_id, unnest([7, case when doc_id % 2 = 0 then 5 else 4 end, 2, 0, 2, 2]) p, unnest([0, 1, 2, 3, 4, 5]) i, unnest([true, true, doc_id % 4 >= 1, true, doc_id % 4 >= 2, doc_id % 4 >= 3]) there,
unnest([source || ' ' || lang, text, null, text[-90:], null, null]) t, unnest([14, 12, 0, 16, 0, 0]) f, unnest([0, 0, 120 + doc_id * 7 % 400, 0, 120 + doc_id * 8 % 400, 120 + doc_id * 9 % 400]) iw, unnest([0, 0, 90 + doc_id * 11 % 380, 0, 90 + doc_id * 12 % 380, 90 + doc_id * 13 % 380]) ih from documents)
select doc_id, (row_number() over (partition by doc_id order by case p when 0 then 0 when 2 then 1 else 2 end, p, i) - 1)::int pos, ['question', '', 'figure', '', 'context', 'knowledge', '', 'header'][p + 1] as role,
case when p = 2 then greatest(floor(iw * 0.6::double), 50) else 400 end::int w, case when p = 2 then greatest(floor(ih * 0.6::double), 50) else 0 end::int h, case when p = 2 then 0 else greatest(f - 2, 10) end::int font,
case when p = 5 and length(t) > greatest(floor(length(t) * 0.3::double), 50) then greatest(floor(length(t) * 0.3::double), 50) + 3 else length(t) end::int n_chars from r where there""",
    "layout_parameter_quality": """with d as (select doc_id, n_chars c, doc_id % 2 = 0 img, doc_id % 3 = 0 know from documents),
g as (select * from (values ('single_column'), ('two_column'), ('side_by_side'), ('compact'), ('emphasis'), ('grid'), ('text_wrap'), ('panoramic')) a(strategy), (values ('narrow', 1), ('medium', 2), ('wide', 3)) b(width_class, i), (values ('none'), ('heavy')) x(truncation), (values ('compact'), ('normal'), ('large')) y(font_profile))
select doc_id, strategy, width_class, truncation, font_profile, round(0.3 * (0.25 * case when c < 300 then [1.0, 0.8, 0.5][i] when c < 800 then [0.7, 1.0, 0.8][i] else [0.5, 0.8, 1.0][i] end::double
+ 0.25 * case when img then case when strategy in ('side_by_side', 'text_wrap', 'grid') then 1.0 when strategy in ('single_column', 'emphasis') then 0.8 else 0.7 end
  else case when strategy in ('single_column', 'two_column', 'compact') then 1.0 when strategy = 'emphasis' then 0.9 when strategy in ('side_by_side', 'text_wrap', 'grid') then 0.5 else 0.7 end end::double
+ 0.20 * case when font_profile = 'compact' and c > 800 then 0.6 when font_profile = 'large' and c > 600 then 0.7 when font_profile = 'normal' then 1.0 else 0.8 end::double
+ 0.15 * case when know and truncation = 'heavy' and c < 400 then 0.5 when not know and truncation <> 'none' then 0.8 else 1.0 end::double
+ 0.15 * case when width_class = 'wide' then 1.0 - (1400 - 1280) / 1280 else 1.0 end::double), 9)::double quality from d, g""",
    "canvas_slices": f"""with {SIZES}, c as (select *, case when w > 640 then ceil((w - 640) / 640) + 1 else 1 end c0, case when h > 640 then ceil((h - 640) / 640) + 1 else 1 end r0 from z),
s as (select *, case when c0 * r0 > 16 then floor(w * sqrt(16 / (c0 * r0))) else w end w1, case when c0 * r0 > 16 then floor(h * sqrt(16 / (c0 * r0))) else h end h1 from c),
f as (select *, case when w1 > 640 then ceil((w1 - 640) / 640) + 1 else 1 end cols, case when h1 > 640 then ceil((h1 - 640) / 640) + 1 else 1 end rows_ from s)
select p_partkey, cols::int as cols, rows_::int as rows, (256 + cols * rows_ * 100)::int tokens, (256 + least(c0 * r0, 16) * 100)::int estimate, least((cols - 1) * 640, greatest(0, w1 - 640))::int last_x, least((rows_ - 1) * 640, greatest(0, h1 - 640))::int last_y from f""",
    "image_sizes": f"""with {SIZES}, s as (select *, least(500 / greatest(w, h), 1.0) s, h / w r from z), n as (select *, case when r <= 2 then 1 else least(greatest(2, round_even(r / 2.5, 0)), 3) end n from s)
select p_partkey, greatest(floor(w * s), 1)::int w, greatest(floor(h * s), 1)::int h, n::int sections, case when n = 1 then h else least((n - 1) * (floor((h + (n - 1) * 50) / n) - 50) + floor((h + (n - 1) * 50) / n), h) end::int foot, (floor(w / 28) * 28)::int low, (ceil(w / 28) * 28)::int up from n""",
}
