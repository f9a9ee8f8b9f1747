"""Lenient JSON out of model responses, and the decisions read from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestore.functions.text import filled
from lodestore.functions.vector import let

STRATEGIES = ("single_column", "two_column", "side_by_side", "compact", "emphasis", "grid", "text_wrap", "panoramic")
LAYOUT = "struct<strategy:string,width_class:string,image_scale:string,content_priority:string,truncation:string,font_profile:string>"
#: Layout parameters, the values each may have and its default.
CHOICES = {
    "strategy": (STRATEGIES, "single_column"),
    "width_class": (("narrow", "medium", "wide"), "medium"),
    "image_scale": (("small", "medium", "large"), "medium"),
    "content_priority": (("question_first", "context_first", "balanced"), "balanced"),
    "truncation": (("none", "light", "heavy"), "none"),
    "font_profile": (("compact", "normal", "large"), "normal"),
}


# What is cut out of a response, a fenced object (dots match line ends in both), and a flat object.
THOUGHTS = r"<think>.*?</think>"
FENCED = r"```(?:json)?\s*(\{[^`]+\})\s*```"
FLAT = r"\{[^{}]*\}"
#: JSON and nothing more lenient.
STRICT = {"allowSingleQuotes": "false"}


def without_thoughts(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"(?s){THOUGHTS}", ""))


def _first_json(*tries: Column) -> Column:
    return F.get(F.filter(F.array(*tries), lambda x: F.coalesce(F.try_parse_json(x).isNotNull(), F.lit(False))), F.lit(0))


def response_json(c: Column) -> Column:
    """The first of these that is JSON: the first flat object of a response, the whole of it; else null."""
    return let(without_thoughts(c), lambda s: _first_json(F.regexp_extract(s, FLAT, 0), s))


def fenced_json(c: Column) -> Column:
    """The first of these that is JSON: the inside of a fenced block, the first flat object, the whole; else null."""
    return let(without_thoughts(c), lambda s: _first_json(F.regexp_extract(s, f"(?s){FENCED}", 1), F.regexp_extract(s, FLAT, 0), s))


def layout_params(c: Column) -> Column:
    """Layout parameters of a response, defaults for missing ones; null if there is no JSON object."""
    made = lambda p: F.when(p.isNotNull(), F.struct(*[F.coalesce(filled(p[k]), F.lit(d)).alias(k) for k, (_, d) in CHOICES.items()]))
    return let(F.from_json(fenced_json(c), LAYOUT), made)


#: What a response has to name; the other parameters have defaults.
REQUIRED = ("strategy", "width_class")


def valid_response(c: Column) -> Column:
    """Whether a response is JSON with a known strategy and width; other fields may be missing or odd."""
    return let(F.from_json(fenced_json(c), LAYOUT), lambda p: valid_params(p, REQUIRED))


def valid_params(p: Column, fields: tuple[str, ...] = tuple(CHOICES)) -> Column:
    """Whether these fields have values that are allowed."""
    ok = F.lit(True)
    for k in fields:
        values = CHOICES[k][0]
        ok = ok & F.coalesce(p[k].isin(*values), F.lit(False))
    return ok


def config_hash(p: Column) -> Column:
    return F.concat_ws("_", *[p[k] for k in CHOICES])


def parse_config_hash(c: Column) -> Column:
    """strategy (longest name first) and the rest of a configuration's name."""
    names = "|".join(sorted(STRATEGIES, key=lambda s: -len(s)))
    return F.struct(F.regexp_extract(c, f"^({names})_", 1).alias("strategy"), F.regexp_extract(c, f"^(?:{names})_(.*)$", 1).alias("rest"))


def write_decision(c: Column, candidates: Column) -> Column:
    """CREATE, APPEND or NOOP with a canvas.

    Without JSON: CREATE if there is no candidate, else APPEND to the first; an unknown action is NOOP; an
    APPEND to a canvas that is not a candidate goes to the first.
    """

    def decided(j: Column) -> Column:
        first = F.get(candidates, F.lit(0))
        action = F.upper(j["action"])
        parsed = action.isNotNull()
        known = F.array_contains(candidates, j["canvas_id"])
        chosen = F.when(~parsed & first.isNull(), "CREATE").when(~parsed, "APPEND").when(action.isin("CREATE", "APPEND", "NOOP"), action).otherwise("NOOP")
        target = F.when(chosen == "APPEND", F.when(F.coalesce(known, F.lit(False)), j["canvas_id"]).otherwise(first))
        return F.struct(chosen.alias("action"), target.alias("canvas_id"), j["topic"].alias("topic"))

    return let(F.from_json(response_json(c), "action string, canvas_id string, topic string", STRICT), decided)


def read_decision(c: Column, candidates: Column) -> Column:
    """RETRIEVE with the named candidates (the first if none is valid) or DIRECT_ANSWER."""

    def decided(j: Column) -> Column:
        action = F.coalesce(F.upper(j["action"]), F.lit("RETRIEVE"))
        valid = F.array_intersect(F.coalesce(j["canvas_ids"], F.array().cast("array<string>")), candidates)
        ids = F.when(F.size(valid) > 0, valid).otherwise(F.slice(candidates, 1, 1))
        none = F.array().cast("array<string>")
        chosen = F.when(action == "DIRECT_ANSWER", action).otherwise("RETRIEVE")
        return F.struct(chosen.alias("action"), F.when(chosen == "RETRIEVE", ids).otherwise(none).alias("canvas_ids"))

    return let(F.from_json(response_json(c), "action string, canvas_ids array<string>", STRICT), decided)


def answers_of(c: Column) -> Column:
    """Answers as an array from JSON text that holds one string or a list of them."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array(F.get_json_object(F.concat(F.lit('{"a":'), c, F.lit("}")), "$.a")))
