"""String expressions: answer normalisers, answer extraction, prompt parts, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def filled(c: Column) -> Column:
    """Null for what is empty as well as for what is missing."""
    return F.nullif(c, F.lit(""))


def normalize_answer(c: Column) -> Column:
    """Lower case, articles out, everything but ASCII letters, digits and blanks to a blank, blanks collapsed."""
    s = F.regexp_replace(F.lower(c), r"\b(?:an?|the)\b", " ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def normalize_answer_drop(c: Column) -> Column:
    """Lower case, ASCII punctuation deleted, then articles out, blanks collapsed; letters of any script stay."""
    s = F.translate(F.lower(c), PUNCTUATION, "")
    s = F.regexp_replace(s, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def first_letter(c: Column, letters: str = "A-F", default: str = "A") -> Column:
    return F.coalesce(filled(F.regexp_extract(F.upper(c), f"[{letters}]", 0)), F.lit(default))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# Patterns by which an answer letter is found: stated (in either case), alone on a line, between delimiters.
ANSWER_STATED = r"answer\s*(?:is|:)\s*\(?([A-Fa-f])\)?"
ANSWER_ALONE = r"^[\s*\(\[]*([A-Fa-f])[\s*\)\].:]*$"
ANSWER_APART = r"(?:^|[\s*\(\[])([A-Fa-f])(?:[\s*\)\].,;:!?]|$)"


def last_answer(c: Column) -> Column:
    """The answer letter nearest to the end, else A.

    Lines from the last up: one that states an answer, or a letter by itself; then the last letter between
    delimiters, then the last letter of any kind.
    """
    s = strip(c)
    lines = F.transform(F.reverse(F.split(s, "\n")), strip)
    stated = lambda x: filled(F.regexp_extract(x, f"(?i){ANSWER_STATED}", 1))
    lone = lambda x: filled(F.regexp_extract(x, ANSWER_ALONE, 1))
    found = F.get(F.filter(F.transform(lines, lambda x: F.coalesce(stated(x), lone(x))), lambda x: x.isNotNull()), F.lit(0))
    apart = F.regexp_extract_all(s, F.lit(ANSWER_APART), F.lit(1))
    some = F.regexp_extract_all(F.upper(s), F.lit("[A-F]"), F.lit(0))
    last = lambda a: F.element_at(F.when(F.size(a) > 0, a), -1)
    return F.coalesce(F.upper(F.coalesce(found, last(apart))), last(some), F.lit("A"))


def letter(i: Column) -> Column:
    return F.char(F.lit(65) + i)


def format_choices(choices: Column, sep: str = "\n", most: int | None = None) -> Column:
    """`A. first`, `B. second`, ... a line each."""
    some = choices if most is None else F.slice(choices, 1, most)
    return F.array_join(F.transform(some, lambda x, i: F.concat(letter(i), F.lit(". "), x)), sep)


def record_blocks(*, header: list[Column], labelled: list[tuple[str, Column]], choices: Column, fallback: Column) -> Column:
    """Text blocks of a record: a header joined by ` | `, `Label: value` for what is there, lettered choices.

    Absent and empty mean the same; a record without any block gives the first 1200 characters of fallback.
    """
    head = filled(F.concat_ws(" | ", *[filled(h) for h in header]))
    rest = [F.concat(F.lit(f"{k}: "), filled(v)) for k, v in labelled]
    listed = F.when(F.size(choices) > 0, format_choices(choices))
    found = F.array_compact(F.array(head, *rest, listed))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.substring(fallback, 1, 1200)))


def clip(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


# Markdown that is replaced, in this order, and by what.
MARKDOWN = (
    (r"```[\s\S]*?```", "[text]"),
    (r"`([^`]+)`", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
)


def markdown_strip(c: Column) -> Column:
    """Inline code, bold, italics, links and heading marks out, their text kept; a fenced block becomes a mark."""
    for pattern, by in MARKDOWN:
        c = F.regexp_replace(c, pattern, by)
    return c


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_text(c: Column) -> Column:
    """Text of a page: comments, scripts and styles dropped, tags to blanks, blanks collapsed."""
    s = F.regexp_replace(c, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def table_markdown(header: Column, rows: Column, most: int = 10, cell: int = 50) -> Column:
    """A Markdown table of the first rows, with a note of how many there are if some are left out."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.substring(x, 1, cell)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda x: F.lit("---")), " | "), F.lit(" |"))
    note = F.when(F.size(rows) > most, F.concat(F.lit("... ("), F.size(rows).cast("string"), F.lit(" rows total)")))
    body = F.concat(F.array(line(header), rule), F.transform(F.slice(rows, 1, most), line), F.array_compact(F.array(note)))
    return F.array_join(body, "\n")


def table_rows(header: Column, rows: Column, most: int = 8, cell: int = 40) -> Column:
    """headers, and the first rows with their cells cut."""
    cut = F.transform(F.slice(rows, 1, most), lambda r: F.transform(r, lambda x: F.substring(x, 1, cell)))
    return F.struct(header.alias("headers"), cut.alias("rows"))


def recent_summary(items: Column, last: int = 5, size: int = 200) -> Column:
    """The last items joined by ` | `, cut to a size."""
    start = F.greatest(F.size(items) - F.lit(last - 1), F.lit(1))
    return F.substring(F.array_join(F.slice(items, start, last), " | "), 1, size)


def pipe_tables(text: Column) -> Column:
    """rows (cells of lines with four pipes or more, dash-only ones dropped) and prose (the other lines)."""
    lines = F.split(text, "\n")
    pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 4
    cells = lambda x: F.transform(F.split(F.trim(F.regexp_replace(F.trim(x), r"^\||\|$", "")), r"\|"), lambda c: F.trim(c))
    rows = F.filter(F.transform(F.filter(lines, pipes), cells), lambda r: F.exists(r, lambda c: ~c.rlike("^[- ]*$")))
    return F.struct(rows.alias("rows"), F.array_join(F.filter(lines, lambda x: ~pipes(x)), "\n").alias("prose"))


def wrap_words(c: Column, width: int) -> Column:
    """Lines of at most `width` characters, broken between words; longer words are cut; empty paragraphs stay.

    Works on the text with a greedy pattern: as many characters as fit before a blank or the end.
    """
    line = f"(\\S.{{0,{width - 1}}}(?=\\s|$)|\\S{{{width}}})"
    wrapped = lambda p: F.when(F.trim(p) == "", F.array(F.lit(""))).otherwise(F.transform(F.regexp_extract_all(p, F.lit(line), F.lit(1)), lambda x: F.rtrim(x)))
    return F.flatten(F.transform(F.split(c, "\n"), wrapped))


def dict_rows(rows: Column, headers: Column | None = None) -> Column:
    """headers and rows of a list of maps: columns of the first map, missing cells empty."""
    names = F.map_keys(F.get(rows, F.lit(0))) if headers is None else headers
    return F.struct(names.alias("headers"), F.transform(rows, lambda r: F.transform(names, lambda k: F.coalesce(F.element_at(r, k).cast("string"), F.lit("")))).alias("rows"))


def key_values(m: Column) -> Column:
    """Two columns, key and value, of one map."""
    return F.transform(F.map_entries(m), lambda e: F.array(e["key"].cast("string"), F.coalesce(e["value"].cast("string"), F.lit(""))))


def content_id(*parts: Column) -> Column:
    """mem_<16 digits> from the content, the same whenever it is computed."""
    return F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("\u0001", *parts).cast("binary"), 256), 1, 16))
