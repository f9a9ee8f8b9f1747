"""Tables that shrink to a width, texts that end in dots, and blocks placed page by page, as expressions.

Texts are measured as in layout: each character advances by half the font size.  Pages are squares with padding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestore.functions.vector import let

# Padding of a cell, room that a cell keeps when a table is scaled, dots, heights of separators, space around captions.
CELL_PADDING = 8
CELL_LEAST = 2 * CELL_PADDING + 10
DOTS = ".."
SEPARATORS = {"line": 20, "dots": 40}
CAPTION_SPACE = 5

PIECE = "struct<block:int,page:int,x:int,y:int,w:int,h:int,lines:int>"


def _int(c: Column) -> Column:
    return F.floor(c).cast("int")


def _total(widths: Column) -> Column:
    return F.aggregate(widths, F.lit(0).cast("long"), lambda s, w: s + w)


def column_widths(cells: Column, font: Column, padding: int = CELL_PADDING) -> Column:
    """The width of each column of an array of rows of strings: its longest cell and the padding; short rows have empty cells."""
    n = F.array_max(F.transform(cells, F.size))
    widest = lambda k: F.array_max(F.transform(cells, lambda r: F.coalesce(F.length(F.get(r, k)), F.lit(-1))))
    width = lambda k: F.when(widest(k) < 0, 0).otherwise(_int(widest(k) * font * 0.5) + 2 * padding)
    return F.transform(F.sequence(F.lit(0), n - 1), width)


def capped(widths: Column, room: Column) -> Column:
    """What is left if the widest column (of equals the first) loses one until all fit into the room.

    The columns end at a common cap, of which the last few have one more.  With the widths in order, w[1] <= w[2] ...,
    the cap lies between w[k] and w[k + 1] where what is left of the room behind the k smallest, dealt to the others
    evenly, is less than w[k + 1].
    """

    def cap(w: Column) -> Column:
        n = F.size(w)
        sums = F.aggregate(w, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        each = let(sums, lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.floor((room - F.get(s, k)) / (n - k))))
        return F.get(F.filter(each, lambda c, k: c < F.get(w, k)), F.lit(0))

    def shrink(c: Column) -> Column:
        more = room - F.aggregate(widths, F.lit(0).cast("long"), lambda s, w: s + F.least(w.cast("long"), c))
        wider = lambda upto: F.size(F.filter(F.slice(widths, 1, upto), lambda w: w > c))
        all_wider = F.size(F.filter(widths, lambda w: w > c))
        return F.transform(widths, lambda w, i: F.when(w <= c, w.cast("long")).otherwise(c + (wider(i + 1) > all_wider - more).cast("int")).cast("int"))

    return F.when(_total(widths) <= room, F.transform(widths, lambda w: w.cast("int"))).otherwise(let(cap(F.array_sort(widths)), shrink))


def fitted_widths(widths: Column, room: Column, least: int = CELL_LEAST) -> Column:
    """Column widths of a table in a room: scaled down evenly, no column below `least` at first, then capped()."""
    total = _total(widths)
    scaled = F.transform(widths, lambda w: F.greatest(_int(w * (room / total)), F.lit(least)))
    return F.when(total <= room, F.transform(widths, lambda w: w.cast("int"))).otherwise(let(scaled, lambda s: capped(s, room)))


def fitted_prefix(advances: Column, room: Column) -> Column:
    """How many characters fit, by binary search over the prefix sums of their advances; advances are not negative."""
    sums = F.aggregate(advances, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def search(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("low"), F.size(advances).alias("high"))

        def halve(r: Column, _: Column) -> Column:
            mid = _int((r["low"] + r["high"] + 1) / 2)
            ok = F.get(s, mid) <= room
            open_ = r["low"] < r["high"]
            return F.struct(F.when(open_ & ok, mid).otherwise(r["low"]).alias("low"), F.when(open_ & ~ok, mid - 1).otherwise(r["high"]).alias("high"))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(advances) + 2)).cast("int"))
        return F.aggregate(steps, start, halve, lambda r: r["low"])

    return let(sums, search)


def ellipsized(text: Column, room: Column, font: Column, advances: Column | None = None) -> Column:
    """The text if it fits, else as much of it as fits with two dots behind; nothing where the dots do not fit.

    advances: the width of each character, by default half the font size.
    """
    dots = F.lit(len(DOTS)) * font * 0.5
    if advances is None:
        whole, n = F.length(text) * font * 0.5, _int((room - dots) / (font * 0.5))
    else:
        whole, n = F.aggregate(advances, F.lit(0.0), lambda s, x: s + x), fitted_prefix(advances, room - dots)
    cut = F.concat(F.substring(text, F.lit(1), n), F.lit(DOTS))
    return F.when((room > 0) & (whole <= room), text).when((room <= 0) | (room - dots <= 0), "").otherwise(cut)


def wrapped_lines(text: Column, width: Column, font: Column) -> Column:
    """Lines of a text wrapped by characters; a blank paragraph is one line."""
    per_line = F.greatest(_int(width / (font * 0.5)), F.lit(1))
    return F.aggregate(F.split(text, "\n"), F.lit(0), lambda n, p: n + F.when(p.rlike(r"\S"), F.ceil(F.length(p) / per_line).cast("int")).otherwise(1))


def text_block(text: Column, font: Column, size: int, padding: int, spacing: float = 1.5) -> Column:
    return F.struct(F.lit("lines").alias("kind"), wrapped_lines(text, F.lit(size - 2 * padding), font).alias("n"), _int(font * spacing).alias("h"), F.lit(size - 2 * padding).alias("w"), F.lit(0).alias("caption"))


def table_block(rows: Column, widths: Column, font: int, spacing: float = 1.5) -> Column:
    """A block of `rows` rows of columns of these widths."""
    return F.struct(F.lit("lines").alias("kind"), rows.cast("int").alias("n"), F.lit(int(font * spacing) + 2 * CELL_PADDING).alias("h"), _total(widths).cast("int").alias("w"), F.lit(0).alias("caption"))


def image_block(w: Column, h: Column, captioned: Column, font: int, size: int, padding: int, spacing: float = 1.5) -> Column:
    """A picture, scaled to the width of a page and half its height at most; a caption takes a line and some space."""
    scale = F.least((size - 2 * padding) / w, (size // 2) / h, F.lit(1.0))
    return F.struct(F.lit("image").alias("kind"), F.lit(1).alias("n"), _int(h * scale).alias("h"), _int(w * scale).alias("w"), F.when(captioned, int(font * spacing) + CAPTION_SPACE).otherwise(0).alias("caption"))


def separator_block(style: str, size: int, padding: int) -> Column:
    return F.struct(F.lit("separator").alias("kind"), F.lit(1).alias("n"), F.lit(SEPARATORS[style]).alias("h"), F.lit(size - 2 * padding).alias("w"), F.lit(0).alias("caption"))


def paged(blocks: Column, size: int, padding: int, gap: int) -> Column:
    """pieces and heights of blocks one below another on square pages.

    A piece is what a block has on one page: block and page (from 0), place, size and number of lines.  Lines and rows go
    on to the next page where they do not fit; pictures with their captions, and separators, stay in one piece.  A gap
    comes behind every block but separators.  heights: how far each page is filled, padding included.
    """
    foot, top = size - padding, padding
    state = lambda page, y, pieces, heights: F.struct(page.cast("int").alias("page"), y.cast("int").alias("y"), pieces.alias("pieces"), heights.alias("heights"))
    piece = lambda i, page, x, y, w, h, lines: F.struct(*[c.cast("int").alias(n) for n, c in zip(("block", "page", "x", "y", "w", "h", "lines"), (i, page, x, y, w, h, lines), strict=True)])
    closed = lambda s: F.greatest(s["y"] + padding, F.lit(2 * padding))

    def lines(s: Column, b: Column, i: Column) -> Column:
        # a line that is higher than a page has one to itself
        here = F.greatest(F.least(_int((foot - s["y"]) / b["h"]), b["n"]), F.lit(0))
        room = F.greatest(_int(F.lit(foot - top) / b["h"]), F.lit(1))

        def spread(k: Column) -> Column:
            rest = b["n"] - k
            pages = F.ceil(rest / room).cast("int")
            first = F.when(k > 0, F.array(piece(i, s["page"], F.lit(padding), s["y"], b["w"], k * b["h"], k))).otherwise(F.array().cast(f"array<{PIECE}>"))
            on = lambda p: F.least(room, rest - (p - 1) * room)
            more = F.when(pages > 0, F.transform(F.sequence(F.lit(1), pages), lambda p: piece(i, s["page"] + p, F.lit(padding), F.lit(top), b["w"], on(p) * b["h"], on(p)))).otherwise(F.array().cast(f"array<{PIECE}>"))
            full = F.when(pages > 0, F.concat(F.array((s["y"] + k * b["h"] + padding).cast("int")), F.array_repeat((F.lit(top + padding) + room * b["h"]).cast("int"), F.greatest(pages - 1, F.lit(0))))).otherwise(F.array().cast("array<int>"))
            y = F.when(pages > 0, top + on(pages) * b["h"]).otherwise(s["y"] + k * b["h"])
            return state(s["page"] + pages, y + gap, F.concat(s["pieces"], first, more), F.concat(s["heights"], full))

        return let(here, spread)

    def whole(s: Column, b: Column, i: Column) -> Column:
        new = foot - s["y"] < b["h"] + b["caption"]
        at = F.struct((s["page"] + new.cast("int")).alias("page"), F.when(new, top).otherwise(s["y"]).alias("y"), F.when(new, F.concat(s["heights"], F.array(closed(s)))).otherwise(s["heights"]).alias("heights"))
        behind = F.when(b["kind"] == "separator", 0).otherwise(gap)
        x = padding + _int((F.lit(size - 2 * padding) - b["w"]) / 2)
        return let(at, lambda a: state(a["page"], a["y"] + b["h"] + b["caption"] + behind, F.concat(s["pieces"], F.array(piece(i, a["page"], x, a["y"], b["w"], b["h"], F.lit(0)))), a["heights"]))

    numbered = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    start = state(F.lit(0), F.lit(top), F.array().cast(f"array<{PIECE}>"), F.array().cast("array<int>"))
    step = lambda s, x: F.when(x["b"]["kind"] == "lines", lines(s, x["b"], x["i"])).otherwise(whole(s, x["b"], x["i"]))
    return F.aggregate(numbered, start, step, lambda s: F.struct(s["pieces"].alias("pieces"), F.concat(s["heights"], F.array(closed(s))).alias("heights")))


def preserved(pieces: Column, pages: int) -> Column:
    """The share, in percent, of lines and pictures that the first `pages` pages hold; 100 without any."""
    count = lambda p: F.greatest(p["lines"], F.lit(1))
    total = F.aggregate(pieces, F.lit(0), lambda s, p: s + count(p))
    kept = F.aggregate(F.filter(pieces, lambda p: p["page"] < pages), F.lit(0), lambda s, p: s + count(p))
    return F.when(total > 0, 100.0 * kept / total).otherwise(100.0)
