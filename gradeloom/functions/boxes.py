r"""Boxes and thoughts as column expressions.

A text is split at ``\boxed{``. What stands behind an opening, up to the next one, is its piece. The last balanced box closes within its own piece: a box opened later inside of it
would have to close first, and then that one were the last. So a fold over a piece's closing braces finds where its box ends, and one fold over the pieces the last box.
All folds are linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X

BOX, OPEN, CLOSE = r"\boxed{", "<think>", "</think>"
SHORT_THOUGHT = 50
#: More than a short thought is long whatever stands before it, so that no more of it need be kept.
_ENOUGH = 4 * SHORT_THOUGHT


def _opens(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def _piece(piece: Column) -> Column:
    """end: where the box of a piece closes (-1: not in it); low: the least depth reached, its box's inside being 0; net: the depth at its end."""
    parts = F.split(piece, r"\}")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + _opens(part) - 1
        end = F.when((s["end"] < 0) & (depth < 0), s["at"] + F.length(part)).otherwise(s["end"])
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"), (s["at"] + F.length(part) + 1).alias("at"), end.alias("end"))

    closed = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.aggregate(closed, start, step, lambda s: F.struct(s["end"].alias("end"), s["low"].alias("low"), (s["depth"] + _opens(F.element_at(parts, -1))).alias("net")))


def _pieces(text: Column) -> Column:
    return F.split(text, r"\\boxed\{")


def last_box(text: Column) -> Column:
    """start (from 0) and content (trimmed) of the last balanced box; null without one."""
    pieces = _pieces(text)
    first = F.element_at(pieces, 1)
    start = F.struct(F.length(first).alias("at"), F.lit(-1).alias("start"), F.lit("").alias("content"))

    def step(s: Column, piece: Column) -> Column:
        end = _piece(piece)["end"]
        found = end >= 0
        return F.struct(
            (s["at"] + len(BOX) + F.length(piece)).alias("at"), F.when(found, s["at"]).otherwise(s["start"]).alias("start"),
            F.when(found, F.substring(piece, F.lit(1), end)).otherwise(s["content"]).alias("content"),
        )

    found = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda s: F.when(s["start"] >= 0, F.struct(s["start"].alias("start"), X.clean_text(s["content"]).alias("content"))))
    return F.when(text.contains(BOX), found)


def box_source(text: Column, start: Column) -> Column:
    """Where the last box is; ``start`` is null without one."""
    close, opened = F.instr(text, CLOSE) - 1, F.length(text) - F.length(F.substring_index(text, OPEN, -1)) - len(OPEN)
    closed = F.when(start >= close + len(CLOSE), F.lit("solution")).otherwise(F.lit("thought"))
    unclosed = F.when(text.contains(OPEN) & (start >= opened + len(OPEN)), F.lit("thought")).otherwise(F.lit("solution"))
    return F.when(start.isNull(), F.lit("none")).when(close >= 0, closed).otherwise(unclosed)


def _measured(text: Column) -> Column:
    """A text with runs of blanks as one; cut where it is long enough."""
    return F.regexp_replace(text, "[ \t\r\n]++", " ")


def _long(text: Column) -> Column:
    return F.length(X.clean_text(_measured(text))) >= SHORT_THOUGHT


def _without_boxes(text: Column) -> Column:
    """The text between balanced boxes, or an end of it that is long enough. What stands between a box and the next one inside of it goes, too."""
    pieces = _pieces(text)
    start = F.struct(F.lit(0).alias("low"), F.lit("").alias("kept"))

    def step(s: Column, piece: Column) -> Column:
        p = _piece(piece)
        low = F.least(p["low"], p["net"] + 1 + s["low"])
        own = F.when(p["end"] >= 0, F.substring(piece, p["end"] + 2, F.length(piece))).when(low < 0, F.lit("")).otherwise(F.concat(F.lit(BOX), piece))
        return F.struct(low.alias("low"), F.when(F.length(s["kept"]) > _ENOUGH, s["kept"]).otherwise(_measured(F.concat(own, s["kept"]))).alias("kept"))

    behind = F.reverse(F.slice(pieces, F.lit(2), F.size(pieces)))
    kept = F.aggregate(behind, start, step, lambda s: s["kept"])
    return F.when(text.contains(BOX), F.concat(F.element_at(pieces, 1), kept)).otherwise(text)


def think_type(text: Column) -> Column:
    """How a text thinks; a thought is short if less than SHORT_THOUGHT characters stand outside of its boxes."""
    thought = F.substring_index(F.substring_index(text, CLOSE, 1), OPEN, -1)
    long = F.when(_long(_without_boxes(thought)), F.lit("reasoning_think")).otherwise(F.lit("short_think"))
    return F.when(text.contains(CLOSE), long).when(text.contains(OPEN), F.lit("unclosed_think")).otherwise(F.lit("missing_think"))
