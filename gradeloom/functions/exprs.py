"""Column expressions with the reference semantics of nulls, NaN, white space and typed truth values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<missing>"
#: White space of Unicode (fixed values).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BOXED = r"(?U)\\boxed\s*\{"
#: Lower bounds of the ratio buckets 2..7; below the first is bucket 1 (fixed values).
RATIO_BOUNDS = (0.5, 0.8, 1.0, 1.2, 1.5, 2.0)
RATIO_LABELS = ("<0.5", "0.5-0.8", "0.8-1.0", "1.0-1.2", "1.2-1.5", "1.5-2.0", ">=2.0")


def key_text(c: Column) -> Column:
    return c.cast("string")


def to_text(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def clean_text(c: Column) -> Column:
    """Text without white space (of Unicode) at its ends, in linear time; null is empty."""
    return F.btrim(to_text(c), F.lit(WHITE))


def label(c: Column) -> Column:
    return to_text(c, MISSING)


def boxed_count(c: Column) -> Column:
    """Openings of a box, balanced or not; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(BOXED)), F.lit(0))


def numeric_value(c: Column) -> Column:
    return c.try_cast("double")


def safe_int(c: Column) -> Column:
    return c.try_cast("bigint")


def _truth(c: Column, kind: str, boolean: bool, number: int, words: tuple[str, str]) -> Column:
    """Typed truth: only booleans, integers and words count; floats and anything else never do."""
    if kind == "boolean":
        test = c == F.lit(boolean)
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        test = c == F.lit(number)
    elif kind == "string":
        test = F.lower(clean_text(c)).isin(*words)
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def is_correct(c: Column, kind: str = "int") -> Column:
    return _truth(c, kind, True, 1, ("1", "true"))


def is_incorrect(c: Column, kind: str = "int") -> Column:
    """Not the complement of :func:`is_correct`: null, 2 and 1.0 are neither."""
    return _truth(c, kind, False, 0, ("0", "false"))


def is_correct_json(v: Column) -> Column:
    """Truth of a variant value: its JSON type decides, so 1.0 is not 1."""
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint") == 1)
        .when(kind == "STRING", F.lower(clean_text(F.try_variant_get(v, "$", "string"))).isin("1", "true")),
        F.lit(False),
    )


def ratio(output_tokens: Column, train_tokens: Column) -> Column:
    """Output to train tokens; null if either is missing or the latter is not above zero. A NaN target gives NaN."""
    o, t = numeric_value(output_tokens), numeric_value(train_tokens)
    return F.when(F.isnan(t) | (t > 0), o / t)


def ratio_group(r: Column) -> Column:
    """Bucket 1..7; NaN falls in 1 (no comparison holds), null stays null."""
    g = F.lit(1)
    for i, low in enumerate(RATIO_BOUNDS):
        g = F.when(r >= low, F.lit(i + 2)).otherwise(g)
    return F.when(r.isNull(), F.lit(None).cast("int")).when(F.isnan(r), F.lit(1)).otherwise(g)


def split_name(*candidates: Column, fallback: Column) -> Column:
    """First ``le<n>`` or ``gt<n>`` part between underscores among the candidates."""
    found = [F.nullif(F.regexp_extract(c, r"(?:^|_)((?:le|gt)\d+)(?:_|$)", 1), F.lit("")) for c in candidates]
    return F.coalesce(*found, fallback)


def after_marker(text: Column, marker: str) -> Column:
    """What follows the first marker, trimmed; empty without one."""
    at = F.instr(text, marker)
    return F.when(at > 0, clean_text(F.substring(text, at + len(marker), F.length(text)))).otherwise(F.lit(""))


def before_marker(text: Column, marker: str) -> Column:
    at = F.instr(text, marker)
    return F.when(at > 0, clean_text(F.substring(text, F.lit(1), at - 1))).otherwise(F.lit(""))


def review_slice(reason: Column, box_source: Column, output: Column) -> Column:
    """The part of a wrong output that a reviewer reads: the side of ``</think>`` that holds the box, for no_match rows alone."""
    text, close = to_text(output), "</think>"
    cut = (reason == "no_match") & (F.instr(text, close) > 0)
    return F.when(cut & (box_source == "solution"), after_marker(text, close)).when(cut & (box_source == "thought"), before_marker(text, close)).otherwise(text)


def says_yes(c: Column) -> Column:
    return F.lower(c).contains("yes")


def unfenced(c: Column) -> Column:
    """JSON text without a Markdown fence and its language tag."""
    t = clean_text(c)
    inner = F.btrim(t, F.lit("`"))
    inner = F.when(F.lower(F.substring(inner, 1, 4)) == "json", clean_text(F.substring(inner, F.lit(5), F.length(inner)))).otherwise(inner)
    return F.when(t.startswith("```"), inner).otherwise(t)


def hint_lines(c: Column) -> Column:
    """Lines of a hint text, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, "\n"), clean_text), lambda x: x != "")


def hint_items(c: Column) -> Column:
    return F.filter(F.transform(c, clean_text), lambda x: x != "")


def falsy(c: Column, other: Column) -> Column:
    """``c`` unless it is null or zero."""
    return F.coalesce(F.nullif(c, F.lit(0)), other)


def usage(body: Column) -> Column:
    """input, cached, output and total tokens from an API response held as a variant."""
    get = lambda p: F.try_variant_get(body, f"$.usage.{p}", "bigint")
    return F.struct(
        falsy(get("input_tokens"), get("prompt_tokens")).alias("input_tokens"),
        F.coalesce(get("input_tokens_details.cached_tokens"), get("prompt_tokens_details.cached_tokens")).alias("cached_input_tokens"),
        falsy(get("output_tokens"), get("completion_tokens")).alias("output_tokens"),
        get("total_tokens").alias("total_tokens"),
    )


OUTPUT_SCHEMA = "array<struct<content:array<struct<type:string,text:string>>>>"


def output_text(text: Column, output: Column) -> Column:
    """A response's text: ``output_text`` if not empty, else the text parts of its output, one a line."""
    parts = F.flatten(F.transform(F.coalesce(output, F.array().cast(OUTPUT_SCHEMA)), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    kept = F.filter(parts, lambda p: p["type"].isin("output_text", "text") & (F.coalesce(p["text"], F.lit("")) != ""))
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.array_join(F.transform(kept, lambda p: p["text"]), "\n"))


def first_present(names: list[str], columns: list[str]) -> str | None:
    """The first name that is a column: presence decides, not whether a value is null."""
    return next((n for n in names if n in columns), None)


def first_value(names: list[str], columns: list[str]) -> Column:
    """The first of the named columns that is not null, as text; absent ones are skipped."""
    found = [F.col(n).cast("string") for n in names if n in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def finish_rank(c: Column, *first: str) -> Column:
    """Sort key: the given reasons in their order, then all others."""
    out = F.lit(len(first))
    for i, name in reversed(list(enumerate(first))):
        out = F.when(c == name, F.lit(i)).otherwise(out)
    return out


def seeded(seed: int, key: Column) -> Column:
    """Order of a seeded sample: independent of partitions, the same in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def label_mask(ids: Column, prompt_length: Column) -> Column:
    """Labels for training: ids of the prompt are -100."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(-100)).otherwise(x))


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def percent(share: Column) -> Column:
    """A share with one decimal."""
    return F.format_string("%.1f%%", share.cast("double") * 100)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def undoubled(c: Column) -> Column:
    """A template's text with doubled braces as braces."""
    return F.replace(F.replace(c, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
