"""Append-only result logs: batch results, latest success per key, restart, and folds over verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.sources.readers import last_per_key

FIELDS = "concise_hint", "detailed_method_hint", "detailed_scaffold_hint"


def succeeded() -> Column:
    """An ok row with all three hints."""
    return (F.col("status") == "ok") & F.forall(F.array(*[F.coalesce(F.length(c), F.lit(0)) for c in FIELDS]), lambda n: n > 0)


def latest(log: DataFrame) -> DataFrame:
    """The last success of each index."""
    return last_per_key(log.where(succeeded()))


def parse_results(lines: DataFrame, *keep: str) -> DataFrame:
    """Checkpoint rows of batch results (``_v`` variants): hints as JSON texts, or an error with its reason (of a status other than 200, the whole response); ``keep`` are further columns to keep. Each value is
    read from the variant once."""
    get = lambda c, p, t="string": F.try_variant_get(c, f"$.{p}", t)
    rows = lines.select(*keep, get("_v", "custom_id").alias("index"), get("_v", "error", "variant").alias("_e"), get("_v", "response.status_code", "int").alias("_code"), get("_v", "response.body", "variant").alias("_body"), F.when(F.coalesce(get("_v", "response.status_code", "int"), F.lit(0)) != 200, F.coalesce(F.to_json(get("_v", "response", "variant")), F.lit("{}"))).alias("_r"))
    text = X.output_text(get("_body", "output_text"), get("_body", "output", X.OUTPUT_SCHEMA))
    rows = rows.select(*keep, "index", "_e", "_r", X.usage(F.col("_body")).alias("usage"), X.unfenced(text).alias("_t"))
    rows = rows.select(*keep, "index", "_e", "_r", "usage", F.try_parse_json("_t").alias("_h"))
    items = lambda name: X.hint_items(F.coalesce(get("_h", name, "array<string>"), X.hint_lines(get("_h", name))))
    out = rows.select(*keep, "index", "_e", "_r", "usage", F.col("_h").isNotNull().alias("_json"), X.clean_text(get("_h", "concise_hint")).alias("_c"), items("detailed_method_hint").alias("_m"), items("detailed_scaffold_hint").alias("_s"))
    error = (
        F.when(F.col("_e").isNotNull() & ~F.is_variant_null("_e"), F.to_json("_e"))
        .when(F.col("_r").isNotNull(), F.col("_r"))
        .when(~F.col("_json"), F.lit("Output is not JSON."))
        .when(F.col("_c") == "", F.lit("Missing concise_hint."))
        .when(F.coalesce(F.size("_m"), F.lit(0)) < 1, F.lit("Empty detailed_method_hint."))
        .when(F.coalesce(F.size("_s"), F.lit(0)) < 1, F.lit("Empty detailed_scaffold_hint."))
    )
    out = out.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select(*keep, "index", F.when(ok, "ok").otherwise("error").alias("status"), "error", F.when(ok, F.col("_c")).alias(FIELDS[0]), F.when(ok, F.to_json("_m")).alias(FIELDS[1]), F.when(ok, F.to_json("_s")).alias(FIELDS[2]), "usage.*")


def parse_errors(lines: DataFrame, *keep: str) -> DataFrame:
    """Checkpoint rows of a batch's error file: each is an error, with its reason or else the whole line."""
    told = [F.to_json(F.try_variant_get("_v", f"$.{p}", "variant")) for p in ("error", "response.body.error")]
    reason = F.coalesce(*[F.nullif(x, F.lit("null")) for x in told], F.to_json("_v"))
    usage = [F.lit(None).cast("bigint").alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")]
    return lines.select(*keep, F.try_variant_get("_v", "$.custom_id", "string").alias("index"), F.lit("error").alias("status"), reason.alias("error"), *[F.lit(None).cast("string").alias(c) for c in FIELDS], *usage)


def table(log: DataFrame, optional: tuple[str, ...] = ("model", "batch_id", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")) -> DataFrame:
    """The latest success of each index as a table: its hints, and those of the optional columns that the log has."""
    return latest(log).select("index", *FIELDS, *[c for c in optional if c in log.columns])


def usage_totals(df: DataFrame) -> DataFrame:
    """Token sums and the share of cached input."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(c)
    out = df.agg(*[total(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")])
    return out.withColumn("cache_ratio", F.when(F.col("input_tokens") > 0, F.col("cached_input_tokens") / F.col("input_tokens")).otherwise(F.lit(0.0)))


def verdict_fold(passes: Column, max_pass: int = 5, max_fail: int = 10, most: int = 30) -> Column:
    """State of a solve-and-verify loop after ordered verdicts: correct starts at 1, a pass adds one and clears errors, a fail
    clears correct and adds an error; it ends at max_pass, max_fail or ``most`` verdicts."""
    start = F.struct(F.lit(1).alias("correct"), F.lit(0).alias("errors"), F.lit(0).alias("steps"), F.lit("open").alias("state"))

    def step(s: Column, ok: Column) -> Column:
        correct, errors = F.when(ok, s["correct"] + 1).otherwise(F.lit(0)), F.when(ok, F.lit(0)).otherwise(s["errors"] + 1)
        state = F.when(correct >= max_pass, F.lit("solved")).when(errors >= max_fail, F.lit("failed")).otherwise(F.lit("open"))
        return F.when(s["state"] == "open", F.struct(correct.alias("correct"), errors.alias("errors"), (s["steps"] + 1).alias("steps"), state.alias("state"))).otherwise(s)

    return F.aggregate(F.slice(passes, 1, most), start, step)
