"""Command lines: each reads files, applies an operator and writes what comes out. ``python -m gradeloom.cli --help`` lists them.

Generation, training and calls of models are boundaries: ``inputs`` writes what they read, ``assemble`` and ``hint-results`` read what they write.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import runs
from gradeloom.functions import exprs as X
from gradeloom.operators import analyze, curate, curriculum, grade, judge, prepare, reports
from gradeloom.sources import readers, writers
from gradeloom.sources.one_file import write_one_file
from gradeloom.streaming import checkpoints

COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def command(name: str, *options: tuple[str, dict]) -> Callable:
    def add(f: Callable) -> Callable:
        COMMANDS[name] = f, list(options)
        return f

    return add


def opt(name: str, kind: type = str, default: object = None, required: bool = False, **more) -> tuple[str, dict]:
    return name, {"type": kind, "default": default, "required": required, **more}


PREDICTION, GENERATIONS, DATASET, OUTPUT = (opt(f"--{x}", required=True) for x in ("prediction", "generations", "dataset", "output"))


def _show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(), ensure_ascii=False, default=str))


@command("subset", opt("--input", required=True), opt("--sample-size", int, 12_000), opt("--seed", int, 9), opt("--threshold-column"), opt("--max-threshold", float), opt("--hints"), opt("--hints-output"))
def subset(spark: SparkSession, a: argparse.Namespace) -> None:
    """An exact seeded sample below a threshold, and its hints; files are named by the parameters."""
    chosen = curate.sample(curate.threshold(readers.records(spark, a.input), a.threshold_column, a.max_threshold), a.sample_size, a.seed)
    path = writers.subset_name(a.input, a.sample_size, a.seed, a.threshold_column, a.max_threshold)
    chosen.drop("_pos", "_order").write.mode("overwrite").parquet(path)
    if a.hints:
        hints = curate.align(spark.read.parquet(path), readers.records(spark, a.hints).drop("_pos"))
        hints.write.mode("overwrite").parquet(a.hints_output or writers.subset_name(a.hints, a.sample_size, a.seed, a.threshold_column, a.max_threshold))
    print(path)


@command("key-overlap", opt("--left", required=True), opt("--right", required=True), opt("--sample-size", int, 10))
def key_overlap(spark: SparkSession, a: argparse.Namespace) -> None:
    """Key profiles of two files, their overlap, and examples."""
    left, right = (readers.index_column(spark, x) for x in (a.left, a.right))
    for df in (left, right):
        _show(curate.key_profile(df))
    _show(curate.key_overlap(left, right))
    _show(curate.overlap_examples(left, right, a.sample_size))


@command("review-export", opt("--input", required=True), opt("--hints", required=True), opt("--output-root", required=True), opt("--stem", default="review"), opt("--chunk-size", int, 1000))
def review_export(spark: SparkSession, a: argparse.Namespace) -> None:
    """Question, answer and hint of each row in numbered chunks."""
    print(*writers.write_chunks(curate.review_records(readers.records(spark, a.input), readers.records(spark, a.hints).drop("_pos")), a.output_root, a.stem, size=a.chunk_size), sep="\n")


@command("multi-box-count", opt("--input", required=True, nargs="+"), opt("--examples", int, 10))
def multi_box_count(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows, and rows with several boxes, of each file and of all; and examples."""
    df = curate.fan_out({path: readers.records(spark, path).select("_pos", "index", "solution") for path in a.input})
    _show(curate.multi_box_totals(df))
    _show(df.where(X.boxed_count(F.col("solution")) > 1).orderBy("split", "_pos").select("split", "index").limit(a.examples))


@command("filter", opt("--input", required=True), opt("--invalid", required=True), OUTPUT, opt("--hints"), opt("--stats-output"))
def filter_(spark: SparkSession, a: argparse.Namespace) -> None:
    """Without invalid keys and rows with several boxes; counts as JSON."""
    rows, invalid = readers.records(spark, a.input), readers.key_set(spark, a.invalid)
    curate.single_box(curate.without_keys(rows, invalid)).drop("_pos").write.mode("overwrite").parquet(a.output)
    stats = curate.funnel(rows, invalid, hints=readers.records(spark, a.hints) if a.hints else None).first().asDict()
    print(json.dumps(stats))
    if a.stats_output:
        writers.write_stats([stats], a.stats_output)


@command("inputs", opt("--input", required=True), OUTPUT, opt("--hints"), opt("--condition", default="nohint"), opt("--limit", int))
def inputs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rendered model inputs."""
    rows = curate.limited(readers.records(spark, a.input), a.limit)
    prepare.inference_inputs(rows, readers.records(spark, a.hints) if a.hints else None, a.condition).write.mode("overwrite").parquet(a.output)


@command("assemble", opt("--inputs", required=True), opt("--outputs", required=True), opt("--run-id", required=True), OUTPUT, opt("--retry-output"), opt("--append", action="store_true"))
def assemble(spark: SparkSession, a: argparse.Namespace) -> None:
    """Outputs with their inputs' fields. With a retry output, rows cut off by length go there as records to try again; appended rows are those of the second try."""
    rows = prepare.assembled(readers.records(spark, a.inputs), readers.records(spark, a.outputs), a.run_id)
    if a.retry_output:
        _show(prepare.length_counts(rows))
        rows, cut = prepare.split_by_length(rows)
        writers.write_json_lines(prepare.retry_records(readers.records(spark, a.inputs), cut), a.retry_output)
    writers.write_json_lines(rows, a.output, append=a.append)


@command("curriculum", PREDICTION, DATASET, opt("--output-dir", required=True), opt("--target-hard-size", int, 2000), opt("--seed", int, 9))
def curriculum_(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hard and easy indexes, the ledger and the checks."""
    rows = curriculum.split(readers.records(spark, a.prediction), readers.train_tokens(readers.records(spark, a.dataset)), a.target_hard_size, a.seed)
    writers.write_keys(rows.where("hard"), f"{a.output_dir}/hard")
    writers.write_keys(rows.where("not hard"), f"{a.output_dir}/easy")
    stats = {"ledger": [r.asDict() for r in curriculum.ledger(rows).orderBy("pool").collect()], "check": curriculum.self_check(rows, a.target_hard_size).first().asDict()}
    writers.write_stats(stats, f"{a.output_dir}/stats.json")


@command("sft-records", opt("--input", required=True), OUTPUT, opt("--index-file"), opt("--limit", int))
def sft_records(spark: SparkSession, a: argparse.Namespace) -> None:
    """Training records, all or by an ordered file of indexes, as a JSON array."""
    rows = readers.records(spark, a.input)
    if a.index_file:
        rows = prepare.in_key_order(rows, readers.ordered_keys(spark, a.index_file))
    rows = curate.limited(rows, a.limit)
    _show(prepare.skipped(rows))
    writers.write_sft(prepare.sft_records(rows), a.output)


@command("grade", opt("--input", required=True), OUTPUT, opt("--label-field", default="label"), opt("--pred-field", default="model_output"), opt("--index-field", default="index"))
def grade_(spark: SparkSession, a: argparse.Namespace) -> None:
    """Graded predictions."""
    rows = readers.records(spark, a.input).withColumnsRenamed({a.label_field: "label", a.pred_field: "model_output", a.index_field: "index"})
    writers.write_json_lines(grade.predictions(rows), a.output)


@command("negative", PREDICTION, opt("--output"))
def negative(spark: SparkSession, a: argparse.Namespace) -> None:
    """Report of incorrect rows."""
    _write(reports.negative(readers.records(spark, a.prediction)), a.output)


@command("positive", PREDICTION, GENERATIONS, DATASET, opt("--output"))
def positive(spark: SparkSession, a: argparse.Namespace) -> None:
    """Report of correct rows."""
    _write(reports.positive(readers.records(spark, a.prediction), readers.records(spark, a.generations), readers.train_tokens(readers.records(spark, a.dataset))), a.output)


@command("metrics", PREDICTION, opt("--generations"), opt("--metrics-output"), opt("--incorrect-output"))
def metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics by dataset, and all incorrect cases."""
    rows = readers.records(spark, a.prediction)
    if a.generations:
        rows = analyze.enriched(rows, readers.generations(readers.records(spark, a.generations)))
    _write(reports.metrics(rows), a.metrics_output)
    if a.incorrect_output:
        write_one_file(reports.incorrect_cases(rows), a.incorrect_output, begin=reports.CASES, empty="\nNone.")


def _write(text: str, path: str | None) -> None:
    if path is None:
        print(text)
    else:
        with open(path, "w", encoding="utf-8") as out:
            out.write(text)


@command("suspects", PREDICTION, GENERATIONS, opt("--output-dir", required=True), opt("--chunk-size", int, 100))
def suspects(spark: SparkSession, a: argparse.Namespace) -> None:
    """Suspected false negatives in numbered chunks."""
    rows = judge.suspects(readers.records(spark, a.prediction), readers.records(spark, a.generations).drop("_pos"))
    print(*writers.write_chunks(rows, a.output_dir, "suspect_false_negative", size=a.chunk_size), sep="\n")


@command("judgement", PREDICTION, opt("--false-negative", required=True), opt("--suspect-false-negative"))
def judgement(spark: SparkSession, a: argparse.Namespace) -> None:
    """Applies confirmed verdicts to a Parquet table of predictions, and takes them out of the suspects."""
    rows, confirmed = spark.read.parquet(a.prediction), readers.key_set(spark, a.false_negative)
    suspected = spark.read.parquet(a.suspect_false_negative) if a.suspect_false_negative else None
    _show(judge.verdict_counts(rows, confirmed, suspected))
    writers.swap(judge.apply_verdicts(rows, confirmed), a.prediction)
    if suspected is not None:
        writers.swap(judge.without_confirmed(suspected, confirmed), a.suspect_false_negative)


@command("hint-results", opt("--results", required=True), opt("--errors"), OUTPUT)
def hint_results(spark: SparkSession, a: argparse.Namespace) -> None:
    """The latest hints of each index from result files, as a table; token sums."""
    log = checkpoints.parse_results(readers.json_lines(spark, a.results), "_pos")
    if a.errors:
        log = log.unionByName(checkpoints.parse_errors(readers.json_lines(spark, a.errors), "_pos"))
    checkpoints.table(log).write.mode("overwrite").parquet(a.output)
    _show(checkpoints.usage_totals(log))


@command("run", opt("--config", required=True), opt("--set", action="append", default=[]))
def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """The job that a config names by ``job_type``, with the config's values as its options; ``--set name=value`` overrides."""
    config = runs.overridden(readers.config(a.config), dict(x.split("=", 1) for x in a.set))
    name = config.pop("job_type")
    main([name, *(y for k, v in config.items() if v is not None for y in (f"--{k.replace('_', '-')}", *(map(str, v) if isinstance(v, list) else [str(v)])))], spark)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gradeloom")
    subs = top.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = subs.add_parser(name, help=f.__doc__.splitlines()[0])
        for flag, how in options:
            how = {k: v for k, v in how.items() if not (how.get("action") and k == "type") and not (how.get("action") == "store_true" and k == "default")}
            sub.add_argument(flag, **how)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("gradeloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
