"""Whole jobs: analyze or anonymize a table, evaluate samples, compare with a golden set.

``python -m veilspark.plans.jobs evaluate ...`` (or spark-submit) ends with 0,
with 1 if a quality gate was not passed, and with 2 if the input is bad.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions.spans import WHITESPACE
from veilspark.operators import evaluate as E
from veilspark.plans.analyze import analyze, anonymize, explode_spans, scan
from veilspark.plans.config import options_of
from veilspark.sources import readers, sinks

CLI_SCORE_THRESHOLD = 0.4
BAD_INPUT = (PySparkException, Py4JJavaError, ValueError, KeyError, AttributeError, TypeError)


def pattern_entity_filter(profile: str = catalog.DEFAULT_PROFILE) -> tuple[str, ...]:
    """Types of the active pattern recognizers, or the fixed list if there are none."""
    return catalog.select(profile, "all").pattern_entities or catalog.FALLBACK_PATTERN_ENTITIES


def evaluate_samples(
    samples: DataFrame,
    iou_threshold: float = 0.5,
    score_threshold: float = 0.3,
    entities: Iterable[str] | None = None,
    **options,
) -> E.Evaluation:
    """Analyze ``sample_id, text, spans`` with every type and score the result.

    Labels refer to the text as given, so leading white space shifts the found
    spans back by its length.
    """
    options = {"entities": "all", **options}
    lead = F.length("text") - F.length(F.ltrim(F.col("text"), F.lit(WHITESPACE)))
    found = scan(samples.select("sample_id", "text", F.col("text").alias("raw_text"), lead.alias("lead_chars")),
                 id_col="sample_id", **options)
    shifted = found.select("sample_id", F.col("raw_text").alias("text"), F.expr(
        "transform(spans, s -> named_struct('entity_type', s.entity_type, 'start', s.start + lead_chars, "
        "'end', s.end + lead_chars, 'score', s.score))").alias("spans"))
    return E.evaluate(E.prediction_rows(shifted), E.truth_rows(samples), iou_threshold, score_threshold, entities)


def golden_comparison(golden: DataFrame, **options) -> E.GoldenComparison:
    """Exact comparison of a golden set with what a profile detects."""
    options = {"entities": "all", **options}
    found = explode_spans(analyze(golden.select("id", "text"), id_col="id", **options), "id")
    return E.compare_exact(found, readers.golden_spans(golden))


def golden_by_profile(golden: DataFrame, profiles: Iterable[str], value: str = "recall",
                      per_profile: dict | None = None, **options) -> DataFrame:
    """The same golden set through several profiles, one column each."""
    reports = {
        p: golden_comparison(golden, profile=p, **{**options, **(per_profile or {}).get(p, {})}).report
        for p in profiles}
    return E.compare_profiles(reports, value)


def print_rows(df: DataFrame) -> None:
    """Every row of a report, fetched partition by partition; one line each."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def run_evaluation(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        samples = readers.read_samples(spark, args.data)
        samples.agg(F.count("text")).first()  # a sample file that does not parse ends here
        thresholds = readers.read_thresholds(spark, args.thresholds)
        options = _configured(spark, args)
    except BAD_INPUT as exc:
        print(f"bad input: {exc}", file=sys.stderr)
        return 2
    entities = None
    if args.pattern_only:
        entities = pattern_entity_filter(args.profile)
    elif args.entities:
        entities = catalog.parse_entity_list(args.entities)
    result = evaluate_samples(samples, args.iou_threshold, args.score_threshold, entities, **options).persisted()
    gated = result.gate(thresholds)
    print_rows(gated.orderBy("entity_type"))
    if args.show_errors:
        print_rows(result.error_samples())
    if args.output:
        sinks.write_report(result.report(), args.output, mode="overwrite")
    if not E.verdict(gated).first()["passed"]:
        print("one or more thresholds were not reached")
        return 1 if args.fail_on_threshold else 0
    print("all thresholds reached")
    return 0


def golden_floors(profile: str) -> dict[str, float]:
    """Hard floors of the pattern types and the bands of the profile's name types."""
    return {**catalog.PATTERN_RECALL_FLOOR, **catalog.NER_RECALL_BANDS.get(profile, {})}


def run_golden(spark: SparkSession, args: argparse.Namespace) -> int:
    """Compare exactly and gate the recall of the expected types."""
    try:
        golden = readers.read_golden(spark, args.data)
        golden.agg(F.count("text"), F.count("entities")).first()  # a line that does not parse ends here
        options = _configured(spark, args)
    except BAD_INPUT as exc:
        print(f"bad input: {exc}", file=sys.stderr)
        return 2
    compared = golden_comparison(golden, **options).persisted()
    print_rows(compared.report.orderBy("entity_type"))
    print_rows(compared.missing)
    print_rows(compared.extra_shown())
    if args.output:
        sinks.write_golden(compared, golden, args.output, mode="overwrite")
    floors = compared.floors(golden_floors(args.profile)).orderBy("entity_type")
    print_rows(floors)
    if args.no_gate or E.verdict(floors).first()["passed"]:
        return 0
    print("one or more recall floors were not reached")
    return 1


def _configured(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The options a profile or a plug-in file stands for."""
    if not args.config:
        return {"profile": args.profile}
    return {"profile": args.profile, **options_of(readers.read_config(spark, args.config), args.without_models)}


def run_table(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        options = _configured(spark, args)
        if args.gazetteer:
            options["gazetteer"] = spark.read.parquet(args.gazetteer)
        for name in ("case", "min_score", "language"):
            if getattr(args, name) is not None:
                options[name] = getattr(args, name)
        texts = readers.read_texts(spark, args.input, args.format)
        entities = catalog.parse_entity_list(args.entities) if args.entities else None
        if entities == ("ALL",):
            entities = "all"
        if args.command == "analyze":
            done = analyze(texts, entities, **options)
        else:
            done = anonymize(texts, entities, args.strategy, salt=args.salt, **options)
    except BAD_INPUT as exc:
        print(f"bad input: {exc}", file=sys.stderr)
        return 2
    if args.command == "analyze":
        sinks.write_table(done, args.output)
    else:
        sinks.write_anonymized(done, args.output, keep_original=not args.drop_original)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "anonymize"):
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--format", default="parquet")
        c.add_argument("--output", required=True)
        c.add_argument("--entities")
        c.add_argument("--profile", default=catalog.DEFAULT_PROFILE)
        c.add_argument("--case", choices=("as_written", "insensitive"))
        c.add_argument("--min-score", type=float)
        c.add_argument("--language")
        c.add_argument("--gazetteer", help="parquet table of name and entity_type")
        if name == "anonymize":
            c.add_argument("--salt")
            c.add_argument("--strategy", default=catalog.DEFAULT_STRATEGY)
            c.add_argument("--drop-original", action="store_true")
    c = sub.add_parser("evaluate")
    c.add_argument("--data", required=True)
    c.add_argument("--thresholds", required=True)
    c.add_argument("--iou-threshold", type=float, default=0.5)
    c.add_argument("--score-threshold", type=float, default=CLI_SCORE_THRESHOLD)
    c.add_argument("--pattern-only", action="store_true")
    c.add_argument("--entities")
    c.add_argument("--show-errors", action="store_true")
    c.add_argument("--fail-on-threshold", action="store_true")
    c.add_argument("--profile", default=catalog.DEFAULT_PROFILE)
    c.add_argument("--output")
    c = sub.add_parser("golden")
    c.add_argument("--data", required=True)
    c.add_argument("--profile", default=catalog.DEFAULT_PROFILE)
    c.add_argument("--output")
    c.add_argument("--no-gate", action="store_true")
    for c in sub.choices.values():
        c.add_argument("--config", help="plug-in file; replaces the patterns and models of the profile")
        c.add_argument("--without-models", action="store_true", help="leave out the file's models")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    run = {"evaluate": run_evaluation, "golden": run_golden}.get(args.command, run_table)
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
