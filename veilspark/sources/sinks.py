"""Sinks: analyzed and anonymized tables, span rows, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilspark.operators.evaluate import GoldenComparison
from veilspark.operators.validate import BAD_LANGUAGE, BAD_STRATEGY, EMPTY_TEXT, checked_rows

FORMATS = ("parquet", "orc", "json")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: tuple[str, ...] = ()) -> None:
    """Write a result with its nested entities.

    Files follow the partitions of the plan; nothing is gathered first.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_anonymized(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                     keep_original: bool = True) -> None:
    """Write an ``anonymize`` result, without the original text and values if asked."""
    if not keep_original:
        df = df.drop("original_text", "entities_found")
    write_table(df, path, fmt, mode)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a one-row JSON report as text."""
    report.select("report").coalesce(1).write.mode(mode).text(path)


def write_golden(compared: GoldenComparison, examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a golden comparison: ``report`` (figures), ``types`` (JSON lines), ``missing`` and ``extra`` (JSON lines, any number)."""
    write_report(compared.to_json(examples), f"{path}/report", mode)
    for name in ("types", "missing", "extra"):
        write_table(compared.report if name == "types" else getattr(compared, name), f"{path}/{name}", "json", mode)


def write_checked(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options) -> dict[str, int]:
    """Write valid rows to ``path/outcome=valid`` and rejected ones, with their reason, to ``path/outcome=rejected``.

    One pass over the source: the numbers returned, of valid rows and per reason, are observed while it is written.
    ``options`` are those of :func:`veilspark.operators.validate.checked_rows`.
    """
    rows, seen = checked_rows(df, **options), Observation()
    named = {"valid": F.col("reason").isNull(), **{r: F.col("reason") == r for r in (EMPTY_TEXT, BAD_LANGUAGE, BAD_STRATEGY)}}
    rows = rows.observe(seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in named.items()])
    outcome = F.when(F.col("reason").isNull(), "valid").otherwise("rejected")
    write_table(rows.withColumn("outcome", outcome), path, fmt, mode, ("outcome",))
    return dict(seen.get)
