"""Input checks: which rows may be analyzed, and whether labels and spans are sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import DEFAULT_LANGUAGE, LANGUAGES, STRATEGIES
from veilspark.functions.spans import is_blank, strip_text

EMPTY_TEXT = "text cannot be empty"
BAD_LANGUAGE = "unsupported language"
BAD_STRATEGY = "unsupported strategy"


def rejection(text: Column, language: Column | None = None, strategy: Column | None = None) -> Column:
    """Why a row is rejected, or null.  An absent language or strategy means the default."""
    reason = F.when(is_blank(text), F.lit(EMPTY_TEXT))
    if language is not None:
        reason = reason.when(language.isNotNull() & ~language.isin(*LANGUAGES), F.lit(BAD_LANGUAGE))
    if strategy is not None:
        reason = reason.when(strategy.isNotNull() & ~strategy.isin(*STRATEGIES), F.lit(BAD_STRATEGY))
    return reason


def check_language(language: str) -> str:
    if language not in LANGUAGES:
        raise ValueError(f"unsupported language {language!r}; supported: {', '.join(LANGUAGES)}")
    return language


def prepare(
    df: DataFrame,
    text_col: str = "text",
    language: str = DEFAULT_LANGUAGE,
    language_col: str | None = None,
    strategy_col: str | None = None,
    mode: str = "reject",
) -> DataFrame:
    """Valid rows with stripped text and a language.

    ``mode="reject"`` leaves bad rows out (:func:`rejected_rows` returns them),
    ``mode="fail"`` ends the job at the first one.
    """
    if mode not in ("reject", "fail"):
        raise ValueError(f"unknown mode {mode!r}")
    check_language(language)
    text = F.col(text_col)
    lang = F.col(language_col) if language_col else None
    strategy = F.col(strategy_col) if strategy_col else None
    reason = rejection(text, lang, strategy)
    if mode == "reject":
        df = df.filter(reason.isNull())
        stripped = strip_text(text)
    else:
        stripped = F.when(reason.isNull(), strip_text(text)).otherwise(
            F.raise_error(F.concat(F.lit("rejected row: "), reason)))
    out = df.withColumn(text_col, stripped)
    return out.withColumn(
        "language", F.coalesce(lang, F.lit(language)) if lang is not None else F.lit(language))


def rejected_rows(
    df: DataFrame, text_col: str = "text", language_col: str | None = None, strategy_col: str | None = None,
) -> DataFrame:
    """The rows :func:`prepare` leaves out, with a ``reason``."""
    reason = rejection(
        F.col(text_col),
        F.col(language_col) if language_col else None,
        F.col(strategy_col) if strategy_col else None)
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def checked_rows(df: DataFrame, text_col: str = "text", language: str = DEFAULT_LANGUAGE, language_col: str | None = None,
                 strategy_col: str | None = None) -> DataFrame:
    """Every row with its ``reason``: null for valid rows, which are as :func:`prepare` makes them; rejected ones stay as they are."""
    check_language(language)
    lang = F.col(language_col) if language_col else F.lit(None).cast("string")
    reason = rejection(F.col(text_col), F.col(language_col) if language_col else None,
                       F.col(strategy_col) if strategy_col else None)
    rows = df.withColumn("reason", reason)
    valid = F.col("reason").isNull()
    return rows.withColumn(text_col, F.when(valid, strip_text(F.col(text_col))).otherwise(F.col(text_col))).withColumn(
        "language", F.when(valid, F.coalesce(lang, F.lit(language))).otherwise(lang))


def bad_labels(samples: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """Labels whose ``text[start:end]`` is not the stated value."""
    label = F.col("label")
    found = F.substring(F.col(text_col), label["start"] + 1, label["end"] - label["start"])
    return (
        samples.select(id_col, text_col, F.explode_outer("spans").alias("label"))
        .select(
            id_col, label["entity_type"].alias("entity_type"), label["start"].alias("start"),
            label["end"].alias("end"), label["text"].alias("stated"), found.alias("found"))
        .filter(F.col("stated").isNotNull() & ~F.col("found").eqNullSafe(F.col("stated"))))


def bad_spans(spans: DataFrame) -> DataFrame:
    """Span rows that break ``0 < score <= 1``, ``start >= 0`` or ``end > start``."""
    sound = (
        (F.col("score") > 0) & (F.col("score") <= 1) & (F.col("start") >= 0) & (F.col("end") > F.col("start")))
    return spans.filter(~F.coalesce(sound, F.lit(False)) | F.isnan("score"))
