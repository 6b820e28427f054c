"""``analyze`` and ``anonymize``: text table or stream in, spans or new text out.

Without a large dictionary or external spans both are one map over the rows: no
shuffle, the same plan on a batch and on a stream, and without detectors no Python
worker either.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import (
    CONTEXT_FACTOR, CONTEXT_MIN_SCORE, DEFAULT_ENTITIES, DEFAULT_LANGUAGE, DEFAULT_PROFILE, DEFAULT_STRATEGY,
    NER_ENTITIES, Plan, Recognizer, select,
)
from veilspark.functions import resolve, spans as S
from veilspark.functions.replacement import check_strategy, choose_sql, rewrite_sql, with_values_sql
from veilspark.functions.scan import plain_sql, scan_sql, settled_sql
from veilspark.operators import ner
from veilspark.operators.validate import prepare

_CASES = ("as_written", "insensitive")


def scan(
    df: DataFrame,
    entities: Iterable[str] | str | None = None,
    profile: str = DEFAULT_PROFILE,
    language: str = DEFAULT_LANGUAGE,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    language_col: str | None = None,
    entities_col: str | None = None,
    strategy_col: str | None = None,
    mode: str = "reject",
    case: str = "as_written",
    validated_score: float | None = None,
    min_score: float | None = None,
    trim_spans: bool = False,
    extra: Iterable[Recognizer] = (),
    catalogue: Iterable[Recognizer] | None = None,
    strict_contract: bool = False,
    detectors: Iterable[str] = (),
    gazetteer: DataFrame | ner.Names | None = None,
    external: DataFrame | None = None,
    context: Mapping[str, Iterable[str]] | None = None,
    context_window: int = 5,
) -> DataFrame:
    """The valid input rows with stripped text, ``language`` and ordered ``spans``.

    ``entities``: ``None`` or empty = the default types, ``"all"`` = every type.
    ``entities_col``: optional ``array<string>`` column with the same meaning per row.
    ``case``: match patterns as written, or without regard to case.
    ``gazetteer``: ``name, entity_type`` rows of a dictionary detector, of any types, or what ``ner.load_names`` made of them.
    ``external``: span rows computed elsewhere, keyed by ``id_col``.
    ``context``: words per entity type that raise the score of a span near them.
    """
    if case not in _CASES:
        raise ValueError(f"unknown case {case!r}; known: {', '.join(_CASES)}")
    named = {d: ner.detector_entities(d) for d in detectors}
    if gazetteer is not None:
        gazetteer = gazetteer if isinstance(gazetteer, ner.Names) else ner.load_names(gazetteer)
        named["gazetteer"] = gazetteer.kinds
    if external is not None:
        named["external"] = ()
    # per-row types can only narrow what the job scans for
    job_entities = "all" if entities_col else entities
    plan = select(profile, job_entities, extra, named, strict_contract, catalogue)

    rows = prepare(df, text_col, language, language_col, strategy_col, mode)
    # SQL text refers to copies under internal names, which no lambda variable hides
    rows = rows.withColumn("_veil_text", F.col(text_col))
    if entities_col:
        rows = rows.withColumn("_veil_asked", F.col(entities_col))
    rows = rows.withColumn("_veil_clean", F.expr(S.scannable_sql("_veil_text")))
    rows = rows.withColumn("_veil_plain", F.expr(plain_sql("_veil_clean")))
    rows = rows.withColumn(
        "_veil_found", F.expr(scan_sql("_veil_clean", plan.rows, case == "insensitive", validated_score, "_veil_plain")))
    settled = None
    if not (plan.detectors or context or trim_spans):
        settled = settled_sql("_veil_clean", plan.rows, "_veil_plain")
    spans = [resolve.trim_spans("_veil_found") if trim_spans else "_veil_found"]
    by_name = F.col("language") == DEFAULT_LANGUAGE  # other languages: pattern rules only
    models = [d for d in plan.detectors if d not in ("gazetteer", "external")]
    if models:
        rows = rows.withColumn("_veil_models", ner.detectors_column(models, F.when(by_name, F.col(text_col))))
        spans += [f"_veil_models.d{i}" for i in range(len(models))]
    if gazetteer is not None:
        rows = ner.join_dictionary(rows, gazetteer, id_col, text_col, by_name)
        spans.append("_veil_dictionary")
    if external is not None:
        rows = ner.join_external(rows, external, id_col)
        spans.append("_veil_external")
    found = spans[0] if len(spans) == 1 else "concat(" + ", ".join(
        f"coalesce({s}, {S.NO_SPANS})" for s in spans) + ")"
    return _finish(rows, found, plan, bool(entities_col), min_score, context, context_window, settled)


def _finish(rows: DataFrame, spans: str, plan: Plan, asked: bool,
            min_score: float | None, context, context_window: int, settled: str | None = None) -> DataFrame:
    """Type filter, duplicate removal, pattern-over-name rule, order; ``settled`` says where the scan has done the first and last."""
    def unless(sql: str, spans: str) -> str:
        return f"if({settled}, {spans}, {sql})" if settled else sql

    if plan.detectors and plan.entities is not None:
        spans = resolve.keep_types(spans, plan.entities)
    if asked:
        spans = (f"filter({spans}, s -> array_contains(if(size(_veil_asked) > 0, _veil_asked, "
                 f"array({S.quote_list(DEFAULT_ENTITIES)})), s.entity_type))")
    rows = rows.withColumn("_veil_s0", F.expr(spans))
    rows = rows.withColumn("_veil_s1", F.expr(unless(resolve.dedup_same_type("_veil_s0"), "_veil_s0")))
    spans = "_veil_s1"
    if plan.detectors:
        rows = rows.withColumn("_veil_s2", F.expr(resolve.drop_ner_overlaps(
            spans, plan.pattern_entities, NER_ENTITIES)))
        spans = "_veil_s2"
    if context:
        rows = rows.withColumn("_veil_s3", F.expr(ner.boost_sql(
            spans, "_veil_text", context, context_window, CONTEXT_FACTOR, CONTEXT_MIN_SCORE)))
        spans = "_veil_s3"
    if min_score is not None:
        spans = resolve.keep_score(spans, min_score)
    rows = rows.withColumn("_veil_ordered", F.expr(unless(resolve.stable_order(spans), spans)))
    # cut the text anew where a stand-in took part, or a detector gave offsets only
    blank = f"transform(_veil_ordered, s -> {S.respan_sql('s', 'CAST(NULL AS string)', 's.start', 's.end')})"
    exact = S.let_sql("bl", S.blocks_sql("_veil_text"), with_values_sql("bl", blank))
    redo = S.has_mark_sql("_veil_text")
    if plan.detectors:
        redo += " OR exists(_veil_ordered, s -> s.text IS NULL)"
    rows = _settle(rows, "spans", f"if({redo}, {exact}, _veil_ordered)")
    return rows.drop(*[c for c in rows.columns if c.startswith("_veil_")])


def _settle(rows: DataFrame, name: str, sql: str) -> DataFrame:
    """Add a column that is computed once whatever is done with it later.

    A filter on a plain column would be pushed below its projection and compute
    it again there, with everything it is made of.  A generator of one row stops
    the filter and costs nothing.
    """
    return rows.drop(name).select("*", F.inline_outer(F.array(F.struct(F.expr(sql).alias(name)))))


def analyze(df: DataFrame, entities: Iterable[str] | str | None = None, *, id_col: str = "doc_id",
            text_col: str = "text", keep: Iterable[str] = (), **options) -> DataFrame:
    """``id, pii_entities, text_length, language`` per valid row (options: :func:`scan`)."""
    rows = scan(df, entities, id_col=id_col, text_col=text_col, **options)
    return rows.select(
        id_col, *keep, F.col("spans").alias("pii_entities"),
        F.length(text_col).alias("text_length"), "language")


def analyze_rows(df: DataFrame, entities: Iterable[str] | str | None = None, *, id_col: str = "doc_id",
                 text_col: str = "text", keep: Iterable[str] = (), position: str | None = None,
                 **options) -> DataFrame:
    """One row per span: ``id, entity_type, text, start, end, score, recognizer, pattern``.

    ``position`` names a column for the place of a span in the result order.
    """
    rows = scan(df, entities, id_col=id_col, text_col=text_col, **options)
    return explode_spans(rows, id_col, "spans", keep, position)


def explode_spans(rows: DataFrame, id_col: str = "doc_id", spans_col: str = "pii_entities",
                  keep: Iterable[str] = (), position: str | None = None) -> DataFrame:
    """Span rows from a span array.

    The outer form and a filter afterwards, not ``explode``: for the latter the
    optimizer adds ``size(spans) > 0`` below, which would scan every text twice.
    """
    exploded = rows.select(id_col, *keep, F.posexplode_outer(spans_col).alias("_veil_pos", "_veil_s"))
    place = [F.col("_veil_pos").alias(position)] if position else []
    return exploded.filter(F.col("_veil_s").isNotNull()).select(id_col, *keep, *place, "_veil_s.*")


def anonymize(
    df: DataFrame,
    entities: Iterable[str] | str | None = None,
    strategy: str = DEFAULT_STRATEGY,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    strategy_col: str | None = None,
    operators: Mapping[str, str] | None = None,
    salt: str | None = None,
    mask_options: Mapping | None = None,
    merge_adjacent: bool = False,
    keep: Iterable[str] = (),
    keep_original: bool = True,
    **options,
) -> DataFrame:
    """``id, original_text, anonymized_text, entities_found, text_length, anonymization_strategy``.

    ``operators`` names a strategy per entity type, ``strategy_col`` a strategy
    per row.  ``entities_found`` is what ``analyze`` returns, before conflicts
    are resolved.
    """
    check_strategy(strategy)
    for s in (operators or {}).values():
        check_strategy(s)
    rows = scan(df, entities, id_col=id_col, text_col=text_col, strategy_col=strategy_col, **options)
    text = F.col(text_col)
    chosen = F.coalesce(F.col(strategy_col), F.lit(strategy)) if strategy_col else F.lit(strategy)
    rows = rows.withColumn("_veil_text", text).withColumn("_veil_strategy", chosen)
    rows = rows.withColumn("_veil_blocks", F.expr(S.blocks_sql("_veil_text")))
    rows = rows.withColumn("_veil_resolved", F.expr(resolve.resolve_conflicts(
        "spans", "_veil_blocks" if merge_adjacent else None, merge_adjacent)))
    valued = {strategy, *(operators or {}).values()} & {"hash", "mask"} or strategy_col
    if valued:  # only these strategies read the value
        rows = rows.withColumn("_veil_valued", F.expr(with_values_sql("_veil_blocks", "_veil_resolved")))
    replace_with = choose_sql("s.entity_type", "s.text", strategy, "_veil_strategy" if strategy_col else None, operators, salt, mask_options)
    new_text = rewrite_sql("_veil_blocks", "length(_veil_text)", "_veil_valued" if valued else "_veil_resolved", replace_with)
    original = [text.alias("original_text")] if keep_original else []
    rows = _settle(rows, "anonymized_text", new_text)
    return rows.select(
        id_col, *keep, *original, "anonymized_text",
        F.col("spans").alias("entities_found"), F.length(text).alias("text_length"),
        chosen.alias("anonymization_strategy"))
