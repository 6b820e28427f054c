"""The engine as SQL functions, for people who write SQL only.

``register(spark)`` makes ``pii_spans(text)``, ``pii_anonymize(text)`` and
``pii_valid_bsn(text)``.  They are SQL functions over built-in expressions, so
a query that calls them is planned like any other::

    SELECT doc_id, s.* FROM (SELECT doc_id, pii_spans(text) AS a FROM docs)
    LATERAL VIEW OUTER explode(a) AS s WHERE s IS NOT NULL

``spans_table(spans)`` is a table function for use in a FROM list; it adds the place of a span in the
result order, and only the spans travel to it, not the text::

    SELECT d.doc_id, s.* FROM (SELECT doc_id, pii_spans(text) AS a FROM docs) d, LATERAL spans_table(d.a) s
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from veilspark.catalog import DEFAULT_PROFILE, DEFAULT_STRATEGY, select
from veilspark.functions import resolve
from veilspark.functions.replacement import check_strategy, choose_sql, rewrite_sql, with_values_sql
from veilspark.functions.scan import scan_sql
from veilspark.functions.spans import (
    SPANS_TYPE, WHITESPACE, blocks_sql, let_sql, scannable_sql, valid_bsn_sql,
)


SPAN_ROW = "position int, entity_type string, text string, start int, end int, score double, recognizer string, pattern string"


class SpansTable:
    """Rows of a span array; a null array has none."""

    def eval(self, spans: list):
        for position, s in enumerate(spans or ()):
            yield (position, *s)


def register(spark: SparkSession, entities: Iterable[str] | str | None = None, profile: str = DEFAULT_PROFILE,
             strategy: str = DEFAULT_STRATEGY) -> None:
    """Create the functions for this session.

    The text is stripped first, as ``analyze`` does.  Null gives null.
    """
    check_strategy(strategy)
    # lambdas within lambdas are resolved from outside in, a level at a time
    levels = "spark.sql.analyzer.maxIterations"
    spark.conf.set(levels, max(400, int(spark.conf.get(levels, "100"))))
    rows = select(profile, entities).rows
    found = let_sql("clean", scannable_sql("body"), let_sql(
        "raw", scan_sql("clean", rows), let_sql("kept", resolve.dedup_same_type("raw"), resolve.stable_order("kept"))))
    new_text = let_sql("spans", found, let_sql("bl", blocks_sql("body"), let_sql(
        "res", resolve.resolve_conflicts("spans"), let_sql("val", with_values_sql("bl", "res"), rewrite_sql(
            "bl", "length(body)", "val", choose_sql("s.entity_type", "s.text", strategy))))))
    body = f"btrim(t, '{WHITESPACE}')"
    for name, returns, expression in (
            ("pii_spans", SPANS_TYPE, let_sql("body", body, found)),
            ("pii_anonymize", "STRING", let_sql("body", body, new_text))):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {returns} "
                  f"RETURN if(t IS NULL, NULL, {expression})")
    spark.udtf.register("spans_table", udtf(SpansTable, returnType=SPAN_ROW))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pii_valid_bsn(t STRING) RETURNS BOOLEAN "
              f"RETURN {valid_bsn_sql('t')}")
