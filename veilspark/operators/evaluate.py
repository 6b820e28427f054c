"""Score predicted spans against labelled spans.

Truth and predictions are span rows keyed by sample.  Repeats are summed, with
partial sums per task, and :mod:`veilspark.operators.sweep` matches what is left by one
exchange on (sample, window of positions).  Only span rows are shuffled: the few
characters of context an error table shows are cut out while the text is at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions.spans import blocks_sql, context_sql, cut_sql
from veilspark.operators.lineage import cut_lineage
from veilspark.operators.sweep import outcomes

OUTSIDE = "O"
CONTEXT_CHARS = 20


class ThresholdError(RuntimeError):
    """A quality gate was not passed."""


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _score_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), f1_score(p, r).alias("f1")]


def with_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to ``tp, fp, fn``."""
    return counts.select("*", *_score_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def truth_rows(samples: DataFrame, id_col: str = "sample_id", text_col: str = "text",
               spans_col: str = "spans") -> DataFrame:
    """``sample_id, entity_type, start, end, n, text, context`` from a label array; a row per label, ``n`` is 1."""
    return _span_rows(samples, id_col, text_col, spans_col, scored=False)


def prediction_rows(analyzed: DataFrame, id_col: str = "sample_id", text_col: str = "text",
                    spans_col: str = "spans") -> DataFrame:
    """The same from a span array, with ``score``."""
    return _span_rows(analyzed, id_col, text_col, spans_col, scored=True)


def _span_rows(rows: DataFrame, id_col: str, text_col: str, spans_col: str, scored: bool) -> DataFrame:
    rows = rows.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("_text"),
                       F.col(spans_col).alias("_spans"))
    rows = rows.withColumn("_blocks", F.expr(blocks_sql("_text"))).withColumn("_len", F.length("_text"))
    out = rows.select("sample_id", "_blocks", "_len", F.explode_outer("_spans").alias("_s"))
    out = out.filter(F.col("_s").isNotNull()).select(
        "sample_id", F.col("_s.entity_type").alias("entity_type"),
        F.col("_s.start").cast("int").alias("start"), F.col("_s.end").cast("int").alias("end"),
        *([F.col("_s.score").alias("score")] if scored else []),
        F.expr(cut_sql("_blocks", "_s.start", "_s.end")).alias("text"),
        F.expr(context_sql("_blocks", "_len", "_s.start", "_s.end", CONTEXT_CHARS)).alias("context"))
    return out.withColumn("n", F.lit(1).cast("long"))


def unique_spans(rows: DataFrame, scored: bool) -> DataFrame:
    """Equal spans as one row with a count ``n``; predictions of unequal score stay apart, so that a threshold can tell them."""
    identity = ["sample_id", "entity_type", "start", "end", *(["score"] if scored else [])]
    extras = [c for c in ("text", "context") if c in rows.columns]
    return rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in extras])


class Evaluation:
    """Outcome rows and the tables made from them.

    ``outcomes``: one row per distinct span with ``kind`` (``tp``, ``fn``,
    ``fp``), ``n``, and for a missed truth the prediction of another type that
    covers it (``wrong_*``).  Several tables share them, so persist or write
    them (:meth:`persisted`) before asking for more than one at scale.  Tables that only
    count are made from ``lean`` outcomes, without texts, if there is a way to make those.
    """

    def __init__(self, outcomes: DataFrame | Callable[[], DataFrame], entities: tuple[str, ...] | None = None,
                 lean: Callable[[], DataFrame] | None = None):
        self._made, self._lean, self.entities = outcomes, lean, entities

    @property
    def outcomes(self) -> DataFrame:
        if callable(self._made):
            self._made = self._made()
        return self._made

    @property
    def _counted(self) -> DataFrame:
        if self._lean is None:
            return self.outcomes
        if callable(self._lean):
            self._lean = self._lean()
        return self._lean

    def persisted(self) -> Evaluation:
        """Outcomes computed once and cut off from their lineage."""
        return Evaluation(cut_lineage(self.outcomes), self.entities)

    def _wanted(self, df: DataFrame) -> DataFrame:
        return df if self.entities is None else df.filter(F.col("entity_type").isin(*self.entities))

    @property
    def counts(self) -> DataFrame:
        """``entity_type, tp, fp, fn``."""
        total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
        return self._wanted(self._counted).groupBy("entity_type").agg(total("tp"), total("fp"), total("fn"))

    @property
    def metrics(self) -> DataFrame:
        """``entity_type, tp, fp, fn, precision, recall, f1``."""
        return with_scores(self.counts)

    @property
    def overall(self) -> DataFrame:
        """The same over all types (micro average), one row."""
        sums = self.counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
        return with_scores(sums)

    @property
    def metrics_rollup(self) -> DataFrame:
        """Per type and overall (``entity_type`` null) in one pass."""
        total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
        return with_scores(self._wanted(self._counted).rollup("entity_type").agg(
            total("tp"), total("fp"), total("fn")))

    @property
    def metrics_table(self) -> DataFrame:
        """Metrics with three decimals."""
        return self.metrics.select(
            "entity_type", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")], "tp", "fp", "fn")

    @property
    def confusion(self) -> DataFrame:
        """``row_label, col_label, n`` with at least one count.

        Diagonal: matches.  Row ``O``: missed truth under its type.  Column
        ``O``: spurious predictions beside theirs.  Elsewhere: truth beside the
        type found in its place.  Labels are the types with counts, and ``O``.
        """
        o = self._counted
        cell = lambda r, c: F.struct(r.alias("row_label"), c.alias("col_label"))
        t, outside = F.col("entity_type"), F.lit(OUTSIDE)
        cells = F.array_compact(F.array(
            F.when(F.col("kind") == "tp", cell(t, t)),
            F.when(F.col("kind") == "fn", cell(outside, t)),
            F.when(F.col("kind") == "fp", cell(t, outside)),
            F.when(F.col("wrong_type").isNotNull(), cell(t, F.col("wrong_type")))))
        long = o.select("n", F.explode(cells).alias("c")).groupBy("c.row_label", "c.col_label").agg(
            F.sum("n").alias("n"))
        # a few hundred label pairs at most; labels are the types with counts of their own
        row, col = F.col("row_label"), F.col("col_label")
        own = F.when(row == OUTSIDE, col).when((col == OUTSIDE) | (row == col), row)
        kinds = F.collect_set(own if self.entities is None else F.when(own.isin(*self.entities), own)).over(Window.partitionBy(F.lit(1)))
        listed = lambda c: (c == OUTSIDE) | F.array_contains("_kinds", c)
        return (long.withColumn("_kinds", kinds).filter(listed(row) & listed(col))
                .select("row_label", "col_label", "n"))

    @property
    def confusion_normalised(self) -> DataFrame:
        """Confusion with the share of each cell in its row."""
        row = Window.partitionBy("row_label")
        return self.confusion.withColumn("share", ratio(F.col("n"), F.sum("n").over(row)))

    def confusion_matrix(self, types: Iterable[str] | None = None) -> DataFrame:
        """Square form: one row per label, one column per label, zeros filled in.

        Without ``types`` the type names (a few dozen) are read first.
        """
        if types is None:
            types = [r[0] for r in self.counts.select("entity_type").orderBy("entity_type").collect()]
        labels = [*sorted(types), OUTSIDE]
        spark = self._counted.sparkSession
        frame = spark.createDataFrame([(x,) for x in labels], "row_label string")
        wide = self.confusion.groupBy("row_label").pivot("col_label", labels).agg(F.sum("n"))
        return frame.join(wide, "row_label", "left").na.fill(0)

    @property
    def errors(self) -> DataFrame:
        """``kind, entity_type, text, context, predicted, ground_truth, iou`` of every error.

        ``partial`` rows are misses with a prediction of another type in place;
        ``low_iou`` rows are misses whose best same-type overlap is too small.
        Equal spans appear once, with their count ``n``.
        """
        o = self._wanted(self.outcomes)
        null = F.lit(None).cast("string")
        rows = F.array_compact(F.array(
            F.when(F.col("kind") == "fp", F.struct(
                F.lit("false_positive").alias("kind"), F.col("text"), F.col("context"),
                null.alias("predicted"), null.alias("ground_truth"), F.lit(None).cast("double").alias("iou"))),
            F.when(F.col("kind") == "fn", F.struct(
                F.lit("false_negative").alias("kind"), F.col("text"), F.col("context"),
                null.alias("predicted"), null.alias("ground_truth"), F.lit(None).cast("double").alias("iou"))),
            F.when(F.col("wrong_type").isNotNull(), F.struct(
                F.lit("partial").alias("kind"), F.col("text"), F.col("context"),
                F.col("wrong_text").alias("predicted"), F.col("text").alias("ground_truth"),
                F.col("wrong_iou").alias("iou"))),
            F.when(F.col("low_iou").isNotNull(), F.struct(
                F.lit("low_iou").alias("kind"), F.col("text"), F.col("context"),
                F.col("low_text").alias("predicted"), F.col("text").alias("ground_truth"),
                F.col("low_iou").alias("iou")))))
        return o.select("sample_id", "entity_type", "start", "end", "n", F.explode(rows).alias("e")).select(
            "sample_id", "e.kind", "entity_type", "start", "end", "e.text", "e.context",
            "e.predicted", "e.ground_truth", "e.iou", "n")

    def error_samples(self, per_type: int = 3, partials: int = 5) -> DataFrame:
        """First errors per kind and type with totals; first partials overall.

        "First" is by sample and position.  The limits are those of a report;
        Spark keeps the first rows of each task before it shuffles them.
        """
        e = self.errors
        totals = e.groupBy("kind", "entity_type").agg(F.sum("n").alias("total"))
        order = ["sample_id", "start", "end"]
        rank = F.row_number().over(Window.partitionBy("kind", "entity_type").orderBy(*order))
        listed = e.filter(F.col("kind").isin("false_positive", "false_negative")).withColumn(
            "_r", rank).filter(F.col("_r") <= per_type).drop("_r")
        partial = e.filter(F.col("kind") == "partial").orderBy(*order, "entity_type").limit(partials)
        return listed.unionByName(partial).join(totals, ["kind", "entity_type"])

    @property
    def error_distribution(self) -> DataFrame:
        """False positives and false negatives per type."""
        return self.counts.select("entity_type", F.col("fp").alias("false_positives"),
                                  F.col("fn").alias("false_negatives"))

    @property
    def error_summary(self) -> DataFrame:
        """Number of errors per kind."""
        return self.errors.groupBy("kind").agg(F.sum("n").alias("n"))

    def gate(self, thresholds: DataFrame, skip_missing: bool = False) -> DataFrame:
        wanted = thresholds if self.entities is None else thresholds.filter(
            F.col("entity_type").isin(*self.entities))
        return gate(self.metrics, wanted, skip_missing)

    def report(self) -> DataFrame:
        """One row ``report``: the whole result as JSON (global, per entity, matrix)."""
        counts = ["tp", "fp", "fn"]
        block = lambda tp, fp, fn: F.struct(
            *_score_columns(tp, fp, fn), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
        per = self.counts.select(F.struct("entity_type", block(*map(F.col, counts)).alias("m")).alias("p"), *counts)
        cells = self.confusion.select(F.struct("row_label", "col_label", "n").alias("c"))
        # as many rows as there are entity types and label pairs
        both = per.unionByName(cells, allowMissingColumns=True)
        total = both.agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
            F.array_sort(F.collect_list("p")).alias("p"), F.array_sort(F.collect_list("c")).alias("c"))
        return total.select(F.to_json(F.struct(
            block(*map(F.col, counts)).alias("global"), F.map_from_entries("p").alias("per_entity"),
            F.col("c").alias("confusion_matrix"))).alias("report"))


def evaluate(
    predictions: DataFrame,
    truth: DataFrame,
    iou_threshold: float = 0.5,
    score_threshold: float = 0.3,
    entities: Iterable[str] | None = None,
) -> Evaluation:
    """Match predictions to truth (both as :func:`prediction_rows` / :func:`truth_rows`).

    A truth span is matched by the first prediction, in result order, of its
    type with IoU >= ``iou_threshold``; one prediction may match several.  A
    missed truth takes the prediction of another type with the best such IoU,
    the first of equals, and that prediction is no false positive.  ``entities``
    narrows the tables after matching.
    """
    if not 0 < iou_threshold <= 1:
        raise ValueError("iou_threshold must be in (0, 1]")
    found = predictions.filter(F.col("score") >= score_threshold)
    texts = ("text", "context")
    return Evaluation(lambda: outcomes(found, truth, iou_threshold), tuple(entities) if entities else None,
                      lambda: outcomes(found.drop(*texts), truth.drop(*texts), iou_threshold))


# ---------------------------------------------------------------------------
# Gates
# ---------------------------------------------------------------------------


def thresholds_table(spark: SparkSession, minimums: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``entity_type, min_precision, min_recall``; an absent value means 0."""
    rows = [(e, float(m.get("precision", 0.0)), float(m.get("recall", 0.0))) for e, m in minimums.items()]
    return spark.createDataFrame(rows, "entity_type string, min_precision double, min_recall double")


def recall_floor(spark: SparkSession, floors: Mapping[str, float]) -> DataFrame:
    return thresholds_table(spark, {e: {"recall": r} for e, r in floors.items()})


def gate(metrics: DataFrame, thresholds: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Metrics beside their minimums with ``passed``.

    A type without counts scores 0; with ``skip_missing`` it is left out.  Both
    sides hold one row per entity type.
    """
    how = "inner" if skip_missing else "full_outer"
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    counts = [c for c in ("tp", "fp", "fn") if c in metrics.columns]
    joined = metrics.select("entity_type", *counts, "precision", "recall", "f1").join(
        thresholds, "entity_type", how).select(
        "entity_type", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        *[zero(c) for c in ("precision", "recall", "f1", "min_precision", "min_recall")])
    return joined.withColumn("passed", (F.col("precision") >= F.col("min_precision"))
                             & (F.col("recall") >= F.col("min_recall")))


def verdict(gated: DataFrame) -> DataFrame:
    """One row ``passed``: whether every type passed."""
    return gated.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def require(gated: DataFrame) -> None:
    """Raise :class:`ThresholdError` if a type missed its minimum."""
    failed = gated.filter(~F.col("passed")).orderBy("entity_type").collect()  # at most one row per type
    if failed:
        raise ThresholdError("below threshold: " + ", ".join(
            f"{r.entity_type} (p={r.precision:.2f} r={r.recall:.2f})" for r in failed))


# ---------------------------------------------------------------------------
# Exact comparison with a golden set
# ---------------------------------------------------------------------------


@dataclass
class GoldenComparison:
    """Distinct expected and detected spans side by side (``expected``, ``detected`` flags)."""

    sides: DataFrame

    def persisted(self) -> GoldenComparison:
        """The sides computed once and cut off from their lineage."""
        return GoldenComparison(cut_lineage(self.sides))

    @property
    def report(self) -> DataFrame:
        """``entity_type, expected, detected, correct, precision, recall, f1``."""
        flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        e, d = F.col("_expected").isNotNull(), F.col("_detected").isNotNull()
        counts = self.sides.groupBy("entity_type").agg(
            flag(e).alias("expected"), flag(d).alias("detected"), flag(e & d).alias("correct"))
        return (
            counts.withColumn("precision", ratio(F.col("correct"), F.col("detected")))
            .withColumn("recall", ratio(F.col("correct"), F.col("expected")))
            .withColumn("f1", f1_score(F.col("precision"), F.col("recall"))))

    @property
    def missing(self) -> DataFrame:
        """``id:TYPE@start`` of every expected span that was not detected."""
        return self.sides.filter(F.col("_detected").isNull()).select(F.concat(
            F.col("id").cast("string"), F.lit(":"), "entity_type", F.lit("@"),
            F.col("start").cast("string")).alias("missing"))

    @property
    def extra(self) -> DataFrame:
        """Detected spans nobody expected."""
        return self.sides.filter(F.col("_expected").isNull()).select("id", "entity_type", "start", "end")

    def extra_shown(self, n: int = 10) -> DataFrame:
        return self.extra.orderBy("id", "start", "end", "entity_type").limit(n)

    def floors(self, minimums: Mapping[str, float]) -> DataFrame:
        """The exact recall of the expected types beside its floor, as :func:`gate` has it."""
        expected = self.report.filter("expected > 0").select(
            "entity_type", F.col("correct").alias("tp"), (F.col("detected") - F.col("correct")).alias("fp"),
            (F.col("expected") - F.col("correct")).alias("fn"), "precision", "recall", "f1")
        return gate(expected, recall_floor(self.sides.sparkSession, minimums), skip_missing=True)

    def to_json(self, total_examples: DataFrame) -> DataFrame:
        """The report as one JSON row of figures; the spans themselves are :attr:`missing` and :attr:`extra`."""
        # as many rows as there are entity types
        per = self.report.select(F.struct("entity_type", F.struct(
            "expected", "detected", "correct", "precision", "recall", "f1")).alias("p"),
            (F.col("expected") - F.col("correct")).alias("m"), (F.col("detected") - F.col("correct")).alias("x"))
        total = total_examples.agg(F.count(F.lit(1)).alias("t"))
        joined = per.unionByName(total, allowMissingColumns=True).agg(
            F.max("t").alias("total_examples"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing"),
            F.coalesce(F.sum("x"), F.lit(0)).alias("extra"),
            F.map_from_entries(F.array_sort(F.collect_list("p"))).alias("per_entity"))
        return joined.select(F.to_json(F.struct("*")).alias("report"))


def compare_exact(detected: DataFrame, expected: DataFrame) -> GoldenComparison:
    """Full outer equality join of distinct spans ``id, entity_type, start, end``."""
    key = ["id", "entity_type", "start", "end"]
    e = expected.select(*key).distinct().withColumn("_expected", F.lit(True))
    d = detected.select(*key).distinct().withColumn("_detected", F.lit(True))
    return GoldenComparison(e.join(d, key, "full_outer"))


def compare_profiles(reports: Mapping[str, DataFrame], value: str = "recall") -> DataFrame:
    """One column per profile with the chosen figure of each report."""
    tagged = None
    for profile, report in reports.items():
        part = report.select("entity_type", F.col(value).alias("value"), F.lit(profile).alias("profile"))
        tagged = part if tagged is None else tagged.unionByName(part)
    if tagged is None:
        raise ValueError("no reports to compare")
    return tagged.groupBy("entity_type").pivot("profile", list(reports)).agg(F.first("value"))
