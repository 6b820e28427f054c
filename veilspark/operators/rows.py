"""Row forms of the span-set operators, for span tables keyed by document.

Overlap joins never pair up a whole document: every span is put into the
position buckets it touches, and (document, bucket) is the equality key.  A
document with a third of all spans therefore spreads over many tasks, and
only near spans meet.  Exact repeats are removed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.catalog import NER_ENTITIES
from veilspark.functions import resolve
from veilspark.operators.lineage import cut_lineage

# Characters per position bucket.  Identifiers are tens of characters long, so
# nearly every span falls into one bucket.
BUCKET = 512

# Characters per window chunk; a bound on the rows a running maximum sorts.
CHUNK = 65536

SPAN_COLUMNS = ("entity_type", "text", "start", "end", "score", "recognizer", "pattern")


def union_spans(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All recognizers' spans together; columns a table lacks become null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def buckets(start: Column, end: Column) -> Column:
    """Every bucket a span touches."""
    last = F.greatest(end - 1, start)
    return F.sequence(F.floor(start / BUCKET), F.floor(last / BUCKET))


def with_buckets(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per bucket a span touches, as ``_bucket``."""
    return spans.withColumn("_bucket", F.explode(buckets(F.col(start), F.col(end))))


def _overlaps_any(spans: DataFrame, others: DataFrame, keys: list[str]) -> Column:
    same = [spans[k] == others[f"_o_{k}"] for k in keys] + [spans["_bucket"] == others["_o_bucket"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return cond & (spans["start"] < others["_o_end"]) & (spans["end"] > others["_o_start"])


def drop_ner_overlaps(
    spans: DataFrame,
    pattern_types: Iterable[str],
    keys: Iterable[str] = ("doc_id",),
    ner_types: Iterable[str] = NER_ENTITIES,
    zero_shot: str = "gliner",
) -> DataFrame:
    """Drop name spans that overlap a pattern-type span of the same document.

    A left-anti join; spans that cannot be dropped do not take part in it.
    """
    keys, pattern_types = list(keys), list(pattern_types)
    is_pattern = F.col("entity_type").isin(pattern_types)
    yields = F.col("entity_type").isin(list(ner_types)) | (
        (F.coalesce("recognizer", F.lit("")) == zero_shot) & is_pattern)
    safe = spans.filter(~yields)
    at_risk = with_buckets(spans.filter(yields))
    blockers = with_buckets(spans.filter(is_pattern).select(*keys, "start", "end").distinct()).select(
        *[F.col(k).alias(f"_o_{k}") for k in keys], F.col("start").alias("_o_start"),
        F.col("end").alias("_o_end"), F.col("_bucket").alias("_o_bucket"))
    hit = at_risk.join(blockers, _overlaps_any(at_risk, blockers, keys), "left_semi")
    identity = [*keys, "entity_type", "start", "end"]
    dropped = hit.select(*identity).distinct()
    kept = spans.filter(yields).join(dropped, identity, "left_anti")
    return safe.unionByName(kept.select(*safe.columns))


def dedup_same_type(spans: DataFrame, keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Drop a span contained in a same-type span that scores at least as high.

    Equal spans are first reduced to the best one (an aggregation with partial
    results per task), so what is left can be told apart by its extent.
    """
    keys = list(keys)
    identity = [*keys, "entity_type", "start", "end"]
    rest = [c for c in spans.columns if c not in identity]
    order = [c for c in ("recognizer", "pattern") if c in rest]
    best = spans.groupBy(*identity).agg(F.min_by(
        F.struct(*rest), F.struct((-F.col("score")).alias("_s"), *order)).alias("_r"))
    best = best.select(*identity, "_r.*")
    inner = with_buckets(best.select(*identity, "score"))
    outer = with_buckets(best.select(*identity, "score")).select(
        *[F.col(k).alias(f"_o_{k}") for k in keys], F.col("entity_type").alias("_o_type"),
        F.col("start").alias("_o_start"), F.col("end").alias("_o_end"), F.col("score").alias("_o_score"),
        F.col("_bucket").alias("_o_bucket"))
    covers = (
        _overlaps_any(inner, outer, keys) & (F.col("entity_type") == F.col("_o_type"))
        & (F.col("_o_start") <= F.col("start")) & (F.col("_o_end") >= F.col("end"))
        & (F.col("_o_score") >= F.col("score"))
        & ((F.col("_o_start") != F.col("start")) | (F.col("_o_end") != F.col("end"))))
    dropped = inner.join(outer, covers, "left_semi").select(*identity).distinct()
    return best.join(dropped, identity, "left_anti").select(*spans.columns)


def _running_max(rows: DataFrame, part: list[str], value: str, out: str, inclusive: bool) -> DataFrame:
    """Running maximum of ``value`` in start order, without a window over a whole document.

    Starts are unique within ``part``.  The window runs within chunks of
    positions, and a second one over a single row per chunk carries the maximum
    on, so no task ever sorts more than CHUNK rows of one document at a time.
    The rows are read twice, hence the cut.
    """
    rows = cut_lineage(rows.withColumn("_chunk", F.floor(F.col("start") / CHUNK)))
    per_chunk = rows.groupBy(*part, "_chunk").agg(F.max(value).alias("_m"))
    earlier = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.withColumn("_carry", F.max("_m").over(earlier)).drop("_m")
    within = Window.partitionBy(*part, "_chunk").orderBy("start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return (rows.join(carried, [*part, "_chunk"])
            .withColumn(out, F.greatest(F.max(value).over(within), "_carry"))
            .drop("_chunk", "_carry"))


def _next_start(rows: DataFrame, part: list[str], out: str) -> DataFrame:
    """Start of the following row, chunk-wise as in :func:`_running_max`."""
    rows = cut_lineage(rows.withColumn("_chunk", F.floor(F.col("start") / CHUNK)))
    first = rows.groupBy(*part, "_chunk").agg(F.min("start").alias("_first"))
    carried = first.withColumn("_carry", F.lead("_first").over(
        Window.partitionBy(*part).orderBy("_chunk"))).drop("_first")
    within = Window.partitionBy(*part, "_chunk").orderBy("start")
    return (rows.join(carried, [*part, "_chunk"])
            .withColumn(out, F.coalesce(F.lead("start").over(within), "_carry"))
            .drop("_chunk", "_carry"))


# Chunks that may hang together in one group; wider ones are scanned chunk by chunk.
GROUP_CHUNKS = 4


def _grouped(spans: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``_group``, rows of groups that are too wide or None) of distinct spans, after one cut.

    A position that no span crosses separates what is before it from what is after it, for every operator here.  Texts
    are cut at every CHUNK characters; chunks with a span across the cut between them belong to one group.  Such spans
    are few, and without any of them the groups are the chunks.
    """
    unique = cut_lineage(spans.groupBy(*keys, "entity_type", "start").agg(
        F.max("end").alias("end"), F.max("score").alias("score")).withColumn("_chunk", F.floor(F.col("start") / CHUNK)))
    last = F.floor((F.greatest("end", F.col("start") + 1) - 1) / CHUNK)
    crossed = unique.filter(last > F.col("_chunk")).select(
        *keys, F.explode(F.sequence(F.col("_chunk") + 1, last)).alias("_chunk")).distinct()
    # chunks in a row with crossed beginnings hang together: the first of them, and the one before it
    order = Window.partitionBy(*keys).orderBy("_chunk")
    runs = crossed.withColumn("_run", F.col("_chunk") - F.row_number().over(order))
    runs = runs.withColumn("_group", F.min("_chunk").over(Window.partitionBy(*keys, "_run")) - 1).withColumn(
        "_width", F.max("_chunk").over(Window.partitionBy(*keys, "_run")) - F.col("_group") + 1)
    tied = cut_lineage(runs.select(*keys, "_chunk", "_group", "_width"))
    if tied.isEmpty():
        return unique.withColumn("_group", F.col("_chunk")), None
    heads = tied.select(*keys, F.col("_group").alias("_chunk"), "_group", "_width").distinct()
    rows = unique.join(tied.unionByName(heads), [*keys, "_chunk"], "left")
    narrow = F.coalesce("_width", F.lit(1)) <= GROUP_CHUNKS
    wide = rows.filter(~narrow).select(*unique.columns)
    return (rows.filter(narrow).withColumn("_group", F.coalesce("_group", "_chunk")),
            None if wide.isEmpty() else wide.drop("_chunk"))


def _by_group(rows: DataFrame, keys: list[str], sql: str) -> DataFrame:
    """An array operator of :mod:`veilspark.functions.resolve` on the ``_spans`` of each group."""
    none = F.lit(None).cast("string")
    gathered = rows.groupBy(*keys, "_group").agg(F.collect_list(F.struct(
        "entity_type", none.alias("text"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.col("score").cast("double").alias("score"), none.alias("recognizer"), none.alias("pattern"))).alias("_spans"))
    done = gathered.select(*keys, F.explode(F.expr(sql)).alias("_s"))
    return done.select(*keys, "_s.entity_type", "_s.start", "_s.end", "_s.score")


def merge_same_type(spans: DataFrame, keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Overlapping spans of one type become one: gaps and islands.

    Columns: keys, ``entity_type, start, end, score``.
    """
    keys = list(keys)
    rows, wide = _grouped(spans, keys)
    merged = _by_group(rows, keys, resolve.merge_same_type("_spans"))
    return merged if wide is None else merged.unionByName(_merge_by_scan(wide, keys))


def resolve_conflicts(spans: DataFrame, keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Disjoint spans per document: merge per type, drop inner ones, cut partial overlaps."""
    keys = list(keys)
    rows, wide = _grouped(spans, keys)
    resolved = _by_group(rows, keys, resolve.resolve_conflicts("_spans"))
    return resolved if wide is None else resolved.unionByName(_resolve_by_scan(wide, keys))


def _merge_by_scan(unique: DataFrame, keys: list[str]) -> DataFrame:
    """Islands by running maxima, for groups of any width."""
    part = [*keys, "entity_type"]
    reached = _running_max(unique, part, "end", "_reach", inclusive=False)
    opened = reached.withColumn("_open", F.when(
        F.col("start") >= F.coalesce("_reach", F.lit(-1)), F.col("start")))
    islands = _running_max(opened, part, "_open", "_island", inclusive=True)
    return islands.groupBy(*part, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")
    ).select(*part, "start", "end", "score")


def _resolve_by_scan(unique: DataFrame, keys: list[str]) -> DataFrame:
    merged = _merge_by_scan(unique, keys)
    # of spans with one start the longest stays, then the best score, then the type name
    longest = merged.groupBy(*keys, "start").agg(F.min(F.struct(
        (-F.col("end")).alias("e"), (-F.col("score")).alias("s"), "entity_type")).alias("_b")).select(
        *keys, F.col("_b.entity_type").alias("entity_type"), "start", (-F.col("_b.e")).alias("end"),
        (-F.col("_b.s")).alias("score"))
    reached = _running_max(longest, keys, "end", "_reach", inclusive=False)
    outer = reached.filter(F.col("end") > F.coalesce("_reach", F.lit(-1))).drop("_reach")
    following = _next_start(outer, keys, "_next")
    return following.withColumn("end", F.least("end", F.coalesce("_next", "end"))).select(
        *keys, "entity_type", "start", "end", "score")
