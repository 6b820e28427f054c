"""Matching predicted with labelled spans in one sweep.

Both sides are one table, tagged and without repeats, and go through one exchange on (sample, window of positions).  A window
is at least eight times as wide as the longest prediction that can match, and also gets the spans that begin up to two such lengths
outside it.  So whatever decides about a span that begins in a window is there: the spans it
overlaps, and for a prediction also the other predictions of those.  Each task sorts its windows by start and passes over them
once, with the spans that are still open at hand; a sample of any length is spread over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WIDTH = 4096
OUT_ROWS = 20_000
TRUTH, PREDICTION = 0, 1

_COLUMNS = ("sample_id", "_window", "home", "side", "entity_type", "start", "end", "n", "score", "text", "context")
_OUT = ("sample_id", "entity_type", "start", "end", "n", "text", "context", "kind",
        "wrong_type", "wrong_text", "wrong_iou", "low_text", "low_iou")


def _iou(a: tuple, b: tuple) -> float:
    inter = min(a[6], b[6]) - max(a[5], b[5])
    return inter / ((a[6] - a[5]) + (b[6] - b[5]) - inter) if inter > 0 else 0.0


def matched(rows: list[tuple], threshold: float) -> Iterator[tuple]:
    """Outcomes of the spans at home in one window; ``rows`` are in start order."""
    open_: tuple[list[int], list[int]] = ([], [])
    # per truth: first prediction of its type, best of another type, best of its type that is not enough
    best: dict[int, list] = {i: [None, None, None] for i, r in enumerate(rows) if r[3] == TRUTH}
    rank = {i: (-r[8], r[5], -r[6], r[4]) for i, r in enumerate(rows) if r[3] == PREDICTION}

    def meet(truth: int, found: int) -> None:
        quality = _iou(rows[truth], rows[found])
        same, enough = rows[truth][4] == rows[found][4], quality >= threshold
        if same and enough:
            place, order = 0, rank[found]
        elif same or enough:
            place, order = 2 if same else 1, (-quality, rank[found])
        else:
            return
        known = best[truth][place]
        if known is None or order < known[0]:
            best[truth][place] = (order, found, quality)

    for i, row in enumerate(rows):
        side, start, end = row[3], row[5], row[6]
        others = open_[1 - side]
        others[:] = [j for j in others if rows[j][6] > start]
        for j in others:
            if rows[j][5] < end:
                meet(*((i, j) if side == TRUTH else (j, i)))
        open_[side].append(i)
    used = {(hit or wrong)[1] for hit, wrong, _ in best.values() if hit or wrong}
    for i, (sample, _, home, side, kind, start, end, n, _, text, context) in enumerate(rows):
        if not home:
            continue
        head = (sample, kind, start, end)
        if side == PREDICTION:
            if n > (i in used):
                yield (*head, n - (i in used), text, context, "fp", None, None, None, None, None)
            continue
        hit, wrong, low = best[i]
        if hit:
            yield (*head, n, text, context, "tp", None, None, None, None, None)
        elif wrong:
            yield (*head, n, text, context, "fn", rows[wrong[1]][4], rows[wrong[1]][9], wrong[2], None, None)
        elif low:
            yield (*head, n, text, context, "fn", None, None, None, rows[low[1]][9], low[2])
        else:
            yield (*head, n, text, context, "fn", None, None, None, None, None)


def _sweep(threshold: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []

        def made():
            columns = list(zip(*out)) if out else [[]] * len(_OUT)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        sample = window = None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[1] != window or row[0] != sample:
                    out += matched(group, threshold)
                    group, (sample, window) = [], row[:2]
                    if len(out) >= OUT_ROWS:
                        yield made()
                group.append(row)
        out += matched(group, threshold)
        yield made()

    return run


def windows(start: Column, end: Column, margin: Column, width: Column) -> Column:
    """The windows that need a span."""
    last = F.greatest(start, end) + margin
    return F.sequence(F.floor((start - margin) / width), F.floor(last / width))


def outcomes(predictions: DataFrame, truth: DataFrame, iou_threshold: float) -> DataFrame:
    """One row per distinct span with ``kind`` and, for a miss, what was found in its place.

    Both sides: ``sample_id, entity_type, start, end, n``, predictions with ``score``, and perhaps ``text`` and
    ``context``.  Repeats are summed first, with partial sums per task, so a sample that a third of all rows repeat is shuffled once.
    """
    key = ["sample_id", "entity_type", "start", "end"]
    texts = [c for c in ("text", "context") if c in truth.columns and c in predictions.columns]

    def side(rows: DataFrame, tag: int, score: Column) -> DataFrame:
        own = [F.col(c) if c in texts else F.lit(None).cast("string").alias(c) for c in ("text", "context")]
        return rows.select(F.lit(tag).alias("side"), *key, F.col("n").cast("long").alias("n"), score.alias("score"), *own)

    both = side(truth, TRUTH, F.lit(None).cast("double")).unionByName(side(predictions, PREDICTION, F.col("score").cast("double")))
    spans = both.groupBy("side", *key).agg(F.sum("n").alias("n"), F.max("score").alias("score"),
                                           F.first("text").alias("text"), F.first("context").alias("context"))
    # a prediction that matches is at most this long; the labels alone are read for it
    longest = truth.agg(F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(0)).alias("l")).scalar()
    spans = spans.withColumn("_margin", 2 * F.ceil(longest / F.lit(float(iou_threshold))) + 2)
    spans = spans.withColumn("_width", F.greatest(F.lit(WIDTH), 4 * F.col("_margin")))
    placed = spans.withColumn("_window", F.explode(windows(F.col("start"), F.col("end"), F.col("_margin"), F.col("_width"))))
    placed = placed.withColumn("home", F.floor(F.col("start") / F.col("_width")) == F.col("_window")).select(*_COLUMNS)
    ordered = placed.repartition("sample_id", "_window").sortWithinPartitions("sample_id", "_window", "start")
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema} | {
        "kind": "string", "wrong_type": "string", "wrong_text": "string", "wrong_iou": "double", "low_text": "string",
        "low_iou": "double"}
    shape = StructType.fromDDL(", ".join(f"`{c}` {kinds[c]}" for c in _OUT))
    return ordered.mapInArrow(_sweep(iou_threshold, to_arrow_schema(shape)), shape)
