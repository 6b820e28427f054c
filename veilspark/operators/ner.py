"""Names, places and organizations: model plugs, label maps, spans from elsewhere.

A model is the user's own; the harness runs it in Arrow batches, once loaded
per Python worker, and only the text column travels to it.  The dictionary
detector (:mod:`veilspark.operators.names`) needs no model.  It is a different
method from one, so its recall is not comparable.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import NER_LABELS, NER_SCORE, ZERO_SHOT_LABELS, ZERO_SHOT_THRESHOLD
from veilspark.functions.spans import (
    NO_SPANS, SPANS_TYPE, blocks_sql, cut_sql, let_sql, quote, quote_list, regex_hits_sql, scannable_sql,
)
from veilspark.operators.names import Names, dictionary_spans, load_names  # noqa: F401 - also found here

# ---------------------------------------------------------------------------
# Labels
# ---------------------------------------------------------------------------


def map_label(label: Column | str, mapping: Mapping[str, str] = NER_LABELS) -> Column:
    """Entity type of a model label; an unknown label stays as it is."""
    label = F.col(label) if isinstance(label, str) else label
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), label)


# ---------------------------------------------------------------------------
# Model plugs
# ---------------------------------------------------------------------------

ModelFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class Detector:
    name: str
    fn: ModelFn
    entity_types: tuple[str, ...]
    labels: Mapping[str, str]
    threshold: float


_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, fn: ModelFn, entity_types: Iterable[str],
                      labels: Mapping[str, str] | None = None, threshold: float | None = None) -> None:
    """Make a model available to ``analyze(detectors=[name])``.

    ``fn`` gets an iterator of frames ``doc_id, text`` and yields, for each of
    them in turn, one frame ``doc_id, entity_type, start, end[, score]``.  Load
    the model before the loop: that happens once per Python worker and stream.
    ``entity_type`` may be a model label; ``labels`` maps it.  The names
    ``spacy`` and ``gliner`` come with the label tables of those models.
    """
    default_labels = {"gliner": ZERO_SHOT_LABELS}.get(name, NER_LABELS)
    default_threshold = ZERO_SHOT_THRESHOLD if name == "gliner" else 0.0
    if name in ("gazetteer", "external"):
        raise ValueError(f"{name!r} is a built-in source of spans")
    _DETECTORS[name] = Detector(
        name, fn, tuple(entity_types), dict(default_labels if labels is None else labels),
        default_threshold if threshold is None else threshold)


def detector_entities(name: str) -> tuple[str, ...]:
    if name not in _DETECTORS:
        raise ValueError(f"unknown detector {name!r}; registered: {', '.join(_DETECTORS) or 'none'}")
    return _DETECTORS[name].entity_types


def detectors_column(names: Sequence[str], text: Column) -> Column:
    """Spans of registered models as a struct of arrays ``d0, d1, ..`` (null text: no spans).

    One stage for all of them: a text travels to Python once, whatever the number of models.  The models
    take the same frames in turn; one that reads ahead makes the others' frames wait for them.
    """
    models = [_DETECTORS[n] for n in names]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        queues, sizes, source = [deque() for _ in models], deque(), iter(batches)

        def pull() -> bool:
            texts = next(source, None)
            if texts is None:
                return False
            present = texts[texts.notna()]
            sizes.append(len(texts))
            for queue in queues:
                queue.append(pd.DataFrame({"doc_id": present.index, "text": present.to_numpy()}))
            return True

        def frames(queue: deque) -> Iterator[pd.DataFrame]:
            while queue or pull():
                yield queue.popleft()

        for found in zip(*(m.fn(frames(q)) for m, q in zip(models, queues))):
            size = sizes.popleft()
            yield pd.DataFrame({f"d{i}": _as_spans(m, rows, size) for i, (m, rows) in enumerate(zip(models, found))})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, ", ".join(f"d{i} {SPANS_TYPE}" for i in range(len(models))))(text)


def _as_spans(model: Detector, found: pd.DataFrame, size: int) -> list[list[dict]]:
    lists: list[list] = [[] for _ in range(size)]
    for row in found.itertuples(index=False):
        kind = model.labels.get(row.entity_type, row.entity_type)
        score = float(getattr(row, "score", NER_SCORE))
        if score >= model.threshold and kind in model.entity_types:
            lists[row.doc_id].append({
                "entity_type": kind, "text": None, "start": int(row.start), "end": int(row.end),
                "score": score, "recognizer": model.name, "pattern": row.entity_type})
    return lists


def verify(spans: DataFrame, predicate: Column) -> DataFrame:
    """Keep candidates a second check agrees with; it never adds any.

    ``predicate`` is a boolean column over the span rows: built-in expressions,
    or a pandas UDF that wraps a model.
    """
    return spans.filter(F.coalesce(predicate, F.lit(False)))


def verify_with(analyzed: DataFrame, fn: ModelFn, entity_types: Iterable[str], text_col: str = "text",
                spans_col: str = "pii_entities", window: int = 40) -> DataFrame:
    """Keep those spans of some types that a model agrees with; spans of other types stay.

    ``fn`` gets an iterator of frames ``entity_type, text, before, after`` and yields a boolean series for each.  Only
    candidates travel to it, each with ``window`` characters on both sides, never whole texts, and no frame is empty.  Verdicts
    are matched by position in the row, so there is no shuffle, and a stream will do.  No verdict (null) drops the span.
    """
    around = lambda a, b: cut_sql("_veil_vb", a, b)
    candidate = (f"named_struct('entity_type', s.entity_type, 'text', {around('s.start', 's.end')}, "
                 f"'before', {around(f'greatest(0, s.start - {int(window)})', 's.start')}, "
                 f"'after', {around('s.end', f'least(_veil_vl, s.end + {int(window)})')})")
    wanted = f"s.entity_type IN ({quote_list(entity_types)})"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        asked = deque()

        def frames() -> Iterator[pd.DataFrame]:
            for rows in batches:
                rows = [list(r) if r is not None else [] for r in rows]
                asked.append(rows)
                flat = [c for r in rows for c in r if c is not None]
                if flat:
                    yield pd.DataFrame(flat, columns=["entity_type", "text", "before", "after"])

        def answered(verdicts: Iterator) -> pd.Series:
            return pd.Series([[c is None or next(verdicts) is True for c in r] for r in asked.popleft()], dtype=object)

        for verdicts in fn(frames()):
            while not any(c is not None for r in asked[0] for c in r):
                yield answered(iter(()))
            yield answered(iter([v is not None and v == True for v in verdicts]))  # noqa: E712 - numpy booleans too
        while asked:
            yield answered(iter(()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rows = analyzed.withColumn("_veil_vb", F.expr(blocks_sql(text_col))).withColumn("_veil_vl", F.length(text_col))
    rows = rows.withColumn("_veil_vc", F.expr(f"transform({spans_col}, s -> if({wanted}, {candidate}, NULL))"))
    rows = rows.withColumn("_veil_vv", F.pandas_udf(run, "array<boolean>")("_veil_vc"))
    kept = F.expr(f"filter({spans_col}, (s, i) -> _veil_vv[i])")
    return rows.withColumn(spans_col, kept).select(*analyzed.columns)


# ---------------------------------------------------------------------------
# Names and external spans
# ---------------------------------------------------------------------------

WORD = r"(?U)\w+"

# Words looked at one by one to find a place among all of a text.
WORD_BLOCK = 64


def tokens_sql(text: str) -> str:
    """Words with offsets."""
    return regex_hits_sql(scannable_sql(text), WORD)


def _collect(spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Span rows as one array per document; repeats are removed before the shuffle."""
    have = set(spans.columns)
    col = lambda c, default: F.col(c) if c in have else default
    row = F.struct(
        F.col("entity_type").cast("string").alias("entity_type"), F.lit(None).cast("string").alias("text"),
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        col("score", F.lit(NER_SCORE)).cast("double").alias("score"),
        col("recognizer", F.lit("external")).cast("string").alias("recognizer"),
        col("pattern", F.lit("external")).cast("string").alias("pattern"))
    return (spans.select(*keys, row.alias("_row")).distinct()
            .groupBy(*keys).agg(F.collect_list("_row").alias(name)))


def join_dictionary(rows: DataFrame, names: Names, id_col: str, text_col: str, wanted: Column) -> DataFrame:
    """Add ``_veil_dictionary``: in the row if the names are a trie, else by a join on id and text, so a repeated id does no harm."""
    if names.trie is not None:
        return rows.withColumn("_veil_dictionary", names.column(F.when(wanted, F.col(text_col))))
    rows = rows.withColumn("_veil_h", F.xxhash64(text_col))
    keys = [id_col, "_veil_h"]
    docs = rows.filter(wanted).select(*keys, text_col)
    spans = _collect(names.spans(docs, keys, text_col), keys, "_veil_dictionary")
    joined = rows.join(spans, keys, "left")
    return joined.withColumn("_veil_dictionary", F.coalesce(
        F.when(wanted, F.col("_veil_dictionary")), F.expr(NO_SPANS)))


def join_external(rows: DataFrame, external: DataFrame, id_col: str) -> DataFrame:
    """Add ``_external``: spans computed elsewhere, unioned in by document."""
    joined = rows.join(_collect(external, [id_col], "_veil_external"), id_col, "left")
    return joined.withColumn("_veil_external", F.coalesce(F.col("_veil_external"), F.expr(NO_SPANS)))


# ---------------------------------------------------------------------------
# Context words
# ---------------------------------------------------------------------------


def boost_sql(spans: str, text: str, words: Mapping[str, Iterable[str]], window: int,
              factor: float, minimum: float) -> str:
    """Raise the score of a span with a context word within ``window`` words of it.

    Words are compared in lower case, without lemmas.  A raised score is at
    least ``minimum`` and at most 1.
    """
    window = int(window)

    def near(wanted: str) -> str:
        # words of the text before and after the span, by their places in ``lows``
        return (f"exists(slice(lows, greatest(b - {window}, 0) + 1, least(b, {window})), w -> w IN ({wanted})) "
                f"OR exists(slice(lows, a + 1, {window}), w -> w IN ({wanted}))")

    kinds = {kind: [w.lower() for w in ws] for kind, ws in words.items() if list(ws)}
    cases = " ".join(f"WHEN s.entity_type = {quote(kind)} THEN {near(quote_list(ws))}" for kind, ws in kinds.items())
    if not cases:
        return spans
    score = (f"if(CASE {cases} ELSE false END, "
             f"least(1.0D, greatest(s.score + {factor!r}D, {minimum!r}D)), s.score)")
    raised = ("named_struct('entity_type', s.entity_type, 'text', s.text, 'start', s.start, 'end', s.end, "
              f"'score', {score}, 'recognizer', s.recognizer, 'pattern', s.pattern)")
    # how many words end before a span, how many start before its end: by blocks of words, then within one
    before = _count_sql("tails", "w.end <= s.start", "x <= s.start")
    until = _count_sql("heads", "w.start < s.end", "x < s.end")
    each = f"transform({spans}, s -> {let_sql('b', before, let_sql('a', until, raised))})"
    block = f"sequence(0, (size(toks) - 1) DIV {WORD_BLOCK})"
    places = let_sql("heads", f"transform({block}, k -> toks[int(k * {WORD_BLOCK})].start)", let_sql(
        "tails", f"transform({block}, k -> toks[int(k * {WORD_BLOCK})].end)", let_sql(
            "lows", "transform(toks, w -> lower(w.text))", each)))
    boosted = let_sql("toks", tokens_sql(text), f"if(size(toks) = 0, {spans}, {places})")
    asked = f"exists({spans}, s -> s.entity_type IN ({quote_list(kinds)}))"
    return f"if({asked}, {boosted}, {spans})"


def _count_sql(firsts: str, word: str, first: str) -> str:
    """How many of the words, in their order, satisfy a condition that no later one does after one that doesn't."""
    blocks = f"greatest(size(filter({firsts}, x -> {first})) - 1, 0)"
    return let_sql("k", blocks, f"k * {WORD_BLOCK} + size(filter(slice(toks, int(k * {WORD_BLOCK} + 1), {WORD_BLOCK}), w -> {word}))")
