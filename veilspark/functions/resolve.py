"""Span-set algebra on the span array of one row.

Every operator sorts the spans and looks at running maxima, so the work grows
with the number of spans (not its square), and each is a pure expression: no
shuffle, legal on a stream.  All take and return SQL text; the row forms of the
same operators are in :mod:`veilspark.operators.rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from veilspark.functions.spans import (
    cut_sql, let_sql, prefix_max_sql, quote, quote_list, respan_sql, span_sql,
)


# Overlapping spans of one type that are compared pair by pair.
FEW = 32


def sort_sql(spans: str, *keys: str) -> str:
    """Spans ordered by SQL keys over ``s``."""
    named = ", ".join(f"'k{i}', {k}" for i, k in enumerate(keys))
    return f"transform(sort_array(transform({spans}, s -> named_struct({named}, 'span', s))), k -> k.span)"


def stable_order(spans: str) -> str:
    """Total order of results: score desc, start, end desc, type (then pattern)."""
    return sort_sql(spans, "-s.score", "s.start", "-s.end", "s.entity_type", "s.recognizer", "s.pattern")


def _if_many(spans: str, folded: str) -> str:
    return f"if(size({spans}) < 2, {spans}, {folded})"


def _islands(ordered: str, per_island: str, gap: str = "s.start >= r.end") -> str:
    """Cut spans in (type, start) order into runs of one type that hang together.

    ``per_island`` is an expression over ``island``; ``gap`` says when a span
    ``s`` stands apart from the furthest end before it, ``r.end``.
    """
    reach = prefix_max_sql(
        "transform(a, s -> named_struct('entity_type', s.entity_type, 'end', s.end))")
    opens = (
        "filter(transform(a, (s, i) -> " + let_sql(
            "r", "reach[i]", f"if(r IS NULL OR r.entity_type != s.entity_type OR {gap}, i, -1)")
        + "), i -> i >= 0)")
    island = "slice(a, first + 1, coalesce(get(opens, k + 1), size(a)) - first)"
    each = f"transform(opens, (first, k) -> {let_sql('island', island, per_island)})"
    return let_sql("a", ordered, let_sql("reach", reach, let_sql("opens", opens, each)))


def dedup_same_type(spans: str) -> str:
    """Drop a span contained in a same-type span that scores at least as high.

    In (type, start, end desc, score desc) order whatever contains a span comes
    before it, and overlaps it.  A span of a short run is compared with those before it; in a
    long one a running maximum per distinct score tells whether one of them covers it.
    """
    ordered = sort_sql(
        spans, "s.entity_type", "s.start", "-s.end", "-s.score", "s.recognizer", "s.pattern")
    few = ("filter(island, (s, j) -> NOT exists(slice(island, 1, j), "
           "o -> o.end >= s.end AND o.score >= s.score))")
    # the staircase of a longer run: per score, how far the spans before each that score as high reach
    reach = prefix_max_sql("transform(island, o -> if(o.score >= level, o.end, -1))")
    many = let_sql("levels", "array_distinct(transform(island, s -> s.score))", let_sql(
        "stairs", f"transform(levels, level -> {reach})",
        "filter(island, (s, j) -> coalesce(get(stairs[int(array_position(levels, s.score) - 1)], j), -1) < s.end)"))
    kept = f"if(size(island) <= {FEW}, {few}, {many})"
    return _if_many(spans, f"flatten({_islands(ordered, f'if(size(island) = 1, island, {kept})')})")


def drop_ner_overlaps(
    spans: str,
    pattern_types: Iterable[str],
    ner_types: Iterable[str],
    zero_shot: str = "gliner",
) -> str:
    """Pattern results win over name results that overlap them.

    A span is dropped if it overlaps a span of a pattern type and its own type
    is a name type, or it comes from the zero-shot detector and its type is also
    a pattern type.
    """
    pattern_types, ner_types = list(pattern_types), list(ner_types)
    if not pattern_types:
        return spans

    def blocks(s: str) -> str:
        return f"{s}.entity_type IN ({quote_list(pattern_types)})"

    def yields(s: str) -> str:
        zero = f"coalesce({s}.recognizer, '') = {quote(zero_shot)} AND {blocks(s)}"
        return f"({s}.entity_type IN ({quote_list(ner_types)}) OR ({zero}))" if ner_types else f"({zero})"

    ordered = sort_sql(spans, "s.start", f"NOT {blocks('s')}", "s.end")
    # how far blockers that started at or before a span reach
    reach = prefix_max_sql(f"transform(a, s -> if({blocks('s')}, s.end, -1))")
    # where the next blocker starts, as the greatest negative start from the end
    following = "reverse(" + prefix_max_sql(
        f"transform(reverse(a), s -> if({blocks('s')}, -s.start, -2147483647))") + ")"
    hit = (f"({blocks('s')} OR coalesce(reach[i], -1) > s.start "
           "OR -coalesce(following[i], -2147483647) < s.end)")
    keep = f"filter(a, (s, i) -> NOT ({yields('s')} AND {hit}))"
    kept = let_sql("a", ordered, let_sql("reach", reach, let_sql("following", following, keep)))
    both = f"exists({spans}, y -> {yields('y')}) AND exists({spans}, b -> {blocks('b')})"
    return f"if({both}, {kept}, {spans})"


def merge_same_type(spans: str, bridge: Callable[[str, str], str] | None = None) -> str:
    """Overlapping spans of one type become one (min start, max end, max score).

    ``bridge(left_end, right_start)`` may say that a gap also counts as overlap.
    The text of a real union is left null and cut later.
    """
    ordered = sort_sql(spans, "s.entity_type", "s.start", "-s.end", "-s.score", "s.recognizer", "s.pattern")
    gap = "s.start >= r.end"
    if bridge is not None:
        gap += f" AND NOT ({bridge('r.end', 's.start')})"
    best = "element_at(sort_array(transform(island, s -> named_struct('k', -s.score, 's', s))), 1).s"
    union = let_sql("b", best, span_sql(
        "b.entity_type", "if(forall(island, s -> s.start = b.start AND s.end = b.end), b.text, CAST(NULL AS string))",
        "island[0].start", "array_max(transform(island, s -> s.end))", "b.score", "b.recognizer", "b.pattern"))
    return _if_many(spans, _islands(ordered, f"if(size(island) = 1, island[0], {union})", gap))


def drop_inside(spans: str) -> str:
    """Drop a span inside another; of equal spans the better score stays (then type name).

    The result is in start order, and its ends ascend too.
    """
    ordered = sort_sql(spans, "s.start", "-s.end", "-s.score", "s.entity_type")
    reach = prefix_max_sql("transform(a, s -> s.end)")
    keep = "filter(a, (s, i) -> coalesce(s.end > reach[i], true))"
    return _if_many(spans, let_sql("a", ordered, let_sql("reach", reach, keep)))


def cut_partial(spans: str) -> str:
    """Cut a span where the next one starts (input as :func:`drop_inside` leaves it)."""
    end = "least(s.end, coalesce(get(every, i + 1).start, s.end))"
    trimmed = respan_sql("s", f"if({end} = s.end, s.text, CAST(NULL AS string))", "s.start", end)
    return let_sql("every", spans, f"transform(every, (s, i) -> {trimmed})")


def resolve_conflicts(spans: str, blocks: str | None = None, merge_adjacent: bool = False) -> str:
    """Disjoint spans in text order, ready for replacement.

    With ``merge_adjacent`` same-type spans separated only by spaces become one;
    that needs the text, given as ``blocks`` (``blocks_sql``).
    """
    bridge = None
    if merge_adjacent:
        if blocks is None:
            raise ValueError("merge_adjacent needs the text")
        bridge = lambda end, start: f"trim({cut_sql(blocks, end, start)}) = ''"
    merged = let_sql("m", merge_same_type(spans, bridge), drop_inside("m"))
    return f"if(size({spans}) = 0, {spans}, {cut_partial(merged)})"


def trim_spans(spans: str) -> str:
    """Spans without trailing spaces and dashes."""
    one = let_sql("t", "rtrim(' -', s.text)", respan_sql("s", "t", "s.start", "s.start + length(t)"))
    return f"transform({spans}, s -> {one})"


def keep_score(spans: str, minimum: float) -> str:
    return f"filter({spans}, s -> s.score >= {float(minimum)!r}D)"


def keep_types(spans: str, entities: Iterable[str]) -> str:
    return f"filter({spans}, s -> s.entity_type IN ({quote_list(entities)}))"
