"""Replacement expressions: what takes the place of a found value (SQL text)."""

from __future__ import annotations

from collections.abc import Mapping

from veilspark.catalog import DEFAULT_STRATEGY, STRATEGIES
from veilspark.functions.spans import cut_sql, quote

# Fixed values of the mask strategy.
CHARS_TO_MASK = 6
MASKING_CHAR = "*"


def mask_sql(value: str, chars_to_mask: int = CHARS_TO_MASK, masking_char: str = MASKING_CHAR,
             from_end: bool = False) -> str:
    """Mask the first (or last) characters of a value, keep the rest."""
    hidden = f"least({int(chars_to_mask)}, length({value}))"
    stars = f"repeat({quote(masking_char)}, {hidden})"
    if from_end:
        return f"concat(substring({value}, 1, length({value}) - {hidden}), {stars})"
    return f"concat({stars}, substring({value}, {hidden} + 1))"


def replacement_sql(entity_type: str, value: str, strategy: str, salt: str | None = None,
                    mask_options: Mapping | None = None) -> str:
    """The text that stands for ``value`` under one strategy."""
    if strategy == "redact":
        return "''"
    if strategy == "hash":
        return f"sha2({value}, 256)" if salt is None else f"sha2(concat({quote(salt)}, {value}), 256)"
    if strategy == "mask":
        return mask_sql(value, **(mask_options or {}))
    # replace, and the fallback of any name that got past the argument check
    return f"concat('<', {entity_type}, '>')"


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported strategy {strategy!r}; supported: {', '.join(STRATEGIES)}")
    return strategy


def choose_sql(
    entity_type: str,
    value: str,
    strategy: str = DEFAULT_STRATEGY,
    strategy_col: str | None = None,
    operators: Mapping[str, str] | None = None,
    salt: str | None = None,
    mask_options: Mapping | None = None,
) -> str:
    """One strategy for all, or per row (a column), or per entity type (``operators``)."""
    make = lambda s: replacement_sql(entity_type, value, s, salt, mask_options)
    cases = [f"WHEN {entity_type} = {quote(e)} THEN {make(check_strategy(s))}"
             for e, s in (operators or {}).items()]
    if strategy_col:
        cases += [f"WHEN {strategy_col} = {quote(s)} THEN {make(s)}" for s in STRATEGIES]
    rest = make(check_strategy(strategy))
    return f"CASE {' '.join(cases)} ELSE {rest} END" if cases else rest


def rewrite_sql(blocks: str, length: str, resolved: str, replace_with: str) -> str:
    """Text with every resolved span replaced.

    ``resolved`` holds disjoint spans in text order; ``replace_with`` gives the
    new text in terms of ``s`` and ``s.text``.  Each output piece is the gap
    before a span and its replacement; the pieces and the tail are joined once.
    """
    gap = cut_sql(blocks, "if(i = 0, 0, get({r}, i - 1).end)".format(r=resolved), "s.start")
    tail = cut_sql(blocks, f"element_at({resolved}, -1).end", length)
    pieces = f"transform({resolved}, (s, i) -> concat({gap}, {replace_with}))"
    return f"if(size({resolved}) = 0, array_join({blocks}, ''), concat(array_join({pieces}, ''), {tail}))"


def with_values_sql(blocks: str, spans: str) -> str:
    """Spans whose missing texts are cut out of the blocks."""
    value = f"coalesce(s.text, {cut_sql(blocks, 's.start', 's.end')})"
    return (f"transform({spans}, s -> named_struct('entity_type', s.entity_type, 'text', {value}, "
            "'start', s.start, 'end', s.end, 'score', s.score, 'recognizer', s.recognizer, "
            "'pattern', s.pattern))")
