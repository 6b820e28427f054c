"""The pattern scan: catalogue rows -> one ``array<span>`` expression.

Patterns are grouped by how their matches begin.  One alternation per group is
tried first; a text in which it finds nothing has no match of any member, so
the members are not run.  On ordinary prose this replaces 32 passes over a text
by four.  Only built-in rows are grouped; a user's row is tried on its own.

A text of up to BLOCK characters is passed over once for all grouped rows: where any of them begins, every row's
match there is noted, and of one row's matches those that begin within an earlier one go, as a search from left to
right never sees them.  Longer texts, and those that hold one of the characters the notes are made of, are passed over
row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from veilspark.catalog import _HEX, Recognizer
from veilspark.functions.spans import (
    BLOCK, NO_SPANS, SPAN_TYPE, VALIDATORS, java_regex, let_sql, quote, regex_hits_sql, span_sql,
)

# Where a match of a grouped row may begin: all but a phone number's plus sign stand at the edge of a word.
_BEGIN = r"(?:\b(?=[\dA-Za-z])|(?=\+))"
# Control characters that no text holds as a rule: those that end a row's match in the notes of a pass, one for each
# row, and one at both ends of the notes.  They have one byte in Java, as most texts do.
_CODE = 0x80
_CODES = "\x80-\x9f"
_EDGE = "\x02"
_DAY_FIRST = ("DATE_DD_MM_YYYY", "DATE_MM_DD_YYYY", "DATE_DD_MM_YY", "DATE_DD_MONTH_YYYY", "CASE_OM")

# First characters of a match per group, as a look-ahead for its alternation.
_GROUP_LEAD = {
    "digit": r"[\d+]",
    "capital": r"[A-Z\d]",
    "hex": rf"{_HEX}(?:{_HEX}[:-]|{_HEX}{{3}}\.|{_HEX}{{7}}-)",
}


def _body(row: Recognizer) -> str:
    return f"(?i:{row.regex[4:]})" if row.regex.startswith("(?i)") else row.regex


def _member(row: Recognizer) -> str:
    return f"(?={row.lead}){_body(row)}"


def _guard_regex(group: str, rows: list[Recognizer], insensitive: bool) -> str:
    return java_regex("(?:" + "|".join(_member(r) for r in rows) + ")", insensitive, _GROUP_LEAD[group])


def _may_be_empty(regex: str) -> bool:
    """Whether a pattern may match nothing at some place; also if Python can't tell."""
    try:
        return re.compile(regex).match("") is not None
    except re.error:
        return True


def _score(row: Recognizer, validated_score: float | None) -> float:
    return float(row.score if row.validator is None or validated_score is None else validated_score)


def _valid_sql(row: Recognizer, value: str) -> str:
    valid = VALIDATORS[row.validator] if isinstance(row.validator, str) else row.validator
    return valid(value)


def _row_sql(clean: str, row: Recognizer, insensitive: bool, validated_score: float | None) -> str:
    def emit(text: str, start: str, end: str) -> str:
        return span_sql(quote(row.entity_type), text, start, end, f"{_score(row, validated_score)!r}D",
                        quote(row.recognizer), quote(row.pattern))

    spans = regex_hits_sql(clean, java_regex(row.regex, insensitive, row.lead or None), emit, SPAN_TYPE)
    if _may_be_empty(row.regex):
        spans = f"filter({spans}, v -> v.end > v.start)"
    if row.validator is not None:
        spans = f"filter({spans}, v -> {_valid_sql(row, 'v.text')})"
    # letters of either case are no use as a hint where case is ignored
    if row.needs and not (insensitive and any(c.isalpha() for n in row.needs for c in n)):
        there = " OR ".join(f"contains({clean}, {quote(n)})" for n in row.needs)
        spans = f"if({there}, {spans}, {NO_SPANS})"
    return spans


def _begin(row: Recognizer) -> str:
    """How a grouped row's matches begin, in few enough ways that most rows needn't be tried at a place."""
    if row.pattern in _DAY_FIRST:
        return r"\d{1,2}(?!\d)"
    if row.pattern == "IPV4":
        return r"\d{1,3}\."
    if row.group == "hex":
        return _GROUP_LEAD["hex"]
    if row.group == "capital" and not row.lead.startswith(r"[A-Z\d]"):
        return "[A-Z]"
    return r"\d{3}" if row.lead.startswith((r"\d{", r"[1-9]\d{3}", "200")) else row.lead


def _once_regexes(rows: list[Recognizer], insensitive: bool) -> tuple[str, str, list[Recognizer]]:
    """An expression that says whether any row matches; one of no characters for every place where one does, whose
    group i holds what the i-th of the rows given back matches there."""
    ways: dict[str, list[Recognizer]] = {}
    for row in rows:
        ways.setdefault(_begin(row), []).append(row)
    some = "|".join(f"(?={b})(?:{'|'.join(_body(r) for r in of)})" for b, of in ways.items())
    each = "".join(f"(?>(?={b})" + "".join(f"(?=({_body(r)})|)" for r in of) + "|)" for b, of in ways.items())
    # a group that took part stands here again; one that did not is nowhere
    any_ = "|".join(f"\\{i}" for i in range(1, len(rows) + 1))
    return (java_regex(f"{_BEGIN}(?:{some})", insensitive), java_regex(f"{_BEGIN}{each}(?={any_})", insensitive),
            [r for of in ways.values() for r in of])


def _once_sql(clean: str, groups: dict[str, list[Recognizer]], insensitive: bool, validated_score: float | None) -> str:
    """All matches of the grouped rows by one pass over a plain text, without duplicates and in the order of results.

    A match is a number until the end, as a fold over structs copies them at every step: its type's rank, start, end from
    the back and row, which sort as duplicate removal has them; and in the end, the score's rank for the type's.
    """
    guard, each, rows = _once_regexes([r for members in groups.values() for r in members], insensitive)
    scores = [_score(r, validated_score) for r in rows]
    order = sorted(range(len(rows)), key=lambda n: (rows[n].entity_type, -scores[n], rows[n].recognizer, rows[n].pattern))
    types = sorted({r.entity_type for r in rows})
    levels = sorted(set(scores), reverse=True)

    def of(values) -> str:
        return f"array({', '.join(str(v) for v in values)})"

    ranks = of(f"{types.index(rows[n].entity_type)}L" for n in order)
    heights = of(f"{levels.index(scores[n])}L" for n in order)
    kinds = of(
        f"named_struct('t', {quote(rows[n].entity_type)}, 's', {scores[n]!r}D, "
        f"'r', {quote(rows[n].recognizer)}, 'p', {quote(rows[n].pattern)})" for n in order)
    start, back, row = "shiftright({0}, 19) & 8191L", "shiftright({0}, 6) & 8191L", "int({0} & 63L)"
    end = f"(8191L - ({back}))"

    notes = "".join(f"${n + 1}{chr(_CODE + order.index(n))}" for n in range(len(rows)))
    marked = f"regexp_replace({clean}, {quote(each)}, '{_EDGE}{notes}{_EDGE}')"
    # pieces alternate gap, notes, gap; a match takes none of the text away, so the gaps are the text
    hit = let_sql("code", f"ascii(right(note, 1)) - {_CODE}", (
        f"(({ranks}[code] * 8192L + pos) * 8192L + 8191L - pos - length(note) + 1L) * 64L + code"))
    noted = f"regexp_extract_all(part, '[^{_CODES}]+[{_CODES}]', 0)"
    there = let_sql("pos", "length(array_join(slice(gaps, 1, k + 1), ''))", f"transform({noted}, note -> {hit})")
    hits = let_sql("pieces", f"split({marked}, '{_EDGE}', -1)", let_sql(
        "gaps", "filter(pieces, (part, k) -> k % 2 = 0)",
        f"sort_array(flatten(transform(filter(pieces, (part, k) -> k % 2 = 1), (part, k) -> {there})))"))
    same_row = "(o & 63L) = (h & 63L)"
    late = f"exists(slice(hits, 1, k), o -> {same_row} AND {end.format('o')} > ({start.format('h')}))"
    reach = f"aggregate(filter(hits, o -> {same_row}), 0L, (r, o) -> if(o < h AND ({start.format('o')}) >= r, {end.format('o')}, r))"
    seen = f"if(exists(transform(hits, (h, k) -> {late}), x -> x), filter(hits, h -> ({start.format('h')}) >= {reach}), hits)"
    valid = "true"
    for n, i in enumerate(order):
        if rows[i].validator is not None:
            value = f"substring({clean}, int({start.format('h')}) + 1, int({end.format('h')} - ({start.format('h')})))"
            valid += f" AND ((h & 63L) != {n} OR {_valid_sql(rows[i], value)})"
    if valid != "true":
        seen = f"filter({seen}, h -> {valid})"
    inside = (f"shiftright(o, 32) = shiftright(h, 32) AND ({back.format('o')}) <= ({back.format('h')}) "
              f"AND {heights}[{row.format('o')}] <= {heights}[{row.format('h')}]")
    kept = let_sql("seen", seen, f"filter(seen, (h, k) -> NOT exists(slice(seen, 1, k), o -> {inside}))")
    ordered = f"sort_array(transform({kept}, h -> {heights}[{row.format('h')}] * 4294967296L + (h & 4294967295L)))"
    kind = f"{kinds}[{row.format('h')}]"
    span = span_sql(
        f"{kind}.t", f"substring({clean}, int({start.format('h')}) + 1, int({end.format('h')} - ({start.format('h')})))",
        f"int({start.format('h')})", f"int({end.format('h')})", f"{kind}.s", f"{kind}.r", f"{kind}.p")
    spans = f"transform({let_sql('hits', hits, ordered)}, h -> {span})"
    return f"if({clean} RLIKE {quote(guard)}, {spans}, {NO_SPANS})"


def _once_groups(rows: Iterable[Recognizer]) -> dict[str, list[Recognizer]]:
    """The rows that one pass looks for; none where there is too little or too much to look for at once."""
    groups: dict[str, list[Recognizer]] = {}
    for row in rows:
        if row.group is not None:
            groups.setdefault(row.group, []).append(row)
    return groups if 1 < sum(map(len, groups.values())) <= 32 else {}


def plain_sql(clean: str) -> str:
    """Whether a text is passed over once for all grouped rows."""
    return f"(length({clean}) <= {BLOCK} AND NOT {clean} RLIKE '[{_CODES}{_EDGE}]')"


def settled_sql(clean: str, rows: Iterable[Recognizer], plain: str) -> str | None:
    """Whether :func:`scan_sql` gives a text's spans without duplicates and in the order of results; None for never."""
    rows = list(rows)
    single = [r for r in rows if r.group is None]
    if not _once_groups(rows) or any(r.pattern != "EMAIL_ADDRESS" or r.lead for r in single):
        return None
    return plain + (f" AND NOT contains({clean}, '@')" if single else "")


def scan_sql(
    clean: str,
    rows: Iterable[Recognizer],
    insensitive: bool = False,
    validated_score: float | None = None,
    plain: str | None = None,
) -> str:
    """All matches of all rows, in any order; what duplicate removal drops may be missing.

    ``clean`` is the text as :func:`scannable_sql` gives it, ``plain`` a column with the value of :func:`plain_sql`.
    """
    rows = list(rows)
    groups: dict[str | None, list[Recognizer]] = {}
    for row in rows:
        groups.setdefault(row.group, []).append(row)
    found, by_row = [], []
    for group, members in groups.items():
        arrays = [_row_sql(clean, r, insensitive, validated_score) for r in members]
        if group is None:
            for row, spans in zip(members, arrays):
                guard = f"{clean} RLIKE {quote(java_regex(row.regex, insensitive))}"
                if row.pattern == "EMAIL_ADDRESS":
                    guard = f"contains({clean}, '@') AND {guard}"
                found.append(f"if({guard}, {spans}, {NO_SPANS})")
        else:
            guard = f"{clean} RLIKE {quote(_guard_regex(group, members, insensitive))}"
            by_row.append(f"if({guard}, concat({', '.join(arrays)}), {NO_SPANS})")
    if by_row:
        slow = by_row[0] if len(by_row) == 1 else f"concat({', '.join(by_row)})"
        once = _once_groups(rows)
        found.append(f"if({plain or plain_sql(clean)}, {_once_sql(clean, once, insensitive, validated_score)}, {slow})"
                     if once else slow)
    return found[0] if len(found) == 1 else f"concat({', '.join(found)})" if found else NO_SPANS
