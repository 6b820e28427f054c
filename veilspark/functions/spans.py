"""Span expressions over a text column: built-in functions only.

``regex_spans`` is the core: every match of a regular expression with its
character offsets, as one expression without a Python worker.  The text is
passed over once with ``regexp_replace``, which puts a mark on both sides of
each match, and then cut at the marks; the pieces alternate gap, match, gap,
and running lengths give the offsets.

Functions named ``*_sql`` return Spark SQL text and take SQL text for their
arguments.  The long expressions are put together as text because that is one
call into the JVM instead of thousands; the plan is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode reserves these code points for use inside a program.  A text that
# holds MARK is scanned with STAND_IN in its place (same length, same class).
MARK = "\ufdd0"
STAND_IN = "\ufdd1"

# What Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

SPAN_TYPE = (
    "struct<entity_type:string,text:string,start:int,end:int,score:double,"
    "recognizer:string,pattern:string>"
)
SPANS_TYPE = f"array<{SPAN_TYPE}>"
HIT_TYPE = "struct<text:string,start:int,end:int>"
NO_SPANS = f"CAST(array() AS {SPANS_TYPE})"

# Running values over an array are made chunk by chunk: a fold copies what it has
# gathered at every step, so one fold over a long array would be quadratic.  The
# number is even, so that every chunk of pieces begins with a gap.
CHUNK = 32

# Texts up to this many characters are cut directly; longer ones block-wise.
BLOCK = 4096


def quote(value: str) -> str:
    """A SQL string literal without escapes."""
    if "'" not in value:
        return f"r'{value}'"
    if '"' not in value:
        return f'r"{value}"'
    return "concat(" + ", \"'\", ".join(f"r'{part}'" for part in value.split("'")) + ")"


def quote_list(values: Iterable[str]) -> str:
    return ", ".join(quote(v) for v in values)


def strip_text(text: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip_text(text)) == 0)


def has_mark_sql(text: str) -> str:
    return f"contains({text}, '{MARK}')"


def scannable_sql(text: str) -> str:
    """The text as the scan may see it (see MARK)."""
    return f"if({has_mark_sql(text)}, translate({text}, '{MARK}', '{STAND_IN}'), {text})"


def let_sql(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once, as a lambda variable."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def java_regex(regex: str, insensitive: bool = False, lead: str | None = None) -> str:
    r"""The expression for Java: Unicode-aware ``\d \w \s \b``, optional lead."""
    flags = "(?Ui)" if insensitive else "(?U)"
    return flags + (f"(?={lead})" if lead else "") + regex


def span_sql(entity_type: str, text: str, start: str, end: str, score: str, recognizer: str, pattern: str) -> str:
    return (
        f"named_struct('entity_type', {entity_type}, 'text', {text}, 'start', {start}, 'end', {end}, "
        f"'score', {score}, 'recognizer', {recognizer}, 'pattern', {pattern})")


def respan_sql(s: str, text: str, start: str, end: str) -> str:
    """Span ``s`` with another extent."""
    return span_sql(f"{s}.entity_type", text, start, end, f"{s}.score", f"{s}.recognizer", f"{s}.pattern")


def _hit_sql(text: str, start: str, end: str) -> str:
    return f"named_struct('text', {text}, 'start', {start}, 'end', {end})"


def regex_hits_sql(
    clean: str, regex: str, emit: Callable[[str, str, str], str] = _hit_sql, emit_type: str = HIT_TYPE,
) -> str:
    """An array of every match of a Java regex, as ``emit(text, start, end)``.

    ``clean`` must not hold MARK (see :func:`scannable_sql`).  No match and one
    match, by far the most frequent, need no running position.
    """
    parts = f"split(regexp_replace({clean}, {quote(regex)}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    groups = f"sequence(0, (size(p) - 1) DIV {CHUNK})"
    chars = f"aggregate(slice(p, int(g * {CHUNK} + 1), {CHUNK}), 0, (n, part) -> n + length(part))"
    before = "aggregate(slice(lens, 1, int(g)), 0, (n, len) -> n + len)"
    hit = emit("part", "acc.pos", "acc.pos + length(part)")
    fold = (
        f"aggregate(slice(p, int(g * {CHUNK} + 1), {CHUNK}), "
        f"named_struct('pos', {before}, 'hit', false, 'out', CAST(array() AS array<{emit_type}>)), "
        "(acc, part) -> named_struct('pos', acc.pos + length(part), 'hit', NOT acc.hit, "
        f"'out', if(acc.hit, concat(acc.out, array({hit})), acc.out)), acc -> acc.out)")
    many = let_sql("lens", f"transform({groups}, g -> {chars})", f"flatten(transform({groups}, g -> {fold}))")
    single = emit("p[1]", "length(p[0])", "length(p[0]) + length(p[1])")
    return let_sql("p", parts, (
        f"CASE size(p) WHEN 1 THEN CAST(array() AS array<{emit_type}>) WHEN 3 THEN array({single}) "
        f"ELSE {many} END"))


def prefix_max_sql(values: str) -> str:
    """For every element the greatest earlier one (null for the first)."""
    here = f"slice(v, int(g * {CHUNK} + 1), {CHUNK})"
    carry = "array_max(slice(tops, 1, int(g)))"
    within = f"transform({here}, (x, j) -> greatest({carry}, array_max(slice({here}, 1, j))))"
    groups = f"sequence(0, (size(v) - 1) DIV {CHUNK})"
    body = let_sql("tops", f"transform({groups}, g -> array_max({here}))",
                   f"flatten(transform({groups}, g -> {within}))")
    return let_sql("v", values, f"if(size(v) = 0, v, {body})")


def regex_spans(text: str, regex: str, insensitive: bool = False) -> Column:
    """Every match of ``regex`` in a text column: ``array<struct<text,start,end>>``.

    Offsets are 0-based, half-open and count code points.  ``text`` is a column
    name or any SQL expression.
    """
    rx = java_regex(regex, insensitive)
    hits = regex_hits_sql(scannable_sql(text), rx)
    # the matched text is exact unless a stand-in took part
    exact = (
        f"transform({hits}, h -> named_struct('text', substring({text}, h.start + 1, h.end - h.start), "
        "'start', h.start, 'end', h.end))")
    return F.expr(
        f"CASE WHEN {text} IS NULL THEN NULL WHEN NOT ({text} RLIKE {quote(rx)}) "
        f"THEN CAST(array() AS array<{HIT_TYPE}>) WHEN {has_mark_sql(text)} THEN {exact} ELSE {hits} END")


def valid_bsn_sql(value: str) -> str:
    total = " + ".join(f"{9 - i} * int(substring(d, {i + 1}, 1))" for i in range(8))
    check = f"length(d) = 9 AND int(substring(d, 9, 1)) = ({total}) % 11"
    return f"coalesce({let_sql('d', f'regexp_replace({value}, {quote("[^0-9]")}, {quote("")})', check)}, false)"


def is_valid_bsn(value: str) -> Column:
    """11-test of a citizen number: exactly nine digits and the right ninth."""
    return F.expr(valid_bsn_sql(value))


# Named checks: SQL text of a matched value -> SQL text of a boolean.
VALIDATORS: dict[str, Callable[[str], str]] = {"bsn": valid_bsn_sql}


def overlaps(a: Column, b: Column) -> Column:
    """Half-open intersection; touching spans do not overlap."""
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two character spans, 0.0 if disjoint."""
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / ((e1 - s1) + (e2 - s2) - inter))


def blocks_sql(text: str) -> str:
    """The text as an array of pieces of BLOCK characters (the last shorter).

    ``substring`` walks a string from its first byte, so cutting thousands of
    spans out of a long text one by one would be quadratic; cutting them out of
    blocks is not.
    """
    return (f"if(length({text}) <= {BLOCK}, array({text}), "
            f"regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}', 0))")


def cut_sql(blocks: str, start: str, end: str) -> str:
    """``text[start:end]`` given :func:`blocks_sql`; empty if ``end <= start``."""
    first, last = f"int(({start}) DIV {BLOCK})", f"int((({end}) - 1) DIV {BLOCK})"
    pick = f"array_join(slice({blocks}, {first} + 1, {last} - {first} + 1), '')"
    return f"if(({end}) <= ({start}), '', substring({pick}, ({start}) % {BLOCK} + 1, ({end}) - ({start})))"


def context_sql(blocks: str, length: str, start: str, end: str, chars: int = 20) -> str:
    """The span with ``chars`` characters either side, clipped to the text."""
    return cut_sql(blocks, f"greatest(0, {start} - {chars})", f"least({length}, {end} + {chars})")
