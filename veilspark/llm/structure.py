"""Conversation structure repair by a generalised LR parse with weighted edits.

A conversation is right if its roles' initials match ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs
of a user and an assistant turn. The grammar below says so; its LR automaton is built from it. A conversation's
rows are read in order into a graph-structured stack: all stacks that a choice of edits leads to are kept at once,
share what lies below their tops, and are merged where their tops are equal, to the minimum of (cost, audit). A row is

- kept (K, 0) if its role's initial can be shifted, or given another role (R, 2) that can;
- deleted (D, 3), as it must be if it is blank or a duplicate;
- preceded by inserted empty turns (I, 2 each), of which no gap needs more than two;

and costs 1 more if it is truncated and not deleted. The audit lists these initials. Equally cheap repairs differ in their
audits, of which the least in ASCII order is taken; no audit of the rows read so far begins with another of equal cost, so
the minimum of each merge is that of the whole.

At scale. Rows are numbered by a range partition in which each part counts its own, and conversations are cut into chunks of
``CHUNK`` rows. A chunk is parsed from each stack that can stand before it (there are eight, as the grammar recurs on
the left and so keeps stacks flat), to the cheapest edits for each stack after it. Of those only the cost goes on, and the
audit's rank among the chunk's own: two audits that differ within a chunk are compared there. Chunks are chained by
these numbers, and each is then parsed once more between its two stacks. Only one letter a row is gathered, a chunk at a
time, and less than a kilobyte a chunk for each conversation. Texts stay rows. A digest over a conversation's text is serial by nature: its rows
pass through one task in order, one Arrow batch at a time.

Faults. Blank: no character but white space. Duplicate: role and text of an earlier row of the conversation.
Truncated: the last visible character is none of ``.!?``. A row has the first of these only.

Results for odd input: nulls of role and text are one blank; rows without a conversation id form one
conversation; null turns come first; rows of equal turn are ordered by role, the first ``LEAD`` characters of the text and its SHA-256;
of rows equal in all columns all but the first are duplicates; roles whose initial is none of s, u, a can't be kept;
gaps beyond 64 bits are null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut, discard, table

CHUNK = 256
# by this many characters of their text rows of equal turn and role are ordered first
LEAD = 256
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
MAKES = "ua"
GAP = 2
# start symbol first; its reductions wait for the end
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))


class Automaton:
    """LR(0) automaton of a grammar: what each state shifts or goes to, what it reduces, and where it may end."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        heads = {head for head, _ in grammar}

        def closed(items):
            items, todo = set(items), list(items)
            while todo:
                rule, dot = todo.pop()
                body = grammar[rule][1]
                if dot < len(body) and body[dot] in heads:
                    new = {(i, 0) for i, (head, _) in enumerate(grammar) if head == body[dot]} - items
                    items |= new
                    todo += new
            return frozenset(items)

        start = grammar[0][0]
        states = [closed({(i, 0) for i, (head, _) in enumerate(grammar) if head == start})]
        self.goto: dict[tuple[int, str], int] = {}
        for at, items in enumerate(states):
            for symbol in sorted({grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}):
                after = closed({(r, d + 1) for r, d in items if grammar[r][1][d:d + 1] == symbol})
                if after not in states:
                    states.append(after)
                self.goto[at, symbol] = states.index(after)
        done = [[grammar[r] for r, d in items if d == len(grammar[r][1])] for items in states]
        self.reduces = [[(head, len(body)) for head, body in rules if head != start] for rules in done]
        self.ends = {at for at, rules in enumerate(done) if any(head == start for head, _ in rules)}


LR = Automaton()


class Top:
    """A stack: its top's state, and the stack below, which other tops share."""

    shared: dict[tuple, Top] = {}
    __slots__ = ("state", "below")

    def __new__(cls, state: int, below: Top | None):
        known = cls.shared.get((state, below))
        if known is None:
            known = cls.shared[state, below] = object.__new__(cls)
            known.state, known.below = state, below
        return known

    def states(self) -> tuple[int, ...]:
        return (*(self.below.states() if self.below else ()), self.state)


def stack(states: tuple[int, ...]) -> Top:
    top = None
    for state in states:
        top = Top(state, top)
    return top


Weight = tuple[int, str]
Tops = dict[Top, Weight]


def _merge(tops: Tops, top: Top, weight: Weight) -> None:
    if top not in tops or weight < tops[top]:
        tops[top] = weight


_SHIFTED: dict[tuple[Top, str], list[Top]] = {}


def shifted(top: Top, symbol: str) -> list[Top]:
    """The stacks after a symbol, with every reduction made; none where the symbol can't be shifted."""
    if (top, symbol) not in _SHIFTED:
        found = []
        if (top.state, symbol) in LR.goto:
            todo = [Top(LR.goto[top.state, symbol], top)]
            while todo:
                new = todo.pop()
                for head, size in LR.reduces[new.state]:
                    base = new
                    for _ in range(size):
                        base = base.below
                    todo.append(Top(LR.goto[base.state, head], base))
                if not LR.reduces[new.state]:
                    found.append(new)
        _SHIFTED[top, symbol] = found
    return _SHIFTED[top, symbol]


def inserted(tops: Tops, most: int = GAP) -> Tops:
    """The stacks with up to ``most`` empty turns more."""
    out, last = dict(tops), tops
    for _ in range(most):
        new: Tops = {}
        for top, (cost, audit) in last.items():
            for symbol in MAKES:
                for after in shifted(top, symbol):
                    _merge(new, after, (cost + COST["I"], audit + "I"))
        for top, weight in new.items():
            _merge(out, top, weight)
        last = new
    return out


_STEPS: dict[tuple[Top, str], Tops] = {}


def step(top: Top, code: str) -> Tops:
    """The edits of one row from a stack: ``d`` must go, s u a x are initials (x: any other), capitals truncated."""
    if (top, code) not in _STEPS:
        out: Tops = {}
        for at, (cost, audit) in inserted({top: (0, "")}).items():
            _merge(out, at, (cost + COST["D"], audit + "D"))
            for symbol in "sua" if code != "d" else "":
                edit = "K" if symbol == code.lower() else "R" if symbol in MAKES else None
                for after in shifted(at, symbol) if edit else ():
                    _merge(out, after, (cost + COST[edit] + code.isupper(), audit + edit))
        _STEPS[top, code] = out
    return _STEPS[top, code]


def read(tops: Tops, code: str) -> Tops:
    """The stacks after a row, equal tops merged."""
    out: Tops = {}
    for top, (cost, audit) in tops.items():
        for after, (more, edits) in step(top, code).items():
            _merge(out, after, (cost + more, audit + edits))
    return out


def parsed(codes: str, states: tuple[int, ...]) -> dict[tuple[int, ...], Weight]:
    """The cheapest edits of a chunk from a stack to each stack after it."""
    tops: Tops = {stack(states): (0, "")}
    for code in codes:
        tops = read(tops, code)
    return {top.states(): weight for top, weight in tops.items()}


def closing(states: tuple[int, ...]) -> str:
    """The empty turns, as I's, that end a conversation in a stack."""
    ways = [w for t, w in inserted({stack(states): (0, "")}).items() if t.state in LR.ends]
    return min(ways)[1]


def _stacks() -> list[tuple[int, ...]]:
    """All stacks that can stand between rows, the empty one first."""
    out = [stack((0,))]
    for top in out:
        out += [t for s in "sua" for t in shifted(top, s) if t not in out]
    return [t.states() for t in dict.fromkeys(out)]


STACKS = _stacks()


def summary(codes: str, first: bool) -> list[list[int]]:
    """[before, after, cost, rank of the audit] for each pair of stacks that a chunk joins."""
    found = [(a, STACKS.index(after), cost, audit) for a, before in enumerate(STACKS[:1] if first else STACKS)
             for after, (cost, audit) in parsed(codes, before).items()]
    ranks = {audit: i for i, audit in enumerate(sorted({f[3] for f in found}))}
    return [[a, b, cost, ranks[audit]] for a, b, cost, audit in found]


def chain(chunks: list[list[list[int]]]) -> tuple[int, list[tuple[int, int]]]:
    """(cost, stacks before and after each chunk) of the cheapest way through all chunks to an end."""
    best, back = {0: (0, 0)}, []
    for edges in chunks:
        new: dict[int, tuple] = {}
        for a, b, cost, rank in edges:
            if a in best:
                way = (best[a][0] + cost, (best[a][1], rank), a)
                if b not in new or way < new[b]:
                    new[b] = way
        order = {key: i for i, key in enumerate(sorted({way[1] for way in new.values()}))}
        best = {b: (way[0], order[way[1]]) for b, way in new.items()}
        back.append({b: way[2] for b, way in new.items()})
    ends = {b: len(closing(STACKS[b])) * COST["I"] for b in best}
    now = min(best, key=lambda b: (best[b][0] + ends[b], best[b][1]))
    cost, steps = best[now][0] + ends[now], []
    for before in reversed(back):
        steps.append((before[now], now))
        now = before[now]
    return cost, steps[::-1]


def edits(codes: str, before: int, after: int, last: bool) -> tuple[str, list[dict]]:
    """(audit, what becomes of each row): its edit, its role's initial, the roles put before it and after the last."""
    audit = parsed(codes, STACKS[before])[STACKS[after]][1]
    end = closing(STACKS[after]) if last else ""
    out, top, lead, at = [], stack(STACKS[before]), [], 0

    def shift(symbols: str) -> str:
        nonlocal top
        symbol = next(s for s in symbols if shifted(top, s))
        top = shifted(top, symbol)[0]
        return symbol

    for edit in audit:
        if edit == "I":
            lead.append(shift(MAKES))
            continue
        role = shift(codes[at].lower()) if edit == "K" else shift(MAKES) if edit == "R" else None
        out.append({"edit": edit, "role": role, "before": lead, "after": []})
        lead, at = [], at + 1
    out[-1]["after"] = [shift(MAKES) for _ in end]
    return audit + end, out


class Remembered(dict):
    """Results of a function of hashable arguments, emptied when there are many."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        if len(self) > 20_000:
            self.clear()
        value = self[key] = self.of(*key)
        return value


SUMMARY = "array<array<long>>"
WAY = "struct<cost: long, steps: array<struct<chunk: long, first: int, last: int, ends: boolean>>>"
EDITS = ("struct<audit: string, rows: array<struct<edit: string, role: string, before: array<string>, after: array<string>>>>")


def _summaries(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known = Remembered(summary)
    for codes, first in batches:
        yield pd.Series([known[c, bool(f)] for c, f in zip(codes, first)], dtype=object)


def _chained(groups: pd.Series) -> pd.DataFrame:
    out = []
    for one in groups:
        cost, steps = chain([[[int(x) for x in edge] for edge in c["edges"]] for c in one])
        out.append((cost, [{"chunk": c["chunk"], "first": a, "last": b, "ends": i == len(one) - 1}
                           for i, (c, (a, b)) in enumerate(zip(one, steps))]))
    return pd.DataFrame({"cost": [o[0] for o in out], "steps": [o[1] for o in out]})


def _edited(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    known = Remembered(edits)
    for columns in batches:
        out = [known[c, int(a), int(b), bool(e)] for c, a, b, e in zip(*columns)]
        yield pd.DataFrame({"audit": [o[0] for o in out], "rows": [o[1] for o in out]})


def damaged(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text): rows of ``conversations`` dropped, emptied, cut, repeated or given a role by their key's CRC-32."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", one).alias("role"),
                        F.coalesce("text", one).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """(at, conv, turn, role, text, key): rows in their order over all conversations; ``key`` tells role and text apart."""
    keyed = rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
    keyed = (keyed.withColumn("lead", F.substring("text", 1, LEAD)).withColumn("sha", F.sha2("text", 256))
             .withColumn("place", F.monotonically_increasing_id()))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "lead", "sha", "place")]
    parted = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(parted.select(F.monotonically_increasing_id().alias("at"), "conv", "turn", "role", "text",
                             F.sha2(F.concat("role", F.lit(":"), "sha"), 256).alias("key")), "rows")


def visible_end(text: str = "text") -> Column:
    """The last visible character of a text, empty if it has none."""
    return F.substring(F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def faulted(rows: DataFrame) -> DataFrame:
    """(at, conv, turn, fault, initial, code) of numbered rows, without their texts."""
    firsts = rows.groupBy("conv", "key").agg(F.min("at").alias("one")).select("one")
    marked = rows.select("at", "conv", "turn", "role", visible_end().alias("end")).join(firsts, F.col("at") == F.col("one"), "left")
    fault = (F.when(F.col("end") == "", "blank").when(F.col("one").isNull(), "duplicate")
             .when(~F.col("end").isin(".", "!", "?"), "truncated"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return (marked.withColumn("fault", fault).withColumn("initial", initial).withColumn("code", code)
            .select("at", "conv", "turn", "fault", "initial", "code"))


def ranked(marks: DataFrame) -> DataFrame:
    """The rows with ``rank``, their place in the conversation, from 0."""
    parts = marks.withColumn("part", F.shiftright("at", 33))
    runs = parts.groupBy("part", "conv").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    # rows of this window: as many for a conversation as parts hold some of it
    earlier = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select(F.col("part").alias("p"), F.col("conv").alias("c"), (F.coalesce(earlier, F.lit(0)) - F.col("low")).alias("shift"))
    met = parts.join(shifts, (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")))
    return met.withColumn("rank", F.col("at") + F.col("shift")).drop("p", "c", "part", "shift")


def illegal_pairs(initials: Column) -> Column:
    """How many neighbours in a list of initials are none of su, ua, au."""
    pairs = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials)), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows) as repaired.

    Conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows: at (their order), conv, turn, role (as given),
    text, fault, edit, as_role (after the edit, null if deleted), before and after (roles of the empty turns put there).
    """
    rows = numbered(turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                                 F.col(text_col).alias("text")))
    marks = cut(ranked(faulted(rows)), "marks")
    counted = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    turn = F.col("turn").cast("decimal(38,0)")
    distinct = marks.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.count(F.lit(1)).alias("n"))
    stats = marks.groupBy("conv").agg(*counted, (F.max(turn) - F.min(turn)).alias("span"))
    parts = marks.groupBy("conv", F.expr(f"rank div {chunk}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("at", "code", "initial", "fault"))).alias("t"))
    codes = F.array_join(F.col("t.code"), "")
    parts = cut(parts.select("conv", "chunk", F.col("t.at").alias("at"), F.col("t.fault").alias("fault"), codes.alias("codes"),
                             illegal_pairs(F.col("t.initial")).alias("illegal"), F.element_at("t.initial", 1).alias("first"),
                             F.element_at("t.initial", -1).alias("last")), "chunks")
    summed = parts.select("conv", "chunk", "illegal", "first", "last",
                          F.pandas_udf(_summaries, SUMMARY)("codes", F.col("chunk") == 0).alias("edges"))
    gathered = summed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "illegal", "first", "last", "edges"))).alias("m"))
    # neighbours of which one ends a chunk and the other begins the next
    crossing = F.expr("size(filter(sequence(1, size(m)), i -> i < size(m) and "
                      "concat(m[i - 1].last, m[i].first) not in ('su', 'ua', 'au')))")
    inner = F.aggregate(F.col("m.illegal"), F.lit(0), lambda a, x: a + x)
    edges = F.transform("m", lambda c: F.struct(c["chunk"].alias("chunk"), c["edges"].alias("edges")))
    ways = cut(gathered.select("conv", (crossing + inner).cast("long").alias("illegal"),
                               F.pandas_udf(_chained, WAY)(edges).alias("w")), "ways")
    steps = ways.select(F.col("conv").alias("c"), F.explode("w.steps").alias("s"))
    edited = parts.join(steps, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("s.chunk")))
    made = F.pandas_udf(_edited, EDITS)("codes", "s.first", "s.last", "s.ends")
    edited = cut(edited.select("conv", "chunk", "at", "fault", made.alias("e")), "edits")
    audits = edited.groupBy("conv").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "e.audit")))["audit"], "").alias("audit"))

    def with_(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("conv", "c")
        return left.join(right, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")

    found = with_(with_(with_(stats, distinct), ways.select("conv", "illegal", F.col("w.cost").alias("cost"))), audits)
    gaps = F.coalesce(F.col("span") + 1 - F.col("n"), F.lit(0)).cast("string").try_cast("long")
    convs = found.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    acts = edited.select(F.explode(F.arrays_zip("at", "fault", F.col("e.rows").alias("rows"))).alias("r"))
    acts = acts.select(F.col("r.at").alias("of"), "r.fault", "r.rows.*").withColumnRenamed("role", "to")
    named = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))

    def names(roles: str) -> Column:
        return F.transform(roles, lambda r: named[r])

    after = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "R", named[F.col("to")])
    each = rows.join(acts, F.col("at") == F.col("of")).select(
        "at", "conv", "turn", "role", "text", "fault", "edit", after.alias("as_role"), names("before").alias("before"),
        names("after").alias("after"))
    discard(parts)
    return convs, each


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines, whose rows come in order; a conversation may span batches."""
    now, state, lines = None, None, 0
    for batch in batches:
        out = []
        for conv, new in zip(batch["key"], batch["lines"]):
            if state is None or conv != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state, lines = conv, hashlib.sha256(), 0
            for line in new:
                state.update(b"\n" * (lines > 0) + line)
                lines += 1
        yield pd.DataFrame(out, columns=["key", "sha"])
    if state is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["key", "sha"])


def digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): of the repaired ``role:text`` lines, joined by line ends."""
    def empty(roles: str) -> Column:
        return F.transform(roles, lambda r: F.concat(r, F.lit(":")).cast("binary"))

    own = F.when(F.col("as_role").isNotNull(), F.array(F.concat("as_role", F.lit(":"), "text").cast("binary"))).otherwise(
        F.array().cast("array<binary>"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    lines = rows.select(key.alias("key"), "at", F.concat(empty("before"), own, empty("after")).alias("lines"))
    ordered = lines.repartition("key").sortWithinPartitions("key", "at").select("key", "lines")
    found = ordered.mapInPandas(_digests, "key string, sha string")
    return found.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("conv"), F.col("sha").alias("repaired_sha256"))


def op13_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation: its faults after the damage, the cheapest repair, and a digest of what that gives."""
    turns = table(spark, sf_dir, "conversations")
    convs, rows = repair(damaged(turns), "conv")
    kind = turns.schema["conv_id"].dataType
    sums = digests(rows).select(F.col("conv").cast(kind).alias("d"), "repaired_sha256")
    given = turns.select("conv_id").distinct()
    found = given.join(convs, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    found = found.join(sums, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return found.select("conv_id", gaps, *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _more(way: str, cost: str, letters: str) -> str:
    """SQL: a way of six digits of cost and its audit, made longer."""
    return f"lpad((left({way}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({way}, 7) || '{letters}'"


ORACLE = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
b AS (SELECT *, flatten([[(ascii(key[i::INT]) >> j::INT) & 1 for j in range(8)] for i in range(1, length(key) + 1)]) AS bits FROM k),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bits::BIGINT[]),
    lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS kind FROM b),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, substr(text, 1, 256), sha256(text), copy) AS n FROM g),
f AS (SELECT *, regexp_extract(text, '(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, role[1] AS i,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM o),
m AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
    FROM f),
s AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
-- cheapest ways to: nothing, a system turn, an open user turn, whole pairs; each as six digits of cost and the audit
w AS (SELECT conv_id, 0::BIGINT AS n, '000000' AS e, NULL::VARCHAR AS y, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM s
  UNION ALL
  SELECT conv_id, n, e2, y2, least(u1, u2), least(a1, a2) FROM (
    SELECT conv_id, n + 1 AS n, {_more("e", "3", "D")} AS e2,
      least({_more("y", "3", "D")}, CASE WHEN keep = 's' THEN {_more("e", "t", "K")} END) AS y2,
      {_more("ui", "3", "D")} AS u1, CASE WHEN keep = 'u' THEN {_more("az", "t", "K")} WHEN keep <> 'd' THEN {_more("az", "2 + t", "R")} END AS u2,
      {_more("ai", "3", "D")} AS a1, CASE WHEN keep = 'a' THEN {_more("ui", "t", "K")} WHEN keep <> 'd' THEN {_more("ui", "2 + t", "R")} END AS a2
    FROM (SELECT *, least(e, y, ai) AS az FROM (SELECT w.conv_id, w.n, e, y,
        least(u, {_more("least(e, y, a)", "2", "I")}) AS ui, least(a, {_more("u", "2", "I")}, {_more("least(e, y, a)", "4", "II")}) AS ai,
        CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE i END AS keep, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t
      FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1)))),
z AS (SELECT w.conv_id, least(e, a, {_more("u", "2", "I")}, {_more("y", "4", "II")}) AS best FROM w JOIN s
    ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.rows = w.n),
c AS (SELECT conv_id, substr(best, 7) AS audit, unnest(range(1, length(best) - 5)) AS j FROM z),
q AS (SELECT conv_id, j, audit[j] AS edit, count(*) FILTER (WHERE audit[j] <> 'I') OVER v AS n,
    count(*) FILTER (WHERE audit[j] <> 'D') OVER v AS place FROM c WINDOW v AS (PARTITION BY conv_id ORDER BY j)),
l AS (SELECT q.conv_id, q.j, q.edit, q.place, m.role, m.text,
    max(CASE WHEN q.place = 1 AND q.edit = 'K' AND m.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS sys
  FROM q LEFT JOIN m ON q.edit <> 'I' AND m.conv_id IS NOT DISTINCT FROM q.conv_id AND m.n = q.n),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM l WHERE edit <> 'D' GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(best, 6)::BIGINT, 0) AS cost,
  coalesce(substr(best, 7), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id
"""
