"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, from a user to an
assistant turn. A dynamic programme over this automaton's states reads the roles in order and chooses for every turn the
role it gets, whether it starts a new turn or is merged into the one before, and where empty turns are inserted, so
that the summed cost of merges, relabels and insertions is least. The repaired sequence is then rendered with a template.

The turns of a conversation are numbered in order (a range partition, in which each part counts its own) and cut into
chunks of ``CHUNK``. Each chunk is reduced to a matrix of least costs from state to state, ``GROUP`` matrices to one, and so
on up to one group a conversation; from there the states between groups, and between chunks, are found downwards, and
each chunk is traced back between its states alone. Only role codes are gathered, a chunk at a time, or ``GROUP``
matrices of 16 numbers; texts stay rows. So a conversation of any length, with any turn numbers, is spread over tasks. The result is one row per turn with its rendered piece; pieces in order
are the rendered conversation, so a conversation is never collected into one row unless ``render`` is asked to.

Results for odd input: a null text is an empty one; a null or unknown role may take any role at ``COST_UNKNOWN``;
a null turn comes after all others; rows with null conversation ids form one conversation; turns of equal number are
ordered by role and text, nulls first; rows equal in all four columns count once; of equally cheap repairs the one
that ends in, and before that comes from, the earliest state (start, system, user, assistant) is taken, chunk by
chunk (and group by group beyond ``GROUP`` chunks); an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
UNKNOWN = 0
CHUNK = 512
GROUP = 256
# by this many characters the range partition tells texts of equal turns apart; its bounds go to the driver
LEAD = 256
COST_MERGE, COST_RELABEL, COST_INSERT, COST_UNKNOWN = 1, 3, 4, 2
FAR = 1 << 40
# legal next states of each state
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _insertions(a: int, b: int) -> list[int] | None:
    """The fewest empty turns that lead legally from state a to a new turn in state b."""
    paths = [[a]]
    for _ in range(4):
        for path in paths:
            if b in LEGAL[path[-1]]:
                return path[1:]
        paths = [p + [n] for p in paths for n in LEGAL[p[-1]] if n != START]
    return None


NEW = {(a, b): _insertions(a, b) for a in range(4) for b in (SYSTEM, USER, ASSISTANT)}


def move(before: int, role: int, after: int) -> tuple[int, bool]:
    """(cost, merged) of reading a turn of a role (0: unknown) from one state into another."""
    if after == START:
        return FAR, False
    label = 0 if role == after else COST_UNKNOWN if role == UNKNOWN else COST_RELABEL
    inserted = NEW[before, after]
    fresh = FAR if inserted is None else COST_INSERT * len(inserted)
    joined = COST_MERGE if before == after else FAR
    return label + min(fresh, joined), joined < fresh


COSTS = np.array([[[move(a, r, b)[0] for b in range(4)] for a in range(4)] for r in range(4)], np.int64)
# what closing a conversation in a state costs: the empty turns up to an assistant's
CLOSE = np.array([FAR, COST_INSERT * 2, COST_INSERT, 0], np.int64)
ENDING = {SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def reduce_roles(roles: list[int]) -> np.ndarray:
    """Least costs from each state before the turns to each state after them."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        total = np.minimum((total[:, :, None] + COSTS[role][None]).min(axis=1), FAR)
    return total


def trace(roles: list[int], first: int, last: int) -> list[int]:
    """The states after each turn on the cheapest way between two states."""
    costs = [np.where(np.arange(4) == first, 0, FAR)]
    for role in roles:
        costs.append(np.minimum((costs[-1][:, None] + COSTS[role]).min(axis=0), FAR))
    states, now = [], last
    for i in range(len(roles), 0, -1):
        states.append(now)
        now = int(np.argmin(costs[i - 1] + COSTS[roles[i - 1]][:, now]))
    return states[::-1]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Least costs from each state before the chunks to each state after them."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for matrix in matrices:
        total = np.minimum((total[:, :, None] + matrix[None]).min(axis=1), FAR)
    return total


def chain(matrices: list[np.ndarray], first: int = START, last: int | None = None) -> list[tuple[int, int]]:
    """(state before, state after) of each chunk on the cheapest way between two states, or to the end of the conversation."""
    costs = [np.where(np.arange(4) == first, 0, FAR)]
    for matrix in matrices:
        costs.append(np.minimum((costs[-1][:, None] + matrix).min(axis=0), FAR))
    now, out = int(np.argmin(costs[-1] + CLOSE)) if last is None else last, []
    for i in range(len(matrices), 0, -1):
        before = int(np.argmin(costs[i - 1] + matrices[i - 1][:, now]))
        out.append((before, now))
        now = before
    return out[::-1]


def _actions(roles: list[int], first: int, last: int) -> list[dict]:
    """What becomes of each turn: its role, the empty turns before it, whether it is merged."""
    out, before = [], first
    for role, state in zip(roles, trace(roles, first, last)):
        merged = move(before, role, state)[1]
        out.append({"state": state, "merged": merged, "relabelled": role != state,
                    "inserted": [] if merged else NEW[before, state]})
        before = state
    return out


MATRIX = "array<long>"
WAYS = "array<struct<chunk: long, first: int, last: int, closing: boolean>>"
ACTIONS = "array<struct<state: int, merged: boolean, relabelled: boolean, inserted: array<int>>>"


def _reduced(chunks: pd.Series) -> pd.Series:
    return pd.Series([reduce_roles(list(c)).ravel() for c in chunks], dtype=object)


def _matrices(one) -> list[np.ndarray]:
    return [np.array(c["matrix"], np.int64).reshape(4, 4) for c in one]


def _multiplied(groups: pd.Series) -> pd.Series:
    return pd.Series([product(_matrices(one)).ravel() for one in groups], dtype=object)


def _ways(one, first: int, last: int | None, closing: bool) -> list[dict]:
    return [{"chunk": c["chunk"], "first": a, "last": b, "closing": closing and i == len(one) - 1}
            for i, (c, (a, b)) in enumerate(zip(one, chain(_matrices(one), first, last)))]


def _chained(groups: pd.Series) -> pd.Series:
    return pd.Series([_ways(one, START, None, True) for one in groups], dtype=object)


def _divided(groups: pd.Series, first: pd.Series, last: pd.Series, closing: pd.Series) -> pd.Series:
    return pd.Series([_ways(one, int(a), int(b), bool(c)) for one, a, b, c in zip(groups, first, last, closing)], dtype=object)


def _acted(chunks: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([_actions(list(c), int(a), int(b)) for c, a, b in zip(chunks, first, last)], dtype=object)


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``at``, their place in the order of all; (at, conv, rank, code), their place in the conversation)."""
    order = [F.col(c).asc_nulls_first() for c in ("conv", "number", "given")]
    parted = rows.repartitionByRange(*order, F.substring("text", 1, LEAD).asc_nulls_first())
    parted = parted.sortWithinPartitions(*order, F.col("text").asc_nulls_first(), F.col("turn").asc_nulls_first())
    rows = cut(parted.withColumn("at", F.monotonically_increasing_id()), "turns")
    codes = rows.select("at", F.shiftright("at", 33).alias("part"), "conv", "code")
    runs = codes.groupBy("part", "conv").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    # as many runs of a conversation as it has parts, at most those of the range partition
    earlier = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.select(F.col("part").alias("p"), F.col("conv").alias("c"),
                        (F.coalesce(earlier, F.lit(0)) - F.col("low")).alias("shift"))
    ranked = codes.join(begun, (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")))
    return rows, ranked.select("at", "conv", (F.col("at") + F.col("shift")).alias("rank"), "code")


def ways_of(parts: DataFrame, group: int = GROUP) -> DataFrame:
    """(c, k, first, last, closing): the states before and after each chunk of (conv, chunk, codes)."""
    level = parts.select("conv", "chunk", F.pandas_udf(_reduced, MATRIX)("codes").alias("matrix"))
    highest, below = parts.agg(F.max("chunk")).first()[0] or 0, []

    def gathered(level: DataFrame) -> DataFrame:
        return (level.groupBy("conv", F.expr(f"chunk div {group}").alias("up"))
                .agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("m")))

    while highest >= group:
        held = cut(gathered(level), "matrices")
        below.append(held)
        level = held.select("conv", F.col("up").alias("chunk"), F.pandas_udf(_multiplied, MATRIX)("m").alias("matrix"))
        highest //= group

    def listed(rows: DataFrame, found) -> DataFrame:
        return (rows.select(F.col("conv").alias("c"), F.explode(found).alias("w"))
                .select("c", F.col("w.chunk").alias("k"), "w.first", "w.last", "w.closing"))

    ways = listed(gathered(level), F.pandas_udf(_chained, WAYS)("m"))
    for held in reversed(below):
        met = held.join(ways, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("k")))
        ways = listed(met, F.pandas_udf(_divided, WAYS)("m", "first", "last", "closing"))
    return ways


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", chunk: int = CHUNK, begin: str = "<|im_start|>", end: str = "<|im_end|>\n",
           group: int = GROUP) -> DataFrame:
    """One row per turn: (conv, turn, chunk, place, given, role, merged, relabelled, inserted, closing, text, piece).

    ``chunk`` and ``place`` order the turns of a conversation; ``inserted`` has the roles of empty turns put before a turn,
    ``closing`` of those put after the last; ``piece`` is what the turn adds to the rendered conversation.
    """
    names = F.lit(list(ROLES))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).alias("given"), F.col(text_col).alias("text")).distinct()
    rows = (rows.withColumn("number", F.coalesce("turn", F.lit((1 << 63) - 1)))
            .withColumn("code", F.coalesce(F.array_position(names, F.lower(F.trim("given"))).cast("int"), F.lit(UNKNOWN))))
    texts, ranked = numbered(rows)
    parts = cut(ranked.groupBy("conv", F.expr(f"rank div {chunk}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("at", "code"))).alias("t")), "codes")
    ways = ways_of(parts.select("conv", "chunk", F.col("t.code").alias("codes")), group)
    traced = (parts.join(ways, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
              .withColumn("a", F.pandas_udf(_acted, ACTIONS)("t.code", "first", "last")))
    acts = (traced.select("chunk", "first", "closing", F.size("t").alias("n"), F.posexplode(F.arrays_zip("t", "a")))
            .select(F.col("col.t.at").alias("at"), "chunk", F.col("pos").alias("place"), F.col("col.a.state").alias("state"),
                    F.col("col.a.merged").alias("merged"), F.col("col.a.relabelled").alias("relabelled"),
                    F.col("col.a.inserted").alias("before"),
                    ((F.col("first") == START) & (F.col("pos") == 0)).alias("opens"),
                    (F.col("closing") & (F.col("pos") == F.col("n") - 1)).alias("ends")))
    each = (texts.join(acts, "at").withColumn("text", F.coalesce("text", F.lit("")))
            .select("conv", "turn", "chunk", "place", "given", "state", "merged", "relabelled", "before", "opens", "ends", "text"))
    after = F.when(~F.col("ends"), F.array().cast("array<int>"))
    for state, roles in ENDING.items():
        after = after.when(F.col("state") == state, F.array(*map(F.lit, roles)).cast("array<int>"))

    def named(states: str):
        return F.transform(states, lambda s: F.element_at(names, s))

    def empty_turns(roles: str):
        return F.array_join(F.transform(roles, lambda r: F.concat(F.lit(begin), r, F.lit("\n" + end))), "")

    each = (each.withColumn("after", after).withColumn("role", F.element_at(names, F.col("state")))
            .withColumn("inserted", named("before")).withColumn("closing", named("after")))
    fresh = F.concat(F.when(F.col("opens"), "").otherwise(end), empty_turns("inserted"), F.lit(begin), "role", F.lit("\n"))
    piece = F.concat(F.when(F.col("merged"), "\n").otherwise(fresh), "text",
                     F.when(F.col("ends"), F.concat(F.lit(end), empty_turns("closing"))).otherwise(""))
    return each.select("conv", "turn", "chunk", "place", "given", "role", "merged", "relabelled", "inserted", "closing",
                       "text", piece.alias("piece"))


def render(repaired: DataFrame) -> DataFrame:
    """(conv, rendered): whole conversations in one row each, for tables whose conversations fit one."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "place", "piece")))
    return repaired.groupBy("conv").agg(F.array_join(ordered["piece"], "").alias("rendered"))


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation with its repaired role and its rendered piece."""
    found = repair(table(spark, sf_dir, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "turn", "chunk", "place", "role", "merged", "relabelled", "inserted",
                        "closing", "piece")
