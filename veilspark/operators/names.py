"""Known names in a text: the dictionary detector.

A name is a run of words; a text has it where the same words stand in the same order, whatever stands between them (so
across line breaks and dashes).  Names may have any number of words, and the longest per start wins.  The dictionary is measured
first, by one aggregate, and that decides how names reach the texts:

* Up to ``LIMIT`` characters it is made into a word trie, which is broadcast.  Texts are matched in their rows: no
  shuffle, no exploded words, and legal on a stream.
* Beyond that a bitmap of bounded size holds a hash of every beginning of every name, and of every whole name.  A run of words is followed
  as long as its hash is in it, so only runs that are almost surely names leave a row; those are joined with the names, word
  by word, which drops the few that are none.  A full bitmap lets more runs through, and changes no result.

Words are those of Java's Unicode-aware ``\\w+``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.catalog import NER_SCORE
from veilspark.functions.spans import SPANS_TYPE

WORD = regex.compile(r"[\p{Alphabetic}\p{Mn}\p{Me}\p{Mc}\p{Nd}\p{Pc}\p{Join_Control}]+")

# Characters of names that are broadcast as a trie: some hundred megabytes in a Python worker at most.
LIMIT = 4_000_000

# Bits of the bitmap of beginnings, at most; it has sixteen for each beginning up to that.
BITS = 1 << 28
BLOCK = 1 << 15

_MIX, _END, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


class Trie:
    """Names by their words.  A branch is a dictionary; where only one name is left, it is its rest: (words, type)."""

    def __init__(self, names: Iterable[tuple[str, str]] = ()):
        self.root: dict = {}
        for name, kind in names:
            words = words_of(name)
            if words:
                self.add(words, kind)

    def add(self, words: list[str], kind: str) -> None:
        node, at = self.root, 0
        while True:
            word = words[at] if at < len(words) else ""  # no word is empty: a name that ends here
            there = node.get(word)
            rest = tuple(words[at + 1:])
            if there is None:
                node[word] = (rest, kind)
                return
            if isinstance(there, tuple):
                other, known = there
                if other == rest:
                    node[word] = (rest, min(known, kind))
                    return
                node[word] = there = {}
                there[other[0] if other else ""] = (other[1:], known)
            node, at = there, at + 1

    def longest(self, words: list[str]) -> Iterator[tuple[int, int, str]]:
        """(first word, word after the last, type) of the longest name at each word that begins one."""
        if self.root.keys().isdisjoint(words):
            return
        for first in range(len(words)):
            node, at, best = self.root, first, None
            while True:
                there = node.get(words[at]) if at < len(words) else None
                if node is not self.root and "" in node:
                    best = (first, at, node[""][1])
                if there is None:
                    break
                at += 1
                if isinstance(there, tuple):
                    rest, kind = there
                    if tuple(words[at:at + len(rest)]) == rest:
                        best = (first, at + len(rest), kind)
                    break
                node = there
            if best:
                yield best


class Hashes(dict):
    """Hashes of words, emptied when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def beginnings(words: Iterable[str], hashes: Hashes) -> Iterator[int]:
    """A hash for the first word, the first two, and so on."""
    value = 0
    for word in words:
        value = (value * _MIX + hashes[word]) & _ALL
        value ^= value >> 29
        yield value


def whole(beginning: int) -> int:
    """The hash of a run of words that is a whole name, from that of a beginning."""
    value = beginning * _END & _ALL
    return value ^ value >> 32


class Beginnings:
    """Which hashes are in a bitmap of the names' beginnings."""

    def __init__(self, bits: bytes):
        self.bits, self.mask = bits, len(bits) * 8 - 1

    def __contains__(self, value: int) -> bool:
        place = value & self.mask
        return self.bits[place >> 3] >> (place & 7) & 1 > 0

    def runs(self, words: list[str], hashes: Hashes) -> Iterator[tuple[int, int]]:
        """(first word, word after the last) of every run that may be a name."""
        for first in range(len(words)):
            for length, value in enumerate(beginnings((words[i] for i in range(first, len(words))), hashes), 1):
                if value not in self:
                    break
                if whole(value) in self:
                    yield first, first + length


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = Hashes()
    for batch in batches:
        out: set[int] = set()
        for name in batch["name"]:
            value = None
            for value in beginnings(name.split(" "), hashes):
                out.add(value)
            if value is not None:
                out.add(whole(value))
        yield pd.DataFrame({"hash": np.fromiter(out, np.uint64, len(out)).view(np.int64)})


def bitmap(hashes: DataFrame, most_bits: int = BITS) -> bytes:
    """Bits of the hashes, sixteen for each or ``most_bits``; a power of two, made block by block where the hashes are."""
    wanted, bits = 16 * hashes.agg(F.approx_count_distinct("hash")).first()[0], BLOCK
    while bits < min(wanted, most_bits):
        bits *= 2
    places = hashes.select(F.expr(f"hash & {bits - 1}").alias("place"))
    blocks = places.groupBy(F.expr(f"place div {BLOCK}").alias("block")).agg(
        F.bitmap_construct_agg(F.expr(f"place % {BLOCK}")).alias("bits"))
    out = bytearray(bits // 8)
    for r in blocks.toLocalIterator():
        out[r.block * BLOCK // 8:(r.block + 1) * BLOCK // 8] = r.bits
    return bytes(out)


@dataclass
class Names:
    """A measured dictionary: its types, and either a trie of its names or their table and bitmap."""

    kinds: tuple[str, ...]
    trie: Broadcast | None = None
    table: DataFrame | None = None
    bits: Broadcast | None = None

    def column(self, text: Column) -> Column:
        """The names of a text as a span array (null text: none).  Needs a trie."""
        trie = self.trie

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = trie.value
            for texts in batches:
                yield pd.Series([_trie_spans(known, t) for t in texts], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, SPANS_TYPE)(text)

    def spans(self, docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
        """``keys, entity_type, start, end, score, recognizer, pattern`` of every name found."""
        if self.trie is not None:
            # the outer form and a filter above it, or the optimizer would match each text twice
            rows = docs.select(*keys, F.explode_outer(self.column(F.col(text_col))).alias("_s")).filter(F.col("_s").isNotNull())
            return rows.select(*keys, "_s.entity_type", "_s.start", "_s.end", "_s.score", "_s.recognizer", "_s.pattern")
        runs = docs.select(*keys, F.explode_outer(self._runs(F.col(text_col))).alias("_r")).filter(F.col("_r").isNotNull())
        found = runs.select(*keys, F.col("_r.name").alias("name"), F.col("_r.start").alias("start"), F.col("_r.end").alias("end"))
        found = found.join(self.table, "name")
        best = found.groupBy(*keys, "start").agg(F.min(F.struct((-F.col("end")).alias("e"), "entity_type")).alias("_b"))
        return best.select(
            *keys, F.col("_b.entity_type").alias("entity_type"), "start", (-F.col("_b.e")).alias("end"),
            F.lit(NER_SCORE).alias("score"), F.lit("gazetteer").alias("recognizer"), F.lit("dictionary").alias("pattern"))

    def _runs(self, text: Column) -> Column:
        bits = self.bits

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known, hashes = Beginnings(bits.value), Hashes()
            for texts in batches:
                yield pd.Series([_likely_runs(known, hashes, t) for t in texts], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<struct<name: string, start: int, end: int>>")(text)


def _offsets(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text)]


def _trie_spans(trie: Trie, text: str | None) -> list[dict]:
    found = list(trie.longest(words_of(text))) if text else []
    if not found:
        return []
    at = _offsets(text)
    return [{"entity_type": kind, "text": None, "start": at[a][0], "end": at[b - 1][1], "score": NER_SCORE,
             "recognizer": "gazetteer", "pattern": "dictionary"} for a, b, kind in found]


def _likely_runs(known: Beginnings, hashes: Hashes, text: str | None) -> list[dict]:
    words = words_of(text) if text else []
    found = list(known.runs(words, hashes))
    if not found:
        return []
    at = _offsets(text)
    return [{"name": " ".join(words[a:b]), "start": at[a][0], "end": at[b - 1][1]} for a, b in found]


def load_names(gazetteer: DataFrame, limit: int = LIMIT, most_bits: int = BITS) -> Names:
    """Measure a dictionary ``name, entity_type`` and make what its size allows (runs an aggregate over it).

    Rows without a name, without a word in it or without a type are left out.  Equal names of several types count as the first by type name.
    """
    given = gazetteer.select("name", "entity_type").where("name is not null and entity_type is not null")
    size = given.agg(F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars"),
                     F.sort_array(F.collect_set("entity_type")).alias("kinds")).first()
    spark = gazetteer.sparkSession
    if size.chars <= limit:
        return Names(tuple(size.kinds), spark.sparkContext.broadcast(Trie((r.name, r.entity_type) for r in given.collect())))

    def joined(names: pd.Series) -> pd.Series:
        return names.map(lambda n: " ".join(words_of(n)))

    joined.__annotations__ = {"names": pd.Series, "return": pd.Series}
    table = given.select(F.pandas_udf(joined, "string")("name").alias("name"), "entity_type").where("name <> ''")
    table = table.groupBy("name").agg(F.min("entity_type").alias("entity_type"))
    bits = bitmap(table.select("name").mapInPandas(_hashed, "hash long"), most_bits)
    return Names(tuple(size.kinds), None, table, spark.sparkContext.broadcast(bits))


def dictionary_spans(docs: DataFrame, gazetteer: DataFrame | Names, keys: list[str], text_col: str = "text") -> DataFrame:
    """Known names in a text: ``keys, entity_type, start, end, score, recognizer, pattern``."""
    names = gazetteer if isinstance(gazetteer, Names) else load_names(gazetteer)
    return names.spans(docs, keys, text_col)
