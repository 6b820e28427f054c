"""Substring dedup by seed and extend: passages of ``window`` or more words that an earlier document has too.

Seeds. The ``SEED``-word grams of a text are winnowed: of every ``window - SEED + 1`` neighbouring grams the one
with the smallest hash (the rightmost of equal ones) is an anchor. Every window of ``window`` words holds exactly one
such run of grams, so it owns one anchor, and equal windows own equal anchors wherever they stand. Documents are
joined on anchors that stand in at least two of them; the windows of all other anchors cannot repeat and are not looked at.

Extension. From each shared anchor a match is extended left and right to every window that owns it. Windows of
equal words meet by their hash, and the smallest document of each is a partial ``min``, so a passage that a third of all
documents share costs one aggregate and no pair of copies. Windows that repeat an earlier document's
are laid over the text; touching ones form the maximal repeats, which are reported and cut out.

Hashes have 64 bits. Texts are shuffled by document id, never by content; all else shuffled are hashes and ids.

Results for odd input: a null text has no words; texts under ``window`` words lose nothing; a null ``doc_id`` is
neither earlier nor later than any other, so such a row is kept whole and removes nothing; rows that share
a ``doc_id`` are one document and don't remove each other's words; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import cut, discard, table, text_bytes

WINDOW = 13
SEED = 5
MEMO = 300_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """XXH64 of words, remembered for the words a worker meets again; emptied when it has grown to ``MEMO``."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """One mixed hash for each run of ``size`` words, as signed longs."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _M1 + hashes[j:j + n]
    out = (out ^ (out >> _S29)) * _M2
    out = (out ^ (out >> _S32)) * _M3
    return (out ^ (out >> _S29)).view(np.int64)


def owners(seeds: np.ndarray, run: int) -> np.ndarray:
    """For each ``run`` neighbouring seeds the place of the smallest, the rightmost of equal ones."""
    n = len(seeds) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = seeds[:n].copy(), np.arange(n)
    for j in range(1, run):
        other = seeds[j:j + n]
        better = other <= best
        best = np.where(better, other, best)
        place = np.where(better, np.arange(j, j + n), place)
    return place


def covered(repeated: np.ndarray, words: int, window: int) -> np.ndarray:
    """Marks the words that lie in a repeated window; ``repeated`` marks window starts."""
    steps = np.zeros(words + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:words]) > 0


def _pairs(ids: list, values: list[np.ndarray], names: str) -> pd.DataFrame:
    lengths = [len(v) for v in values]
    return pd.DataFrame({
        names: np.concatenate(values) if values else np.zeros(0, np.int64),
        "id": np.repeat(np.array(ids, np.int64), lengths)})


def _anchors(window: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for batch in batches:
            values = []
            for text in batch["text"]:
                found = grams(memo.of(text.split()), seed)
                values.append(np.unique(found[np.unique(owners(found, window - seed + 1))]))
            yield _pairs(batch["id"].tolist(), values, "anchor")

    return run


def _windows(window: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for batch in batches:
            values = []
            for text, shared in zip(batch["text"], batch["shared"]):
                hashes = memo.of(text.split())
                found = grams(hashes, seed)
                mine = np.isin(found[owners(found, window - seed + 1)], shared)
                values.append(np.unique(grams(hashes, window)[mine]))
            yield _pairs(batch["id"].tolist(), values, "hash")

    return run


def shared_anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(id, shared): for each document its anchors that another document has too. ``docs``: id, text as bytes."""
    anchors = cut(docs.where("id is not null").mapInPandas(_anchors(window, seed), "anchor long, id long"), "anchors")
    often = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = anchors.join(often, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("shared"))
    out = cut(shared, "shared")
    discard(anchors)
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
            seed: int = SEED) -> DataFrame:
    """(id, hashes): for each document its windows that a document with a smaller id has too, by hash."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    shared = shared_anchors(texts, window, seed)
    extended = cut(texts.join(shared, "id").mapInPandas(_windows(window, seed), "hash long, id long"), "windows")
    discard(shared)
    first = cut(extended.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                .where("first < last").select("hash", "first"), "first")
    later = extended.join(first, "hash").where("id > first")
    out = cut(later.groupBy("id").agg(F.collect_set("hash").alias("hashes")), "repeats")
    discard(extended, first)
    return out


def _spans(window: int):
    @F.pandas_udf("n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for texts, repeated in batches:
            out = []
            for text, hashes in zip(texts, repeated):
                words = text.split()
                if hashes is None or not len(hashes):
                    out.append((len(words), [], b" ".join(words)))
                    continue
                gone = covered(np.isin(grams(memo.of(words), window), hashes), len(words), window)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((len(words), edges.reshape(-1, 2).tolist(), kept))
            yield pd.DataFrame({
                "n_words": [o[0] for o in out],
                "n_removed": [sum(b - a for a, b in o[1]) for o in out],
                "spans": [[{"start": a, "end": b} for a, b in o[1]] for o in out],
                "kept": [o[2].decode("utf-8", "replace") for o in out]})

    return of


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     seed: int = SEED) -> DataFrame:
    """(id, n_words, n_removed, spans, kept): word spans of the maximal repeats, and the kept words joined by a space."""
    found = repeats(docs, id_col, text_col, window, seed)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return texts.join(found, "id", "left").select("id", _spans(window)("text", "hashes").alias("r")).select("id", "r.*")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                   window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The documents without their repeated words; texts that lose none stay as they are, to the space.

    ``length_col`` names a column that is to hold the number of characters of a changed text.
    """
    found = repeats(docs, id_col, text_col, window, seed)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("bytes"))
    rewritten = rows.join(found, "id", "left").select("row", _spans(window)("bytes", "hashes").alias("r"))
    changed = F.col("r.n_removed") > 0
    out = {c: F.col("row")[c] for c in docs.columns}
    out[text_col] = F.when(changed, F.col("r.kept")).otherwise(out[text_col])
    if length_col:
        kind = docs.schema[length_col].dataType
        out[length_col] = F.when(changed, F.length("r.kept").cast(kind)).otherwise(out[length_col])
    return rewritten.select(*(out[c].alias(c) for c in docs.columns))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its words, how many of them repeat an earlier document, and a digest of the rest."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT doc_id, p, x, string_agg(x, ' ') OVER ahead AS k, count(*) OVER ahead AS n FROM t
      WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT k, min(doc_id) AS first FROM g WHERE n = 13 GROUP BY k),
r AS (SELECT g.doc_id, g.p, g.x, g.n = 13 AND f.first < g.doc_id AS again FROM g LEFT JOIN f ON g.n = 13 AND g.k = f.k),
c AS (SELECT doc_id, p, x, bool_or(coalesce(again, false)) OVER (
        PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
        coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
