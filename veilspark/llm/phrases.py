"""Phrase collocations, counted over a prefix-free parse of the corpus.

Parse. A text's tokens are its lower-cased words and, for each run of stops or line breaks, one mark. A new chunk begins wherever
the hash of ``OVERLAP`` tokens hits one in ``PERIOD``, so equal passages are cut alike wherever they stand; a chunk runs on to
the end of the next trigger, so neighbours overlap by its tokens, and no chunk begins another. Distinct chunks
with their frequencies are the dictionary: a passage that many documents share is counted once, with a weight.

Counting. An n-gram belongs to the chunk it begins in, unless it begins in the ``OVERLAP`` last tokens, which the next
chunk begins with; so each occurrence counts once. Marks end all n-grams. Words and pairs are first counted by 64-bit hash;
those that may be frequent enough go into a bitmap of bounded size, and only n-grams made of such parts are counted by their
words. The bitmap has no false negatives: whatever its fill and the hashes' clashes, counts are exact. A full one only prunes less.

Scores, ties and drops are exact (decimal arithmetic, for counts up to 10^15). Nothing but the bitmap goes through the driver; it is
at most ``BITS`` bits, as is the broadcast. Frequent keys are summed in the tasks before any shuffle.

Results for odd input: a null text is an empty one; null languages are ``und``; texts are split as bytes, so invalid UTF-8 stays as it is;
rows that repeat count each time; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut, discard, table, text_bytes
from veilspark.llm.substring import WordHashes

MOST_WORDS = 3
LEAST = 10
SHARE = 50
TOP = 2000
PARTS = 16
PERIOD = 16
# longest chunk where no trigger comes
LONGEST = 4096
# entries of a task's dictionary, and of its sums, between flushes
HELD = 200_000
SUMS = 4_000_000
# tokens of chunks laid out at once
LAID = 3_000_000
BITS = 1 << 28
BLOCK = 1 << 15
MARK = b"."
_M1, _M2, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29)
_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")


def mixed(hashes: np.ndarray) -> np.ndarray:
    out = (hashes ^ (hashes >> _S)) * _M2
    return out ^ (out >> _S)


def tokens(text: bytes, overlap: int) -> list[bytes]:
    """Words and marks of a text, with ``overlap`` marks at its end."""
    text = text.lower().translate(_STOPS)
    while b".." in text:
        text = text.replace(b"..", MARK)
    return text.replace(MARK, b" . ").split() + [MARK] * overlap


def chunk_starts(hashes: np.ndarray, overlap: int, period: int, longest: int) -> list[int]:
    """Where chunks begin: at 0, at triggers, and where a chunk would grow over ``longest`` tokens."""
    n = len(hashes) - overlap
    window = np.zeros(max(n, 0), np.uint64)
    for j in range(overlap):
        window = window * _M1 + hashes[j:j + n]
    triggers = np.flatnonzero(mixed(window) % np.uint64(period) == 0)
    edges = np.unique(np.concatenate(([0], triggers, [n])))
    starts = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        starts += range(a, b, longest)
    return starts


def _parse(overlap: int, period: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held = WordHashes(), Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()),
                                              pa.array(list(held.values()), pa.int64())], ["lang", "chunk", "n"])
            held.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens(text.as_py(), overlap)
                if len(words) == overlap:
                    continue
                starts = chunk_starts(memo.of(words), overlap, period, longest)
                ends = [*(s + overlap for s in starts[1:]), len(words)]
                held.update([(lang, b" ".join(words[a:b])) for a, b in zip(starts, ends)])
                if len(held) > HELD:
                    yield flushed()
        yield flushed()

    return run


def dictionary(docs: DataFrame, text_col: str, lang_col: str, most_words: int = MOST_WORDS, period: int = PERIOD,
               longest: int = LONGEST) -> DataFrame:
    """(lang, chunk, n): the distinct chunks of the parse and how often each occurs."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_bytes(text_col).alias("text"))
    parsed = texts.mapInArrow(_parse(most_words - 1, period, longest), "lang string, chunk binary, n long")
    return cut(parsed.groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "chunks")


class Words(dict):
    """Numbers of the words of one language, and their hashes by number; the mark is 0."""

    def __init__(self, lang: str):
        super().__init__()
        self.salt = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.words, self.hashes = [], np.zeros(1024, np.uint64)
        self[MARK]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        if number == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros(number, np.uint64)))
        self.hashes[number] = xxhash.xxh64_intdigest(word)
        return number


class Laid:
    """Chunks of one language end to end: the tokens' numbers, their chunks' frequencies, and where n-grams may begin."""

    def __init__(self, known: Words, gathered: Gathered, overlap: int):
        self.known = known
        sizes = np.array(gathered.sizes)
        self.numbers = np.array(gathered.numbers)
        self.weights = np.repeat(np.array(gathered.weights), sizes)
        self.begins = self.numbers > 0
        for j in range(1, overlap + 1):
            self.begins[np.cumsum(sizes) - j] = False

    def unmarked(self, size: int) -> np.ndarray:
        """Whether the run of a size from each token has no mark and does not pass the last token."""
        ok = self.numbers > 0
        for j in range(1, size):
            ok[:-j] &= self.numbers[j:] > 0
            ok[-j:] = False
        return ok

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        words = self.known.hashes[self.numbers]
        out = np.full(len(at), self.known.salt, np.uint64)
        for j in range(size):
            out = out * _M1 + words[at + j]
        return mixed(out)

    def counted(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, sums): of the n-grams that begin at places, one place each of the distinct ones and their summed weights."""
        base, codes = np.int64(len(self.known.words)), self.numbers[at]
        for j in range(1, size):
            if j > 1:
                codes = np.unique(codes, return_inverse=True)[1]
            codes = codes * base + self.numbers[at + j]
        order = np.argsort(codes)
        first = changes(codes[order])
        return at[order[first]], np.add.reduceat(self.weights[at][order], first) if len(at) else self.weights[:0]


def changes(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins among sorted ones."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = changes(keys)
    return keys[first], np.add.reduceat(weights, first)


class Gathered:
    """Chunks of one language as they come: all tokens' numbers, each chunk's size and frequency."""

    def __init__(self):
        self.numbers, self.sizes, self.weights = array("q"), array("q"), array("q")


def by_lang(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[str, Laid]]:
    """Chunks of a few million tokens, language by language."""
    known: dict[str, Words] = {}
    rows: dict[str, Gathered] = {}
    held = 0

    def laid():
        for lang, gathered in rows.items():
            yield lang, Laid(known[lang], gathered, overlap)
            if len(known[lang]) > 4 * HELD:
                known[lang].clear()
        rows.clear()

    for batch in batches:
        for lang, chunk, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if lang not in rows:
                rows[lang] = Gathered()
                if lang not in known:
                    known[lang] = Words(lang)
            gathered, words = rows[lang], chunk.split(b" ")
            gathered.numbers.extend(map(known[lang].__getitem__, words))
            gathered.sizes.append(len(words))
            gathered.weights.append(n)
            held += len(words)
        if held > LAID:
            yield from laid()
            held = 0
    yield from laid()


def _hashed(most_words: int):
    """Summed weights of the hashes of all n-grams but the longest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []

        def flushed():
            k, n = summed(np.concatenate(keys), np.concatenate(sums))
            keys.clear()
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["hash", "n"])

        for _, laid in by_lang(batches, most_words - 1):
            for size in range(1, most_words):
                at = np.flatnonzero(laid.begins & laid.unmarked(size))
                k, n = summed(laid.hashes(at, size), laid.weights[at])
                keys.append(k)
                sums.append(n)
            if sum(map(len, keys)) > SUMS:
                yield flushed()
        if keys:
            yield flushed()

    return run


def bitmap(hashes: DataFrame, least: int, most_bits: int = BITS) -> np.ndarray:
    """Bits of the hashes that sum to ``least`` or more; as many as a power of two, by their number, but at most ``most_bits``."""
    often = cut(hashes.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash"), "often")
    bits, number = BLOCK, often.count()
    while bits < min(16 * number, most_bits):
        bits *= 2
    places = often.select(F.expr(f"hash & {bits - 1}").alias("place"))
    blocks = places.groupBy(F.expr(f"place div {BLOCK}").alias("block")).agg(
        F.bitmap_construct_agg(F.expr(f"place % {BLOCK}")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[r.block * BLOCK // 8:(r.block + 1) * BLOCK // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    discard(often)
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


COUNTS = "lang string, gram binary, n long"


def _starts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Where the words of n-grams start; nothing for the empty one."""
    for grams in batches:
        yield pd.Series([[0, *(i + 1 for i, b in enumerate(g) if b == 32)] if g else [] for g in grams], dtype=object)


def _counted(most_words: int, shared):
    """Summed weights of the n-grams all whose parts are in the bitmap, and of all words together (the empty n-gram)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for lang, laid in by_lang(batches, most_words - 1):
            grams, sums = [b""], [int(laid.weights[laid.begins].sum())]
            words, often = laid.known.words, np.ones(len(laid.numbers), bool)
            for size in range(1, most_words + 1):
                here = laid.unmarked(size)
                if size < most_words:
                    at = np.flatnonzero(here)
                    here[at] = marked(bits, laid.hashes(at, size))
                else:
                    here[:-1] &= often[:-1] & often[1:]
                places, n = laid.counted(np.flatnonzero(here & laid.begins), size)
                parts = [map(words.__getitem__, laid.numbers[places + j].tolist()) for j in range(size)]
                grams += map(b" ".join, zip(*parts))
                sums += n.tolist()
                often = here
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.binary()),
                                              pa.array(sums, pa.int64())], ["lang", "gram", "n"])

    return run


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST,
           period: int = PERIOD, longest: int = LONGEST, most_bits: int = BITS) -> DataFrame:
    """(lang, gram, starts, n): n-grams that occur ``least`` times or more, where their words start, and the empty one for all words."""
    chunks = dictionary(docs, text_col, lang_col, most_words, period, longest)
    bits = bitmap(chunks.mapInArrow(_hashed(most_words), "hash long, n long"), least, most_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    sums = chunks.mapInArrow(_counted(most_words, shared), COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    often = sums.where((F.col("n") >= least) | (F.length("gram") == 0))
    out = cut(often.select("lang", "gram", F.pandas_udf(_starts, "array<int>")("gram").alias("starts"), "n"), "counts")
    shared.unpersist()
    discard(chunks)
    return out


def part(low: str, high: str) -> str:
    """SQL: the words of a gram from one to before another, by their numbers from 0."""
    return (f"substring(gram, starts[{low}] + 1, "
            f"if({high} < size(starts), starts[least({high}, size(starts) - 1)] - 1, length(gram)) - starts[{low}])")


def collocations(counted: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, gram, words, a, k, l, r, score): phrases by their lowest-scoring cut, without those that longer ones mostly contain."""
    phrases = counted.where("size(starts) > 1")
    whole = counted.where("size(starts) > 0").select(F.col("lang").alias("of"), F.col("gram").alias("part"), "n")
    cuts = phrases.select("lang", "gram", "starts", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(starts) - 1)")).alias("k"))
    cuts = cuts.select("lang", "gram", F.size("starts").alias("words"), "a", "k", F.expr(part("0", "k")).alias("left"),
                       F.expr(part("k", "size(starts)")).alias("right"))

    def with_count(rows: DataFrame, side: str, name: str) -> DataFrame:
        met = rows.join(whole, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part")))
        return met.drop("of", "part", side).withColumnRenamed("n", name)

    cuts = with_count(with_count(cuts, "left", "l"), "right", "r")
    a, b = "cast(a as decimal(15, 0))", "cast(l as decimal(15, 0)) * cast(r as decimal(15, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(7, 0)) * {a} * {a}) div ({b})"))
    scored = cuts.groupBy("lang", "gram", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = ("flatten(transform(sequence(2, size(starts) - 1), m -> transform(sequence(0, size(starts) - m), i -> "
             + part("i", "(i + m)") + ")))")
    longer = (phrases.where("size(starts) > 2").select(F.col("lang").alias("of"), "n", F.explode(F.expr(inner)).alias("part"))
              .groupBy("of", "part").agg(F.max("n").alias("longer")))
    met = scored.join(longer, (F.col("lang") == F.col("of")) & (F.col("gram") == F.col("part")), "left")
    kept = met.where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    return kept.select("lang", "gram", "words", "a", "low.k", "low.l", "low.r", "low.score")


def top(docs: DataFrame, first: int = TOP, share: int = SHARE, **settings) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score): each language's first collocations."""
    counted = counts(docs, **settings)
    order = [F.desc("score"), F.desc("a"), F.asc("gram")]
    # first within parts of a language, so that no task gets more than its parts' first rows, however many tasks there are
    found = collocations(counted, share).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    for by in (("lang", "part"), ("lang",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= first)
    totals = counted.where("size(starts) = 0").select(F.col("lang").alias("of"), "n")
    return found.join(totals, F.col("lang") == F.col("of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("gram").cast("string").alias("phrase"), "words", "a", "l", "r", "n",
        "score")


def op12_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of two or three words."""
    return top(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM w),
e AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY lang, size, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM e WHERE size = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f FROM e WHERE f >= 10),
k AS (SELECT lang, size, phrase, w, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
q AS MATERIALIZED (SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM k),
c AS (SELECT k.lang, k.phrase, k.size, k.a, k.k, x.f AS l, y.f AS r, 1000000::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f) AS score
  FROM q k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM f WHERE size = 3) GROUP BY lang, part)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  score::BIGINT AS score
FROM m JOIN n ON n.lang = m.lang LEFT JOIN g ON g.lang = m.lang AND g.part = m.phrase
WHERE coalesce(100 * longer < 50 * a, true) QUALIFY rank <= 2000
"""
