"""Packing of token ids into sequences of a fixed capacity by minimum bin slack.

Tokens. A text's ids are those of the tokenizer, then an end id. A byte-level tokenizer's texts are cut at single blanks and
line ends, where its tokens always end, so that ids of words met before come from a memo; others are encoded whole.

Cutting. A document gives full sequences of ``capacity`` ids as long as it can; what remains, its tail, is shorter than one.
Tails are known by their length alone, so a corpus of any size is a histogram of at most ``capacity - 1`` counts. That,
and nothing else, goes to the driver, where the windows are planned:

- The longest tail opens a window. A subset-sum programme over a bitset of reachable sums, with each length as often as
  it is left, finds the multiset of lengths that fills the rest closest; its counts are traced back.
- The same multiset fills as many windows as its lengths last, so the plan has few rows, each for a range of ranks.
- If slack remains, no unused tail fits into it (else a closer filling existed); the longest is cut to fill it and its rest
  goes back into the histogram. Less than one capacity at the end goes into sequences whose lengths are powers of two.

So no sequence needs padding, and tails are cut only where no multiset closes a window. The plan is broadcast: its size
depends on the capacity alone. A tail finds its windows by its length and its rank among tails of that length; ranks are counted
in the task that encodes and shifted by the counts of the tasks before, so a length that a third of all documents share is no hot key.

Results for odd input: a null text is an empty one, whose only id is the end id; bytes that are not UTF-8 are replaced
by U+FFFD; every row is a document of its own, also if ids are null or repeat; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from veilspark.llm.common import cut, table, text_bytes

CAPACITY = 1024
END_ID = 0
MEMO = 1_200_000
FLUSH = 4 << 20
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# white space other than blanks and line ends, as Unicode has it and Python beyond that; and the mark of a unit without its blank
ODD = re.compile("[\x01\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BARE = "\x01"
STOPS = ".,;:!?"
# words of letters below this code point go straight to the model, in its spelling of bytes
LETTERS = 0x250


def little(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Ids of units of text as little-endian 32-bit numbers, remembered; emptied when it has grown to ``MEMO``.

    A unit is what stands between blanks, with the blank before it unless it is marked as bare, or a line end.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)
        self.by_units = self.tokenizer.normalizer is None and repr(self.tokenizer.pre_tokenizer) == repr(plain)
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {}
        for letter in map(chr, range(LETTERS)):
            self.spelling |= dict(zip(letter.encode(), spelled.pre_tokenize_str(letter)[0][0]))
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, text: str) -> bytes:
        spelled = text.encode().decode("latin-1").translate(self.spelling)
        return little([t.id for t in self.model.tokenize(spelled)])

    def __missing__(self, unit: str) -> bytes:
        bare = unit.lstrip(BARE)
        word = bare.rstrip(STOPS)
        blank = "" if unit[0] in (BARE, "\n") else " "
        if not word.isalpha() or max(word) >= chr(LETTERS):
            found = self.whole(blank + bare)
        elif word != bare:
            found = self[unit[:len(unit) - len(bare) + len(word)]] + self[BARE + bare[len(word):]]
        else:
            found = self._word(blank + word)
        self[unit] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if not text:
            return b""
        if (not self.by_units or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n"
                or text[-1] in " \n" or ODD.search(text) or any(t in text for t in self.added)):
            return self.whole(text)
        units = (BARE + text.replace("\n", " \n " + BARE)).split(" ")
        return b"".join(map(self.__getitem__, units))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A Python worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "id {id}, at long, part int, start long, length int, ids binary, doc_tokens long, nth long"


def _encoded(path: str, capacity: int, end_id: int):
    """Full pieces and tails of documents; ``nth`` counts a task's tails of a length, null for full pieces."""
    end, width = little([end_id]), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at, seen = encoder(path), TaskContext.get().partitionId(), 0, [0] * capacity
        rows, held, kind = [], 0, None

        def flushed():
            columns = list(zip(*rows)) if rows else [[]] * 6
            number = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.array(columns[0], kind), pa.array(range(at - number, at), pa.int64()),
                pa.array([part] * number, pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())],
                ["id", "at", "part", "start", "length", "ids", "doc_tokens", "nth"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, text in zip(batch.column(0), batch.column(1)):
                ids = encode.ids(text.as_py().decode("utf-8", "replace")) + end
                name, tokens = name.as_py(), len(ids) // 4
                for start in range(0, len(ids), width):
                    piece = ids[start:start + width]
                    length, nth = len(piece) // 4, None
                    if length < capacity:
                        nth = seen[length]
                        seen[length] += 1
                    rows.append((name, start // 4, length, piece, tokens, nth))
                    at += 1
                held += len(ids)
                if held > FLUSH:
                    yield flushed()
                    rows, held = [], 0
        if rows:
            yield flushed()

    return run


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum is closest to ``target`` from below."""
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= target), reverse=True):
        left, times = min(counts[length], target // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << (length * times) & mask
            left, times = left - times, times * 2
        if reach >> target & 1:
            break
    at, picked = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + times
            at -= length * times
    return picked


class Plan:
    """Windows for a histogram of tails, as rows that map ranges of ranks to places.

    A row (length, low, high, cut, piece, first, times, base, done) says: of the tails of a length, those ranked from low to
    high give the piece that begins at ``cut``; the tail ranked r is the j-th, j = done + r - low, of its lot and goes
    to sequence first + j div times, at base + (j mod times) * piece.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0
        self.counts = dict(counts)
        # lots of a length still to place: [length of the tail, first rank, tails, where in the tail they begin]
        self.lots = {x: deque([[x, 0, n, 0]]) for x, n in counts.items()}
        total = sum(x * n for x, n in counts.items())
        while total >= capacity:
            longest = max(x for x, n in self.counts.items() if n)
            total -= self._windows(capacity, longest)
        for bit in reversed(range(capacity.bit_length())):
            if total >> bit & 1:
                self._windows(1 << bit, None)

    def _windows(self, size: int, opening: int | None) -> int:
        """Fill windows of a size alike, as many as the lengths last; the tokens placed."""
        left = dict(self.counts)
        if opening is not None:
            left[opening] -= 1
        picked = fill(left, size - (opening or 0))
        if opening is not None:
            picked[opening] = picked.get(opening, 0) + 1
        slack = size - sum(x * n for x, n in picked.items())
        need, split = dict(picked), None
        if slack:
            split = max(x for x, n in self.counts.items() if n > picked.get(x, 0))
            need[split] = need.get(split, 0) + 1
        times = min(self.counts[x] // n for x, n in need.items()) if opening is not None else 1
        base = 0
        for length in sorted(picked, reverse=True):
            self._place(length, length, times * picked[length], picked[length], base)
            base += length * picked[length]
        if split is not None:
            self._place(split, slack, times, 1, base)
        self.sequences += times
        return times * size

    def _place(self, length: int, piece: int, number: int, each: int, base: int) -> None:
        """Place the first ``piece`` ids of tails of a length, ``each`` in a window; what is left of them becomes a lot."""
        self.counts[length] -= number
        done, rest = 0, length - piece
        while done < number:
            lot = self.lots[length][0]
            taken = min(lot[2], number - done)
            self.rows.append((lot[0], lot[1], lot[1] + taken, lot[3], piece, self.sequences, each, base, done))
            if rest:
                self.lots.setdefault(rest, deque()).append([lot[0], lot[1], taken, lot[3] + piece])
                self.counts[rest] = self.counts.get(rest, 0) + taken
            lot[1] += taken
            lot[2] -= taken
            if not lot[2]:
                self.lots[length].popleft()
            done += taken


PLAN = "tail int, low long, high long, cut int, piece int, first long, times int, base int, done long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) for each piece; ``ids`` are little-endian 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    pieces = cut(texts.mapInArrow(_encoded(tokenizer, capacity, end_id), PIECES.format(id=kind)), "pieces")
    tails = pieces.where("nth is not null")
    counts = cut(tails.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # rows of this window: as many for a length as tasks have encoded texts
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(F.col("part").alias("of"), F.col("length").alias("tail"), F.coalesce(earlier, F.lit(0)).alias("shift"))
    ranked = tails.join(shifts, (F.col("part") == F.col("of")) & (F.col("length") == F.col("tail"))).drop("tail")
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("shift"))
    windows = docs.sparkSession.createDataFrame(plan.rows, PLAN)
    met = ranked.join(F.broadcast(windows), (F.col("length") == F.col("tail")) & F.expr("rank >= low and rank < high"))
    j = F.expr("done + rank - low")
    placed = met.select("id", (F.col("start") + F.col("cut")).alias("start"), F.col("piece").cast("long").alias("length"),
                        F.expr("substring(ids, 4 * cut + 1, 4 * piece)").alias("ids"), "doc_tokens",
                        F.expr("first + (done + rank - low) div times").alias("sequence_id"),
                        (F.col("base") + j % F.col("times") * F.col("piece")).cast("long").alias("offset"))
    number = F.lit(plan.sequences) + F.shiftleft(F.col("part").cast("long"), 33) + F.col("at")
    full = pieces.where("nth is null").select("id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens",
                                              number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(placed)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, documents): packed sequences, padded to ``capacity`` unless their length is a power of two.

    ``documents`` has each piece's document, where in it the piece begins, and its place in the sequence.
    """
    joined = (pieces.groupBy("sequence_id")
              .agg(F.sort_array(F.collect_list(F.struct("offset", "length", "id", "start", "ids"))).alias("p")))

    @F.pandas_udf("array<int>")
    def padded(whole):
        import pandas as pd

        out = []
        for ids in whole:
            ids = np.frombuffer(ids, "<u4").astype(np.int32)
            n = len(ids)
            out.append(ids if n & (n - 1) == 0 else np.concatenate((ids, np.full(capacity - n, pad_id, np.int32))))
        return pd.Series(out, dtype=object)

    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", padded(whole).alias("ids"),
                         F.transform("p", lambda x: F.struct(x["id"], x["start"], x["offset"], x["length"])).alias("documents"))


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document: what it holds, and its sequence and place there."""
    found = pack(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                        "sequence_id", "offset")
