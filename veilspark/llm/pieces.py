"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut into units no piece spans: runs of the space mark with the letters after them, up to the next mark, line
end or stop. All new units of equal
length advance together, one character a step: the hashes of the substrings that end there probe the sorted
hashes of the pieces, each piece found continues the best path to its start, and the maximum over piece lengths is kept with
its back pointer. For a unigram model a path's score is the sum of its pieces' scores. For a BPE model a piece may continue
a path only if merging the two pieces' text gives just these two pieces back, which the times of the merges at their
border tell; the one path that remains is the result of the merges, so ids equal those of the merge procedure. Units that start with several space marks, whose merges tie,
and those of lengths that under ``FEW`` units share, which would advance nearly alone, are merged directly.

Encoded units are remembered between the batches of a worker, in two generations of about ``MEMO``. The vocabulary is read on the driver and
broadcast (its size does not depend on the data). No shuffle.

Results for odd input: null and empty texts have no ids; characters outside the vocabulary become their UTF-8 bytes'
pieces (``<unk>`` if the model has none); a space mark in a text is a space; repeated rows are each encoded; an empty table gives
an empty result. Decoding ignores null ids arrays (null text) and control pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO = 60_000
STOPS = ",.!?;:"
SUB_BATCH = 512
FEW = 16
BITS = 20
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Vocabulary:
    """Pieces, scores and kinds of a model, and the sorted substring hashes of its ordinary pieces."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int],
                 unknown: int = 0, kind: str = "bpe") -> None:
        self.pieces, self.kind, self.unknown = pieces, kind, unknown
        self.special, self.byte_ids = special, byte_ids
        bytes_too = special | set(byte_ids.values())
        normal = [i for i in range(len(pieces)) if i not in bytes_too and pieces[i]]
        self.number = {pieces[i]: i for i in normal}
        self.scores = np.array(scores, float)
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        if kind == "bpe":
            normal = self._spines(normal)
        hashes = np.array([hash_of(pieces[i]) for i in normal], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(normal, np.int64)[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.keys >> np.uint64(64 - BITS)] = True
        alone = "" if any("\n" in pieces[i] for i in normal) else "\n"
        # a unit may also end between a letter and a stop, if no piece has a letter before that stop
        joined = {b for i in normal for a, b in zip(pieces[i], pieces[i][1:]) if a.isalpha()}
        stops = "".join(c for c in STOPS if c not in joined)
        word = f"{MARK}*[^\\W\\d_]+(?=[{MARK}{alone}{stops}]|$)"
        self.unit = re.compile(f"{word}|{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}+" if alone else ""))
        shown = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for byte, i in byte_ids.items():
            shown[i] = bytes([byte])
        if 0 <= unknown < len(shown):
            shown[unknown] = " ⁇ ".encode()
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_length = np.array([len(s) for s in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in count]
        special = {i for i in count if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        byte_ids = {int(pieces[i][3:5], 16): i for i in count if model.is_byte(i)}
        return cls(pieces, [model.get_score(i) for i in count], special, byte_ids, model.unk_id(), kind)

    def _spines(self, normal: list[int]) -> list[int]:
        """The pieces that merging can make. Keeps, for each, what its left and right edge were at every time.

        An edge symbol exists from the merge that formed it until the one that takes it in; times are merge scores.
        """
        halves: dict[int, tuple[int, int]] = {}
        made = []
        for i in normal:
            text = self.pieces[i]
            if self.merge(text) == [i]:
                made.append(i)
                if len(text) > 1:
                    halves[i] = self.number[text[:self.last_cut]], self.number[text[self.last_cut:]]
        self.raw = np.zeros(len(self.pieces), np.uint64)
        self.power = np.zeros(len(self.pieces), np.uint64)
        for i in made:
            self.raw[i] = hash_of(self.pieces[i], False)
            self.power[i] = pow(_P, len(self.pieces[i]), 1 << 64)
        self.edges = []
        for side in (0, 1):
            rows = {}
            for i in made:
                row, taken, now = [], -np.inf, i
                while True:
                    formed = self.scores[now] if now in halves else np.inf
                    row.append((now, formed, taken))
                    if now not in halves:
                        break
                    now, taken = halves[now][side], formed
                rows[i] = row
            depth = max((len(r) for r in rows.values()), default=1)
            ids = np.full((len(self.pieces), depth), -1, np.int32)
            times = np.zeros((2, len(self.pieces), depth))
            for i, row in rows.items():
                ids[i, :len(row)] = [r[0] for r in row]
                times[0, i, :len(row)], times[1, i, :len(row)] = [r[1] for r in row], [r[2] for r in row]
            self.edges.append((ids, *times))
        return made

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces gives just the two: no merge over their border comes in time."""
        out = np.ones(len(left), bool)
        (left_ids, left_formed, left_taken), (right_ids, right_formed, right_taken) = self.edges[1], self.edges[0]
        for i in range(left_ids.shape[1]):
            rows = np.flatnonzero(out & (left_ids[left, i] >= 0))
            if not len(rows):
                break
            for j in range(right_ids.shape[1]):
                rows = rows[out[rows] & (right_ids[right[rows], j] >= 0)]
                if not len(rows):
                    break
                a, b = left[rows], right[rows]
                both = (right_formed[b, j] > left_taken[a, i]) & (left_formed[a, i] >= right_taken[b, j])
                at = rows[both]
                x, y = left_ids[left[at], i], right_ids[right[at], j]
                over = self.find((self.raw[x] * self.power[y] + self.raw[y]) * np.uint64(_P))
                hit = over >= 0
                at, score = at[hit], self.scores[over[hit]]
                out[at[(score > left_taken[left[at], i]) & (score >= right_taken[right[at], j])]] = False
        return out

    def merge(self, text: str) -> list[int]:
        """BPE ids by merging: the best-scored pair first, the leftmost of equal ones; -1 - code for unknown letters."""
        n = len(text)
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[float, int, int]] = []

        def offer(a: int, b: int) -> None:
            found = self.number.get(text[a:ends[b]])
            if found is not None:
                heapq.heappush(queue, (-self.scores[found], a, ends[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while queue:
            _, a, end = heapq.heappop(queue)
            b = ends[a]
            if not alive[a] or b >= n or not alive[b] or ends[b] != end:
                continue
            ends[a], alive[b], self.last_cut = end, False, b
            if end < n:
                before[end] = a
                offer(a, end)
            if before[a] >= 0:
                offer(before[a], a)
        return [self.number.get(text[a:ends[a]], -1 - ord(text[a])) for a in range(n) if alive[a]]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(64 - BITS)])
        place = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[maybe] if len(self.keys) else np.zeros(0, bool)
        out[maybe[hit]] = self.ids[place[hit]]
        return out


def hash_of(text: str, mixed: bool = True) -> int:
    value = 0
    for c in text:
        value = (value * _P + ord(c) + 1) & _MASK
    return value * _P & _MASK if mixed else value


class Numbers(dict):
    """Numbers strings in the order they are first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        # one tried join in each slot: its key and its result
        self.tried, self.tried_result = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
        self._forget()

    def _forget(self, keep: bool = False) -> None:
        """Start a new memory of encoded units; the one before is kept to look units up in."""
        self.older = (self.memo, self.flat, self.starts, self.lengths) if keep else ({}, None, None, None)
        self.memo = Numbers()
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _may_join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging two pieces' text leaves them as they are; unknown letters never merge."""
        key = left << 32 | right
        slot = ((key.astype(np.uint64) * np.uint64(_P)) >> np.uint64(64 - BITS)).astype(np.int64)
        out = self.tried_result[slot]
        new = np.flatnonzero(self.tried[slot] != key)
        if len(new):
            found = np.ones(len(new), bool)
            real = np.flatnonzero((left[new] >= 0) & (right[new] >= 0))
            found[real] = self.v.stay_apart(left[new[real]], right[new[real]])
            out[new] = found
            self.tried[slot[new]], self.tried_result[slot[new]] = key[new], found
            again = np.flatnonzero(self.tried[slot[new]] == key[new])
            self.tried_result[slot[new[again]]] = found[again]
        return out

    def viterbi(self, units: list[str]) -> list[list[int]]:
        """Piece ids of units of one length; -1 - code for letters outside the vocabulary."""
        flat, counts = self._viterbi(units)
        return [part.tolist() for part in np.split(flat, np.cumsum(counts)[:-1])]

    def _viterbi(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same end to end, and the number of each unit's ids."""
        v, rows, n = self.v, len(units), len(units[0])
        # a row for each place and a column for each unit, so that what one step touches lies together
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, n).T
        codes = np.ascontiguousarray(codes).astype(np.uint64)
        prefix = np.zeros((n + 1, rows), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * np.uint64(_P) + codes[i] + np.uint64(1)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        last, back = np.full((n + 1, rows), -1, np.int64), np.zeros((n + 1, rows), np.int64)
        worst = float(v.scores.min(initial=0)) - 10
        pieces = []
        for length in range(1, min(n, v.longest) + 1):
            shift = np.uint64(pow(_P, length, 1 << 64))
            hashes = (prefix[length:] - prefix[:-length] * shift) * np.uint64(_P)
            pieces.append(v.find(hashes.ravel()).reshape(hashes.shape))
        pieces[0] = np.where(pieces[0] >= 0, pieces[0], -1 - codes.astype(np.int64))
        for end in range(1, n + 1):
            for length in range(1, min(end, v.longest) + 1):
                begin = end - length
                found = pieces[length - 1][begin]
                at = np.flatnonzero((found >= 0) & (best[begin] > -np.inf)) if length > 1 else np.arange(rows)
                if v.kind == "bpe" and begin:
                    at = at[self._may_join(last[begin][at], found[at])]
                gain = 0.0 if v.kind == "bpe" else np.where(found[at] >= 0, v.scores[np.maximum(found[at], 0)], worst)
                score = best[begin][at] + gain
                better = score > best[end][at]
                at = at[better]
                best[end][at], last[end][at], back[end][at] = score[better], found[at], length
        # follow the back pointers of all units at once, last piece first
        places, column, counts = np.full(rows, n), np.arange(rows), np.zeros(rows, np.int64)
        steps = []
        while (live := places > 0).any():
            steps.append(last[places, column])
            counts += live
            places = places - np.where(live, back[places, column], 0)
        pieces_of = np.stack(steps[::-1], axis=1)
        return pieces_of[np.arange(len(steps)) >= len(steps) - counts[:, None]], counts

    def _expanded(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters outside the vocabulary as the pieces of their bytes."""
        strange = np.unique(flat[flat < 0]).tolist()
        if not strange:
            return flat, counts
        sizes, pieces_of = np.ones(len(flat), np.int64), {}
        for i in strange:
            data = chr(-1 - i).encode("utf-8", "surrogatepass")
            pieces_of[i] = [self.v.byte_ids[b] for b in data] if self.v.byte_ids else [self.v.unknown]
            sizes[flat == i] = len(pieces_of[i])
        out, starts = np.repeat(flat, sizes), np.cumsum(sizes) - sizes
        for i, ids in pieces_of.items():
            at = starts[flat == i]
            for k, piece in enumerate(ids):
                out[at + k] = piece
        return out, np.bincount(np.repeat(np.arange(len(counts)), counts), sizes, len(counts)).astype(np.int64)

    def _learn(self, units: list[str]) -> None:
        """Encode units that the memory has just numbered."""
        held, flat, starts, lengths = self.older
        known = [u for u in units if u in held]
        names, runs = [known], []
        if known:
            place = np.fromiter(map(held.__getitem__, known), np.int64, len(known))
            runs.append((gather(flat, starts[place], lengths[place])[0], lengths[place]))
        by_length: dict[int, list[str]] = {}
        direct: list[str] = []
        for unit in sorted(u for u in units if u not in held):
            if self.v.kind == "bpe" and unit.startswith(MARK * 2):
                direct.append(unit)
            else:
                by_length.setdefault(len(unit), []).append(unit)
        for length, some in by_length.items():
            if self.v.kind == "bpe" and len(some) < FEW:
                direct += some
                continue
            step = max(1, 2_000_000 // (length + 1))
            for at in range(0, len(some), step):
                names.append(some[at:at + step])
                runs.append(self._expanded(*self._viterbi(names[-1])))
        if direct:
            merged = [self.v.merge(unit) for unit in direct]
            names.append(direct)
            runs.append(self._expanded(np.array([i for ids in merged for i in ids], np.int64),
                                       np.array([len(ids) for ids in merged], np.int64)))
        counts = np.concatenate([c for _, c in runs])
        place = np.fromiter((self.memo[u] for some in names for u in some), np.int64, len(counts)) - len(self.starts)
        starts, lengths = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        starts[place], lengths[place] = len(self.flat) + np.cumsum(counts) - counts, counts
        self.starts, self.lengths = np.concatenate((self.starts, starts)), np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, *(f.astype(np.int32) for f, _ in runs)))

    def _units(self, text: str | None) -> list[str]:
        return self.v.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self._forget(keep=True)
        # a text's units become numbers at once: held until the batch is cut, they would lie between the few strings that stay
        cut = []
        for text in texts:
            units = self._units(text)
            cut.append(np.fromiter(map(self.memo.__getitem__, units), np.int64, len(units)))
        if len(self.memo) > len(self.starts):
            self._learn(list(islice(self.memo, len(self.starts), None)))
        place = np.concatenate([np.zeros(0, np.int64), *cut])
        flat, ends = gather(self.flat, self.starts[place], self.lengths[place])
        edges = np.concatenate(([0], ends))[np.cumsum([0] + [len(c) for c in cut])]
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def decode(self, ids: list[np.ndarray | None]) -> list[str | None]:
        v, out = self.v, []
        for one in ids:
            if one is None:
                out.append(None)
                continue
            one = np.asarray(one, np.int64)
            shown, _ = gather(v.shown, v.shown_start[one], v.shown_length[one])
            text = shown.tobytes().decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given runs of an array laid end to end, and the end of each."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], ends


_ENCODERS: dict[object, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary, kept between its tasks."""
    vocabulary = shared.value
    key = (len(vocabulary.pieces), vocabulary.kind, vocabulary.pieces[-1] if vocabulary.pieces else "")
    held = _ENCODERS.get(key)
    if held is None or held.v.pieces != vocabulary.pieces:
        _ENCODERS.clear()
        held = _ENCODERS[key] = Encoder(vocabulary)
    return held


def encoder_of(spark: SparkSession, vocabulary: Vocabulary, check: bool = False):
    """A column function from texts to (ids, n_tokens); with ``check`` also ``round_trip``: decoding gives the text."""
    shared = spark.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for texts in batches:
            for at in range(0, len(texts), SUB_BATCH):
                some = texts.iloc[at:at + SUB_BATCH].tolist()
                ids = encoder.encode(some)
                columns = {"ids": ids, "n_tokens": np.array([len(i) for i in ids], np.int32)}
                if check:
                    columns["round_trip"] = np.array(
                        [d == (t or "").replace(MARK, " ") for d, t in zip(encoder.decode(ids), some)], bool)
                yield pd.DataFrame(columns)

    return F.pandas_udf(of, "ids array<int>, n_tokens int" + ", round_trip boolean" * check)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
           check: bool = False) -> DataFrame:
    """(id, ids, n_tokens[, round_trip]) of every row."""
    of = encoder_of(docs.sparkSession, vocabulary, check)
    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("r")).select("id", "r.*")


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of piece ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for ids in batches:
            yield pd.Series(encoder.decode(ids.tolist()), dtype=object)

    return encoded.select(F.col(id_col).alias("id"), of(F.col(ids_col)).alias("text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, their number, and whether decoding gives the text back."""
    found = encode(table(spark, sf_dir, "documents"), Vocabulary.load(), check=True)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "round_trip")
