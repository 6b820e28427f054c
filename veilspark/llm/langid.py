"""Language of words and texts by a linear-chain conditional random field.

Words are runs of letters. A word's score for a language sums learned weights of its character n-grams with marked
ends (those that hold an end are its affixes) and, for lexicon words, of the word itself. Learned transitions join
the words of a text; forward-backward gives each word the probability of each language, so that code-switched
texts get a language per word. A text's language is the one with the largest mean probability over its words.

The model is fitted on the driver from a bounded sample: at most about ``rows_per_label`` documents a language, chosen
by a hash of their id, and ``spans`` runs of ``span`` words from all over each. Half of the training sequences are
joined from runs of several languages, so that transitions are learned from switches too. Prediction covers whole texts:
all words of a batch advance together in segments of ``SEGMENT`` words, whose transfer matrices are chained first,
so that a long text takes no longer loop than its number of segments.

Results for odd input: a text that is null or has no letter gets ``und`` with score 0; ties go to the first language in
code point order; rows with null language, text or id are never learned from; with nothing to learn from every text is
``und``; repeated rows are each predicted; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import remainder, table

BITS = 18
GRAMS = 4
SEGMENT = 64
MEMO = 100_000
SUB_BATCH = 50_000
# words whose features are laid out at once: some hundred bytes for each of their characters
FEATURED = 10_000
ROWS_PER_LABEL = 500
SPANS = 4
SPAN = 24
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of the words with marked ends, and of every word itself."""
    line = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    number = np.repeat(np.arange(len(words)), lengths)
    left = ends[number] - np.arange(len(codes))
    owner, bucket = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS + 1):
        value = value[:len(codes) - n + 1] * _P1 + codes[n - 1:] + np.uint64(1)
        inside = left[:len(value)] >= n
        owner.append(number[:len(value)][inside])
        bucket.append(((value[inside] + np.uint64(n)) * _P2) >> np.uint64(64 - BITS))
    whole = np.zeros(len(words), np.uint64)
    weight = (codes + np.uint64(7)) * _P2
    place = np.arange(len(codes)) - (ends - lengths)[number]
    weight = (weight ^ (weight >> np.uint64(31))) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _P1
    if len(words):
        whole = np.add.reduceat(weight ^ (weight >> np.uint64(29)), ends - lengths)
    owner.append(np.arange(len(words)))
    bucket.append((whole * _P2) >> np.uint64(64 - BITS))
    return np.concatenate(owner), np.concatenate(bucket).astype(np.int64)


class Model:
    """Languages, weights of hashed features, and transition scores."""

    def __init__(self, labels: list[str]) -> None:
        self.labels = labels
        self.weights = np.zeros((1 << BITS, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        for low in range(0, len(words), FEATURED):
            some = words[low:low + FEATURED]
            owner, bucket = word_features(some)
            for k in range(len(self.labels)):
                out[low:low + len(some), k] = np.bincount(owner, self.weights[bucket, k], len(some))
        return out


def _forward_backward(potential: np.ndarray, alive: np.ndarray, move: np.ndarray):
    """Marginals (B, T, K) and expected moves (K, K) of padded training sequences; ``alive`` (B, T) marks words."""
    b, t, k = potential.shape
    alpha, beta = np.zeros((b, t, k)), np.ones((b, t, k))
    now = np.full((b, k), 1.0)
    for i in range(t):
        step = (now @ move) * potential[:, i]
        step /= step.sum(axis=1, keepdims=True)
        now = alpha[:, i] = np.where(alive[:, i, None], step, now)
    for i in range(t - 2, -1, -1):
        step = (beta[:, i + 1] * potential[:, i + 1]) @ move.T
        step /= step.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(alive[:, i + 1, None], step, 1.0)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * move * (potential[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    start = move * (potential[:, 0] * beta[:, 0])[:, None, :]
    start /= start.sum(axis=(1, 2), keepdims=True)
    return marginal, (pair * alive[:, 1:, None, None]).sum(axis=(0, 1)) + start.sum(axis=0)


def fit(runs: list[tuple[str, list[str]]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-4,
        seed: int = 17) -> Model:
    """A model from (language, words) runs, by AdaGrad on the sequences' log-likelihood."""
    runs = sorted((label, words) for label, words in runs if words)
    model = Model(sorted({label for label, _ in runs}))
    if not runs:
        return model
    number = {label: i for i, label in enumerate(model.labels)}
    draw = np.random.default_rng(seed)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in runs for w in words}))}
    owner, bucket = word_features(list(vocabulary))
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    first = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    coded = [(number[label], np.array([vocabulary[w] for w in words])) for label, words in runs]
    k = len(model.labels)
    squares, move_squares = np.full(model.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6)
    for _ in range(epochs):
        order = draw.permutation(len(coded))
        sequences, at = [], 0
        while at < len(order):
            parts = 1 if draw.random() < 0.5 else int(draw.integers(2, 4))
            chosen = [coded[i] for i in order[at:at + parts]]
            at += parts
            if len(chosen) > 1:
                chosen = [(y, w[:max(1, int(draw.integers(1, len(w) + 1)))]) for y, w in chosen]
            sequences.append((np.concatenate([w for _, w in chosen]),
                              np.concatenate([np.full(len(w), y) for y, w in chosen])))
        for low in range(0, len(sequences), 64):
            some = sequences[low:low + 64]
            t = max(len(w) for w, _ in some)
            alive = np.array([[i < len(w) for i in range(t)] for w, _ in some])
            words = np.concatenate([w for w, _ in some])
            truth = np.concatenate([y for _, y in some])
            distinct, inverse = np.unique(words, return_inverse=True)
            sizes = first[distinct + 1] - first[distinct]
            entry = np.repeat(first[distinct] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            features, of = bucket[entry], np.repeat(np.arange(len(distinct)), sizes)
            scores = np.stack([np.bincount(of, model.weights[features, j], len(distinct)) for j in range(k)], axis=1)
            emitted = scores[inverse]
            potential = np.ones((len(some), t, k))
            potential[alive] = np.exp(emitted - emitted.max(axis=1, keepdims=True))
            move = np.exp(model.moves)
            marginal, moves = _forward_backward(potential, alive, move)
            error = marginal[alive]
            error[np.arange(len(truth)), truth] -= 1
            seen = np.zeros((k, k))
            for w, y in some:
                np.add.at(seen, (y[:-1], y[1:]), 1)
                seen[:, y[0]] += move[:, y[0]] / move[:, y[0]].sum()
            per_word = np.stack([np.bincount(inverse, error[:, j], len(distinct)) for j in range(k)], axis=1)
            rows, back = np.unique(features, return_inverse=True)
            slope = np.stack([np.bincount(back, per_word[of, j], len(rows)) for j in range(k)], axis=1) / len(some)
            slope += decay * model.weights[rows]
            squares[rows] += slope ** 2
            model.weights[rows] -= rate * slope / np.sqrt(squares[rows])
            slope = (moves - seen) / len(some) + decay * model.moves
            move_squares += slope ** 2
            model.moves -= rate * slope / np.sqrt(move_squares)
    return model


class Tagger:
    """Applies a model to texts; emission rows of words are remembered between batches."""

    def __init__(self, model: Model) -> None:
        self.model, self.move = model, np.exp(model.moves)
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.labels)))

    def _places(self, words: list[str]) -> np.ndarray:
        """Row number of each word's potentials; -1 for runs without a letter."""
        if len(self.memo) > MEMO:
            self.memo, self.rows = {}, self.rows[:0]
        new = [w for w in set(words) if w not in self.memo]
        if new:
            real = sorted(w for w in new if w.isalpha() or any(map(str.isalpha, w)))
            scores = self.model.emissions(real)
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            self.memo.update(dict.fromkeys(new, -1))
            self.memo.update(zip(real, range(len(self.rows), len(self.rows) + len(real))))
            self.rows = np.concatenate((self.rows, np.maximum(scores, 1e-12)))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def marginals(self, lengths: np.ndarray, potential: np.ndarray) -> np.ndarray:
        """Word probabilities of texts laid end to end."""
        k, move = potential.shape[1], self.move
        segments = -(-lengths // SEGMENT)
        first = np.cumsum(segments) - segments
        total = int(segments.sum())
        text = np.repeat(np.arange(len(lengths)), segments)
        rank = np.arange(total) - first[text]
        size = np.minimum(SEGMENT, lengths[text] - rank * SEGMENT)
        begin = (np.cumsum(lengths) - lengths)[text] + rank * SEGMENT
        steps = np.arange(SEGMENT)
        alive = steps[:, None] < size
        place = np.where(alive, begin + steps[:, None], 0)
        grid = potential[place]
        carry = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for i in range(SEGMENT):
            live = alive[i]
            step = (carry[live] @ move) * grid[i, live][:, None, :]
            carry[live] = step / step.sum(axis=(1, 2), keepdims=True)
        enter, leave = np.ones((total, k)), np.ones((total, k))
        for r in range(1, int(segments.max(initial=0))):
            at = (first + r)[segments > r]
            step = np.einsum("nj,njk->nk", enter[at - 1], carry[at - 1])
            enter[at] = step / step.sum(axis=1, keepdims=True)
        for r in range(int(segments.max(initial=0)) - 1, 0, -1):
            at = (first + r)[segments > r]
            step = np.einsum("njk,nk->nj", carry[at], leave[at])
            leave[at - 1] = step / step.sum(axis=1, keepdims=True)
        alpha = np.empty((SEGMENT, total, k))
        now = enter
        for i in range(SEGMENT):
            step = (now @ move) * grid[i]
            step /= step.sum(axis=1, keepdims=True)
            now = alpha[i] = np.where(alive[i, :, None], step, now)
        now = leave
        for i in range(SEGMENT - 1, -1, -1):
            alpha[i] *= now
            step = (now * grid[i]) @ move.T
            step /= step.sum(axis=1, keepdims=True)
            now = np.where(alive[i, :, None], step, now)
        out = alpha.transpose(1, 0, 2)[alive.T]
        return out / out.sum(axis=1, keepdims=True)

    def texts(self, texts: list[str | None], words: bool = False) -> list[tuple[str, float, list]]:
        """(language, score, runs) of each text; runs of equally labelled words only if asked for."""
        out: list[tuple[str, float, list]] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size > SUB_BATCH:
                out += self._some(held, words)
                held, size = [], 0
        return out + self._some(held, words)

    def _some(self, held: list[list[str]], words: bool) -> list[tuple[str, float, list]]:
        labels = self.model.labels
        if not labels:
            return [(UNKNOWN, 0.0, [])] * len(held)
        places = self._places([w for text in held for w in text])
        number = np.repeat(np.arange(len(held)), [len(text) for text in held])
        real = places >= 0
        places, number = places[real], number[real]
        lengths = np.bincount(number, minlength=len(held))
        found = self.marginals(lengths[lengths > 0], self.rows[places]) if len(places) else self.rows[:0]
        means = np.zeros((len(held), len(labels)))
        for k in range(len(labels)):
            means[:, k] = np.bincount(number, found[:, k], len(held))
        means /= np.maximum(lengths, 1)[:, None]
        best = means.argmax(axis=1)
        out = [(labels[b], min(1.0, float(m[b])), []) if n else (UNKNOWN, 0.0, [])
               for b, m, n in zip(best, means, lengths)]
        if words:
            chosen, ends = found.argmax(axis=1), np.cumsum(lengths)
            for n, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
                part = chosen[a:b]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if b > a else []
                for s, e in zip(starts, [*starts[1:], b - a]):
                    out[n][2].append({"label": labels[part[s]], "start": int(s), "words": int(e - s)})
                out[n] = (out[n][0], out[n][1], list(out[n][2]))
        return out


def training_runs(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "lang", rows_per_label: int = ROWS_PER_LABEL, spans: int = SPANS,
                  span: int = SPAN) -> list[tuple[str, list[str]]]:
    """Runs of words from a bounded, hashed sample of the rows that may be learned from."""
    usable = docs.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
                        & F.col(text_col).isNotNull())
    counts = usable.groupBy(F.col(label_col).alias("label")).count().collect()
    if not counts:
        return []
    whole = 1_000_000
    share = F.create_map(*[x for r in counts
                           for x in (F.lit(r["label"]), F.lit(min(whole, -(-rows_per_label * whole // r["count"]))))])
    chosen = usable.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(whole)) < share[F.col(label_col)])

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for label, text in zip(batch["label"], batch["text"]):
                words = words_of(text)
                steps = max(1, len(words) - span + 1)
                for i in range(min(spans, -(-len(words) // span))):
                    at = steps * i // spans
                    rows.append((label, " ".join(words[at:at + span])))
            yield pd.DataFrame(rows, columns=["label", "words"])

    picked = chosen.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    # the hash picks about rows_per_label rows a language; the limit holds where very many rows share an id
    bound = 4 * rows_per_label * spans * len(counts)
    found = picked.mapInPandas(take, "label string, words string").limit(bound).collect()
    return [(r.label, r.words.split()) for r in found]


def tagger(spark: SparkSession, model: Model, words: bool = False):
    """A column function from texts to (label, score), and with ``words`` also ``runs``: the labelled runs of words."""
    shared = spark.sparkContext.broadcast(model)
    kind = "label string, score double" + (", runs array<struct<label: string, start: long, words: long>>" * words)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        applied = Tagger(shared.value)
        for texts in batches:
            found = applied.texts(texts.tolist(), words)
            columns = {"label": [f[0] for f in found], "score": [f[1] for f in found]}
            yield pd.DataFrame(columns | ({"runs": [f[2] for f in found]} if words else {}))

    return F.pandas_udf(of, kind)


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           words: bool = False) -> DataFrame:
    """(id, label, score[, runs]) of every row."""
    of = tagger(docs.sparkSession, model, words)
    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("r")).select("id", "r.*")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The documents with letters whose language is at least ``least`` probable."""
    of = tagger(docs.sparkSession, model)
    marked = docs.withColumn("__language", of(F.col(text_col)))
    return marked.where((F.col("__language.label") != UNKNOWN) & (F.col("__language.score") >= least)).select(*docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(remainder(id_col, 4) == 2, F.lit(False))


def trained(docs: DataFrame) -> Model:
    return fit(training_runs(docs, remainder("doc_id", 4) != 2))


def op8_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language; documents with id remainder 2 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    found = detect(docs, trained(docs))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), F.col("label").alias("lang_pred"),
                        "score")
