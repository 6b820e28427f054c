"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and of the first ``STEM`` letters of longer ones, hashed into ``2 ** BITS``
buckets. Its score is a bias, a weight for each term, and for each pair of terms the product of their learned factor
vectors, so that a pair such as an insult with a group mention counts beyond the sum of its parts; the pairs are summed
in time linear in the terms.

The model is fitted on the driver from a bounded sample of about ``rows_per_class`` labelled rows a class, chosen by a
hash of their id (one text an id). How strongly it learns pairs is chosen among ``SETTINGS`` on a fifth of these rows, held
back for that, and it is then fitted on all. Rows of the rarer class weigh more, by the square root of the ratio, so that scores lean to neither.
Only terms of at least ``MIN_ROWS`` sampled rows and ``MIN_SHARE`` of them get weights. Scoring covers every word of
every text and needs no shuffle.

Results for odd input: a null or empty text has no terms and gets the score of the bias; rows with null id, text or
label are not learned from; equal labels of one id count once; with labels of one class only the
score is that label, with none at all 0; repeated rows are each scored; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import remainder, table

BITS = 18
FACTORS = 8
STEM = 4
MIN_ROWS = 3
MIN_SHARE = 0.004
ROWS_PER_CLASS = 3000
MEMO = 1_000_000
START = 1e-3
FACTOR_RATE = 0.02
# (epochs, rate of the factors against that of the weights): weak and strong pairs
SETTINGS = ((16, FACTOR_RATE), (40, 0.3))
_TERM = re.compile(r"[^\W_]+")


def bucket(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) >> (64 - BITS)


class Buckets(dict):
    """The buckets of a word and its stem in one number, remembered for the words a worker meets again."""

    def __missing__(self, word: str) -> int:
        own = bucket(word)
        value = self[word] = own << BITS | (bucket(word[:STEM] + "-") if len(word) > STEM else own)
        return value

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        if len(self) > MEMO:
            self.clear()
        words = _TERM.findall(text.lower())
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.concatenate((both >> BITS, both & ((1 << BITS) - 1)))


def _sums(values: np.ndarray, number: np.ndarray, rows: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(number, values, rows).astype(float)  # of no values at all it counts in integers
    return np.stack([np.bincount(number, values[:, f], rows) for f in range(values.shape[1])], axis=1).astype(float)


class FactorizationMachine:
    def __init__(self, factors: int = FACTORS) -> None:
        self.bias = -math.inf
        self.weights = np.zeros(1 << BITS, np.float32)
        self.factors = np.zeros((1 << BITS, factors), np.float32)
        self.active = np.zeros(1 << BITS, bool)

    def raw(self, number: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Scores of rows from (row, term) pairs without repeats."""
        v = self.factors[term].astype(np.float64)
        sums, squares = _sums(v, number, rows), _sums((v * v).sum(axis=1), number, rows)
        return self.bias + _sums(self.weights[term], number, rows) + ((sums ** 2).sum(axis=1) - squares) / 2

    def pair(self, a: int, b: int) -> float:
        """The interaction of two buckets."""
        return float(self.factors[a] @ self.factors[b])

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probabilities of rows given as bucket numbers, repeats and unlearned ones included."""
        number = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        term = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        known = self.active[term]
        pairs = np.unique(number[known] << BITS | term[known])
        raw = self.raw(pairs >> BITS, pairs & ((1 << BITS) - 1), len(texts))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-raw))


def fit(rows: list[tuple[int, np.ndarray]], factors: int = FACTORS, epochs: int = 16,
        rate: float = 0.3, factor_rate: float = FACTOR_RATE, decay: float = 0.1, seed: int = 5) -> FactorizationMachine:
    """A machine from (label, distinct buckets) rows by AdaGrad on the logistic loss."""
    model = FactorizationMachine(factors)
    labels = np.array([y for y, _ in rows], float)
    if not len(rows) or labels.min() == labels.max():
        model.bias = math.inf if len(rows) and labels[0] else -math.inf
        return model
    balance = (len(rows) / (2 * np.array([(labels == 0).sum(), (labels == 1).sum()]))) ** 0.5
    draw = np.random.default_rng(seed)
    count = np.bincount(np.concatenate([t for _, t in rows]), minlength=1 << BITS)
    model.active = count >= max(MIN_ROWS, MIN_SHARE * len(rows))
    terms = [t[model.active[t]] for _, t in rows]
    model.factors[model.active] = draw.normal(0, 0.01, (int(model.active.sum()), factors))
    model.bias = 0.0
    squares_w, squares_v, squares_b = np.full(1 << BITS, START), np.full(model.factors.shape, START), START
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for low in range(0, len(order), 64):
            some = order[low:low + 64]
            number = np.repeat(np.arange(len(some)), [len(terms[i]) for i in some])
            term = np.concatenate([terms[i] for i in some])
            v = model.factors[term].astype(np.float64)
            sums = _sums(v, number, len(some))
            raw = (model.bias + _sums(model.weights[term], number, len(some))
                   + ((sums ** 2).sum(axis=1) - _sums((v * v).sum(axis=1), number, len(some))) / 2)
            error = (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - labels[some]) * balance[labels[some].astype(int)] / len(some)
            distinct, back = np.unique(term, return_inverse=True)
            slope = np.bincount(back, error[number], len(distinct)) + decay * model.weights[distinct] / len(some)
            squares_w[distinct] += slope ** 2
            model.weights[distinct] -= rate * slope / np.sqrt(squares_w[distinct])
            slope = _sums(error[number, None] * (sums[number] - v), back, len(distinct))
            slope += decay * model.factors[distinct] / len(some)
            squares_v[distinct] += slope ** 2
            model.factors[distinct] -= rate * factor_rate * slope / np.sqrt(squares_v[distinct])
            squares_b += error.sum() ** 2
            model.bias -= rate * error.sum() / math.sqrt(squares_b)
    return model


def log_losses(model: FactorizationMachine, rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    labels = np.array([y for y, _ in rows], float)
    p = np.clip(model.scores([t for _, t in rows]), 1e-6, 1 - 1e-6)
    return -(labels * np.log(p) + (1 - labels) * np.log(1 - p))


def chosen_fit(rows: list[tuple[int, np.ndarray]], seed: int = 5) -> FactorizationMachine:
    """A machine with weak or strong pairs (``SETTINGS``), by how either predicts a fifth of the rows when fitted on the rest.

    Strong ones learn pairs that no sum of weights can express, and overfit where labels have none; so they are
    taken only if they lose less by two standard errors. The machine returned is fitted on all rows.
    """
    held = np.random.default_rng(seed).random(len(rows)) < 0.2
    learn, check = ([r for r, h in zip(rows, held) if h == side] for side in (False, True))
    epochs, factor_rate = SETTINGS[0]
    if len({y for y, _ in learn}) == 2 and check:
        weak, strong = (log_losses(fit(learn, epochs=e, factor_rate=f, seed=seed), check) for e, f in SETTINGS)
        gain = weak - strong
        if gain.mean() > 2 * gain.std() / math.sqrt(len(gain)):
            epochs, factor_rate = SETTINGS[1]
    return fit(rows, epochs=epochs, factor_rate=factor_rate, seed=seed)


def trained(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> FactorizationMachine:
    """A machine from the labelled rows that ``learn`` (a condition on the id) allows."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1))
    usable = usable.where(learn)
    counts = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    if not counts:
        return fit([])
    whole = 1_000_000
    share = F.when(F.col("y") == 1, min(whole, -(-rows_per_class * whole // counts.get(1, 1)))).otherwise(
        min(whole, -(-rows_per_class * whole // counts.get(0, 1))))
    # about rows_per_class ids a class, and one text for each, so broadcast and sample have that bound at any size of the table
    chosen = F.broadcast(usable.where(F.pmod(F.xxhash64("id"), F.lit(whole)) < share).distinct())

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Buckets()
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "terms": [np.unique(memo.of(t)) for t in batch["text"]]})

    found = (docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")
             .mapInPandas(take, "y int, terms array<long>").collect())
    rows = sorted(((r.y, r.terms) for r in found))
    return chosen_fit([(y, np.array(t, np.int64)) for y, t in rows])


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Buckets()
        for texts in batches:
            parts = [shared.value.scores([memo.of(t) for t in texts.iloc[at:at + 256]])
                     for at in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("score"))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity; labels of ids with remainder 0 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"), remainder("id", 5) != 0)
    found = score(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 5) == 0, F.lit(False)).alias("held_out"),
                        "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
