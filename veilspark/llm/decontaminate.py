"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised to lower-case runs of letters and digits joined by one space. An item of
``m`` characters leaks where a region of a text is within ``e`` edits of it, ``e = min(rate * m, (m - q) // q)`` rounded
down. Such a region shares at least ``m - q + 1 - q * e`` character q-grams with the item, and their diagonals (place in
the text less place in the item) differ by at most ``e``. So shared q-grams are counted in bands of diagonals, each
wider than its step by ``e`` and thus overlapping the next; bands that reach the bound are retained and verified
by an alignment that stays within the band, with free ends in the text. An item's most frequent q-grams, two thirds
as many as its bound, are left out of the count and the bound is lowered by as many, which loses nothing.

Items of fewer than ``q`` characters have no edit budget; they leak where their words stand in a text as they are.

The item index goes to the executors as a broadcast of at most about ``block_chars`` item characters; a larger benchmark is
taken in several blocks, one scan of the texts each, whose results are written before the next block is read. Texts are not shuffled. Long texts are searched in pieces that
overlap by more than the longest region, so memory is bounded and nothing is missed at their borders.

Results for odd input: null and empty texts leak nothing; items that are null or without a letter or digit take no
part; bytes that are no UTF-8 count as the replacement character; equal items are each reported; a null ``doc_id`` or item id is reported as null; repeated
rows are reported each; empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import cut, discard, table

Q = 8
RATE = 0.08
STEP = 16
BLOCK_CHARS = 8_000_000
PIECE = 1 << 20
ALIGNED = 256
BITS = 22
_TOKEN = re.compile(r"[^\W_]+")
_P1 = np.uint64(0x9E3779B97F4A7C15)
_EDIT = 1 << 32
_FAR = 1 << 50


def normalise(text: str | None) -> str:
    return " ".join(_TOKEN.findall(text.lower())) if text else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each q characters, built by doubling; ``q`` is a power of two."""
    out, width, factor = codes, 1, int(_P1)
    while width < q:
        n = max(0, len(out) - width)
        out = out[:n] * np.uint64(factor) + out[width:width + n]
        factor = factor * factor % (1 << 64)
        width *= 2
    return out * _P1


def budget(m: int, q: int, rate: float) -> int:
    return min(math.floor(rate * m), (m - q) // q)


class ItemIndex:
    """Sorted q-grams of the items, where each occurs, and every item's edit budget and bound."""

    def __init__(self, items: list[tuple[object, str]], q: int, rate: float) -> None:
        kept = [(i, t) for i, t in items if len(t) >= q]
        self.q = q
        self.short: dict[str, list] = {}
        for i, t in items:
            if 0 < len(t) < q:
                self.short.setdefault(t, []).append(i)
        self.short_words = sorted({t.count(" ") + 1 for t in self.short})
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.codes = [codes_of(t) for t in self.texts]
        self.m = np.array([len(t) for t in self.texts], np.int64)
        self.e = np.array([budget(len(t), q, rate) for t in self.texts], np.int64)
        self.least = self.m - q + 1 - q * self.e
        self.step = np.maximum(STEP, self.e)
        grams = [qgrams(c, q) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        common = np.unique(flat, return_inverse=True, return_counts=True)
        rarest_first = np.lexsort((place, common[2][common[1]], item))
        left_out = self.least * 2 // 3
        self.least = self.least - left_out
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(self.m - q + 1) - (self.m - q + 1), self.m - q + 1)
        counted = rarest_first[rank < np.repeat(self.m - q + 1 - left_out, self.m - q + 1)]
        flat, item, place = flat[counted], item[counted], place[counted]
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.keys >> np.uint64(64 - BITS)] = True
        self.reach = int(self.m.max() + self.e.max() + self.step.max()) if kept else 0

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text place, item, item place) of every shared q-gram."""
        grams = qgrams(codes, self.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(64 - BITS)])
        found = np.searchsorted(self.keys, grams[at])
        right = self.keys[np.minimum(found, len(self.keys) - 1)] == grams[at]
        at, found = at[right], found[right]
        counts = self.bounds[found + 1] - self.bounds[found]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        entry = np.repeat(self.bounds[found] - (ends - counts), counts) + np.arange(total)
        return np.repeat(at, counts), self.item[entry], self.place[entry]

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the bands whose shared q-grams reach the item's bound."""
        at, item, place = self.hits(codes)
        shift = self.reach + STEP
        diagonal, step = at - place + shift, self.step[item]
        band, over = np.divmod(diagonal, step)
        also = over < self.e[item]
        keys = np.concatenate((item << 40 | band, item[also] << 40 | band[also] - 1))
        keys, counts = np.unique(keys, return_counts=True)
        keys = keys[counts >= self.least[keys >> 40]]
        item, band = keys >> 40, keys & ((1 << 40) - 1)
        return list(zip(item.tolist(), (band * self.step[item] - shift).tolist()))

    def align(self, bands: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int] | None]:
        """(start, end, edits) of the best region on each band's diagonals, or None if it is over the budget.

        ``bands``: item, lowest diagonal, the text's codes. All bands advance together, one item character a step.
        Cost and start travel in one number; of equal regions the latest start, then the first end.
        """
        items = np.array([b[0] for b in bands])
        m, e, size = self.m[items], self.e[items], np.array([len(b[2]) for b in bands])[:, None]
        low = (np.array([b[1] for b in bands]) - e)[:, None]
        width = self.step[items] + 3 * e + 1
        k = np.arange(int(width.max()))
        ramp, outside = k * _EDIT, k >= width[:, None]
        pattern = np.zeros((len(bands), int(m.max())), np.uint32)
        padded = np.zeros((len(bands), len(k) + pattern.shape[1] + 1), np.uint32)
        for n, (item, _, codes) in enumerate(bands):
            pattern[n, :m[n]] = self.codes[item]
            a, b = max(0, low[n, 0]), min(len(codes), low[n, 0] + padded.shape[1])
            if a < b:
                padded[n, a - low[n, 0]:b - low[n, 0]] = codes[a:b]
        ends = low + k
        cost = np.where((ends >= 0) & (ends <= size) & ~outside, (1 << 31) - ends, _FAR)
        out: list[tuple[int, int, int] | None] = [None] * len(bands)
        for i in range(1, pattern.shape[1] + 1):
            ends = low + i + k
            step = cost + (padded[:, i - 1:i - 1 + len(k)] != pattern[:, i - 1:i]) * _EDIT
            np.minimum(step[:, :-1], cost[:, 1:] + _EDIT, out=step[:, :-1])
            step[(ends < 1) | (ends > size) | outside] = _FAR
            cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
            for n in np.flatnonzero(m == i).tolist():
                best = int(np.argmin(cost[n]))
                value = int(cost[n, best])
                if value >> 32 <= e[n]:
                    out[n] = (1 << 31) - (value & (_EDIT - 1)), int(low[n, 0]) + i + best, value >> 32
        return out

    def search_short(self, texts: list[str]) -> list[tuple[int, object, int, int]]:
        """(text, item id, start, end) of the items below ``q`` characters, as whole words of normalised texts."""
        out = []
        for n, text in enumerate(texts if self.short else ()):
            bounds = np.flatnonzero(codes_of(f" {text} ") == 32).tolist()
            for words in self.short_words:
                for a, b in zip(bounds, bounds[words:]):
                    if b - a <= self.q:
                        out += [(n, i, a, b - 1) for i in self.short.get(text[a:b - 1], ())]
        return out

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the leaks in normalised texts; of overlapping regions the best."""
        if not self.ids:
            return []
        found: dict[tuple[int, int], set] = {}
        batch: list[tuple[int, int, str]] = []
        size = 0
        for n, text in enumerate(texts):
            for at in range(0, max(1, len(text)), PIECE):
                part = text[at:at + PIECE + 2 * self.reach]
                batch.append((n, at, part))
                size += len(part)
                if size >= PIECE:
                    self._search(batch, found)
                    batch, size = [], 0
        self._search(batch, found)
        out = []
        for (n, item), regions in found.items():
            taken: list[tuple[int, int]] = []  # apart from each other, in order
            for edits, start, end in sorted(regions):
                at = bisect(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end))
                    out.append((n, item, start, end, edits))
        return sorted(out)

    def _search(self, batch: list[tuple[int, int, str]], found: dict) -> None:
        if not batch:
            return
        starts = np.cumsum([0] + [len(p[2]) + 1 for p in batch])
        codes = codes_of("\n".join(p[2] for p in batch))
        wanted: list[tuple[int, int, int]] = []
        for item, low in self.bands(codes):
            m, e, step = int(self.m[item]), int(self.e[item]), int(self.step[item])
            first = max(0, int(np.searchsorted(starts, max(0, low - e), "right")) - 1)
            last = min(len(batch) - 1, int(np.searchsorted(starts, max(0, low + step + m + 2 * e), "right")) - 1)
            wanted += [(item, low, p) for p in range(first, last + 1)]
        wanted.sort(key=lambda w: (self.m[w[0]], w))
        for at in range(0, len(wanted), ALIGNED):
            some = wanted[at:at + ALIGNED]
            bands = [(item, low - int(starts[p]), codes[starts[p]:starts[p] + len(batch[p][2])]) for item, low, p in some]
            for (item, _, p), region in zip(some, self.align(bands)):
                if region:
                    n, begins, _ = batch[p]
                    found.setdefault((n, item), set()).add((region[2], region[0] + begins, region[1] + begins))


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            texts = [normalise(t) for t in batch["text"]]
            leaks = [(n, index.ids[i], *region) for n, i, *region in index.search(texts)]
            leaks += [(*found, 0) for found in index.search_short(texts)]
            ids = batch["id"].tolist()
            yield pd.DataFrame({
                "id": pd.Series([ids[n] for n, *_ in leaks], dtype=object),
                "item": pd.Series([i for _, i, *_ in leaks], dtype=object),
                "start": [r[2] for r in leaks], "end": [r[3] for r in leaks], "edits": [r[4] for r in leaks]})

    return run


def _leaked(shared):
    def of(texts: pd.Series) -> pd.Series:
        index, known = shared.value, [normalise(t) for t in texts]
        found = {n for n, *_ in index.search(known)} | {n for n, *_ in index.search_short(known)}
        return pd.Series([n in found for n in range(len(texts))], dtype=bool)

    return of


def _blocks(items: DataFrame, text_col: str, block_chars: int) -> int:
    chars = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(1, math.ceil(chars / block_chars))


def _index(items: DataFrame, item_col: str, text_col: str, q: int, rate: float, block: int, blocks: int):
    """Broadcast index of one block of the benchmark."""
    known = items.select(F.col(item_col).cast("string").alias("item"), F.make_valid_utf8(text_col).alias("text"))
    rows = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
    return items.sparkSession.sparkContext.broadcast(ItemIndex([(r.item, normalise(r.text)) for r in rows], q, rate))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, start, end, edits) with offsets in the normalised text: one row per leaked region.

    Ids come as strings, whatever their type, so that nulls and large numbers stay exact.
    """
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.make_valid_utf8(text_col).alias("text"))
    blocks, out = _blocks(items, item_text_col, block_chars), None
    for block in range(blocks):
        shared = _index(items, item_col, item_text_col, q, rate, block, blocks)
        found = texts.mapInPandas(_scan(shared), "id string, item string, start long, end long, edits long")
        if blocks > 1:
            found = cut(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", q: int = Q, rate: float = RATE,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item; no shuffle."""
    blocks, out = _blocks(items, item_text_col, block_chars), docs
    for block in range(blocks):
        shared = _index(items, item_col, item_text_col, q, rate, block, blocks)
        kept = out.where(~F.pandas_udf(_leaked(shared), "boolean")(F.make_valid_utf8(text_col)))
        if blocks > 1:
            before, kept = out, cut(kept, "clean")
            shared.destroy()
            if block:
                discard(before)
        out = kept
    return out


def op7_qgram_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked benchmark regions: document, item, region in the normalised text, edits."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").cast("long").alias("doc_id"), F.col("item").cast("long").alias("item_id"),
                        "start", "end", "edits")
