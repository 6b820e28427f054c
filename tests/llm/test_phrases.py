import random
import re
from collections import Counter
from functools import reduce

import duckdb
import numpy as np
import pytest

from veilspark.llm import phrases

SF = "/root/testdata/sf0.01"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def plain(rows, least=10, share=50, first=2000, most=3):
    """The contract by dictionaries."""
    f, out = {}, []
    for lang, text in rows:
        for words in pieces(text):
            for n in range(1, most + 1):
                f.setdefault(lang or "und", Counter()).update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    for lang, c in f.items():
        total = sum(n for p, n in c.items() if len(p) == 1)
        candidates, kept = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        covered = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i:i + n]] = max(covered[p[i:i + n]], a)
        for p, a in candidates.items():
            if 100 * covered[p] < share * a:
                score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def result(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def invented(draw, words, n):
    return "".join(draw.choice(words) + draw.choice([" ", " ", " ", " ", "\t", ". ", ",", "\n", "  ", "...", ".\n"]) for _ in range(n))


@pytest.mark.parametrize("settings", [{}, {"period": 1}, {"period": 2, "longest": 5}, {"period": 10_000, "longest": 7},
                                      {"most_bits": phrases.BLOCK}, {"most_words": 4}, {"most_words": 2}])
def test_counts_whatever_the_parse(spark, settings):
    draw = random.Random(21)
    words = ["The", "of", "a", "Ünder", "x-y", "é", "it's", "日本", "(z)", "q"]
    passage = invented(draw, words, 200)
    rows = [(draw.choice(["en", "de", None]), invented(draw, words, draw.randrange(0, 60))) for _ in range(150)]
    rows += [("en", passage)] * 30 + [("fr", "a " * 3000), ("en", None), ("en", ""), (None, " . ! ")]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = phrases.top(frame, **settings)
    assert result(found) == plain(rows, most=settings.get("most_words", 3))


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(db.sql(f"select {', '.join(COLUMNS)} from ({phrases.ORACLE})").fetchall())
    assert result(phrases.op12_prefix_free(spark, SF)) == want and len(want) > 1000


def test_chunks_overlap_by_a_trigger(spark):
    draw = random.Random(22)
    words = phrases.tokens(invented(draw, ["a", "b", "c", "d", "e"], 5000).encode(), 2)
    memo = phrases.WordHashes()
    starts = phrases.chunk_starts(memo.of(words), 2, 16, 4096)
    assert starts[0] == 0 and len(starts) > 50
    chunks = [tuple(words[a:b]) for a, b in zip(starts, [*(s + 2 for s in starts[1:]), len(words)])]
    assert reduce(lambda x, y: x + y[2:], chunks) == tuple(words)
    whole = set(chunks)
    assert not any(c != d and d[:len(c)] == c for c in whole for d in whole)


def test_bits_hold_every_frequent_hash(spark):
    draw = np.random.default_rng(23)
    hashes = draw.integers(-(1 << 63), (1 << 63) - 1, 5000)
    rows = [(int(h), int(n)) for h, n in zip(hashes, draw.integers(1, 20, 5000))]
    often = np.array([h for h, n in rows if n >= 10]).view(np.uint64)
    for most in (phrases.BITS, phrases.BLOCK):
        bits = phrases.bitmap(spark.createDataFrame(rows, "hash long, n long"), 10, most)
        assert phrases.marked(bits, often).all()
    rare = np.array([h for h, n in rows if n < 10]).view(np.uint64)
    assert phrases.marked(phrases.bitmap(spark.createDataFrame(rows, "hash long, n long"), 10), rare).mean() < 0.2


def test_odd_rows(spark):
    rows = [("en", bytearray(b"\xff\xfe Bad \xc3 bytes. ")) for _ in range(12)] + [("en", None), (None, bytearray(b"a b"))]
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "lang string, text binary, n int, chunk int, gram int")
    found = phrases.top(frame).collect()
    assert [(r.words, r.a, r.n) for r in found] == [(4, 12, 48)] or [(r.words, r.a, r.n) for r in found] == [(3, 12, 48)] * 2
    assert phrases.top(frame.limit(0)).count() == 0
    huge = spark.createDataFrame([("en", b"a", [0], 10 ** 14), ("en", b"b", [0], 10 ** 14), ("en", b"a b", [0, 2], 10 ** 14 - 1)],
                                 "lang string, gram binary, starts array<int>, n long")
    assert [r.score for r in phrases.collocations(huge).collect()] == [1_000_000 * (10 ** 14 - 1) ** 2 // 10 ** 28]
