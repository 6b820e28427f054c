"""Span operators on inputs that are long, dense or cut in many places."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import resolve as R
from veilspark.functions.spans import SPANS_TYPE
from veilspark.operators import ner
from veilspark.operators import rows as rows_form
from veilspark.plans.analyze import explode_spans

SPAN = "entity_type string, text string, start int, end int, score double, recognizer string, pattern string"


def random_rows(seed, docs=30, most=60, longest=12):
    draw = random.Random(seed)
    out = []
    for i in range(docs):
        for _ in range(draw.randrange(most)):
            start = draw.randrange(300)
            end = start + (draw.randrange(1, longest) if draw.random() < 0.97 else draw.randrange(1, 200))
            out.append((i, draw.choice("ABC"), None, start, end, draw.choice([0.3, 0.5, 0.6]), "r", "p"))
    return out


def keyed(df):
    return sorted(tuple(r) for r in df.select("doc_id", "entity_type", "start", "end", "score").collect())


@pytest.mark.parametrize("groups", [1, 3, 1000])
def test_row_forms_equal_array_forms_over_chunk_borders(spark, monkeypatch, groups):
    monkeypatch.setattr(rows_form, "CHUNK", 16)
    monkeypatch.setattr(rows_form, "GROUP_CHUNKS", groups)
    spans = spark.createDataFrame(random_rows(41) + random_rows(42, 20, 15, 5), f"doc_id long, {SPAN}")
    arrays = rows_form.union_spans(spans).distinct().groupBy("doc_id").agg(F.collect_list(F.struct(
        "entity_type", "text", "start", "end", "score", "recognizer", "pattern")).alias("spans"))
    for of_rows, of_arrays in ((rows_form.resolve_conflicts, R.resolve_conflicts), (rows_form.merge_same_type, R.merge_same_type)):
        want = explode_spans(arrays.select("doc_id", F.expr(of_arrays("spans")).alias("s")), "doc_id", "s")
        assert keyed(of_rows(spans)) == keyed(want)
    none = spans.limit(0)
    assert rows_form.resolve_conflicts(none).count() == rows_form.merge_same_type(none).count() == 0


def test_ten_thousand_nested_spans(spark):
    n = 10_000
    scores = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.9]
    spans = [("A", None, i, 3 * n - i, scores[(i * 7919) % 8], "r", "p") for i in range(n)]
    best, want = -1.0, []
    for s in spans:
        if s[4] > best:
            best = s[4]
            want.append(s[2])
    frame = spark.createDataFrame([(spans,)], f"spans {SPANS_TYPE}")
    begun = time.time()
    kept = frame.select(F.expr(R.dedup_same_type("spans")).alias("s")).first().s
    assert sorted(s.start for s in kept) == want and time.time() - begun < 30


def test_long_runs_equal_pairwise_comparison(spark):
    draw = random.Random(43)
    for n in (33, 70, 200):
        spans = [("A", None, s, s + draw.randrange(20, 60), round(draw.random(), 1), "r", f"p{i}")
                 for i, s in enumerate(sorted(draw.randrange(100) for _ in range(n)))]
        ordered = sorted(spans, key=lambda s: (s[2], -s[3], -s[4], s[6]))
        want = [s for i, s in enumerate(ordered) if not any(o[3] >= s[3] and o[4] >= s[4] for o in ordered[:i])]
        kept = spark.createDataFrame([(spans,)], f"spans {SPANS_TYPE}").select(F.expr(R.dedup_same_type("spans")).alias("s")).first().s
        assert sorted(tuple(s) for s in kept) == sorted(want)


def boosted(frame, words, window):
    sql = ner.boost_sql("spans", "text", words, window, 0.35, 0.4)
    return [[round(s.score, 6) for s in r.s] for r in frame.select(F.expr(sql).alias("s")).collect()]


def test_context_near_and_far(spark):
    draw = random.Random(44)
    texts, expected = [], []
    for _ in range(40):
        words = [draw.choice(["kvk", "KVK", "a", "b", "c,", "d"]) for _ in range(draw.randrange(1, 200))]
        text, spans, want = " ".join(words), [], []
        tokens = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        for _ in range(draw.randrange(0, 8)):
            start = draw.randrange(len(text))
            end = start + draw.randrange(1, 12)
            kind = draw.choice("XY")
            spans.append((kind, None, start, end, 0.2, "r", "p"))
            near = [w for w, _, e in tokens if e <= start][-3:] + [w for w, s, _ in tokens if s >= end][:3]
            want.append(0.55 if kind == "X" and "kvk" in near else 0.2)
        texts.append((text, spans))
        expected.append(want)
    frame = spark.createDataFrame(texts, f"text string, spans {SPANS_TYPE}").coalesce(1)
    assert boosted(frame, {"X": ["Kvk"], "Y": []}, 3) == expected
    assert boosted(frame, {"X": ["kvk"]}, 0) == [[0.2] * len(w) for w in expected]


def test_context_of_many_spans_in_a_long_text(spark):
    text = " ".join("kvk" if i % 40 == 0 else f"w{i}" for i in range(20_000))
    spans = [("X", None, p, p + 1, 0.2, "r", "p") for p in range(0, 100_000, 100)]
    frame = spark.createDataFrame([(text, spans)], f"text string, spans {SPANS_TYPE}")
    begun = time.time()
    scores = boosted(frame, {"X": ["kvk"]}, 5)[0]
    assert 0 < sum(s > 0.5 for s in scores) < 1000 and time.time() - begun < 60
