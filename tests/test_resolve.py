"""Span-set operators: array form, row form and plain Python agree."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.catalog import NER_ENTITIES
from veilspark.functions import resolve as R
from veilspark.functions.spans import SPANS_TYPE
from veilspark.operators import rows as rows_form

PATTERN_TYPES = ["EMAIL", "CASE_NO", "DATE_TIME"]
TYPES = PATTERN_TYPES + ["PERSON", "LOCATION", "NORP"]


def random_docs(seed, docs=150, most=14, width=40):
    rng = random.Random(seed)
    out = []
    for d in range(docs):
        spans = set()
        for _ in range(rng.randrange(most)):
            start = rng.randrange(width)
            kind = rng.choice(TYPES)
            recognizer = rng.choice(["p", "gliner"]) if kind in ("DATE_TIME", "NORP") else "p"
            spans.add((kind, start, start + rng.randrange(1, 12), rng.choice([0.4, 0.5, 0.6, 0.85]), recognizer))
        out.append((d, sorted(spans)))
    # spans across bucket and chunk borders
    out.append((docs, [("CASE_NO", 0, 70000, 0.5, "p"), ("CASE_NO", 69990, 140000, 0.6, "p"),
                       ("EMAIL", 500, 520, 0.6, "p"), ("PERSON", 515, 600, 0.85, "p"),
                       ("PERSON", 200000, 200010, 0.85, "p"), ("EMAIL", 139990, 140010, 0.6, "p")]))
    return out


def frame(spark, data):
    rows = [(d, [(k, None, s, e, sc, r, "x") for k, s, e, sc, r in spans]) for d, spans in data]
    return spark.createDataFrame(rows, f"doc_id bigint, spans {SPANS_TYPE}")


def array_result(df, sql, full=True):
    out = {}
    for r in df.select("doc_id", F.expr(sql).alias("x")).collect():
        out[r.doc_id] = {(s.entity_type, s.start, s.end, s.score) for s in r.x}
        assert len(out[r.doc_id]) == len(r.x)
    return out


def row_result(df, data):
    out = {d: set() for d, _ in data}
    for r in df.collect():
        out[r.doc_id].add((r.entity_type, r.start, r.end, r.score))
    return out


def long_form(df):
    return df.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def brute_dedup(spans):
    return {(a[0], a[1], a[2], a[3]) for a in spans if not any(
        b[:4] != a[:4] and b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3] for b in spans)}


def brute_ner(spans):
    blockers = [s for s in spans if s[0] in PATTERN_TYPES]

    def dropped(s):
        hit = any(s[1] < b[2] and s[2] > b[1] for b in blockers)
        return hit and (s[0] in NER_ENTITIES or (s[4] == "gliner" and s[0] in PATTERN_TYPES))

    return {s[:4] for s in spans if not dropped(s)}


def brute_resolve(spans):
    merged = []
    for kind in sorted({s[0] for s in spans}):
        groups = []
        for s in sorted((s for s in spans if s[0] == kind), key=lambda s: s[1]):
            if groups and s[1] < groups[-1][2]:
                g = groups[-1]
                groups[-1] = (kind, g[1], max(g[2], s[2]), max(g[3], s[3]))
            else:
                groups.append(s[:4])
        merged += groups
    kept = [a for a in merged if not any(
        b is not a and (
            ((b[1], b[2]) == (a[1], a[2]) and (-b[3], b[0]) < (-a[3], a[0]))
            or ((b[1], b[2]) != (a[1], a[2]) and b[1] <= a[1] and b[2] >= a[2])) for b in merged)]
    kept.sort(key=lambda s: s[1])
    return {(k, s, min(e, kept[i + 1][1]) if i + 1 < len(kept) else e, sc)
            for i, (k, s, e, sc) in enumerate(kept)}


@pytest.fixture(scope="module")
def data():
    return random_docs(3)


def test_dedup(spark, data):
    df = frame(spark, data)
    want = {d: brute_dedup(s) for d, s in data}
    assert array_result(df, R.dedup_same_type("spans")) == want
    assert row_result(rows_form.dedup_same_type(long_form(df)), data) == want


def test_ner_overlaps(spark, data):
    df = frame(spark, data)
    want = {d: brute_ner(s) for d, s in data}
    got = {}
    for r in df.select("doc_id", F.expr(R.drop_ner_overlaps("spans", PATTERN_TYPES, NER_ENTITIES)).alias("x")).collect():
        got[r.doc_id] = {(s.entity_type, s.start, s.end, s.score) for s in r.x}
    assert got == want
    assert row_result(rows_form.drop_ner_overlaps(long_form(df), PATTERN_TYPES), data) == want


def test_resolve(spark, data):
    df = frame(spark, data)
    want = {d: brute_resolve(s) for d, s in data}
    assert array_result(df, R.resolve_conflicts("spans")) == want
    assert row_result(rows_form.resolve_conflicts(long_form(df)), data) == want


def test_merge(spark, data):
    df = frame(spark, data)
    assert array_result(df, R.merge_same_type("spans")) == row_result(
        rows_form.merge_same_type(long_form(df)), data)


def test_resolved_spans_are_disjoint_and_ordered(spark, data):
    for r in frame(spark, data).select(F.expr(R.resolve_conflicts("spans")).alias("x")).collect():
        ends = [0] + [s.end for s in r.x]
        assert all(s.start >= e and s.end > s.start for s, e in zip(r.x, ends))


def test_stable_order(spark, data):
    for r in frame(spark, data).select(F.expr(R.stable_order("spans")).alias("x")).collect():
        keys = [(-s.score, s.start, -s.end, s.entity_type) for s in r.x]
        assert keys == sorted(keys)


def test_touching_spans_do_not_overlap(spark):
    df = frame(spark, [(0, [("EMAIL", 0, 5, 0.6, "p"), ("PERSON", 5, 9, 0.85, "p")])])
    got = array_result(df, R.drop_ner_overlaps("spans", PATTERN_TYPES, NER_ENTITIES))
    assert len(got[0]) == 2


def test_cross_type_spans_stay(found):
    kinds = {(r[1], r[2], r[3]) for r in found("Bel 0612345678.")}
    assert kinds == {("PHONE_NUMBER", 4, 14), ("DRIVERS_LICENSE", 4, 14)}


def test_many_spans_in_one_row(spark):
    n = 5000
    spans = [("EMAIL", i * 4, i * 4 + 5, 0.5, "p") for i in range(n)]
    df = frame(spark, [(0, spans)])
    assert array_result(df, R.resolve_conflicts("spans")) == {0: {("EMAIL", 0, 4 * (n - 1) + 5, 0.5)}}


def test_hot_document_is_split(spark):
    """One document holds nearly all spans; the overlap join's keys stay small."""
    df = spark.range(20000).selectExpr(
        "0L as doc_id", "if(id % 2 = 0, 'EMAIL', 'PERSON') as entity_type", "cast(null as string) as text",
        "cast(id * 10 as int) as start", "cast(id * 10 + 12 as int) as end", "0.5D as score",
        "'p' as recognizer", "'x' as pattern")
    sizes = rows_form.with_buckets(df).groupBy("doc_id", "_bucket").count().agg(F.max("count")).first()[0]
    assert sizes <= rows_form.BUCKET / 10 + 3
    kept = rows_form.drop_ner_overlaps(df, ["EMAIL"])
    assert kept.count() == 10000 and kept.filter("entity_type = 'PERSON'").count() == 0
