import zlib

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import toxicity as tox
from veilspark.llm.common import table

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def area(labels, scores):
    ranks = np.argsort(np.argsort(scores)) + 1
    one = np.array(labels) == 1
    return (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_query_held_out(spark):
    labels = table(spark, SF, "labels").select("doc_id", "toxic")
    found = tox.op5_toxicity_fm(spark, SF).cache()
    assert found.count() == table(spark, SF, "documents").count()
    assert found.where("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.5 as int)").count() == 0
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert area([r.toxic for r in rows], [r.score for r in rows]) > 0.93


def test_pairs_beyond_the_sum():
    """An insult is toxic only beside a group mention: no additive weights separate the four kinds."""
    draw = np.random.default_rng(0)
    rows = []
    for _ in range(800):
        insult, group = draw.random(2) < 0.5
        words = [f"w{draw.integers(30)}" for _ in range(6)] + ["fool"] * int(insult) + ["folk"] * int(group)
        rows.append((int(insult == group), np.unique(tox.Buckets().of(" ".join(words)))))
    model = tox.chosen_fit(rows[:600])  # with the query's own settings
    right = [(model.scores([t])[0] > 0.5) == bool(y) for y, t in rows[600:]]
    assert np.mean(right) > 0.95


def test_sums_where_labels_have_no_pairs():
    draw = np.random.default_rng(2)
    rows = []
    for _ in range(700):
        words = [f"w{draw.integers(60)}" for _ in range(8)] + ["fool"] * int(draw.random() < 0.3)
        rows.append((int(("fool" in words) != (draw.random() < 0.1)), np.unique(tox.Buckets().of(" ".join(words)))))
    model, weak = tox.chosen_fit(rows[:500]), tox.fit(rows[:500])
    texts = [t for _, t in rows[500:]]
    assert np.allclose(model.scores(texts), weak.scores(texts))


def test_query_scores_are_those_of_the_machine(spark):
    """All scores recomputed from the fitted weights, word by word and pair by pair."""
    docs = table(spark, SMALL, "documents")
    model = tox.trained(docs, table(spark, SMALL, "labels"), tox.remainder("id", 5) != 0)
    memo, found = tox.Buckets(), {r.doc_id: r.score for r in tox.op5_toxicity_fm(spark, SMALL).collect()}
    for r in docs.collect():
        terms = sorted({int(t) for t in memo.of(r.text or "") if model.active[t]})
        v = model.factors[terms].astype(float)
        pairs = sum(float(v[i] @ v[j]) for i in range(len(terms)) for j in range(i))
        raw = model.bias + float(model.weights[terms].astype(float).sum()) + pairs
        assert np.isclose(found[r.doc_id], 1 / (1 + np.exp(-np.clip(raw, -700, 700))), atol=1e-9)


def test_sample_is_bounded_in_rows(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(tox, "chosen_fit", lambda rows: seen.append(len(rows)) or tox.fit(rows))
    tox.trained(docs, labels, F.lit(True))
    assert seen == [2]


def test_pair_sum_is_exact():
    draw = np.random.default_rng(1)
    model = tox.FactorizationMachine(3)
    model.bias, terms = 0.3, np.array([5, 9, 700, 4000])
    model.weights[terms], model.factors[terms], model.active[terms] = draw.normal(size=4), draw.normal(size=(4, 3)), True
    want = 0.3 + model.weights[terms].sum() + sum(model.pair(a, b) for a in terms for b in terms if a < b)
    raw = model.raw(np.zeros(4, int), terms, 1)[0]
    assert np.isclose(raw, want)
    assert np.isclose(model.scores([np.array([9, 9, 5, 4000, 700, 123])])[0], 1 / (1 + np.exp(-want)))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "bad words " * 20000, 1), (None, "bad", 1), (4, "fine", 1), (4, "fine", 1)],
        "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 1), (4, 0, 1), (None, 1, 1), (1, None, 1), (2, 0, 1)],
                                   "doc_id long, toxic int, text int")
    model = tox.trained(docs, labels, F.lit(True))
    found = tox.score(docs, model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    none = tox.trained(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in tox.score(docs, none).collect()} == {0.0}
    assert tox.score(docs.limit(0), model).count() == 0
