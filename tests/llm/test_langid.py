import zlib

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import langid
from veilspark.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_marginals(potential, move):
    """Forward and backward messages of one text, word by word."""
    n, k = potential.shape
    forward, backward = np.zeros((n, k)), np.ones((n, k))
    now = np.ones(k)
    for i in range(n):
        now = (now @ move) * potential[i]
        now = forward[i] = now / now.sum()
    for i in range(n - 2, -1, -1):
        backward[i] = move @ (potential[i + 1] * backward[i + 1])
        backward[i] /= backward[i].sum()
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def test_segments_equal_plain_forward_backward():
    draw = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"])
    model.moves = draw.normal(size=(3, 3))
    lengths = np.array([1, 64, 65, 300, 2, 128, 127])
    potential = np.exp(draw.normal(size=(lengths.sum(), 3)))
    found = langid.Tagger(model).marginals(lengths, potential)
    ends = np.cumsum(lengths)
    for a, b in zip(ends - lengths, ends):
        assert np.allclose(found[a:b], plain_marginals(potential[a:b], np.exp(model.moves)))


def test_gradient_matches_differences():
    draw = np.random.default_rng(2)
    alive = np.array([[True, True, True], [True, True, False]])
    score, moves = draw.normal(size=(2, 3, 2)), draw.normal(size=(2, 2))

    def log_sum(score, moves):
        total = 0.0
        for b in range(2):
            now = np.zeros(2)
            for t in range(int(alive[b].sum())):
                now = np.log(np.exp(now[:, None] + moves).sum(axis=0)) + score[b, t]
            total += np.log(np.exp(now).sum())
        return total

    marginal, pairs = langid._forward_backward(np.exp(score), alive, np.exp(moves))
    for at in ((0, 1, 0), (1, 1, 1), (1, 0, 0)):
        step = np.zeros_like(score)
        step[at] = 1e-5
        assert np.isclose((log_sum(score + step, moves) - log_sum(score - step, moves)) / 2e-5, marginal[at], atol=1e-6)
    for at in ((0, 1), (1, 1)):
        step = np.zeros_like(moves)
        step[at] = 1e-5
        assert np.isclose((log_sum(score, moves + step) - log_sum(score, moves - step)) / 2e-5, pairs[at], atol=1e-6)


def test_query_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    found = langid.op8_langid_crf(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    kept = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in kept) / len(kept) > 0.98


def test_code_switched_words(spark):
    docs = table(spark, SF, "documents")
    model = langid.trained(docs)
    parts = {r.lang: r.text for r in docs.where("n_chars > 600").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = " ".join([parts["en"][:300], parts["fr"][:300], parts["en"][300:600]])
    frame = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    runs = langid.detect(frame, model, words=True).first().runs
    assert [r.label for r in runs if r.words > 5] == ["en", "fr", "en"]
    assert sum(r.words for r in runs) == len(langid.words_of(mixed))


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ³ !", "en"), (None, "the cat sat", "en"), (4, "the cat sat", None),
            (5, "the cat and the hat " * 4000, "en"), (5, "le chat et le chapeau", "fr"), (7, "le chat est la", "fr")]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in rows], "doc_id long, text string, lang string, r int")
    model = langid.trained(docs)
    found = [(r.id, r.label) for r in langid.detect(docs, model).collect()]
    assert [x for x in found if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert len(found) == len(rows)
    none = langid.trained(docs.limit(0))
    assert none.labels == []
    assert {r.label for r in langid.detect(docs, none).collect()} == {"und"}
    assert langid.detect(docs.limit(0), model).count() == 0


def test_features_of_many_words_are_laid_out_in_blocks():
    import tracemalloc

    model = langid.Model(["a", "b"])
    model.weights[:] = np.random.default_rng(0).normal(size=model.weights.shape)
    words = [f"woord{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}y{i}" for i in range(60_000)]
    tracemalloc.start()
    scores = model.emissions(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    assert (scores[25_000:25_010] == model.emissions(words[25_000:25_010])).all()
