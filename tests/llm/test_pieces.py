import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from veilspark.llm import pieces
from veilspark.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "   b c", "a   ", "<s> x", "\0a", "a\r\nb", "　x", "É😀 ñ", "\n\n", " \n x", "a" + " " * 40 + "b",
       " " * 37, "UPPER MiXed 12345 ---- ....", "<0x41>", "日本語テキスト", "क्षत्रिय", "x" * 500, "word " * 20000]


@pytest.fixture(scope="module")
def known():
    return pieces.Vocabulary.load()


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.MODEL)


def test_query_equals_the_library(spark, library):
    rows = pieces.op9_sentencepiece(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_odd_texts_equal_the_library(known, library):
    draw = random.Random(4)
    letters = ["▁", " ", "e", "n", "t", "h", "E", "é", "1", ".", "\n", "ß"]
    made = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 14))) for _ in range(800)]
    encoder = pieces.Encoder(known)
    for text in ODD + [m for m in made if "▁" not in m]:
        ids = encoder.encode([text])[0]
        assert ids.tolist() == library.encode(text), repr(text)
        assert encoder.decode([ids])[0] == text


def test_unigram_paths_are_best():
    names = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "ca"]
    scores = [0, -3, -3.5, -4, -4.2, -4.4, -9, -2, -3.1, -5]
    known = pieces.Vocabulary(names, scores, {0}, {}, 0, "unigram")

    def best(text):
        if not text:
            return 0.0
        return max(scores[names.index(text[:n])] + best(text[n:]) for n in (1, 2, 3) if text[:n] in names[1:] and n <= len(text))

    draw = random.Random(2)
    units = ["▁" + "".join(draw.choice("abc") for _ in range(7)) for _ in range(50)]
    for unit, ids in zip(units, pieces.Encoder(known).viterbi(units)):
        assert "".join(names[i] for i in ids) == unit
        assert np.isclose(sum(scores[i] for i in ids), best(unit))
    assert pieces.Encoder(known).encode(["az"])[0].tolist() == [8, 0]


def test_odd_rows_and_decoding(spark, known):
    rows = [(1, None), (2, ""), (None, "same text"), (3, "same text"), (3, "same text"), (4, "é " * 30000), (5, " x\n")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    found = pieces.encode(docs, known, check=True)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found.collect())
    back = sorted((r.id or 0, r.text) for r in pieces.decode(found, known).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    assert pieces.encode(docs.limit(0), known).count() == 0


def test_pieces_apart_as_merging_says(known):
    draw = random.Random(8)
    ids = known.ids.tolist()
    short = [i for i in ids if len(known.pieces[i]) <= 3 and "▁▁" not in known.pieces[i]]
    pairs = [(draw.choice(short), draw.choice(short)) for _ in range(6000)]
    pairs += [(a, b) for a in short[:60] for b in short[:60]]
    left, right = np.array(pairs).T
    want = [known.merge(known.pieces[a] + known.pieces[b]) == [a, b] for a, b in pairs]
    assert known.stay_apart(left, right).tolist() == want


def test_a_batch_holds_no_strings_but_new_units(known):
    """A million words of a few kinds: numbers are held for them, some 60 bytes each at most, and no strings."""
    import tracemalloc

    text, encoder = "een twee drie vier vijf " * 4000, pieces.Encoder(known)
    alone = encoder.encode([text])[0].tolist()
    tracemalloc.start()
    ids = encoder.encode([text] * 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(one.tolist() == alone for one in ids)
    assert peak < 100 * 1_000_000


def test_units_of_an_older_memory_keep_their_ids(known, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 40)
    draw, encoder = random.Random(9), pieces.Encoder(known)
    words = ["".join(draw.choice("abdeinorstz") for _ in range(draw.randrange(1, 9))) for _ in range(150)]
    for _ in range(20):
        texts = [" ".join(draw.choices(words, k=30)) for _ in range(4)]
        assert [i.tolist() for i in encoder.encode(texts)] == [library.encode(t) for t in texts]
