import corpus_pipeline as pipe
import test_decontaminate
import test_simhash
from sentencepiece import SentencePieceProcessor

from veilspark.llm import decontaminate as dec
from veilspark.llm import langid, pieces
from veilspark.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_repeats(rows, window=13):
    """Texts without words under windows that a smaller id has too; the others unchanged."""
    split = {i: t.encode().split() for i, t in rows}
    first = {}
    for i, words in sorted(split.items()):
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s:s + window]), i)
    out = {}
    for i, text in rows:
        words, gone = split[i], set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s:s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = b" ".join(w for n, w in enumerate(words) if n not in gone).decode() if gone else text
    return out


def test_each_stage_on_its_input(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}

    one = pipe.language(spark, docs, SF)
    assert one.columns == names
    model = langid.trained(docs)
    tags = {r.id: r for r in langid.detect(docs, model).collect()}
    kept = {r.doc_id: r.text for r in one.collect()}
    assert kept == {i: t for i, t in rows.items() if tags[i].label != "und" and tags[i].score >= 0.3}
    assert len(kept) > 0.97 * len(rows)

    one = spark.createDataFrame(one.collect(), docs.schema)
    two = pipe.near_duplicates(spark, one, SF)
    assert two.columns == names
    groups = {i: c for i, _, c in test_simhash.plain_components(list(kept.items()))}
    kept = {r.doc_id: r.text for r in two.collect()}
    assert set(kept) == set(groups.values()) and two.count() == len(kept)

    two = spark.createDataFrame(two.collect(), docs.schema)
    three = pipe.substrings(spark, two, SF).collect()
    want = plain_repeats(list(kept.items()))
    assert {r.doc_id: r.text for r in three} == want
    assert all(r.n_chars == len(r.text) for r in three if r.text != kept[r.doc_id])

    three = spark.createDataFrame(three, docs.schema)
    four = pipe.benchmark(spark, three, SF)
    assert four.columns == names
    items = [dec.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    leaked = {i for i, t in want.items() if any(x in dec.normalise(t) for x in items)}
    kept = {r.doc_id: r.text for r in four.collect()}
    assert leaked and not leaked & set(kept)
    for i in set(want) - set(kept) - leaked:
        assert any(test_decontaminate.least_edits(x, dec.normalise(want[i])) <= dec.budget(len(x), dec.Q, dec.RATE) for x in items)

    four = spark.createDataFrame(four.collect(), docs.schema)
    library = SentencePieceProcessor(model_file=pieces.MODEL)
    last = pipe.tokens(spark, four, SF).collect()
    assert {r.doc_id: r.ids for r in last} == {i: library.encode(t) for i, t in kept.items()}
    assert all(r.round_trip for r in last)

    assert {r.doc_id: r.ids for r in pipe.run(spark, SF).collect()} == {r.doc_id: r.ids for r in last}


def test_odd_rows_pass_every_stage(spark):
    text = "the cat and the dog went to the house by the sea and saw the boat that was there"
    rows = [(1, text, "en", None, 3), (1, text, "en", "x", 3), (None, text, None, None, None), (2, None, "fr", "y", 1),
            (3, "", "en", "y", 0), (4, "12 34", "en", "z", 5), (5, "le chat et le chien " * 4000, "fr", "z", None),
            (None, "a text with no id of its own", "en", "z", 1), (6, text + " today", "en", "q", 1),
            (7, "some more words for the model to learn from", "en", "q", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__id2` string"
    docs = spark.createDataFrame([(*r, "extra") for r in rows], schema)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in pipe.STAGES:
            out = stage(spark, now, SF)
            if name != pipe.STAGES[-1][0]:
                assert out.columns == docs.columns
                now = spark.createDataFrame(out.collect(), docs.schema)
        found = sorted((r.doc_id or -1) for r in out.collect())
        assert found == ([] if empty else found) and (empty or found.count(1) == 1)


