"""The dictionary detector against a plain search, in both of its forms."""

import random
import unicodedata

import pytest

from veilspark.operators import names as N
from veilspark.operators import ner
from veilspark.plans.analyze import analyze_rows

WORDS = ["de", "van", "Jan", "Oost", "Zee", "x1", "d'Or", "Ünal", "ʼs", "Ⅷ", "e\u0301"]


def plain(names, text):
    """(start, end, type): the longest name at each word, of equal ones the first type."""
    spans, words = [m.span() for m in N.WORD.finditer(text)], N.words_of(text)
    known = {}
    for name, kind in names:
        if name and kind and N.words_of(name):
            key = tuple(N.words_of(name))
            known[key] = min(kind, known.get(key, kind))
    out = []
    for i in range(len(words)):
        fit = [k for k in known if tuple(words[i:i + len(k)]) == k]
        if fit:
            best = max(fit, key=len)
            out.append((spans[i][0], spans[i + len(best) - 1][1], known[best]))
    return sorted(out)


def invented(draw, n):
    return "".join(draw.choice(WORDS) + draw.choice([" ", "  ", "-", "\n", ", ", "."]) for _ in range(n))


@pytest.mark.parametrize("options", [{}, {"limit": 0}, {"limit": 0, "most_bits": N.BLOCK}])
def test_both_forms_find_what_a_plain_search_finds(spark, options):
    draw = random.Random(31)
    names = [(invented(draw, draw.choice([1, 1, 2, 2, 3, 4, 7])), draw.choice(["PERSON", "LOCATION", "STREET"])) for _ in range(120)]
    names += [(" ".join(["Jan"] * 50), "PERSON"), ("", "PERSON"), ("...", "PERSON"), (None, "PERSON"), ("Zee", None)]
    texts = [invented(draw, draw.randrange(0, 40)) for _ in range(150)] + ["Jan " * 49, "Jan, " * 60, "", None, "😀 Jan van x1"]
    gazetteer = spark.createDataFrame(names, "name string, entity_type string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    loaded = N.load_names(gazetteer, **options)
    assert loaded.kinds == ("LOCATION", "PERSON", "STREET") and (loaded.trie is None) == bool(options)
    rows = ner.dictionary_spans(docs, loaded, ["doc_id"]).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.start, r.end, r.entity_type))
    for i, text in enumerate(texts):
        assert sorted(found.get(i, [])) == (plain(names, text) if text else []), text


def test_words_are_those_of_the_scan(spark):
    text = "".join(map(chr, [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x2000, 0x2200), 0x203f]))
    text = "".join(c for c in text if unicodedata.category(c) != "Cn")  # letters of the newest Unicode are known to one side only
    frame = spark.createDataFrame([(text,)], "t string")
    want = [h.text for h in frame.selectExpr(f"{ner.tokens_sql('t')} as h").first().h]
    assert N.words_of(text) == want


def test_trie_without_shuffle_and_bitmap_with_one_join(spark, docs):
    gazetteer = spark.createDataFrame([("Jan de Wit", "PERSON")], "name string, entity_type string")
    plan = analyze_rows(docs("Jan de Wit"), gazetteer=gazetteer)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
    assert "slice" not in N.load_names(gazetteer, limit=0).spans(docs("Jan de Wit"), ["doc_id"])._jdf.queryExecution().toString()


def test_own_types_can_be_asked_for(spark, docs):
    gazetteer = spark.createDataFrame([("Hoge Kade", "STREET")], "name string, entity_type string")
    for names in (gazetteer, N.load_names(gazetteer, limit=0)):
        rows = analyze_rows(docs("op de Hoge Kade 3"), ["STREET"], gazetteer=names).collect()
        assert [(r.entity_type, r.text) for r in rows] == [("STREET", "Hoge Kade")]
    with pytest.raises(ValueError, match="PERSON"):
        analyze_rows(docs("x"), ["STREET", "PERSON"], gazetteer=gazetteer)


def test_empty_dictionary(spark, docs):
    none = spark.createDataFrame([], "name string, entity_type string")
    for names in (N.load_names(none), N.load_names(none.limit(0), limit=-1)):
        assert ner.dictionary_spans(docs("Jan"), names, ["doc_id"]).count() == 0
