import random
import time

import numpy as np

from veilspark.llm import decontaminate as dec
from veilspark.llm.common import table

SF = "/root/testdata/sf0.001"


def least_edits(pattern, text):
    """Plain dynamic programme with free ends in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != d), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def plain(texts, items):
    found = set()
    for n, text in enumerate(texts):
        for i, item in enumerate(items):
            m = len(item)
            if m >= dec.Q and least_edits(item, text) <= dec.budget(m, dec.Q, dec.RATE):
                found.add((n, i))
    return found


def edited(text, edits, draw):
    chars = list(text)
    for _ in range(edits):
        at = draw.randrange(len(chars))
        kind = draw.randrange(3)
        if kind == 0:
            chars[at] = draw.choice("abcxyz ")
        elif kind == 1:
            chars.insert(at, draw.choice("abcxyz "))
        else:
            del chars[at]
    return "".join(chars)


def sample():
    draw = random.Random(3)
    words = ["alpha", "be", "gamma", "delta", "the", "of", "and", "om", "ing"]
    items = [dec.normalise(" ".join(draw.choice(words) for _ in range(n))) for n in (2, 3, 8, 15, 25, 40)]
    texts = []
    for item in items * 4:
        before = " ".join(draw.choice(words) for _ in range(draw.randrange(12)))
        edits = draw.randrange(2 + 2 * dec.budget(len(item), dec.Q, dec.RATE)) if len(item) >= dec.Q else 0
        texts.append(dec.normalise(f"{before} {edited(item, edits, draw)} {before[::-1]}"))
    return texts, items


def test_search_equals_plain_alignment():
    texts, items = sample()
    found = dec.ItemIndex(list(enumerate(items)), dec.Q, dec.RATE).search(texts)
    assert {(n, i) for n, i, *_ in found} == plain(texts, items)
    for n, i, start, end, edits in found:
        assert least_edits(items[i], texts[n][start:end]) == edits


def test_pieces_and_small_blocks_change_nothing(monkeypatch):
    texts, items = sample()
    whole = dec.ItemIndex(list(enumerate(items)), dec.Q, dec.RATE).search(texts)
    monkeypatch.setattr(dec, "PIECE", 64)
    monkeypatch.setattr(dec, "ALIGNED", 3)
    parts = dec.ItemIndex(list(enumerate(items)), dec.Q, dec.RATE).search(texts)
    assert {r[:2] for r in parts} == {r[:2] for r in whole}


def test_query_finds_whole_items(spark):
    docs = [(r.doc_id, dec.normalise(r.text)) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, dec.normalise(r.text)) for r in table(spark, SF, "benchmark").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    found = {(r.doc_id, r.item_id) for r in dec.op7_qgram_decontam(spark, SF).collect()}
    assert exact <= found
    texts, known = dict(docs), dict(items)
    for d, i in found - exact:
        assert least_edits(known[i], texts[d]) <= dec.budget(len(known[i]), dec.Q, dec.RATE)


def test_odd_rows(spark):
    item = "The quick brown fox, jumps over the lazy dog!"
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "x " * 5000 + item.upper() + " y" * 9000), (None, item), (4, item), (4, item),
         (5, "the quick brown fox jumped over the lazy dog"), (6, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "short", 1), (10, item, 1)],
                                  "item_id long, text string, start int")
    wide = docs.selectExpr("*", "1 AS item", "2 AS edits")
    found = sorted((r.id or "", r.item, r.edits) for r in dec.leaks(wide, items).collect())
    each = [("", 0), ("3", 0), ("4", 0), ("4", 0), ("5", 2)]
    assert found == sorted((i, item, e) for i, e in each for item in ("7", "10"))
    assert sorted((r.id or "", r.item, r.edits) for r in dec.leaks(wide, items, block_chars=30).collect()) == found
    assert dec.leaks(docs.limit(0), items).count() == 0
    assert dec.leaks(docs, items.limit(0)).count() == 0


def test_gram_hash_depends_on_every_character():
    one = dec.qgrams(dec.codes_of("abcdefgh"))
    assert len(one) == 1
    assert all(dec.qgrams(dec.codes_of("abcdefgh"[:i] + "z" + "abcdefgh"[i + 1:]))[0] != one[0] for i in range(8))
    assert np.array_equal(dec.qgrams(dec.codes_of("xxabcdefgh"))[2:], one)


def test_short_items_leak_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "it was 42, he said"), (2, "it was 4200"), (3, "A-Z of it"), (4, None), (5, "42 a z 42")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "42"), (2, "a z"), (3, "?!"), (4, "42!")], "item_id long, text string")
    found = sorted((r.id, r.item, r.start, r.end, r.edits) for r in dec.leaks(docs, items).collect())
    assert found == [("1", "1", 7, 9, 0), ("1", "4", 7, 9, 0), ("3", "2", 0, 3, 0), ("5", "1", 0, 2, 0), ("5", "1", 7, 9, 0),
                     ("5", "2", 3, 6, 0), ("5", "4", 0, 2, 0), ("5", "4", 7, 9, 0)]
    for block_chars in (2, 1000):
        kept = dec.without_leaks(docs, items, block_chars=block_chars)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 4]


def test_an_item_repeated_many_times_in_one_text():
    item = "the answer to the question"
    index = dec.ItemIndex([(0, item)], dec.Q, dec.RATE)
    began = time.time()
    found = index.search([" ".join([item] * 20000)])
    assert len(found) == 20000 and time.time() - began < 20
    assert all(b[2] >= a[3] for a, b in zip(found, found[1:]))


def test_bytes_that_are_no_text(spark):
    item = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, item)], "doc_id long, text string").selectExpr(
        "doc_id", "cast(concat(cast(text as binary), X'20ff20') as string) AS text")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert dec.leaks(docs, items).count() == 1
    assert dec.without_leaks(docs, items).count() == 0
