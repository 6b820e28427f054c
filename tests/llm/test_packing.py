import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from veilspark.llm import packing
from veilspark.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_sequences(rows, capacity):
    """Gapless sequences within the capacity; the padding they need."""
    by, padding = defaultdict(list), 0
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_fill_is_closest():
    draw = random.Random(3)
    for _ in range(300):
        counts = {draw.randrange(1, 40): draw.randrange(0, 4) for _ in range(draw.randrange(1, 6))}
        target = draw.randrange(0, 90)
        sums = {sum(x * n for x, n in zip(counts, ns)) for ns in itertools.product(*(range(n + 1) for n in counts.values()))}
        picked = packing.fill(counts, target)
        assert all(0 < n <= counts[x] for x, n in picked.items())
        assert sum(x * n for x, n in picked.items()) == max(s for s in sums if s <= target)


def test_plan_places_every_token_once():
    draw = random.Random(4)
    for capacity in (8, 64, 1024):
        for size in (0, 1, 2, 30, 400):
            counts = defaultdict(int)
            for _ in range(size):
                counts[draw.randrange(1, capacity)] += draw.choice((1, 1, 50))
            plan = packing.Plan(dict(counts), capacity)
            held, windows = defaultdict(list), defaultdict(list)
            for tail, low, high, cut, piece, first, times, base, done in plan.rows:
                for rank in range(low, high):
                    j = done + rank - low
                    held[tail, rank].append((cut, piece))
                    windows[first + j // times].append((base + j % times * piece, piece))
            assert set(held) == {(x, r) for x, n in counts.items() for r in range(n)}
            for (tail, _), pieces in held.items():
                at = 0
                for start, length in sorted(pieces):
                    assert start == at
                    at += length
                assert at == tail
            assert sorted(windows) == list(range(plan.sequences))
            lengths = []
            for pieces in windows.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                lengths.append(at)
            assert all(n == capacity or n & (n - 1) == 0 for n in lengths)


def test_units_give_the_tokenizer_s_ids(spark):
    texts = [r.text for r in table(spark, SF, "documents").limit(300).collect()]
    texts += ["", " ", "a", "A b\nC d.", "foo.\nBar  baz", "don't we'll I'M", "x\n\ny", " lead", "trail ", "tab\there", "é ü ñ ß.",
              "a <|endoftext|> b", "a  <|endoftext|>", "日本 語", "nb\xa0sp", "12 a1 1a a's 's", "wow!? ok...", "\x01 b \x01c",
              "ǅ ʰ ª º ²", "end\r\nline", "é x", " em space", "a .b ,c", "...\n...", "Ⅷ x", "œuvre ĳ ʼn"]
    encode = packing.Encoder(packing.TOKENIZER)
    assert encode.by_units
    for _ in range(2):
        for text, want in zip(texts, plain_ids(texts)):
            assert np.frombuffer(encode.ids(text), "<u4").tolist() == want[:-1], repr(text)


def test_query_on_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = packing.op11_bin_slack(spark, SF).collect()
    assert check_sequences(rows, 1024) == 0
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for name, ids in zip(docs, plain_ids(docs.values())):
        at = 0
        for r in sorted(pieces[name], key=lambda r: r.start):
            part = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    # only where no multiset fills a window is a tail cut
    assert len(rows) - sum(-(-len(i) // 1024) for i in plain_ids(docs.values())) < len(docs) / 5


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "a b", 5), (1, "a b", 5), (1, "a b", 5), (2, "", 5), (3, "word " * 30000, 5), (4, "x" * 3000, 5)]
    frame = spark.createDataFrame([(a, bytearray(b.encode()) if b is not None else None, c, c, c) for a, b, c in rows]
                                  + [(5, bytearray(b"caf\xe9 x"), 5, 5, 5)], "doc_id long, text binary, length int, part int, ids int")
    found = packing.pack(frame, capacity=64).cache()
    assert check_sequences(found.collect(), 64) == 0
    total = sum(map(len, plain_ids([b for _, b, _ in rows] + ["caf� x"])))
    assert found.agg({"length": "sum"}).first()[0] == total
    packed = packing.sequences(found, 64).collect()
    assert sum(len(r.ids) for r in packed) == total and {len(r.ids) for r in packed} <= {1, 2, 4, 8, 16, 32, 64}
    by = {(d.id, d.start): r.ids[d.offset:d.offset + d.length] for r in packed for d in r.documents if d.id in (3, 4)}
    for name, text in ((3, "word " * 30000), (4, "x" * 3000)):
        assert [i for (n, _), ids in sorted(by.items()) if n == name for i in ids] == plain_ids([text])[0]
    assert packing.pack(frame.limit(0)).count() == 0


def test_equal_lengths_over_many_tasks(spark):
    text = "if(id % 3 = 0, 'same text here', concat('other ', id)) as text"
    frame = spark.range(3000).selectExpr("id as doc_id", text).repartition(13)
    rows = packing.pack(frame, capacity=100).collect()
    assert check_sequences(rows, 100) == 0
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)

