import hashlib
import random

from pyspark.sql import functions as F

from veilspark.llm import substring
from veilspark.llm.common import table

SF = "/root/testdata/sf0.001"


def plain(rows, window=13):
    """Windows by their words, the smallest id of each; words of later documents under such a window go."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        for s in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[s:s + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[s:s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((-1 if i is None else i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def as_query(frame):
    return frame.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = plain(rows)
    assert got(substring.op10_substring_dedup(spark, SF)) == want
    assert sum(r[2] for r in want) > 0


def test_odd_rows_and_planted_repeats(spark):
    draw = random.Random(7)
    few = [f"w{n}" for n in range(6)]
    rows = [(n, " ".join(draw.choice(few) for _ in range(draw.randint(0, 60)))) for n in range(60)]
    passage = " ".join(f"p{n}" for n in range(13))
    rows += [(100, passage), (101, "x " + passage + "\n\ty"), (102, passage + " " + passage), (103, "a " * 30000),
             (99, "a " * 14), (104, None), (105, ""), (None, passage), (None, None), (106, passage), (106, passage),
             (107, " ".join(f"q{n}" for n in range(20))), (107, " ".join(f"q{n}" for n in range(20)))]
    docs = spark.createDataFrame([(i, t, "h", 3) for i, t in rows], "doc_id long, text string, hash string, id int")
    found = substring.dedup_substrings(docs.repartition(5))
    assert got(as_query(found)) == plain(rows)
    spans = {r.id: [(s.start, s.end) for s in r.spans] for r in found.where("id in (101, 107, 103)").collect()}
    assert spans == {101: [(1, 14)], 107: [], 103: [(0, 30000)]}
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 1, 2, "r"), (2, text + " end", 3, 4, "s")],
                                 "doc_id long, text string, __id int, __hashes int, row string")
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, text, 1, 2, "r"), (2, "end", 3, 4, "s")]
