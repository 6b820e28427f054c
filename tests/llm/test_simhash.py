import numpy as np
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import simhash
from veilspark.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, radius=3):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    smallest = {}
    for i, f in prints:
        if i is not None:
            smallest[find(f)] = min(i, smallest.get(find(f), i))
    return sorted((-1 if i is None else i, format(f, "016x"), smallest.get(find(f))) for i, f in prints)


def got(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in frame.collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert got(simhash.op3_simhash_bktree(spark, SF)) == plain_components(rows)


def as_query(frame):
    return frame.select(F.col("id").alias("doc_id"), simhash.hex_text(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def test_odd_rows(spark):
    rows = [(5, None), (2, ""), (3, " \t"), (7, "a"), (7, "a"), (None, "a"), (9, "One two three four"),
            (10, "one TWO three four"), (11, "É é"), (12, "word " * 20000), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    assert got(as_query(simhash.near_duplicates(docs))) == plain_components(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_over_small_shards_lose_nothing(spark):
    """Chains of flipped bits around a few centres, with trees of four members."""
    values, state = set(), 12345
    for centre in (0, (1 << 64) - 1, 0x0123456789ABCDEF):
        for i in range(40):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            values.add(centre)
            centre ^= 1 << (state >> 58) ^ 1 << (state >> 40) % 64
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.components(simhash.links(fps, shard=4)).collect()
    root = {v: v for v in signed}
    root.update({r.node: r.root for r in found})
    want = {v: v for v in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & simhash.MASK).bit_count() <= 3 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    assert root == want


def test_tree_radius_search():
    values = [(i * 0x9E3779B97F4A7C15) & 0xFF for i in range(60)]
    values = np.array(list(dict.fromkeys(values)), np.uint64)
    tree = simhash.BKTree(values)
    assert sorted(tree.values.tolist()) == sorted(values.tolist())
    for q in range(256):
        _, node, _ = tree.near(np.array([q], np.uint64), 2)
        assert sorted(tree.values[node].tolist()) == sorted(v for v in values.tolist() if (v ^ q).bit_count() <= 2)
    for few in (0, 1):
        tree = simhash.BKTree(values[:few])
        assert len(tree.near(values[:1], 0)[1]) == few


def test_edges_carry_the_distance_to_the_parent_and_prune():
    values = np.random.default_rng(5).integers(0, 1 << 64, 4000, np.uint64)
    values = np.unique(np.concatenate((values, values[:500] ^ np.uint64(5), values[:300] ^ np.uint64(9))))
    tree = simhash.BKTree(values)
    for node in range(0, len(values), 97):
        for apart in range(1, 65):
            low, high = tree.first[node * simhash.WIDE + apart:][:2]
            assert high - low <= 1
            assert all((int(tree.values[node]) ^ int(tree.values[child])).bit_count() == apart for child in range(low, high))
    who, node, visited = tree.near(values[:400], 3)
    apart = np.bitwise_count(values[:400, None] ^ tree.values[None])
    assert set(zip(who.tolist(), node.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= 3))))
    assert visited < 0.4 * 400 * len(values)


def test_shards_hold_thousands_and_crowded_ones_are_routed_again(spark, monkeypatch):
    """A fourth of the fingerprints agree on 51 bits, so most bits don't part them."""
    draw = np.random.default_rng(8)
    values = np.concatenate((draw.integers(0, 1 << 64, 8000, np.uint64), draw.integers(0, 1 << 13, 3000, np.uint64) << np.uint64(17)))
    values = np.unique(np.concatenate((values, values[:8000:7] ^ np.uint64(1 << 40 | 1 << 20))))
    fps = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long")
    sizes = []
    written = simhash.cut

    def noted(df, kind):
        out = written(df, kind)
        if kind == "shards":
            sizes.append(out.groupBy("block", "mask", "agree").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(simhash, "cut", noted)
    found = simhash.components(simhash.links(fps, shard=64)).collect()
    assert len(sizes) > 1 and sizes[-1] <= simhash.CROWDED * 64 < sizes[0]
    plain = values.tolist()
    parent = {v: v for v in plain}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(0, len(values), 500):
        near = np.bitwise_count(values[a:a + 500, None] ^ values[None]) <= 3
        for i, j in np.argwhere(near).tolist():
            parent[find(plain[a + i])] = find(plain[j])
    groups, got_groups = {}, {}
    for v in parent:
        groups.setdefault(find(v), set()).add(v)
    for r in found:
        got_groups.setdefault(r.root, set()).add(r.node & simhash.MASK)
    assert sorted(map(sorted, got_groups.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_one_of_each_group_whatever_the_columns_are_called(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8, 9, "x"), (2, "a b c", 7, 8, 9, "y"), (3, "other words here", 1, 2, 3, "z")],
                                 "doc_id long, text string, __kept_id int, kept_id int, mark int, row string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", 7, 8, 9, "x"), (3, "other words here", 1, 2, 3, "z")]
