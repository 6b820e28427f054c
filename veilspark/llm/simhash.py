"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Two fingerprints link at ``radius`` or fewer differing bits. Distinct fingerprints are routed to shards of one to two
times ``shard`` members: of ``radius + 1`` blocks of bits at least one agrees in a linked pair, so a fingerprint goes to
``radius + 1`` shards, one for each block, named by as many of the block's bits as the number of fingerprints asks for. A
shard of more than ``CROWDED * shard`` members is routed again, by those of its other bits that part its members, so that
no shard grows with the data and no pair is lost. A shard is a BK-tree (children keyed by their integer Hamming distance to the parent), and
each member searches it along the edges within the radius. All trees together are as large as the data, so a shard tree
goes to the task that searches it and not, as a broadcast, to every executor.

A task emits one link from a fingerprint to each local component it reaches, never all pairs. Links are
joined into components by alternating large-star and small-star steps on aggregates, with each step cut.

Results for odd input: a null or empty text has fingerprint zero and links like any other; a null ``doc_id``
takes part, but is never the smallest id (a component of null ids only has a null id); repeated rows and equal
texts share a fingerprint; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import cut, discard, table, text_bytes

RADIUS = 3
SHARD = 2048
CROWDED = 4
SEED = 42
CHUNK = 1 << 16
WIDE = 128
SEARCHED = 256
BROADCAST_ROWS = 200_000


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of every shingle of a lower-cased text, as rows of eight bytes, high byte first."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros((0, 8), np.uint8)
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1:] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_digest
    found = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())])
    return np.frombuffer(found, np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, words: int = 3) -> int:
    """A bit is set if more than half of the shingle hashes have it; the result as a signed long."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at:at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``mark`` (a hash of the text as it is) and ``fp`` (signed long)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"),
                       of(text_bytes(text_col)).alias("fp"))


def finer_masks(mask: int, members: int, ones: np.ndarray, radius: int, shard: int) -> list[int]:
    """Masks that add to ``mask`` bits of ``radius + 1`` blocks, none of which shares a bit with another.

    ``ones`` counts the members that have each bit. The bits that part the members best are dealt out first, and a block
    takes as many as part them into shards; bits that all members share part nothing and come last.
    """
    if members <= CROWDED * shard:
        return [mask]
    share = ones / members
    parting = -np.log2(share ** 2 + (1 - share) ** 2)
    order = [int(bit) for bit in np.argsort(-parting, kind="stable") if not mask >> int(bit) & 1]
    wanted, out = np.log2(members / shard), []
    for block in range(radius + 1):
        bits = order[block::radius + 1]
        enough = int(np.searchsorted(np.cumsum(parting[bits]), wanted)) + 1
        out.append(mask | sum(1 << bit for bit in bits[:enough]))
    return out


def _masks(radius: int, shard: int):
    @F.pandas_udf("array<long>")
    def of(mask: pd.Series, members: pd.Series, ones: pd.Series) -> pd.Series:
        return pd.Series([np.array(finer_masks(m & MASK, n, np.asarray(o), radius, shard), np.uint64).view(np.int64)
                          for m, n, o in zip(mask.tolist(), members.tolist(), ones)], dtype=object)

    return of


class BKTree:
    """A tree over distinct 64-bit numbers whose edges carry the integer distance of child and parent.

    It is the tree that adding the numbers one by one gives. Nodes are numbered level by level, by parent and distance, so
    the children of a node within a range of distances are neighbours in ``values``.
    """

    def __init__(self, values: np.ndarray) -> None:
        order, keys = [np.arange(min(1, len(values)))], []
        rest, at, base = np.arange(1, len(values)), np.zeros(max(0, len(values) - 1), np.int64), 1
        parents = values[:1]
        while len(rest):
            apart = np.bitwise_count(values[rest] ^ parents[at - (base - len(parents))]).astype(np.int64)
            found, first, child = np.unique(at * WIDE + apart, return_index=True, return_inverse=True)
            order.append(rest[first])
            keys.append(found)
            parents = values[rest[first]]
            later = np.ones(len(rest), bool)
            later[first] = False
            rest, at = rest[later], base + child[later]
            base += len(found)
        self.values = values[np.concatenate(order)]
        per_edge = np.bincount(np.concatenate(keys), minlength=len(values) * WIDE) if keys else np.zeros(len(values) * WIDE, int)
        self.first = np.concatenate(([1], 1 + np.cumsum(per_edge))).astype(np.int32)

    def near(self, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(place in ``wanted``, node) of all pairs within the radius, and how many nodes were compared."""
        who, node = np.arange(len(wanted)), np.zeros(len(wanted), np.int64)
        if not len(self.values):
            return who[:0], node[:0], 0
        hits, visited = [], 0
        while len(who):
            visited += len(who)
            apart = np.bitwise_count(wanted[who] ^ self.values[node]).astype(np.int64)
            close = apart <= radius
            hits.append((who[close], node[close]))
            low = self.first[node * WIDE + np.maximum(apart - radius, 0)]
            count = self.first[node * WIDE + apart + radius + 1] - low
            ends = np.cumsum(count)
            who = np.repeat(who, count)
            node = np.repeat(low - (ends - count), count) + np.arange(len(who))
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), visited


def shard_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between the numbers of one shard that connect all those within the radius; at most one a local component."""
    tree = BKTree(np.unique(values))
    parent, links = np.arange(len(tree.values)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    at, step = 0, 16
    while at < len(parent):
        who, node, _ = tree.near(tree.values[at:at + step], radius)
        who = who + at
        fresh = parent[who] != parent[node]
        # one pair for each number and component that it reaches
        pairs = np.stack((who[fresh], parent[node[fresh]]), 1)
        for a, b in np.unique(pairs, axis=0).tolist() if len(pairs) else ():
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(tree.values[x]), int(tree.values[y])))
        while not np.array_equal(parent, above := parent[parent]):
            parent[:] = above
        at, step = at + step, min(2 * step, SEARCHED)
    return links


MASK = (1 << 64) - 1


def _shard_links(radius: int):
    """Links of each shard, whose members come one after the other, sorted by shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, parts = None, []
        for batch in batches:
            keys = batch[["block", "mask", "agree"]].to_numpy(np.int64)
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist() if len(fps) else []
            found = []
            for a, b in zip(starts, [*starts[1:], len(fps)]):
                key = tuple(keys[a])
                if key != open_key and parts:
                    found += shard_links(np.concatenate(parts), radius)
                    parts = []
                open_key = key
                parts.append(fps[a:b])
            yield as_links(found)
        if parts:
            yield as_links(shard_links(np.concatenate(parts), radius))

    def as_links(found: list) -> pd.DataFrame:
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all those within the radius."""
    key = ["block", "mask", "agree"]
    zero = F.lit(0).cast("long")
    ones = F.array(*(F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))) for i in range(64)))
    crowded = F.col("n") > CROWDED * shard
    open_rows = fps.select("fp", zero.cast("int").alias("block"), zero.alias("mask"), zero.alias("agree"))
    found, written = [], []
    while True:
        finer = open_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), ones.alias("ones"))
        finer = cut(finer.select(*key, _masks(radius, shard)("mask", "n", "ones").alias("masks")), "masks")
        each = open_rows.join(F.broadcast(finer) if finer.count() <= BROADCAST_ROWS else finer, key)
        routed = each.select("fp", F.posexplode("masks").alias("block", "mask"))
        routed = routed.withColumn("agree", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        counted = routed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = cut(routed.join(counted, key), "shards")
        written += [finer, sized]
        ready = sized.where(~crowded).repartition(*key).sortWithinPartitions(*key)
        found.append(ready.select(*key, "fp").mapInPandas(_shard_links(radius), "a long, b long"))
        open_rows = sized.where(crowded).select("fp", *key)
        if open_rows.isEmpty():
            break
    out = cut(reduce(DataFrame.unionByName, found).distinct(), "near")
    discard(*written)
    return out


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node reachable."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
              "links")
    before = None
    while (seen := _signature(now)) != before:
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        held, now = now, cut(small, "stars")
        discard(held)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    shard: int = SHARD) -> DataFrame:
    """(id, mark, fp, root, component): ``root`` names the component, ``component`` is the smallest id in it."""
    marked = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    first = cut(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    near = links(first.select("fp"), radius, shard)
    found = components(near)
    rooted = found.join(first, found["node"] == first["fp"]).select("node", "root", "first")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of_fp = rooted.select("node", "root").join(smallest, "root").select(F.col("node").alias("fp"), "root", "component")
    # written, so that the last join stands alone and Spark can split the rows of a hot fingerprint
    classes = cut(first.join(of_fp, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component")).alias("component")), "classes")
    discard(first, near)
    return marked.join(classes, "fp").select("id", "mark", "fp", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one row of each component: that of the smallest id; a null id stays only without others."""
    found = near_duplicates(docs, id_col, text_col, **options)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("b"))
    kept = best.select(F.col("b.id").alias("kept_id"), F.col("b.mark").alias("kept_mark"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    return rows.join(kept, same).dropDuplicates(["kept_id", "kept_mark"]).select("row.*")


def hex_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_text(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))
