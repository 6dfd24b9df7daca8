"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Equal fingerprints are one from the start. The others form a binary trie: a node is a prefix of bits and holds the
fingerprints below it. The join starts with the root against itself and takes pairs of nodes down together, adding up
the bits in which their prefixes differ; a pair that exceeds the budget goes, with all that lies below it.

The upper levels are a table of node pairs, one step of bits per round, and only pairs that hold more than ``LIMIT``
fingerprints go on, so a crowded part of the trie is split further than a thin one. Pairs that are small enough get the
fingerprints of both nodes and are taken down further in one task each. A task sends on a spanning forest of its links,
fewer rows than it has fingerprints.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import attached, materialised
from jobtrail.llm.components import components

#: Fingerprints of a pair of nodes that one task takes down, and bits of one round above that.
LIMIT, STEP = 1 << 16, 3
#: Pairs of nodes that are held at once, and fingerprint pairs of two nodes that are compared rather than split.
HELD, SMALL = 1 << 15, 64
#: Shingles that are hashed at once.
CHUNK = 1 << 16
U64 = np.uint64
#: The bits of a byte, each in a byte of its own; 255 of them add up without a carry.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


@dataclass(frozen=True)
class Params:
    """Fingerprints of shingles of ``words`` words are linked if ``bits`` bits or fewer differ."""

    words: int = 3
    bits: int = 2
    seed: int = 42


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set, lowest bit first."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        lanes = SPREAD[hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, p: Params = Params()) -> int:
    """Bits set in over half the XXH64 hashes of the text's shingles; 0 for a text without words."""
    import xxhash

    # Of bytes, lower() changes A-Z and split() parts at space and U+0009 to U+000D, nothing else.
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(p.words, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts, stops = (stops - lengths)[: len(words) - size + 1], stops[size - 1 :]
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        cuts = zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist())
        counts += bit_counts(np.array([digest(joined[i:j], p.seed) for i, j in cuts], dtype=U64))
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprint_udf(p: Params):
    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), p) for t in texts), dtype=U64, count=len(texts))
        return pa.array(found.view(np.int64))

    return of


class Forest:
    """Links among ``n`` things, kept as the smallest number that each one's links lead to."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray):
        while len(x):
            x, y = self.root[x], self.root[y]
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where in each range of equal prefixes the bit at ``depth`` becomes one."""
    bit = U64(1) << U64(63 - depth)
    first = values[low] & ~((bit << U64(1)) - U64(1)) if depth else np.zeros(len(low), U64)
    return np.clip(np.searchsorted(values, first | bit), low, high)


def linked(left: np.ndarray, right: np.ndarray | None, bits: int):
    """Batches of places x in ``left`` and y in ``right`` whose values differ in ``bits`` bits or fewer.

    Both are sorted and without repeats. Without ``right`` the values of ``left`` meet each other, each pair once.
    """
    alone = right is None
    right = left if alone else right
    if not len(left) or not len(right):
        return
    start = np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]), np.array([0])
    waiting = [(0, start)]
    while waiting:
        depth, (a, b, c, d, differ) = waiting.pop()
        if len(a) > HELD:
            half = len(a) // 2
            waiting += [(depth, tuple(x[half:] for x in (a, b, c, d, differ))), (depth, tuple(x[:half] for x in (a, b, c, d, differ)))]
            continue
        size = (b - a) * (d - c)
        small = (size <= SMALL) | (depth == 64)
        if small.any():
            each, width = size[small], (d - c)[small]
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            x, y = np.repeat(a[small], each) + at // np.repeat(width, each), np.repeat(c[small], each) + at % np.repeat(width, each)
            near = np.bitwise_count(left[x] ^ right[y]) <= bits
            if alone:
                near &= x < y
            if near.any():
                yield x[near], y[near]
        a, b, c, d, differ = (x[~small] for x in (a, b, c, d, differ))
        if not len(a):
            continue
        m, n = _middle(left, a, b, depth), _middle(right, c, d, depth)
        own = alone & (a == c)
        crossed = np.where(own, n, c)  # a node against itself: one child against the other, once
        below = (
            np.concatenate([a, m, a, m]),
            np.concatenate([m, b, m, b]),
            np.concatenate([c, n, n, crossed]),
            np.concatenate([n, d, d, n]),
            np.concatenate([differ, differ, differ + 1, differ + 1]),
        )
        keep = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= bits)
        waiting.append((depth + 1, tuple(x[keep] for x in below)))


def _forest_of(bits: int):
    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [np.sort(rows["fp"].to_numpy()[rows["side"].to_numpy() == s].view(U64)) for s in (0, 1)]
        alone = not len(sides[1])
        values, found = np.concatenate(sides), Forest(len(sides[0]) + len(sides[1]))
        for x, y in linked(sides[0], None if alone else sides[1], bits):
            found.link(x, y if alone else y + len(sides[0]))
        child = np.flatnonzero(found.root != np.arange(len(values)))
        signed = values.view(np.int64)
        return pd.DataFrame({"a": signed[child], "b": signed[found.root[child]]})

    return forest


def _node_pairs(fps: DataFrame, bits: int, limit: int) -> list[tuple[int, DataFrame]]:
    """Depths with pairs ``u, v`` of nodes there, u <= v, that hold at most ``limit`` fingerprints or are full length."""
    depth, small = 0, []
    spark = fps.sparkSession
    total = fps.count()
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), F.lit(0).alias("differ"), F.lit(total).alias("held"))
    while True:
        if depth:
            small.append((depth, pairs.where((F.col("held") <= limit) | F.lit(depth == 64)).select("u", "v")))
        elif total <= limit:
            return [(0, pairs.select("u", "v"))]
        large = pairs.where(F.col("held") > limit)
        if depth == 64 or (depth and large.isEmpty()):
            return small
        step = min(STEP, 64 - depth)
        depth += step
        node = F.shiftrightunsigned("fp", 64 - depth) if depth < 64 else F.col("fp")
        nodes = materialised(fps.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n")))
        # At depth 0 all nodes have the one parent: a shift by 64 would leave them as they are.
        parent = F.shiftrightunsigned("node", step) if depth > step else F.lit(0).cast("long")
        of = lambda name, up: nodes.select(parent.alias(up), F.col("node").alias(name), F.col("n").alias(f"{name}_n"))
        met = large.drop("held").join(of("x", "u"), "u").join(of("y", "v"), "v")
        new = F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit((1 << step) - 1))
        met = met.withColumn("differ", F.col("differ") + F.bit_count(new))
        met = met.where((F.col("differ") <= bits) & ((F.col("u") != F.col("v")) | (F.col("x") <= F.col("y"))))
        held = F.when(F.col("x") == F.col("y"), F.col("x_n")).otherwise(F.col("x_n") + F.col("y_n"))
        pairs = materialised(met.select(F.col("x").alias("u"), F.col("y").alias("v"), "differ", held.alias("held")))


def links(fps: DataFrame, bits: int, limit: int = LIMIT) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of ``fp`` that differ in ``bits`` bits or fewer.

    ``fp`` holds different values. Any two within the budget are found; of links that lead round in a circle within
    one task one is left out.
    """
    sent = None
    for depth, pairs in _node_pairs(fps, bits, limit):
        node = F.lit(0).cast("long") if not depth else F.shiftrightunsigned("fp", 64 - depth) if depth < 64 else F.col("fp")
        at = fps.select("fp", node.alias("node"))
        first = at.join(pairs.withColumn("node", F.col("u")), "node").select("u", "v", "fp", F.lit(0).alias("side"))
        second = at.join(pairs.where("u <> v").withColumn("node", F.col("v")), "node").select("u", "v", "fp", F.lit(1).alias("side"))
        both = first.unionByName(second).withColumn("depth", F.lit(depth))
        sent = both if sent is None else sent.unionByName(both)
    return sent.groupBy("depth", "u", "v").applyInPandas(_forest_of(bits), "a long, b long")


def near_duplicates(docs: DataFrame, p: Params = Params(), text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row, the fingerprint as a long of the same bits.

    Rows are linked if their fingerprints differ in ``p.bits`` bits or fewer; ``component_id`` is the smallest doc_id
    that links lead to. Null, empty and blank texts have fingerprint 0 and are linked like any other. Rows that share
    a doc_id are judged each by its own text. A row without a doc_id links others but gives no name: its component is
    null where no row of it has one. An empty table gives no rows.
    """
    known = materialised(docs.select("doc_id", _fingerprint_udf(p)(F.col(text)).alias("fp")))
    fps = materialised(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    # Every fingerprint names its root, and a root its smallest doc_id.
    comps = components(links(fps.select("fp"), p.bits, limit))
    rooted = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")
    rooted = materialised(rooted)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    classes = attached(rooted.select("fp", "root", "n"), named, "root", "size").select("fp", "n", "component_id")
    return attached(known, classes, "fp", "n").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
