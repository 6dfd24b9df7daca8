"""Near-duplicates by MinHash: banded candidates, sequential Bayesian pruning, and exact verification.

Documents whose signatures agree in all rows of a band are candidates. Their signatures are compared batch by batch;
a pair is dropped as soon as, given the matches so far, the posterior probability that its similarity reaches the
threshold is below a chosen miss probability. What is left is verified on the full sets of shingles.

A bucket of m documents holds m * m / 2 candidates, and most say nothing new: copies of one text are all linked. So
each bucket first verifies its members against its smallest. Only members of one bucket that are then still in
different components are compared pair by pair, each pair in the first band it shares, in blocks of bounded size, so
that no link between components goes unseen. What tasks send on are pairs that pruning leaves, not all pairs.
"""

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import attached, materialised, mixed64, packed, prefiltered, written
from jobtrail.llm.components import components

#: Rows of a bucket that meet in one block at most, from either side, and rows of blocks that go to one group.
BLOCK, GROUP = 512, 8192
#: Documents whose signatures and sets fill a task.
SETS = 2000
#: Hashes of the signature that is compared, 8 bits of each, and how many are compared at a time.
COMPARED, BATCH = 1024, 64
U64 = np.uint64


@dataclass(frozen=True)
class Params:
    """``percent`` / 100 is the similarity that links. ``miss`` bounds the chance to lose a link, in bands and in pruning."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-8
    seed: int = 11

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches of ``n`` hashes that leave the similarity at or over the threshold a chance of ``miss``.

    With a uniform prior, the chance after m matches of n is that of at most m successes in n + 1 trials.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _gaps() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[32, *range(9, 14)]] = True
    return t


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, A-Z lower-cased.

    A text of fewer words than a shingle has its whole sequence as its one shingle; one without words has none.
    """
    lowered, gaps, empty = _lowered(), _gaps(), np.zeros(0, dtype=U64)
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        # About a megabyte at a time keeps the arrays in the cache and bounds them.
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < 1 << 20):
            size += len(texts[stop]) + 1
            stop += 1
        data = np.frombuffer(b" ".join(texts[at:stop]) + b" ", dtype=np.uint8)
        borders = np.cumsum([0] + [len(t) + 1 for t in texts[at:stop]])
        gap = gaps[data]
        inner = np.flatnonzero(~gap)
        if not len(inner):
            out += [empty] * (stop - at)
            at = stop
            continue
        first = np.flatnonzero(np.diff(inner, prepend=-2) > 1)
        starts = inner[first]
        place = inner - np.repeat(starts, np.diff(first, append=len(inner)))
        weights = mixed64(np.arange(1, int(place.max()) + 2, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
        hashes = mixed64(np.add.reduceat((lowered[data[inner]].astype(U64) + U64(1)) * weights[place], first))
        counts = np.searchsorted(starts, borders)
        factors = mixed64(np.arange(1, words + 2, dtype=U64)) | U64(1)
        n = len(hashes)
        whole = np.zeros(max(n - words + 1, 0), dtype=U64)
        for i in range(words):
            whole += hashes[i : i + len(whole)] * factors[i]
        whole = mixed64(whole)
        for lo, hi in zip(counts[:-1], counts[1:]):
            if hi - lo >= words:
                out.append(np.unique(whole[lo : hi - words + 1]))
            elif hi > lo:
                few = np.concatenate([hashes[lo:hi], np.full(1, hi - lo, dtype=U64)]) * np.append(factors[: hi - lo], factors[words])
                out.append(mixed64(few.sum(keepdims=True, dtype=U64)))
            else:
                out.append(empty)
        at = stop
    return out


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least value of each of many hash functions over a set, its upper 32 bits."""
    least = np.full(len(multipliers), np.iinfo(U64).max, dtype=U64)
    for i in range(0, len(hashes), 128):
        np.minimum(least, np.multiply.outer(hashes[i : i + 128], multipliers).min(axis=0), out=least)
    return (least >> U64(32)).astype(np.uint32)


def _multipliers(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Of the hash functions that make bands, and of others that make the signature to compare."""
    m = mixed64(np.arange(1, p.hashes + COMPARED + 1, dtype=U64) * U64(0xA0761D6478BD642F) + U64(p.seed)) | U64(1)
    return m[: p.hashes], m[p.hashes :]


def band_keys(signatures: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit key per row and band."""
    s = signatures.astype(U64).reshape(len(signatures), p.bands, p.rows)
    factors = mixed64(np.arange(1, p.rows + 1, dtype=U64) * U64(0xE7037ED1A0B428DB)) | U64(1)
    return mixed64((s * factors).sum(axis=2, dtype=U64) + mixed64(np.arange(1, p.bands + 1, dtype=U64)))


def _texts(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8") for t in column]


def _keys_udf(p: Params):
    kind = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:bigint,digest:binary,keys:array<bigint>>")
    def keys(texts: pa.Array) -> pa.Array:
        m, out = _multipliers(p)[0], []
        for at in range(0, len(texts), 256):
            for s in shingle_sets(_texts(texts[at : at + 256]), p.words):
                if not len(s):
                    out.append({"n": 0})
                    continue
                bands = band_keys(signature(s, m)[None, :], p)[0].view(np.int64)
                out.append({"n": len(s), "digest": hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "keys": bands})
        return pa.array(out, type=kind)

    return keys


def _sets_udf(p: Params):
    kind = pa.struct([("sig", pa.binary()), ("bands", pa.binary()), ("members", pa.binary())])

    @F.arrow_udf("struct<sig:binary,bands:binary,members:binary>")
    def sets(texts: pa.Array) -> pa.Array:
        (banded, compared), out = _multipliers(p), []
        for at in range(0, len(texts), 256):
            for s in shingle_sets(_texts(texts[at : at + 256]), p.words):
                if not len(s):
                    out.append({"sig": None, "bands": None, "members": None})
                    continue
                keys = band_keys(signature(s, banded)[None, :], p)[0].astype(np.uint32)
                out.append({"sig": signature(s, compared).astype(np.uint8).tobytes(), "bands": keys.tobytes(), "members": s.tobytes()})
        return pa.array(out, type=kind)

    return sets


def _limits(p: Params) -> list[int]:
    return [least_matches(n, p.percent / 100, p.miss) for n in range(BATCH, COMPARED + 1, BATCH)]


def _rows(column, kind) -> np.ndarray:
    """Packed values of equal length as the rows of a matrix."""
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def survivors(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, limits: list[int]) -> np.ndarray:
    """Which of the pairs left[x], right[y] are not pruned, batch after batch.

    Two hashes that differ may agree in 8 bits, which only makes a pair look more alike: none is lost by it.
    """
    alive, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int32)
    for i, limit in enumerate(limits):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += np.count_nonzero(left[x[alive], cut] == right[y[alive], cut], axis=1).astype(np.int32)
        alive = alive[matches[alive] >= limit]
    return alive


def _similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two packed sets are similar enough, exactly."""
    left, right = np.frombuffer(a, dtype=U64), np.frombuffer(b, dtype=U64)
    if len(left) > len(right):
        left, right = right, left
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    inter = int(np.count_nonzero(right[at] == left))
    return 100 * inter >= percent * (len(left) + len(right) - inter)


def _likely_udf(p: Params):
    limits = _limits(p)

    @F.arrow_udf("boolean")
    def likely(s1: pa.Array, s2: pa.Array) -> pa.Array:
        out = np.zeros(len(s1), dtype=bool)
        for at in range(0, len(out), 1024):
            left, right = (_rows(s[at : at + 1024].to_pylist(), np.uint8) for s in (s1, s2))
            own = np.arange(len(left))
            out[at + survivors(left, right, own, own, limits)] = True
        return pa.array(out)

    return likely


def _similar_udf(p: Params):
    @F.arrow_udf("boolean")
    def similar(m1: pa.Array, m2: pa.Array) -> pa.Array:
        return pa.array([_similar(x.as_py(), y.as_py(), p.percent) for x, y in zip(m1, m2)], type=pa.bool_())

    return similar


def _joined(pairs: DataFrame, active: DataFrame, column: str) -> DataFrame:
    """Pairs ``a, b`` with a column of either side as ``x`` and ``y``."""
    side = lambda name, value: active.select(F.col("id").alias(name), F.col(column).alias(value))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")


def _pruned(pairs: DataFrame, active: DataFrame, p: Params) -> DataFrame:
    """Of the pairs ``a, b`` those that signatures do not rule out."""
    return _joined(pairs, active, "sig").where(_likely_udf(p)("x", "y")).select("a", "b")


def _verified(pairs: DataFrame, active: DataFrame, p: Params) -> DataFrame:
    """Of the pairs ``a, b`` those whose full sets are similar enough."""
    return _joined(pairs, active, "members").where(_similar_udf(p)("x", "y")).select("a", "b")


def _across(p: Params):
    limits = _limits(p)

    def compare(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "kind", "i", "j", "side"], ignore_index=True)
        block = rows[["key", "kind", "i", "j"]].ne(rows[["key", "kind", "i", "j"]].shift()).any(axis=1).to_numpy()
        heads = np.flatnonzero(block)
        sides, comps, band = rows["side"].to_numpy(), rows["comp"].to_numpy(), rows["band"].to_numpy()
        # A document comes once for each of its buckets, its signature once for all of the group.
        known = known.drop_duplicates("doc").sort_values("doc", ignore_index=True)
        sigs, bands, ids = _rows(known["sig"], np.uint8), _rows(known["bands"], np.uint32), rows["id"].to_numpy()
        row = np.searchsorted(known["doc"].to_numpy(), ids)
        keep, waiting, size = [], [], 0

        def flush():
            x, y = (np.concatenate(part) for part in zip(*waiting))
            alive = survivors(sigs, sigs, row[x], row[y], limits)
            first = (bands[row[x[alive]]] == bands[row[y[alive]]]).argmax(axis=1)
            alive = alive[first == band[x[alive]]]
            keep.append(np.stack([ids[x[alive]], ids[y[alive]]], axis=1))

        for lo, hi in zip(heads, np.append(heads[1:], len(rows))):
            # Side 0 holds rows that meet each other; side 1 meets side 2.
            alone = sides[lo] == 0
            middle = hi if alone else lo + int(np.searchsorted(sides[lo:hi], 2))
            for one in range(lo, middle):
                others = np.arange(one + 1 if alone else middle, hi)
                others = others[comps[others] != comps[one]]
                if len(others):
                    waiting.append((np.full(len(others), one), others))
                    size += len(others)
                # So many pairs are held at a time, whatever the size of the group.
                if size >= 1 << 16:
                    flush()
                    waiting, size = [], 0
        if waiting:
            flush()
        pairs = np.concatenate([np.zeros((0, 2), dtype=np.int64), *keep])
        return pd.DataFrame({"a": pairs.max(axis=1), "b": pairs.min(axis=1)})

    return compare


def _cross_pairs(apart: DataFrame, active: DataFrame, p: Params) -> DataFrame:
    """Pairs of one bucket in different components that signatures do not rule out; ``apart``: ``key, band, id, comp``.

    The members of a bucket's largest component need not meet each other. The others meet those and each other, in
    blocks: a member goes to as many blocks as there are of those it has to meet.
    """
    sizes = apart.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("x"), F.sum("m").alias("all"))
    main = main.select("key", F.col("x.comp").alias("main"), "all", F.ceil(F.col("x.m") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("x.m")) / BLOCK).cast("int").alias("rests"))
    # Buckets with one main component hold much the same documents: they share groups, as few as their rows need.
    shares = main.groupBy("main").agg(F.ceil(F.sum("all") * 2 / GROUP).alias("parts"))
    main = written(main.drop("all").join(shares, "main"), "main-components")
    rows = apart.join(main, "key")
    of = lambda n: F.pmod(F.xxhash64("id", "key"), n).cast("int")
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    own = of(F.col("rests"))
    to_rests = F.transform(each(F.col("rests")), lambda j: task(0, of(F.col("mains")), j, F.lit(1)))
    to_mains = F.transform(each(F.col("mains")), lambda i: task(0, i, own, F.lit(2)))
    side = lambda j: F.when(j == own, 0).when(j > own, 1).otherwise(2)
    to_each = F.transform(each(F.col("rests")), lambda j: task(1, F.least(j, own), F.greatest(j, own), side(j)))
    tasks = F.when(F.col("comp") == F.col("main"), to_rests).otherwise(F.concat(to_mains, to_each))
    groups = max(1, -(-apart.count() * 2 // GROUP))
    dealt = rows.select("key", "band", "id", "comp", "main", "parts", F.explode(tasks).alias("t"))
    dealt = dealt.select("key", "band", "id", "comp", "main", "parts", "t.kind", "t.i", "t.j", "t.side")
    block = F.pmod(F.xxhash64("key", "kind", "i", "j"), F.col("parts"))
    small = F.pmod(F.xxhash64("main"), F.lit(groups))
    group = F.when(F.col("parts") == 1, small).otherwise(F.xxhash64("main", block))
    dealt = written(dealt.withColumn("group", group).drop("main", "parts"), "dealt")
    asked = dealt.select(F.col("group").alias("of"), F.col("id").alias("doc")).distinct()
    known = asked.join(active.select(F.col("id").alias("doc"), "sig", "bands"), "doc")
    return dealt.groupBy("group").cogroup(known.groupBy("of")).applyInPandas(_across(p), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per input row.

    Documents are linked if the Jaccard similarity of their sets of word shingles is at least ``p.percent`` / 100;
    ``component_id`` is the smallest doc_id that links lead to. Null, empty and blank texts have no shingles and no
    links. Rows that share a doc_id are one document: what links one links all. Rows without a doc_id are compared
    with nothing and have no component.

    Documents with equal sets are one from the start (a digest per document, grouped with partial aggregates), so
    copies cost nothing later. Sets are compared by 64-bit hashes of their shingles.
    """
    base = docs.select("doc_id", _keys_udf(p)(F.col(text)).alias("x"))
    known = materialised(base.select("doc_id", F.col("x.n").alias("n"), F.col("x.digest").alias("digest"), F.col("x.keys").alias("keys")))
    sound = known.where("doc_id is not null and n > 0")
    # Slim tables are written as Parquet, which packs small files into few partitions when it is read.
    classes = written(sound.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("m")), "classes")
    member = attached(sound.select("doc_id", "digest"), classes, "digest", "m")
    same = member.where("doc_id <> id").select("doc_id", "id").distinct()
    first = sound.join(classes.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    banded = first.select(F.col("doc_id").alias("id"), F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last").select("key", "pivot")
    shared = written(shared, "shared-keys")
    buckets = written(prefiltered(banded, "key", shared).join(shared, "key").select("key", "band", "id", "pivot"), "buckets")
    # Texts of documents that share a bucket.
    wanted = written(buckets.select(F.col("id").alias("doc_id")).distinct(), "in-buckets")
    active = prefiltered(docs.select("doc_id", text), "doc_id", wanted).join(wanted, "doc_id", "left_semi")
    active = materialised(active.select(F.col("doc_id").alias("id"), _sets_udf(p)(F.col(text)).alias("x")).select("id", "x.sig", "x.bands", "x.members"))
    active = packed(active.where("sig is not null"), wanted.count(), SETS)

    pairs = buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = written(_verified(_pruned(pairs, active, p), active, p), "links")
    comps = components(links).withColumnRenamed("node", "id")
    named = buckets.select("key", "band", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    mixed = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    apart = written(named.join(mixed, "key", "left_semi"), "apart")
    links = links.unionByName(_verified(_cross_pairs(apart, active, p), active, p))
    comps = components(links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    out = known.select("doc_id", F.col("n").alias("n_shingles")).join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """The input's rows whose doc_id is the smallest of its component, and rows without a doc_id."""
    dropped = near_duplicates(docs, p, text).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
