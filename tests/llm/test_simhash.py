"""SimHash near-duplicates against plain loops over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from jobtrail.llm import simhash
from jobtrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(gap, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=2):
    """Fingerprint and component per row; rows are judged each by its own text."""
    marks = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= bits:
                group[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root(k) == root(i) and d is not None]
        out.append((doc_id, marks[i], min(ids) if ids else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in df.collect()), key=repr)


def words(rng, n):
    return [rng.choice("ab cd ef Gh ij kl mn öp 中文 qr".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(None, "no id here"), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\x0btwo\x1fthree")]
    for i in range(10, 60):
        text = words(rng, rng.choice([3, 20, 200, 900]))
        for j in range(3):
            copy = list(text)
            if j:
                copy[rng.randrange(len(copy))] = "changed"
            out.append((i * 10 + j, rng.choice([" ", "\n"]).join(copy)))
    out += [(9000, out[-1][1]), (9000, out[-1][1]), (9000, "another text of the same id"), (-3, out[20][1]), (None, out[30][1])]
    return out + [(9500, " ".join(words(rng, 90_000)))]


@pytest.mark.parametrize("limit", [simhash.LIMIT, 8])
def test_components_are_those_of_all_pairs(spark, rows, limit):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), limit=limit)
    assert found(got) == plain_components(rows)


def test_other_parameters(spark, rows):
    rows = rows[:60]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), simhash.Params(bits=9), limit=16)
    assert found(got) == plain_components(rows, bits=9)


def test_no_rows_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).collect() == []
    more = spark.createDataFrame([(1, "a b c d", 7, 8, 9)], "doc_id long, text string, fingerprint int, component_id int, n int")
    got = simhash.near_duplicates(more)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.first().component_id == 1


def test_only_nulls(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, None)] * 3, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(None, 0, None)] * 3


@pytest.mark.parametrize("bits", [0, 1, 2, 5])
def test_traversal_finds_every_pair(bits):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64))
    values = np.unique(np.concatenate([(seeds[:, None] ^ flips).ravel(), seeds, [np.uint64(0), np.uint64((1 << 64) - 1)]]))
    want = {(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= bits).tolist() if i < j}
    pairs = [(int(a), int(b)) for x, y in simhash.linked(values, None, bits) for a, b in zip(x, y)]
    assert set(pairs) == want and len(pairs) == len(want)
    left, right = values[::2], values[1::2]
    want = {(i, j) for i in range(len(left)) for j in np.flatnonzero(np.bitwise_count(right ^ left[i]) <= bits).tolist()}
    pairs = [(int(a), int(b)) for x, y in simhash.linked(left, right, bits) for a, b in zip(x, y)]
    assert set(pairs) == want and len(pairs) == len(want)


def test_spark_has_the_same_hash(spark):
    shingle = "öne two\x1f three"
    got = spark.range(1).selectExpr(f"xxhash64('{shingle}') AS h").first().h
    assert got % (1 << 64) == xxhash.xxh64(shingle.encode(), seed=42).intdigest()


def test_query_over_its_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op13_simhash"](spark, SF).collect()
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got), key=repr) == plain_components(docs)
    assert all(len(r.fingerprint) == 16 for r in got)
