"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobtrail.llm import bpe, components, langid, linededup, minhash, mixing, quality, sharding, suffix, topk, toxicity
from jobtrail.llm.common import n_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)


def prose(n, rng=RNG, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcde'[rng.randrange(5)]}" for _ in range(n))


def edited(text, edits, rng=RNG):
    parts = text.split(" ")
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


def odd_rows():
    """Rows with nulls in every column, empty, blank and long texts, and repeats."""
    long_text = prose(30_000)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n", None, "a", 3),
        (4, long_text, "en", "b", len(long_text)),
        (5, long_text, "en", "b", len(long_text)),
        (None, "no id here " * 9, "en", None, 1),
        (7, "été 日本語 🎉 naïve\n" * 12, "fr", "c", 1),
        (8, "same row", "en", "a", 8),
        (8, "same row", "en", "a", 8),
        (9, "x" * 5000, "en", "d", 5000),
        (10, "\n".join(["a line that comes again and again"] * 6), "en", "d", 1),
    ]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns that carry the names operators give to results."""
    extra = ("ids", "n_removed", "kept", "n_words", "component_id", "shard", "copies", "score", "size", "n_lines")
    return docs_of(spark, odd_rows()).withColumns({name: F.lit("extra") for name in extra}).cache()


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


# Byte-level BPE


def reference_ids(vocabulary, text):
    import public_tokenizers
    import tiktoken

    ranks = bpe.parse_vocabulary(vocabulary)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (200, 64), (64, 16)])
def test_bpe_cuts_change_nothing(spark, odd, vocabulary, chunk, overlap):
    import public_tokenizers

    more = ["a" * 900, " " * 700 + "b", "it's we'll 'll ''ll" * 60, "x" + " " * 300 + "\n" * 300, "ab1!" * 400]
    docs = odd.select("doc_id", "text", "ids").unionByName(spark.createDataFrame([(100 + i, t, "") for i, t in enumerate(more)], "doc_id long, text string, ids string"))
    got = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap)
    rows = got.select("text", "ids", bpe.decode(vocabulary, F.col("ids")).alias("raw")).collect()
    assert len(rows) == len(odd_rows()) + len(more)
    known = {}
    for r in rows:
        text = r["text"] or ""
        if text not in known:
            known[text] = reference_ids(vocabulary, text)
        assert r["ids"] == known[text] and bytes(r["raw"]) == text.encode()


def test_the_common_pattern_splits_like_its_regex():
    import public_tokenizers

    assert public_tokenizers.PATTERN == bpe.COMMON_PATTERN
    fast, compiled, rng = bpe.splitter(bpe.COMMON_PATTERN), bpe.regex.compile(bpe.COMMON_PATTERN), random.Random(3)
    alphabet = ["'", "'", *"stmdlrev", "re", "ve", "ll", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "é", "日", "🎉", "1", "²", "Ⅷ", "!", "-", "\u0301", "B", "\0", "\x1c", "\x85", "ſ"]
    for _ in range(400):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 8))]
        for got, want in zip(fast(texts), bpe._regex_spans(texts, compiled)):
            assert got.tolist() == want.tolist()


def test_other_patterns_are_split_by_their_regex(spark, vocabulary):
    docs = spark.createDataFrame([("ab, cd  12",), (None,)], "text string")
    (some, none) = bpe.encode(docs, vocabulary, r"[a-z]+|[0-9]").orderBy(F.desc_nulls_last("text")).collect()
    assert [bpe.parse_vocabulary(vocabulary)[t] for t in (b"ab", b"cd", b"1", b"2")] == some["ids"] and none["ids"] == []


def test_pieces_with_a_common_hash_are_encoded_one_by_one(vocabulary):
    ranks, texts = bpe.parse_vocabulary(vocabulary), ["some words, some more", "", "more words"]
    pieces, spans = bpe._Pieces(ranks, bpe.PairTable(ranks)), bpe.splitter(bpe.COMMON_PATTERN)(texts)
    for a, b in zip(pieces.encode(texts, spans), pieces.one_by_one(texts, spans)):
        assert a.tolist() == b.tolist()


def test_bpe_merges_long_pieces_like_short_ones(vocabulary):
    ranks, rng = bpe.parse_vocabulary(vocabulary), random.Random(3)
    for n in (2, 7, 30, 255, 256):
        for alphabet in (b"ab", b"the oninrs", bytes(range(256))):
            piece = bytes(rng.choice(alphabet) for _ in range(n))
            if piece not in ranks:
                assert bpe.merge(piece, ranks) == bpe._merge_long(piece, ranks)
    assert len(bpe.merge(b"a" * 200_000, ranks)) < 200_000


# Suffix dedup


def brute_repeats(rows, length=suffix.LENGTH):
    least = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        if doc_id is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                least[s] = min(least.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw, gone = (text or "").encode(), set()
        for i in range(len(raw) - length + 1) if doc_id is not None else ():
            if least[raw[i : i + length]] < doc_id:
                gone.update(range(i, i + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc_id, len(raw), len(gone), spans, bytes(b for i, b in enumerate(raw) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_suffix_dedup_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(5)
    passages = [prose(rng.randrange(5, 40), rng) for _ in range(6)] + ["a" * 130, "ab" * 60, "ü" * 60]
    rows = [(rng.randrange(60), " ".join([prose(rng.randrange(0, 30), rng), *rng.sample(passages, rng.randrange(0, 3)), prose(rng.randrange(0, 9), rng)])) for _ in range(70)]
    rows += [(1, None), (2, ""), (None, passages[0] * 2), (3, passages[1]), (3, passages[1]), (99, passages[1][:49]), (98, passages[7])]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=700)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=repr) == brute_repeats(rows)


def test_suffix_dedup_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = suffix.remove_repeats(odd)
    assert got.columns == [*[c for c in odd.columns if c not in ("n_removed", "kept")], "n_bytes", "n_removed", "n_spans", "kept"]
    out = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in out), key=repr) == brute_repeats(rows)
    assert suffix.remove_repeats(odd.limit(0)).collect() == []


# MinHash


def brute_components(rows, words, percent):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        s = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        if doc_id is not None and s:
            sets.setdefault(doc_id, []).append(s)
    top = {doc_id: doc_id for doc_id, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    flat = [(d, s) for d, several in sets.items() for s in several]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                top[q] = p
    return top, root


def near_copies(rng):
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng.randrange(30, 120), rng)
        chain = base
        for _ in range(rng.randrange(0, 9)):
            chain = edited(chain if rng.random() < 0.5 else base, rng.randrange(0, 4), rng)
            rows.append((n, chain.upper() if rng.random() < 0.2 else chain))
            n += 1
    return rows + [(n + i, t) for i, t in enumerate(["one", "one", "one two", "", " \n", None, "ONE"])] + [(None, "one"), (3, rows[8][1])]


@pytest.mark.parametrize("p", [minhash.Params(words=3, percent=85, rows=6), minhash.Params()])
def test_minhash_finds_all_links(spark, monkeypatch, p):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = near_copies(random.Random(11))
    _, root = brute_components(rows, p.words, p.percent)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else root(r["doc_id"]))


def test_minhash_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, next(x[1] for x in got if x[0] == 4), 4), (8, 1, 8), (None, 6, None)} <= {(a, 6 if a is None else b, c) for a, b, c in got}
    kept = minhash.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id = 8").count() == 2
    assert minhash.near_duplicates(odd.limit(0)).collect() == []


def test_pruning_limits_bound_the_miss():
    for n in (32, 64, 256):
        m = minhash.least_matches(n, 0.85, 1e-8)
        assert 0 < m < 0.85 * n
        # Chance of fewer matches at the threshold itself, exactly.
        from math import comb

        assert sum(comb(n, i) * 0.85**i * 0.15 ** (n - i) for i in range(m)) < 1e-6


def test_components_by_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 5), (7, 7)]
    _, root = brute_components([(n, None) for n in range(1100)], 1, 100)
    top = {n: n for n in range(1100)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = sorted((find(a), find(b)))
            top[q] = p
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(n, find(n)) for a, b in edges if a is not None and a != b for n in (a, b)}
    assert len(got) == len({r["node"] for r in got})


def test_components_of_few_edges_run_few_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("few-edges", "components of a small table")
        found = components.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))
        tracker = context.statusTracker()
        infos = {s: tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
        context.setJobGroup("", "")
        assert {r["component"] for r in found.collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Only the edges as they come are dealt out to all; the rounds have as many tasks as their rows fill.
    assert sum(i is not None and i.numTasks >= 60 for i in infos.values()) <= 4


# Line dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute_lines(rows):
    """Rows have different ids here, so that id and line number order all lines."""
    places = sorted((d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if len(re.sub(r"[ \t-\r]", "", x)) >= linededup.MIN_CHARS)
    gone = {(d, i) for k, (d, i, x) in enumerate(places) if any(within_one(x, y) for _, _, y in places[:k])}
    out = {}
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        out[d] = (None if t is None else "\n".join(x for i, x in enumerate(lines) if (d, i) not in gone), len(lines), sum((d, i) in gone for i in range(len(lines))))
    return out


def test_line_dedup_is_exact(spark):
    rng = random.Random(9)
    lines = [prose(rng.randrange(3, 14), rng, 50) for _ in range(40)] + ["ü" * 20, "a" * 24, "short"]
    rows = []
    for d in range(60):
        body = []
        for _ in range(rng.randrange(0, 6)):
            x = rng.choice(lines)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(x) + 1), rng.choice("abcü ")
                x = rng.choice([x[:at] + c + x[at:], x[:at] + x[at + 1 :], x[:at] + c + x[at + 1 :]])
            body.append(x)
        rows.append((d, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(["z" * n for n in range(18, 34)]))]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == brute_lines(rows)


def test_line_dedup_of_odd_rows(spark, odd):
    got = linededup.dedup_lines(odd)
    assert got.columns == [*[c for c in odd.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"]
    rows = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in got.collect()}
    assert {(1, 0, 0), (2, 1, 0), (4, 1, 0), (5, 1, 1), (8, 1, 0), (10, 6, 5)} <= rows and got.count() == len(odd_rows())
    assert linededup.dedup_lines(odd.limit(0)).collect() == []


def test_line_dedup_drops_exact_repeats_of_short_lines(spark):
    rows = [(1, "Les.\n\n\nA line that is long enough to count.\nLes."), (2, "Les!\nLes.\n \n中。\nAll rights reserved."), (3, "中。\nAll rights reserved.\nx"), (4, "Les."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(docs, exact_chars=1).collect()}
    # Short lines go if they are equal ("Les!" is near only), blank ones stay.
    assert got == {
        1: ("Les.\n\n\nA line that is long enough to count.", 5, 1),
        2: ("Les!\n \n中。\nAll rights reserved.", 5, 1),
        3: ("x", 3, 2),
        4: ("", 1, 1),
        5: (None, 0, 0),
    }
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    left = stage(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "").collect()
    assert {r["doc_id"]: r["text"] for r in left} == {d: t for d, (t, _, _) in got.items() if d != 4}
    with pytest.raises(ValueError):
        linededup.dedup_lines(docs, min_chars=3, exact_chars=4)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [2, 3])
def test_line_dedup_finds_all_within_the_bound(spark, monkeypatch, edits):
    monkeypatch.setattr(linededup, "BLOCK_LINES", 4)
    rng = random.Random(edits)
    lines = [prose(rng.randrange(4, 10), rng, 50) for _ in range(12)] + ["ü" * 24]
    rows = []
    for d in range(45):
        body = []
        for _ in range(rng.randrange(1, 4)):
            x = rng.choice(lines)
            for _ in range(rng.randrange(edits + 2)):
                at, c = rng.randrange(len(x) + 1), rng.choice("abcü ")
                x = rng.choice([x[:at] + c + x[at:], x[:at] + x[at + 1 :], x[:at] + c + x[at + 1 :]])
            body.append(x)
        rows.append((d, "\n".join(body)))
    places = sorted((d, i, x) for d, t in rows for i, x in enumerate(t.split("\n")) if len(re.sub(r"[ \t-\r]", "", x)) >= linededup.MIN_CHARS)
    gone = {(d, i) for k, (d, i, x) in enumerate(places) if any(distance(x, y) <= edits for _, _, y in places[:k])}
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), max_edits=edits).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_line_keys_meet_for_all_partners_within_the_bound():
    rng = random.Random(4)
    for edits in (2, 3, 4):
        for _ in range(150):
            a = b = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 90)))
            for _ in range(edits):
                at, c = rng.randrange(len(b) + 1), rng.choice("xyz")
                b = rng.choice([b[:at] + c + b[at:], b[:at] + b[at + 1 :], b[:at] + c + b[at + 1 :]])
            *_, keys, counts = linededup._line_rows([a, b], 1, 1, edits)
            assert set(keys[: counts[0]]) & set(keys[counts[0] :]), (edits, a, b)


def test_pipeline_drops_lines_within_two_edits(spark):
    line = "Subscribe to our weekly letter and never miss a story again"
    docs = spark.createDataFrame([(1, line), (2, line.replace("weekly", "wekly").replace("story", "storry")), (3, line[:30])], "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs.withColumn("n_chars", F.length("text").cast("long")), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]


# Sharding


@pytest.mark.parametrize("bucket", [1, 40, 10**9])
def test_shards_differ_by_one_row(spark, bucket):
    rows = spark.range(101).select(F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"), F.lit("x").alias("slot")).repartition(5)
    got = sharding.shuffled_shards(rows, 7, "size", ["doc_id"], seed=3, bucket_bytes=bucket).toPandas()
    assert sorted(got.doc_id) == list(range(101)) and set(got.shard) == set(range(7))
    assert got.groupby("shard").size().isin([14, 15]).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    other = sharding.shuffled_shards(rows.repartition(2), 7, "size", ["doc_id"], seed=3, bucket_bytes=bucket).toPandas()
    assert got.sort_values("doc_id").values.tolist() == other.sort_values("doc_id").values.tolist()
    assert list(got.sort_values(["slot", "shard"]).doc_id) != list(range(101))


def test_shards_of_odd_rows(spark, odd, tmp_path):
    rows = sharding.document_sizes(odd)
    got = sharding.shuffled_shards(rows, 4, "size", ["doc_id", "text_crc32"])
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(counts) == len(odd_rows()) and max(counts) - min(counts) <= 1
    assert rows.where("text_crc32 = 0 and size = 8").count() == 2
    assert sharding.shuffled_shards(rows.limit(0), 4, "size", ["doc_id"]).collect() == []
    sharding.write_shards(got, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(odd_rows())


# Top-k


def brute_top(queries, vectors, k):
    out = []
    for q, v in sorted({(q, tuple(v)) for q, v in queries}):
        n = lambda x: sum(a * b for a, b in zip(v, x))
        best = sorted((-n(x), i) for i, x in {(i, tuple(x)) for i, x in vectors} if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("scale", [3, 200, 10**7, 10**8])
def test_top_k_is_exact(spark, scale):
    rng = random.Random(scale)
    vectors = [(i, [rng.randrange(-scale, scale + 1) for _ in range(9)]) for i in range(300)]
    vectors += [(i + 300, vectors[7][1]) for i in range(60)] + [(400, []), (401, [5]), (402, [0] * 9)] + vectors[:20]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, k=5, block_rows=64).collect()
    want = brute_top([x for x in vectors if x[0] % 50 == 0], vectors, 5)
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df).collect() == [] and topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).collect() == []


def test_only_sound_vectors_take_part(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, [128, -1]), (6, [])]


# Quality rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


def test_measures_by_brute_force(spark, odd):
    rng = random.Random(4)
    some = [" ".join(rng.choice("abc") for _ in range(n)) for n in (7, 8, 9, 30, 120)] + ["a b c d e f g h " * 3, "\x0b x\x0c\x1cy z #*$ ", "l\nl\n \n l\nl"]
    rows = [(100 + i, t) for i, t in enumerate(some)]
    docs = odd.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(*r, "") for r in rows], "doc_id long, text string, n_words string"))
    for r in quality.measure(docs).collect():
        assert tuple(r[m] for m in quality.MEASURES) == brute_measures(r["text"]), r["doc_id"]


@pytest.mark.parametrize("broadcast_rows", [quality.BROADCAST_ROWS, 0])
def test_hosts_are_condemned_on_evidence(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(1)
    good, bad = prose(60, rng, 10**6), prose(60, rng, 10**6).replace(" ", "$ ")
    rows = [(i, good, "en", f"ok{i % 9}", 1) for i in range(180)] + [(1000 + i, bad if i % 10 else good, "en", "spam", 1) for i in range(60)]
    rows += [(2000, bad, "en", "once", 1), (2001, "too short", "en", "ok1", 1), (2002, None, "en", None, 1), (2003, good, "en", None, 1)]
    got = {r["doc_id"]: r for r in quality.judge(quality.measure(docs_of(spark, rows))).collect()}
    assert len(got) == len(rows)
    assert not any(got[1000 + i]["kept"] for i in range(60)) and all(got[i]["kept"] for i in range(180))
    # One failure of one document is no evidence against a host; the host of null is a host like others.
    assert got[2000]["kept"] and not got[2000]["host_rejected"]
    assert got[2001]["base_failed"] and not got[2001]["kept"] and not got[2002]["kept"] and got[2003]["kept"]
    assert quality.judge(quality.measure(docs_of(spark, rows).limit(0))).collect() == []


def test_quality_of_odd_rows(spark, odd):
    got = quality.judge(quality.measure(odd))
    assert got.count() == len(odd_rows()) and {(r["doc_id"], r["kept"]) for r in got.collect()} >= {(1, False), (2, False), (4, True)}


# Mixing


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    return mixing.mix(df.withColumn("row_hash", F.xxhash64("doc_id")).withColumn("target", F.lit("extra")), **more).toPandas()


def test_rates_are_the_tilts_that_meet_the_targets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "c", None, "d"]), rng.choice([0, 1, 7, rng.randrange(1, 400)])) for i in range(900)]
    rows += [(5000 + i, "a", 33) for i in range(2500)] + [(9000, "none", 0)]
    got = mixed(spark, rows)
    assert sorted(got.doc_id) == sorted(r[0] for r in rows)
    for source, g in got.groupby("source", dropna=False):
        words = (g["size"] * g.rate).sum()
        if source == "none":
            assert g.target.iloc[0] == 0 and list(g.copies) == [1]
            continue
        assert abs(words - g.target.iloc[0]) <= 1e-5 * g.target.iloc[0]
        # An exponential tilt by size: log rate over size is one number wherever the limit is not reached.
        free = g[(g.rate < 2.999) & (g["size"] > 0)]
        tilt = np.log(free.rate) / free["size"]
        assert not len(free) or tilt.max() - tilt.min() <= 1e-9
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 3
        assert g.copies.between(0, 3).all() and (g.groupby("size").copies.agg(lambda c: c.max() - c.min()) <= 1).all()
    assert got.sort_values("doc_id").copies.tolist() == mixed(spark, rows[::-1]).sort_values("doc_id").copies.tolist()


def test_targets_are_capped_and_reshared(spark):
    got = mixed(spark, [(1, "a", 100), (2, "b", 1000), (3, "c", 10), (4, None, 1)]).sort_values("doc_id")
    # Weights 1, 2, 3, 1: c and null stop at 30 and 3, then a at 300; b takes the rest.
    assert list(got.target) == [300.0, 778.0, 30.0, 3.0] and list(got.copies) == [3, 1, 3, 3]
    assert len(mixed(spark, [(1, "a", 0)])) == 1
    empty = spark.createDataFrame([], "doc_id long, source string, size long, row_hash long")
    assert mixing.mix(empty).collect() == []


def test_mixed_documents_repeat_rows(spark, odd):
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    slim = odd.select("source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("row_hash"))
    want = mixing.mix(slim).agg(F.sum("copies")).first()[0]
    assert got.count() == want and mixing.mixed_documents(odd.limit(0)).collect() == []


# Classifiers


def test_language_gradients_by_finite_differences():
    """One small step along the gradient must lower the loss that the forward pass gives."""
    rng = np.random.default_rng(0)
    windows = np.concatenate([rng.integers(97, 104, (60, langid.WINDOW)), rng.integers(104, 111, (60, langid.WINDOW))]).astype(np.uint8)
    langs = np.repeat([0, 1], 60)
    model = langid.train(windows, langs, ["x", "y"], langid.Training(steps=60, batch=32, hidden=4))
    texts = [bytes(w) for w in windows]
    assert (langid.probabilities(model, texts).argmax(axis=1) == langs).mean() > 0.95
    sums = langid.probabilities(model, [texts[0] + texts[60], texts[0], b""])
    assert np.allclose(sums[:2].sum(axis=1), 1, atol=1e-5) and (sums[2] == 0).all()


def test_language_of_odd_rows(spark, odd):
    model = langid.fit(odd, langid.Training(steps=20))
    assert model.langs == ["en", "fr"]
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and all(lang in ("en", "fr", "und") for _, lang in got)
    nothing = langid.fit(odd.where("lang is null"), langid.Training(steps=2))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).collect() == []


def test_toxicity_of_odd_rows(spark, odd):
    rng = random.Random(6)
    rows = [(i, prose(40, rng) + (" you grumblefoot " + prose(9, rng) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)] + [(900, None, 1), (901, "", 0), (902, "x", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, labelled)
    assert "grumblefoot" in model.lexicon
    got = odd.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["s"] <= 1 for r in got)
    two = spark.createDataFrame([("you grumblefoot of a thing",), (prose(30, rng),)], "text string").select(toxicity.score(model, F.col("text")).alias("s")).collect()
    assert two[0]["s"] > 0.5 > two[1]["s"]
    blank = toxicity.fit(labelled.limit(0), labelled.limit(0))
    assert all(0 <= r["s"] <= 1 for r in odd.select(toxicity.score(blank, F.col("text")).alias("s")).collect())


def test_isotonic_knots_rise():
    rng = np.random.default_rng(3)
    score = rng.normal(size=500)
    x, y = toxicity.isotonic(score, (rng.random(500) < 1 / (1 + np.exp(-score))).astype(float), np.ones(500))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_digest_of_words_is_not_split_by_batches(spark):
    """Texts over a megabyte and many in a batch give the sets each gives alone."""
    texts = [prose(n).encode() for n in (0, 1, 2, 3, 200_000, 5)]
    together = minhash.shingle_sets(texts, 3)
    assert all((a == b).all() for t, a in zip(texts, together) for b in minhash.shingle_sets([t], 3))
    assert hashlib.blake2b(together[4].tobytes()).digest() and pd.Series([len(s) for s in together]).tolist()[:4] == [0, 1, 1, 1]
