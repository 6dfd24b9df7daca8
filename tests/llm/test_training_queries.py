"""The registered queries against their SQL, and where SQL cannot say it, against laws, libraries and held-out labels."""

import base64
import hashlib
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check import compare, oracle

from jobtrail.llm.queries import ORACLE, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def frame(spark, name, sf=SF):
    return QUERIES[name](spark, sf).toPandas().sort_values("doc_id", ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    result, _ = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert result.startswith("ok"), result


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1_is_what_tiktoken_gives(spark, con):
    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = frame(spark, "op1_byte_bpe").set_index("doc_id")
    texts = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(texts) == len(got)
    for doc_id, text in texts:
        ids, row = library.encode_ordinary(text or ""), got.loc[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op5_deals_every_document_once(spark, con):
    got = frame(spark, "op5_shards")
    texts = dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    assert sorted(got.doc_id) == sorted(texts)
    assert [s - 8 for s in got["size"]] == [len(texts[d].encode()) for d in got.doc_id]
    assert list(got.text_crc32) == [zlib.crc32(texts[d].encode()) for d in got.doc_id]
    counts = got.groupby("shard").size()
    assert set(counts.index) == set(range(24)) and counts.max() - counts.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert got.equals(frame(spark, "op5_shards"))


def test_op8_ranks_held_out_documents(spark):
    got = frame(spark, "op8_toxicity", LARGER)
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{LARGER}/labels.parquet'").df()
    assert list(got.held_out) == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got.merge(labels, on="doc_id")
    held = held[held.held_out]
    ranks, toxic = held.score.rank(), held.toxic == 1
    n, m = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n * (n + 1) / 2) / (n * m) > 0.97
    assert (held.predicted == held.toxic).mean() > 0.96


def test_op9_names_held_out_documents(spark):
    got = frame(spark, "op9_language", LARGER)
    langs = duckdb.sql(f"SELECT doc_id, lang FROM '{LARGER}/documents.parquet'").df()
    assert list(got.held_out) == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]
    held = got.merge(langs, on="doc_id")
    held = held[held.held_out]
    assert got.score.between(0, 1).all() and (held.lang_pred == held.lang).mean() > 0.98


def test_op10_meets_its_targets(spark, con):
    got = frame(spark, "op10_mix")
    sizes = dict(con.execute(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) FROM documents").fetchall())
    sources = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    got["source"] = [sources[d] for d in got.doc_id]
    assert [sizes[d] for d in got.doc_id] == list(got["size"])
    per = got.groupby("source").agg(words=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), longest=("size", "max"))
    assert (per.words == per.said).all()
    want = np.zeros(len(per))
    weight, limit, free = np.array([1 + i % 3 for i in range(len(per))], dtype=float), 3.0 * per.words.to_numpy(), np.ones(len(per), dtype=bool)
    while True:
        want[free] = weight[free] / weight[free].sum() * (per.words.sum() - limit[~free].sum())
        if not (free & (want > limit)).any():
            break
        full = free & (want > limit)
        want[full], free = limit[full], free & ~full
    assert np.allclose(per.target, want)
    assert (got.taken <= 3 * got["size"]).all()
    assert (np.abs(per.taken - per.target) <= 0.02 * per.target + 30).all()
    again = frame(spark, "op10_mix")
    assert list(again.taken) == list(got.taken)
