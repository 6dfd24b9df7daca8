"""The corpus pipeline on a small corpus, stage by stage against brute force, and as a whole."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_training_operators import brute_components, brute_lines, brute_measures, near_copies, prose, reference_ids

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    shared = [prose(12, rng, 10**5) for _ in range(5)]
    rows = []
    for i in range(80):
        lines = [prose(rng.randrange(25, 60), rng, 10**5)] + rng.sample(shared, rng.randrange(0, 2)) + [prose(20, rng, 10**5)]
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 1))
    rows += [(100 + i, t if i % 5 else None, None, None if i % 3 else "s9", None) for i, (_, t) in enumerate(near_copies(rng))]
    rows += [(200, "few words", "en", "s1", 9), (201, "again and again " * 40, "en", "s1", 9), (202, rows[3][1], "en", "s2", 9)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before the first stage and after each."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    folder = tmp_path_factory.mktemp("stages")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(folder / str(i)))
        docs = spark.read.parquet(str(folder / str(i)))
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_but_the_last_stage_return_documents(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_quality_stage_drops_what_breaks_a_base_rule(stages):
    want = {d for d, t in texts(stages[0]).items() if (m := brute_measures(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert set(texts(stages[1])) == want and 201 not in want and 200 not in want


def test_line_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    want = {d: t for d, (t, _, n) in brute_lines(sorted(before.items())).items() if not n or re.search(r"[^\s]", t)}
    assert after == want and 202 not in after
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before = texts(stages[2])
    top, root = brute_components(sorted(before.items()), 5, 80)
    assert set(texts(stages[3])) == {d for d in before if root(d) == d}
    assert len(texts(stages[3])) < len(before)


def test_mixing_stage_comes_near_its_targets(stages):
    size = F.size(F.split(F.trim("text"), r"\s+"))
    per = {r["source"]: r["n"] for r in stages[3].groupBy("source").agg(F.sum(size).alias("n")).collect()}
    got = {r["source"]: r["n"] for r in stages[4].groupBy("source").agg(F.sum(size).alias("n")).collect()}
    order = sorted(per, key=lambda s: (s is None, s))
    weight, total, target, free = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(per.values()), {}, set(order)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s]}
        if not over:
            break
        target.update({s: 3 * per[s] for s in over})
        free -= over
    target.update(share)
    assert all(abs(got.get(s, 0) - target[s]) <= 0.02 * target[s] + 30 for s in order)
    assert stages[4].groupBy("doc_id").count().where("count > 3").count() == 0 and set(texts(stages[4])) <= set(texts(stages[3]))


def test_last_stage_encodes_whole_texts(stages):
    import public_tokenizers

    from jobtrail.llm.bpe import read_vocabulary

    vocabulary, known = read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), texts(stages[4])
    rows = stages[-1].collect()
    assert len(rows) == stages[4].count()
    for doc_id in list(known)[:20]:
        ids = reference_ids(vocabulary, known[doc_id])
        (row, *_) = [r for r in rows if r["doc_id"] == doc_id]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(known[doc_id].encode()).hexdigest()


def test_the_pipeline_as_a_whole(spark, sf_dir, stages):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[-1])


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_with_names_of_results_pass_through(spark):
    names = "n_words n_lines n_removed kept base_failed host_rate host_rejected n_symbols word_chars n_dup_lines n_repeat_words n size id copies rate target component_id".split()
    text = " ".join(f"word{i}" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    rows = [(1, text, "en", "s", 5, *range(len(names)))] * 2 + [(2, None, None, None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        left = [r for r in got.collect() if r.doc_id == 1]
        assert left and all(tuple(r)[5:] == tuple(range(len(names))) for r in left), name
