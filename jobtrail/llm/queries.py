"""One query per operator over its whole table, and the SQL that checks it where SQL can say it."""

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm import alignment, bpe, langid, linededup, minhash, mixing, prefixtrie, quality, sharding, simhash, suffix, topk, toxicity
from jobtrail.llm.common import materialised, n_words, table
from jobtrail.llm.queries_sql import SQL

SHARDS = 24
VOCABULARY = "byte_bpe_50k.tiktoken"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    return encoded.select("doc_id", *bpe.digests(encoded, vocabulary))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, minhash.Params(words=3, percent=85, rows=6))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = linededup.dedup_lines(docs, exact_chars=1)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.document_sizes(table(spark, sf_dir, "documents"))
    placed = sharding.shuffled_shards(rows, SHARDS, "size", ["doc_id", "text_crc32"], seed=17)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = materialised(quality.measure(docs).drop("text"))
    columns = ["doc_id", *[m for m in quality.MEASURES if m != "n_lines"], "base_failed", "host_rejected", "kept"]
    return quality.judge(measured).select(*columns)


def _fold(parts: int):
    """Remainder of the checksum of the id as text; a row without an id has that of an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(_fold(4) != 2))
    scored = docs.select("doc_id", (_fold(4) == 2).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_fold(5) != 0))
    named = langid.identify(docs.select("doc_id", "text", (_fold(5) == 0).alias("held_out")), model)
    return named.select("doc_id", "held_out", "lang_pred", "score")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialised(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("row_hash")))
    mixed = mixing.mix(rows)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (Path(public_tokenizers.path(name)).read_bytes() for name in ALIGNED)
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), simhash.Params(words=3, bits=2, seed=42))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash": op3_minhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_shards": op5_shards,
    "op6_top_k": op6_top_k,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_mix": op10_mix,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
}

ORACLE: dict[str, str] = {name: SQL[name] for name in QUERIES if name in SQL}
