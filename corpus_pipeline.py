"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing to weights, token ids.

Each stage takes all that its predecessor kept, written as Parquet in between. All but the last return the columns
of ``documents``; the last returns one row per document of the mix with its token ids' digests.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm import bpe, linededup, minhash, mixing, quality
from jobtrail.llm.common import table, words, written
from jobtrail.session import shared_dir

VOCABULARY = "byte_bpe_50k.tiktoken"

#: Line dedup judges by edit distance and the mix by Newton steps: SQL expresses neither stage over whole tables.
ORACLE_SQL = None


def _aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but the used ones under names that no operator gives, and those names."""
    names = {c: c if c in used else f"__own{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no base rule and whose source is not condemned. Measures are taken once and written."""
    rows, names = _aside(docs, "text", "source")
    return _back(quality.judge(written(quality.measure(rows), "measured")).where("kept"), names)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier line equals or, from ``linededup.MIN_CHARS`` characters on,
    is within two edits of.

    A document that loses lines and has no word left goes with them.
    """
    rows, names = _aside(docs, "doc_id", "text")
    cleaned = linededup.dedup_lines(rows, exact_chars=1, max_edits=2)
    left = (F.col("n_removed") == 0) | (F.size(words(F.col("text"))) > 0)
    return _back(cleaned.where(left), names).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return minhash.keep_first(docs, minhash.Params(words=5, percent=80, rows=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those it takes no times go."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document of the mix."""
    import public_tokenizers

    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    encoded = bpe.encode(docs.select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    return encoded.select("doc_id", *bpe.digests(encoded, vocabulary))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", remove_repeated_lines),
    ("minhash near-dedup", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two is written to the folder that executors share."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark, "corpus")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
