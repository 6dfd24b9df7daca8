"""Alignment of two tokenizers, each different text once.

Texts are shuffled by their whole text and counted, so a text is tokenised and aligned once however many documents hold
it. Its byte offsets where a token of either side ends cut both token sequences into groups; the two tokens that end
there are linked. Tasks gather texts into batches and keep of each text the distinct pairs of linked ids as places in
the batch's sorted list of pairs. Pairs are counted over the corpus from those lists, weighed by how often the texts
come, and only the counts of its own pairs go back to a batch. Measures are joined to doc_ids by a digest of the text.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import attached, materialised
from jobtrail.session import shared_dir

#: Bytes of text that are tokenised at once, and that share a list of pairs. A longer text is on its own.
PIECE, BATCH = 1 << 19, 1 << 23
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
U64 = np.uint64
_BATCH = "batch long, keys array<binary>, n array<long>, n_a array<long>, n_b array<long>, links array<long>, groups array<string>, pairs binary, weights binary, places binary, times binary, cuts binary"
_KIND = pa.schema(
    [("batch", pa.int64()), ("keys", pa.list_(pa.binary()))]
    + [(c, pa.list_(pa.int64())) for c in ("n", "n_a", "n_b", "links")]
    + [("groups", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("pairs", "weights", "places", "times", "cuts")]
)
_MEASURED = "key binary, n long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters stand for themselves; the other bytes, in order, for those from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library: ids of texts, and the bytes of each id.

    Where the file's merges stand in the order of their ids and nothing else shapes the result, tiktoken gives the same
    ids several times faster; any other byte-level file is read by its own library.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, byte = spec["model"], _byte_of()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ids = {**model["vocab"], **added}
        self.entries = [b""] * (max(ids.values()) + 1)
        for token, at in ids.items():
            self.entries[at] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode("utf-8")
        before = spec.get("pre_tokenizer") or {}
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        plain = {token: at for token, at in model["vocab"].items() if token not in added}
        in_order = None not in merged and all(x < y for x, y in zip(merged, merged[1:])) and len(plain) == 256 + len(merged)
        shaped = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if in_order and level and not any(shaped) and not spec.get("normalizer") and not spec.get("post_processor"):
            import public_tokenizers
            import tiktoken

            ranks = {self.entries[at]: at for at in plain.values()}
            library = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [library.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in texts]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_buffer(data)
            library.encode_special_tokens = True
            self.encode = lambda texts: [np.array(library.encode(t, add_special_tokens=False).ids, dtype=np.int64) for t in texts]


class Pieces:
    """A sentencepiece model that puts a space before a text: ids of texts, and the bytes of each id."""

    def __init__(self, data: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.entries = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.encode = lambda texts: [np.array(ids, dtype=np.int64) for ids in library.encode(texts, num_threads=1)]


class Aligner:
    """Token ids of texts in both vocabularies, their groups, and the pairs of ids that end together."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.sizes = [np.array([len(x) for x in side.entries], dtype=np.int64) for side in (self.a, self.b)]
        self.n_b = len(self.b.entries)
        ids = [[b"%d" % i for i in range(len(side.entries))] for side in (self.a, self.b)]
        # An id is followed by "," within a group, by "|" or ";" at its end.
        self.names = [x + end for part, last in zip(ids, (b"|", b";")) for end in (b",", last) for x in part]

    def align(self, texts: list[str]):
        """Of each text the numbers of tokens and links and the hash of its groups, and all links' pairs in order.

        A text whose tokens do not spell it has none. No entry of a vocabulary is empty, so that tokens of one side
        never end together and each group has one link, that of its last two tokens.
        """
        spaced = [" " + t for t in texts]
        tokens = [self.a.encode(spaced), self.b.encode(texts)]
        none = np.zeros(0, dtype=np.int64)
        for i, text in enumerate(spaced):
            raw = text.encode("utf-8")
            if not texts[i] or any(b"".join(map(side.entries.__getitem__, ids[i].tolist())) != raw for side, ids in zip((self.a, self.b), tokens)):
                tokens[0][i] = tokens[1][i] = none
        n_a, n_b = (np.array([len(x) for x in ids]) for ids in tokens)
        a, b = (np.concatenate([none, *ids]) for ids in tokens)
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        marks = np.zeros((2, int(ends_a[-1]) + 1 if len(ends_a) else 1), dtype=bool)
        marks[0, ends_a], marks[1, ends_b] = True, True
        last_a, last_b = marks[1, ends_a], marks[0, ends_b]
        pairs = a[last_a].astype(U64) * U64(self.n_b) + b[last_b].astype(U64)
        # Both sides in one sequence, group by group: a token comes after all of the other side that its group puts before it.
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        place_a = np.arange(len(a)) + np.append(0, stop_b)[np.cumsum(last_a) - last_a]
        place_b = np.arange(len(b)) + (stop_a[np.cumsum(last_b) - last_b] if len(b) else none)
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[place_a] = a + len(self.a.entries) * last_a
        order[place_b] = 2 * len(self.a.entries) + b + self.n_b * last_b
        hashes, at = [], 0
        for n in (n_a + n_b).tolist():
            said = b"".join(map(self.names.__getitem__, order[at : at + n].tolist()))
            hashes.append(hashlib.sha256(said[:-1]).hexdigest() if n else "")
            at += n
        closed = np.append(0, np.cumsum(last_a))[np.append(0, np.cumsum(n_a))]
        return n_a, n_b, np.diff(closed), hashes, pairs


def _packed(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True), dtype=kind)


def _batch(number: int, keys: list[bytes], times: list[int], parts: list) -> pa.RecordBatch:
    """One row for the texts of a batch."""
    n_a, n_b, links = (np.concatenate([p[i] for p in parts]) for i in range(3))
    pairs, inverse = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
    weights = np.zeros(len(pairs), dtype=np.int64)
    text = np.repeat(np.arange(len(keys)), links)
    np.add.at(weights, inverse, np.array(times, dtype=np.int64)[text])
    held, count = np.unique(text * max(len(pairs), 1) + inverse, return_counts=True)
    place = (held % max(len(pairs), 1)).astype(np.int64)
    cuts = np.bincount(held // max(len(pairs), 1), minlength=len(keys))
    one = lambda x, kind: pa.array([x], type=kind)
    long, many = pa.list_(pa.int64()), [p for part in parts for p in part[3]]
    columns = [pa.array([number], type=pa.int64()), one(keys, pa.list_(pa.binary())), *(one(x, long) for x in (times, n_a, n_b, links)), one(many, pa.list_(pa.string()))]
    # Places rise within a text, so their differences are small numbers, which pack well.
    packed = pairs, weights, np.diff(place, prepend=0).astype(np.int32), count.astype(np.uint32), cuts.astype(np.uint32)
    return pa.RecordBatch.from_arrays(columns + [one(_packed(x), pa.binary()) for x in packed], schema=_KIND)


def _aligned(a: bytes, b: bytes):
    def align(batches):
        from pyspark import TaskContext

        aligner, number = None, TaskContext.get().partitionId() << 32
        keys, times, parts, held, texts, size = [], [], [], 0, [], 0
        for rows in batches:
            for key, text, n in zip(*(rows.column(c) for c in ("key", "text", "n"))):
                aligner = aligner or Aligner(a, b)
                texts.append(text.as_py())
                keys.append(key.as_py())
                times.append(n.as_py())
                size += len(texts[-1])
                if size >= PIECE:
                    parts.append(aligner.align(texts))
                    held, texts, size = held + size, [], 0
                if held >= BATCH:
                    yield _batch(number, keys, times, parts)
                    number, keys, times, parts, held = number + 1, [], [], [], 0
        if texts:
            parts.append(aligner.align(texts))
        if keys:
            yield _batch(number, keys, times, parts)

    return align


def _listed(weighed: bool):
    """The pairs of each batch as rows, with their weights or with the number of the batch."""
    kind = pa.schema([("pair", pa.int64()), ("w" if weighed else "batch", pa.int64())])

    def rows(batches):
        for held in batches:
            for i in range(held.num_rows):
                pairs = _unpacked(held.column("pairs")[i].as_py(), "<i8")
                beside = _unpacked(held.column("weights")[i].as_py(), "<i8") if weighed else np.full(len(pairs), held.column("batch")[i].as_py())
                for at in range(0, len(pairs), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (pairs, beside)], schema=kind)

    return rows


def _measured(batches: pa.Table, counts: pa.Table) -> pa.Table:
    """Measures of the texts of one batch; ``counts`` has a row for each of its pairs."""
    pair, total, best = (counts.column(c).to_numpy() for c in ("pair", "total", "best"))
    order, out = np.argsort(pair), []
    total, best = total[order], best[order].astype(np.int64)
    for row in batches.to_pylist():
        cuts = _unpacked(row["cuts"], "<u4").astype(np.int64)
        place = np.cumsum(_unpacked(row["places"], "<i4"), dtype=np.int64)
        times = _unpacked(row["times"], "<u4").astype(np.int64)
        ends = np.cumsum(cuts)
        summed = lambda x: np.diff(np.append(0, np.cumsum(x))[np.append(0, ends)])
        longs = [row["n"], row["n_a"], row["n_b"], row["links"], row["links"], summed(times * best[place]), summed(times * total[place])]
        out.append(pa.table([pa.array(row["keys"], type=pa.binary()), *(pa.array(x, type=pa.int64()) for x in longs), pa.array(row["groups"], type=pa.string())], names=["key", "n", *MEASURES, "groups_sha256"]))
    return pa.concat_tables(out)


def text_measures(texts: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """``key, n`` and the measures of each text; ``texts``: ``key, text, n`` with different texts that ``n`` rows have each."""
    session = texts.sparkSession
    folder = shared_dir(session, "aligned")
    texts.mapInArrow(_aligned(a, b), _BATCH).write.parquet(folder)
    batches = session.read.parquet(folder)
    counts = batches.select("pairs", "weights").mapInArrow(_listed(True), "pair long, w long").groupBy("pair").agg(F.sum("w").alias("total"))
    counts = materialised(counts)
    # One row per id of the second vocabulary, whatever the input.
    of = F.pmod("pair", F.lit(len(Pieces(b).entries)))
    highest = counts.groupBy(of.alias("b")).agg(F.max("total").alias("top"))
    judged = counts.withColumn("b", of).join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    asked = batches.select("batch", "pairs").mapInArrow(_listed(False), "pair long, batch long")
    told = asked.join(judged, "pair")
    return batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_measured, _MEASURED)


def align(docs: DataFrame, a: bytes, b: bytes, text: str = "text") -> DataFrame:
    """``doc_id`` and the measures of its alignment: one row per input row.

    ``a`` is a byte-level BPE file of the tokenizers library, ``b`` a sentencepiece model, as bytes. Each text is
    encoded as plain text, with one space before it, without special tokens. ``n_a`` and ``n_b`` count tokens,
    ``n_groups`` the groups, ``n_links`` the pairs of tokens that end together. A pair of ids counts as often as it is
    linked in all rows; ``n_best`` is the number of links whose pair counts most among those of its ``b`` id, ties
    included, and ``count_sum`` the sum of the counts over the links. ``groups_sha256`` hashes the groups,
    "a1,a2|b1;a3|b2,b3". Null and empty texts, and those whose tokens do not spell them on either side, have zeros and
    an empty hash. Rows that repeat a doc_id or are without one are rows like any other; an empty table gives none.
    """
    rows, key = docs.select("doc_id", F.col(text).alias("text")), F.unhex(F.sha2("text", 256))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(key.alias("key"), "text", "n")
    measures = materialised(text_measures(distinct, a, b))
    known = materialised(rows.select("doc_id", F.when(F.col("text") != "", key).otherwise(F.lit(b"")).alias("key")))
    joined = attached(known, measures, "key", "n")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in MEASURES]
    return joined.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
