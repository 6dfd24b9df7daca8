"""Cross-tokenizer alignment against a plain version that walks both token lists."""

import hashlib
import json
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import types as T

from jobtrail.llm import alignment
from jobtrail.llm.queries import ALIGNED, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
A, B = (Path(public_tokenizers.path(name)).read_bytes() for name in ALIGNED)


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    one = Tokenizer.from_file(public_tokenizers.path(ALIGNED[0]))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ALIGNED[1]))
    byte = {}
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        byte[chr(b) if shown else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x) for x in range(b)))] = b
    assert set(byte) == set(ByteLevel.alphabet())

    def tokens(text):
        """Lists of (id, end offset) on both sides, empty where either does not spell the text."""
        raw, sides = (" " + text).encode(), []
        for ids, spelled in (
            (one.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in one.id_to_token(i))),
            (two.encode(text), lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()),
        ):
            said, side = b"", []
            for i in ids:
                said += spelled(i)
                side.append((i, len(said)))
            sides.append(side if said == raw else None)
        return sides if text and None not in sides else [[], []]

    def measures(rows):
        each = [tokens(t or "") for _, t in rows]
        links = [[(x, y) for x, e in a for y, f in b if e == f] if len(a) < 500 else [(x, dict((f, y) for y, f in b)[e]) for x, e in a if e in {f for _, f in b}] for a, b in each]
        counts = Counter(p for doc in links for p in doc)
        top = {}
        for (_, y), n in counts.items():
            top[y] = max(top.get(y, 0), n)
        out = []
        for (doc_id, _), (a, b), pairs in zip(rows, each, links):
            ends = sorted({e for _, e in a} & {e for _, e in b})
            said, before = [], 0
            for e in ends:
                said.append(",".join(str(i) for i, x in a if before < x <= e) + "|" + ",".join(str(i) for i, x in b if before < x <= e))
                before = e
            best = sum(counts[p] == top[p[1]] for p in pairs)
            digest = hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""
            out.append((doc_id, len(a), len(b), len(ends), len(pairs), best, sum(counts[p] for p in pairs), digest))
        return sorted(out, key=repr)

    return measures


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", *alignment.MEASURES, "groups_sha256").collect()), key=repr)


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "\n\n \t"), (5, "Hello there, alignment."), (6, "Hello there, alignment."), (None, "Hello there, alignment."),
    (7, "  leading and trailing  "), (8, "<|endoftext|> <s> </s> <unk> <0x41> plain text"), (9, "a▁b has the piece's own mark"),
    (10, "nul \x00 and \x1f"), (11, "ﬁ ①é 中文字 　 é 🙂👍🏽 "), (12, "a" * 300), (13, "=-" * 200), (14, "x"), (5, "the same id, another text"),
    (5, "the same id, another text"), (15, " " * 90), (16, "don't I'll WE'RE 1234567 3.14"),
]


@pytest.mark.parametrize("piece,batch", [(alignment.PIECE, alignment.BATCH), (40, 1), (1, 200)])
def test_measures_are_those_of_a_plain_walk(spark, plain, monkeypatch, piece, batch):
    monkeypatch.setattr(alignment, "PIECE", piece)
    monkeypatch.setattr(alignment, "BATCH", batch)
    rows = ROWS * 2
    assert found(alignment.align(spark.createDataFrame(rows, SCHEMA), A, B)) == plain(rows)


def test_long_text_and_hot_text(spark, plain):
    rows = [(i, "one text that many rows share") for i in range(300)] + [(1000, " ".join(f"word{i % 97}" for i in range(900)))]
    got = {r[0]: r for r in found(alignment.align(spark.createDataFrame(rows, SCHEMA), A, B))}
    want = {r[0]: r for r in plain(rows)}
    assert got == want
    long = [(1, "word and " * 200_000)]
    row = alignment.align(spark.createDataFrame(long, SCHEMA), A, B).first()
    assert row.n_a == 400_001 and row.n_links == row.n_groups > 399_000


def test_nothing_to_align(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    got = alignment.align(spark.createDataFrame([(None, None), (1, "")], SCHEMA), A, B)
    assert found(got) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
    more = spark.createDataFrame([(1, "abc", 5, "x", 2)], "doc_id long, text string, n long, key string, n_links long")
    assert alignment.align(more, A, B).columns == ["doc_id", *alignment.MEASURES, "groups_sha256"]


def test_other_files_take_their_own_library():
    spec = json.loads(A)
    spec["pre_tokenizer"]["use_regex"] = False
    slow = alignment.ByteLevel(json.dumps(spec).encode())
    fast = alignment.ByteLevel(A)
    assert fast.entries == slow.entries
    text = " two words"
    assert b"".join(slow.entries[i] for i in slow.encode([text])[0]) == b"".join(fast.entries[i] for i in fast.encode([text])[0]) == text.encode()


def test_both_libraries_agree(plain):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path(ALIGNED[0])), alignment.ByteLevel(A)
    slow.encode_special_tokens = True
    for c in [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 331)]:
        text = f" a{chr(c)}a 1{chr(c)}1 {chr(c)}.{chr(c)}"
        assert fast.encode([text])[0].tolist() == slow.encode(text, add_special_tokens=False).ids


def test_query_over_its_whole_table(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op11_alignment"](spark, SF)
    assert found(got) == plain(docs)
