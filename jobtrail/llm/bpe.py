"""Byte-level BPE: overlapping chunks are split into pre-tokens in parallel, stitched, and encoded.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own, which may go wrong at its
start (inside a word) and at its end (the next characters are missing). Where two neighbours share a boundary inside
their overlap, both go on alike from there, because a match depends only on the characters from its start on. Texts
are therefore cut at the first shared boundary of each overlap, and the pieces between cuts are encoded anywhere.
Decoding concatenates the bytes of the tokens.
"""

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import mixed64

CHUNK_CHARS, OVERLAP_CHARS = 65_536, 512
#: A match of the pattern looks at most so many characters past its start beyond those it takes.
LOOKAHEAD = 4
CACHED_PIECES, SHORT_BYTES = 200_000, 64
#: Characters whose pre-tokens are encoded together.
BATCH_CHARS = 1 << 18
U64, NONE = np.uint64, np.int32(np.iinfo(np.int32).max)


def read_vocabulary(path: str) -> bytes:
    """The file of ranks as the driver reads it: lines of base64 bytes and rank. It travels with the functions."""
    with open(path, "rb") as f:
        return f.read()


def parse_vocabulary(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: join the pair of lowest rank, leftmost first, while some pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 256:
        return _merge_long(piece, ranks)
    none = len(ranks) + 1
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same over a heap of pairs and linked parts, for pre-tokens of any length."""
    n = len(piece)
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been joined with another since
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class PairTable:
    """Ranks of pairs of tokens that make a token, in an open-addressed table that numpy probes for many at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(12, (8 * len(pairs)).bit_length())
        self.shift, self.last = U64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        keys, values = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32)
        at, self.probes = self._home(keys), 0
        while len(keys):
            self.probes += 1
            empty = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(keys), dtype=bool)
            won[first] = empty[first]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.last
        self.letters = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.letter_pairs = self.of(np.repeat(self.letters, 256), np.tile(self.letters, 256))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` for those that make no token."""
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        left_over = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(left_over):
                break
            at[left_over] = (at[left_over] + 1) & self.last
            met = self.keys[at[left_over]]
            hit = met == keys[left_over]
            out[left_over[hit]] = self.ranks[at[left_over[hit]]]
            left_over = left_over[~hit & (met >= 0)]
        return out


def merge_many(pieces: list[bytes], table: PairTable) -> list[bytes]:
    """Packed ids of many pre-tokens at once, each merged as ``merge`` does.

    All pieces lie side by side. In each round every piece joins its leftmost pair of lowest rank; pieces without a
    pair that has a rank are done and leave.
    """
    out: list[bytes] = [b""] * len(pieces)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    tokens = table.letters[raw]
    piece = np.repeat(np.arange(len(pieces)), sizes)
    rank = np.full(len(tokens), NONE, dtype=np.int32)
    inner = np.flatnonzero(piece[1:] == piece[:-1])
    rank[inner] = table.letter_pairs[raw[inner].astype(np.int32) << 8 | raw[inner + 1]]
    while len(tokens):
        heads = np.flatnonzero(np.diff(piece, prepend=-1))
        counts = np.diff(np.append(heads, len(tokens)))
        best = np.minimum.reduceat(rank, heads)
        done = best == NONE
        if done.any():
            over = np.repeat(done, counts)
            packed, stops = tokens[over].tobytes(), np.cumsum(counts[done]) * 4
            at = 0
            for p, stop in zip(piece[heads[done]].tolist(), stops.tolist()):
                out[p] = packed[at:stop]
                at = stop
            tokens, piece, rank = tokens[~over], piece[~over], rank[~over]
            best, counts = best[~done], counts[~done]
            if not len(tokens):
                break
        hits = np.flatnonzero(rank == np.repeat(best, counts))
        first = hits[np.diff(piece[hits], prepend=-1) != 0]
        tokens[first] = rank[first]
        stay = np.ones(len(tokens), dtype=bool)
        stay[first + 1] = False
        tokens, piece, rank = tokens[stay], piece[stay], rank[stay]
        first -= np.arange(len(first))
        for at in (first - 1, first):
            at = at[(at >= 0) & (at + 1 < len(tokens))]
            alone = piece[at] != piece[at + 1]
            rank[at] = np.where(alone, NONE, table.of(tokens[at], tokens[at + 1]))
        rank[-1] = NONE
    return out


# Fixed value: the pattern of the best-known byte-level vocabulary. Texts split by it are split in numpy.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, OTHER, SPACE, BORDER = range(5)


def _kinds() -> np.ndarray:
    """Kind of each code point, as the pattern's engine sees it."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            first, last = ord(points[m.start()]), ord(points[m.end() - 1])
            kinds[first : last + 1] = kind
    return kinds


def _common_spans(texts: list[str], kinds: np.ndarray) -> list[np.ndarray]:
    """Starts and ends of the pre-tokens of each text by ``COMMON_PATTERN``, found for all texts at once.

    A pre-token is a run of letters, of numbers or of other characters, with the one blank before it; what is left of
    a run of white space is one more, but its last character stands alone before a word if it is no blank. A
    lone apostrophe that no blank precedes takes a contraction's letters.
    """
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), dtype="<u4")
    kind = kinds[points]
    borders = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[borders] = BORDER
    heads = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == BORDER)]))
    stops, run = np.append(heads[1:], len(kind)), kind[heads]
    begins = np.zeros(len(kind) + 1, dtype=bool)
    space = run == SPACE
    before_word = space & (np.append(run[1:], BORDER) != BORDER)
    blank = before_word & (points[stops - 1] == 32)
    begins[heads[run != BORDER]] = True
    # The last character of white space before a word: a blank goes with the word, another one stands alone.
    begins[stops[before_word] - 1] = True
    begins[stops[blank]] = False
    lone = (run == OTHER) & (stops - heads == 1) & (points[heads] == 39) & (np.append(run[1:], BORDER) == LETTER)
    lone[1:] &= ~blank[:-1]
    if lone.any():
        at, end = stops[lone], np.append(stops[1:], len(kind))[lone]
        x, y = points[at], points[np.minimum(at + 1, len(points) - 1)]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = (at + 1 < end) & (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
        taken = np.where(one, 1, np.where(two, 2, 0))
        at, end, taken = at[taken > 0], end[taken > 0], taken[taken > 0]
        begins[at] = False
        begins[(at + taken)[at + taken < end]] = True
    starts = np.flatnonzero(begins)
    cuts = np.flatnonzero(begins[:-1] | (kind == BORDER))
    ends = cuts[np.searchsorted(cuts, starts, side="right")] if len(starts) else starts
    parts = np.searchsorted(starts, borders)
    first = np.concatenate([[0], borders[:-1] + 1])
    return [np.stack([starts[a:z], ends[a:z]]) - o for a, z, o in zip(np.concatenate([[0], parts[:-1]]), parts, first)]


def _regex_spans(texts: list[str], pattern) -> list[np.ndarray]:
    return [np.array([m.span() for m in pattern.finditer(t)], dtype=np.int64).reshape(-1, 2).T for t in texts]


def splitter(pattern: str):
    """Function from texts to the starts and ends of their pre-tokens."""
    if pattern == COMMON_PATTERN:
        kinds = _kinds()
        return lambda texts: _common_spans(texts, kinds)
    compiled = regex.compile(pattern)
    return lambda texts: _regex_spans(texts, compiled)


class _Pieces:
    """Ids of pre-tokens. Those seen before are remembered, and all forgotten when there are too many.

    Pre-tokens are told apart by two 64-bit hashes of their characters, computed for a whole batch at once, so that
    Python touches only those that are new.
    """

    def __init__(self, ranks: dict[bytes, int], table: PairTable):
        self.ranks, self.table = ranks, table
        self.forget()

    def forget(self):
        self.hashes, self.checks = np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)
        self.at, self.sizes, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def learn(self, hashes: np.ndarray, checks: np.ndarray, pieces: list[bytes]):
        short = [i for i, p in enumerate(pieces) if len(p) <= SHORT_BYTES]
        packed = dict(zip(short, merge_many([pieces[i] for i in short], self.table)))
        all_ids = [packed[i] if i in packed else np.array(merge(p, self.ranks), dtype=np.int32).tobytes() for i, p in enumerate(pieces)]
        sizes = np.array([len(x) // 4 for x in all_ids], dtype=np.int64)
        at = np.cumsum(sizes) - sizes + len(self.ids)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(all_ids), dtype=np.int32)])
        self.hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.checks, self.at, self.sizes = (np.concatenate(x)[order] for x in ((self.checks, checks), (self.at, at), (self.sizes, sizes)))

    def one_by_one(self, texts: list[str], spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[i for a, z in s.T for i in merge(t[a:z].encode("utf-8"), self.ranks)] for t, s in zip(texts, spans)]
        return np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64)

    def encode(self, texts: list[str], spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, and how many each text has."""
        if len(self.hashes) > CACHED_PIECES:
            self.forget()
        together = "".join(texts)
        offsets = np.cumsum([0] + [len(t) for t in texts[:-1]])
        counts = np.array([s.shape[1] for s in spans], dtype=np.int64)
        starts, ends = np.concatenate([s + o for s, o in zip(spans, offsets)], axis=1)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        points = np.frombuffer(together.encode("utf-32-le"), dtype="<u4").astype(U64)
        sizes = ends - starts
        if int(sizes.sum()) != len(points):
            points = points[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        heads = np.cumsum(sizes) - sizes
        place = np.arange(len(points)) - np.repeat(heads, sizes)
        weights = mixed64(np.arange(1, 2 * int(sizes.max()) + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
        points += U64(1)
        hashes = mixed64(np.add.reduceat(points * weights[2 * place], heads) + sizes.astype(U64))
        checks = np.add.reduceat(points * weights[2 * place + 1], heads)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not (checks[first][which] == checks).all():
            return self.one_by_one(texts, spans)  # two pre-tokens share a hash
        slot = np.searchsorted(self.hashes, different)
        known = np.zeros(len(different), dtype=bool)
        inside = slot < len(self.hashes)
        known[inside] = self.hashes[slot[inside]] == different[inside]
        new = np.flatnonzero(~known)
        if len(new):
            spots = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            self.learn(different[new], checks[first[new]], [together[a:z].encode("utf-8") for a, z in spots])
            slot = np.searchsorted(self.hashes, different)
        if not (self.checks[slot] == checks[first]).all():
            return self.one_by_one(texts, spans)
        at, lengths = self.at[slot][which], self.sizes[slot][which]
        total = np.cumsum(lengths)
        ids = self.ids[np.repeat(at - total + lengths, lengths) + np.arange(int(total[-1]))]
        bounds = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)


def _encoder(vocabulary: bytes, pattern: str):
    state, table = {}, PairTable(parse_vocabulary(vocabulary))

    @F.arrow_udf("array<int>")
    def encode_texts(texts: pa.Array) -> pa.Array:
        if not state:
            state.update(pieces=_Pieces(parse_vocabulary(vocabulary), table), split=splitter(pattern))
        ids, counts, part, size = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)], [], 0

        def run():
            found, n = state["pieces"].encode(part, state["split"](part))
            ids.append(found)
            counts.append(n)

        for text in texts:
            part.append(text.as_py())
            size += len(part[-1])
            if size > BATCH_CHARS:
                run()
                part, size = [], 0
        if part:
            run()
        offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
        pa.default_memory_pool().release_unused()
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))

    return encode_texts


def _boundaries(pattern: str, chunk_chars: int, overlap_chars: int):
    """Starts of pre-tokens in a chunk's first overlap, and trusted ones in its last, each from that overlap's start."""
    state = {}

    @F.arrow_udf("struct<heads:array<int>,tails:array<int>>")
    def boundaries(chunks: pa.Array) -> pa.Array:
        if not state:
            state["split"] = splitter(pattern)
        out = []
        for chunk in (c.as_py() for c in chunks):
            starts, trusted = state["split"]([chunk])[0][0], len(chunk) - LOOKAHEAD
            out.append({"heads": starts[starts < overlap_chars], "tails": starts[(starts >= chunk_chars) & (starts <= trusted)] - chunk_chars})
        return pa.array(out, type=pa.struct([("heads", pa.list_(pa.int32())), ("tails", pa.list_(pa.int32()))]))

    return boundaries


def encode(
    docs: DataFrame,
    vocabulary: bytes,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """The input with ``ids``, the token ids of the whole text in order (array of int).

    Null and empty texts give an empty array; a column named ``ids`` is replaced. Each match of ``pattern`` is
    encoded separately; special tokens are ordinary text. Texts up to ``chunk_chars`` are one chunk. Longer ones are
    cut at the boundaries that overlapping chunks share. Should two chunks share none (a run of letters longer than
    the overlap), the rest of that text from its last cut stays one piece. Equal long texts are encoded once.
    """
    docs = docs.drop(ids)
    run = _encoder(vocabulary, pattern)
    body = F.coalesce(F.col(text), F.lit(""))
    is_long = F.length(body) > chunk_chars
    short = docs.where(~is_long).withColumn(ids, run(body))

    keyed = docs.where(is_long).withColumn("__key", F.sha2(body, 256))
    texts = keyed.select("__key", body.alias("__text")).dropDuplicates(["__key"])
    starts = F.sequence(F.lit(0), F.length("__text") - 1, F.lit(chunk_chars))
    chunks = texts.select("__key", F.posexplode(F.transform(starts, lambda s: F.substring("__text", s + 1, F.lit(chunk_chars + overlap_chars)))).alias("__no", "__chunk"))
    seen = chunks.repartition("__key", "__no").select("__key", "__no", _boundaries(pattern, chunk_chars, overlap_chars)("__chunk").alias("__b"))
    order = Window.partitionBy("__key").orderBy("__no")
    shared = F.array_min(F.array_intersect("__b.tails", F.lead("__b.heads").over(order)))
    pairs = seen.select("__key", "__no", shared.alias("__shared"))
    # From the first pair without a shared boundary on, what a chunk found is not known to be right.
    broken = F.max(F.col("__shared").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = F.when(~broken, (F.col("__no") + 1) * chunk_chars + F.col("__shared"))
    cuts = pairs.select("__key", cut.alias("__cut")).groupBy("__key").agg(F.sort_array(F.collect_list("__cut")).alias("__cuts"))
    edges = F.concat(F.array(F.lit(0)), F.col("__cuts"))
    ends = F.concat(F.col("__cuts"), F.array(F.length("__text")))
    spans = texts.join(cuts, "__key").withColumn("__spans", F.arrays_zip(edges.alias("a"), ends.alias("b")))
    pieces = spans.select("__key", F.posexplode(F.transform("__spans", lambda s: F.substring("__text", s["a"] + 1, s["b"] - s["a"]))).alias("__no", "__piece"))
    done = pieces.repartition("__key", "__no").select("__key", "__no", run("__piece").alias("__ids"))
    whole = done.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__no", "__ids"))).alias("__all"))
    whole = whole.select("__key", F.flatten(F.transform("__all", lambda x: x["__ids"])).alias(ids))
    return short.unionByName(keyed.join(whole, "__key").select(*docs.columns, ids))


def decode(vocabulary: bytes, ids: Column) -> Column:
    """The bytes that an array of token ids stands for; null gives null."""
    state = {}

    @F.arrow_udf("binary")
    def decode_ids(lists: pa.Array) -> pa.Array:
        if not state:
            ranks = parse_vocabulary(vocabulary)
            tokens = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                tokens[rank] = token
            state["tokens"] = pa.array(tokens, type=pa.large_binary())
        joined = state["tokens"].take(lists.flatten())
        # The bytes of all tokens lie side by side already: only the borders between lists are needed.
        _, borders, data = joined.buffers()
        at = np.frombuffer(borders, dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, dtype=np.int64)
        counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        stops = at[np.concatenate([[0], np.cumsum(counts)])]
        blob = memoryview(data) if data is not None else b""
        valid = lists.is_valid().to_pylist()
        pa.default_memory_pool().release_unused()
        return pa.array([bytes(blob[a:b]) if ok else None for a, b, ok in zip(stops[:-1], stops[1:], valid)], type=pa.binary())

    return decode_ids(ids)


def digests(encoded: DataFrame, vocabulary: bytes, ids: str = "ids") -> list[Column]:
    """Number of tokens, digest of the ids joined by spaces, and digest of the decoded bytes."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode(vocabulary, F.col(ids)), 256).alias("decoded_sha256"),
    ]
