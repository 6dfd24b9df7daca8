"""Exact removal of repeated byte strings: sampled suffixes, sorted by bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller doc_id. Sorting all
suffixes of a corpus would move many times its size, so suffixes are sorted only at anchors: in each string of LENGTH
bytes the 16-gram with the least hash, which depends on the string alone. Equal strings have equal anchors, at the
same place in them, and meet in the bucket of that 16-gram.

1. Documents are dealt into batches. Each batch sends the hashes of its anchors, 5 bytes each, to their buckets and
   learns in return which of them also occur in another document. The others cannot be part of a repeat.
2. For those left, a batch sends the bytes around the anchor, each different context once, with the smallest doc_id.
3. A bucket sorts its contexts rightwards and leftwards from the anchor: q-gram buckets are refined by the bucket
   identifiers of later offsets, only where a bucket still holds several, and the refined pointers are the base of
   the next step. Shared prefix lengths of neighbours then tell, for each string over the anchor, the class of equal
   strings; the smallest doc_id of each class goes back as one bit per string: is there a smaller one than the batch's.
4. The batch marks the bytes.

Anchors that occur very often (a passage in very many documents) would fill one bucket with the contexts at the
passage's ends. Their strings are dealt by the whole string instead of by the anchor, so they spread.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import parts_for, text_bytes

LENGTH, GRAM = 50, 16
#: Gram starts in a string, bytes of a context, and the anchor's place in it.
PLACES = LENGTH - GRAM + 1
SPAN, ANCHOR = LENGTH + PLACES - 1, PLACES - 1
#: A context, the first and last string in it, and padding to whole words.
RECORD = 88
SEGMENT = 1 << 17
#: Occurrences of an anchor over the corpus from which its strings are dealt one by one.
HOT = 2000
SMALLEST_BATCH, LARGEST_BATCH = 2 << 20, 32 << 20
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _owners(data: np.ndarray) -> np.ndarray:
    """For each start of a string, the place of its anchor: the 16-gram of least hash, the leftmost of equals."""
    n = len(data) - LENGTH + 1
    out = np.empty(max(n, 0), dtype=np.int32)
    for at in range(0, n, SEGMENT):
        part = data[at : min(at + SEGMENT, n) + LENGTH - 1]
        v = part.astype(U64)
        v = v[:-1] | (v[1:] << U64(8))
        v = v[:-2] | (v[2:] << U64(16))
        v = v[:-4] | (v[4:] << U64(32))
        h = (v[:-8] * U64(0x9FB21C651E98DF25)) ^ (v[8:] * U64(0xC2B2AE3D27D4EB4F))
        h ^= h >> U64(29)
        h *= U64(0x9E3779B97F4A7C15)
        key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        width = 1
        while width * 2 <= PLACES:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[: len(key) - (PLACES - width)], key[PLACES - width :])
        out[at : at + len(key)] = (key & U64(0xFFFFFFFF)).astype(np.int32) + at
    return out


class _Batch:
    """The texts of a batch side by side, and the anchors of all strings inside one document."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        self.ids = ids
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        inside = np.zeros(len(self.data) + 1, dtype=np.int32)
        some = sizes >= LENGTH
        np.add.at(inside, self.starts[some], 1)
        np.add.at(inside, self.stops[some] - LENGTH + 1, -1)
        s = np.flatnonzero(np.cumsum(inside))
        if not len(s):
            self.anchor = self.low = self.high = self.doc = np.zeros(0, dtype=np.int64)
            self.gram = np.zeros(0, dtype=U64)
            return
        own = _owners(self.data)[s].astype(np.int64)
        first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(s, prepend=-2) != 1))
        self.anchor, self.low, self.high = own[first], s[first], s[np.append(first[1:], len(s)) - 1]
        self.doc = np.searchsorted(self.stops, self.low, side="right")
        words = np.lib.stride_tricks.sliding_window_view(self.data, GRAM)[self.anchor].view(U64)
        self.gram = _mix(words[:, 0] * U64(0x8CB92BA72F3D8DD7) + _mix(words[:, 1]))

    def buckets(self, parts: int):
        """Different anchors in the order of bucket and remainder: those, where each entry is, occurrences, docs."""
        key = ((self.gram >> U64(34)) % U64(parts) << U64(32)) | (self.gram & U64(0xFFFFFFFF))
        keys, where, counts = np.unique(key, return_inverse=True, return_counts=True)
        several = np.zeros(len(keys), dtype=bool)
        if len(keys):
            order = np.argsort(where, kind="stable")
            heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
            docs = self.doc[order]
            several = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads)
        return keys, where, counts, several

    def records(self, states: np.ndarray, parts: int):
        """What goes to the buckets: different contexts with the smallest doc_id, sorted by bucket.

        Also, for every occurrence of a context: its record, entry, and first and last string.
        """
        plain, hot = np.flatnonzero(states == 1), np.flatnonzero(states == 2)
        spans = self.high[hot] - self.low[hot] + 1
        each = np.repeat(hot, spans)
        one = self.low[each] + np.arange(len(each)) - np.repeat(np.cumsum(spans) - spans, spans)
        entry = np.concatenate([plain, each])
        low, high = np.concatenate([self.low[plain], one]), np.concatenate([self.high[plain], one])
        rec = np.zeros((len(entry), RECORD), dtype=np.uint8)
        if len(entry):
            padded = np.concatenate([np.zeros(ANCHOR, np.uint8), self.data, np.zeros(SPAN, np.uint8)])
            base = self.anchor[entry] - ANCHOR
            a, z = (low - base).astype(np.int16), (high - base).astype(np.int16)
            for at in range(0, len(entry), 1 << 14):
                cut = slice(at, at + (1 << 14))
                context = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[base[cut] + ANCHOR]
                column = np.arange(SPAN, dtype=np.int16)
                rec[cut, :SPAN] = np.where((column >= a[cut, None]) & (column < z[cut, None] + LENGTH), context, 0)
            rec[:, SPAN], rec[:, SPAN + 1] = a, z
        words = rec.view(U64)
        weights = _mix(np.arange(1, RECORD // 8 + 1, dtype=U64)) | U64(1)
        digest = np.zeros(len(rec), dtype=U64)
        for j in range(RECORD // 8):
            digest = _mix(digest + words[:, j] * weights[j])
        _, index, where = np.unique(digest, return_index=True, return_inverse=True)
        if not (words[index][where] == words).all():  # two contexts share a digest
            _, index, where = np.unique(words, axis=0, return_index=True, return_inverse=True)
            where = where.ravel()
        smallest = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(smallest, where, self.ids[self.doc[entry]])
        route = np.where(index < len(plain), _mix(self.gram[entry[index]] + U64(1)), digest[index]) >> U64(20)
        bucket = (route % U64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return bucket[order], rec[index[order]], smallest[order], rank[where], entry, low, high


def _refined(columns: list[np.ndarray]) -> np.ndarray:
    """Bucket pointers of rows sorted by columns of q-grams: the number of rows in smaller buckets.

    The first column gives the initial buckets. Each later column refines those that still hold several rows: their
    rows are sorted by pointer and identifier, and each new bucket points behind the smaller ones of its old bucket.
    """
    _, where, counts = np.unique(columns[0], return_inverse=True, return_counts=True)
    pointer = (np.cumsum(counts) - counts)[where]
    open_ones = np.flatnonzero(counts[where] > 1)
    for column in columns[1:]:
        if not len(open_ones):
            break
        order = open_ones[np.lexsort((column[open_ones], pointer[open_ones]))]
        old, ident = pointer[order], column[order]
        new_old = np.diff(old, prepend=-1) != 0
        new = new_old | (np.concatenate([[True], ident[1:] != ident[:-1]]))
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        bucket_start = np.flatnonzero(new_old)[np.cumsum(new_old) - 1]
        pointer[order] = old + heads[group] - bucket_start
        sizes = np.diff(np.append(heads, len(order)))
        open_ones = order[sizes[group] > 1]
    return pointer


def _classes(side: np.ndarray):
    """Rank of each row among the sorted rows, and the prefix each shares with the row before it in that order."""
    width = side.shape[1]
    offsets = [*range(0, width - 7, 8)] + ([width - 8] if width % 8 else [])
    columns = [np.ascontiguousarray(side[:, o : o + 8]).view(">u8").ravel().astype(U64) for o in offsets]
    order = np.argsort(_refined(columns), kind="stable")
    ranked = side[order]
    shared = np.zeros(len(side), dtype=np.int16)
    differ = ranked[1:] != ranked[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank, shared


def _smaller_elsewhere(rec: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each record one bit per string: does the same string stand in a record with a smaller doc_id?"""
    bits = np.zeros(len(rec), dtype=U64)
    if len(rec) < 2:
        return bits
    first, last = rec[:, SPAN], rec[:, SPAN + 1]
    right_rank, right_shared = _classes(rec[:, ANCHOR:SPAN])
    left_rank, left_shared = _classes(np.ascontiguousarray(rec[:, :ANCHOR][:, ::-1]))
    best_right = np.maximum(right_shared, np.append(right_shared[1:], 0))[right_rank]
    best_left = np.maximum(left_shared, np.append(left_shared[1:], 0))[left_rank]
    for c in range(PLACES):
        right, left = c + GRAM, ANCHOR - c
        own = np.flatnonzero((first <= c) & (c <= last) & (best_right >= right) & ((best_left >= left) | (left == 0)))
        if len(own) < 2:
            continue
        right_class = np.cumsum(right_shared < right)[right_rank[own]].astype(U64)
        left_class = np.cumsum(left_shared < left)[left_rank[own]].astype(U64) if left else np.zeros(len(own), dtype=U64)
        _, where = np.unique((right_class << U64(32)) | left_class, return_inverse=True)
        least = np.full(int(where.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, where, docs[own])
        bits[own] |= (least[where] < docs[own]).astype(U64) << U64(c)
    return bits


def _batch_of(group: pa.Table, text: str) -> _Batch:
    texts = [(t.as_py() or "").encode("utf-8") for t in group.column(text)]
    ids = group.column("__doc").to_numpy()
    return _Batch(texts, ids)


def _runs(sorted_ids: np.ndarray):
    """Value, start and stop of each run."""
    heads = np.flatnonzero(np.diff(sorted_ids, prepend=-1) != 0)
    return zip(sorted_ids[heads].tolist(), heads.tolist(), np.append(heads[1:], len(sorted_ids)).tolist())


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


_MESSAGE = pa.schema([("to", pa.int64()), ("back", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
_MESSAGE_DDL = "to long, back long, kind int, body binary"


def _send_anchors(parts: int, text: str):
    def send(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys, _, counts, several = _batch_of(group, text).buckets(parts)
        note = np.minimum(counts, 127).astype(np.uint8) | (several.astype(np.uint8) << 7)
        low = (keys & U64(0xFFFFFFFF)).astype(np.uint32)
        rows = [(p, key[0].as_py(), 0, low[a:z].tobytes() + note[a:z].tobytes()) for p, a, z in _runs((keys >> U64(32)).astype(np.int64))]
        return _table(_MESSAGE, rows)

    return send


def _find_repeated(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    bodies = [b.as_py() for b in group.column("body")]
    low = [np.frombuffer(b, dtype=np.uint32, count=len(b) // 5) for b in bodies]
    note = np.concatenate([np.frombuffer(b, dtype=np.uint8, offset=len(b) // 5 * 4) for b in bodies])
    _, where, batches = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    several = np.zeros(len(batches), dtype=bool)
    several[where[note >> 7 == 1]] = True
    total = np.bincount(where, weights=note & 127, minlength=len(batches))
    state = np.where(several | (batches > 1), np.where(total > HOT, 2, 1), 0).astype(np.uint8)[where]
    rows, at = [], 0
    for back, part in zip(group.column("back").to_pylist(), low):
        rows.append((back, key[0].as_py(), 0, state[at : at + len(part)].tobytes()))
        at += len(part)
    return _table(_MESSAGE, rows)


def _joined(messages: pa.Table, kind: int) -> bytes:
    """Bodies of one kind in the order of their senders."""
    rows = [(s, b) for s, k, b in zip(messages.column("back").to_pylist(), messages.column("kind").to_pylist(), messages.column("body").to_pylist()) if k == kind]
    return b"".join(b for _, b in sorted(rows))


def _states(batch: _Batch, messages: pa.Table, parts: int) -> np.ndarray:
    _, where, _, _ = batch.buckets(parts)
    return np.frombuffer(_joined(messages, 0), dtype=np.uint8)[where]


def _send_contexts(parts: int, text: str):
    def send(key: tuple[pa.Scalar, ...], group: pa.Table, messages: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _table(_MESSAGE, [])
        batch, me = _batch_of(group, text), key[0].as_py()
        states = _states(batch, messages, parts)
        bucket, rec, smallest, *_ = batch.records(states, parts)
        rows = [(b, me, 1, rec[a:z].tobytes() + smallest[a:z].tobytes()) for b, a, z in _runs(bucket)]
        # What the batch has learnt comes back to it with the answers.
        rows.append((me % parts, me, 0, _joined(messages, 0)))
        return _table(_MESSAGE, rows)

    return send


def _compare_contexts(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    rows = list(zip(*[group.column(c).to_pylist() for c in ("back", "kind", "body")]))
    out = [(back, -1, 0, body) for back, kind, body in rows if kind == 0]
    sent = [(back, body, len(body) // (RECORD + 8)) for back, kind, body in rows if kind == 1]
    if sent:
        rec = np.concatenate([np.frombuffer(b, dtype=np.uint8, count=n * RECORD).reshape(n, RECORD) for _, b, n in sent])
        docs = np.concatenate([np.frombuffer(b, dtype=np.int64, offset=n * RECORD) for _, b, n in sent])
        bits, at = _smaller_elsewhere(rec, docs), 0
        for back, _, n in sent:
            out.append((back, key[0].as_py(), 1, bits[at : at + n].tobytes()))
            at += n
    return _table(_MESSAGE, out)


def _mark(parts: int, text: str, columns: list[str]):
    def mark(key: tuple[pa.Scalar, ...], group: pa.Table, messages: pa.Table) -> pa.Table:
        batch = _batch_of(group, text)
        covered = np.zeros(len(batch.data) + 1, dtype=np.int32)
        if len(batch.anchor):
            _, _, smallest, where, entry, low, high = batch.records(_states(batch, messages, parts), parts)
            bits = np.frombuffer(_joined(messages, 1), dtype=U64)[where]
            bits = np.where(batch.ids[batch.doc[entry]] > smallest[where], U64(0xFFFFFFFFFFFFFFFF), bits)
            some = np.flatnonzero(bits)
            spans = high[some] - low[some] + 1
            each = np.repeat(some, spans)
            start = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(spans) - spans, spans)
            place = (start - batch.anchor[entry[each]] + ANCHOR).astype(U64)
            start = start[(bits[each] >> place) & U64(1) == 1]
            covered += np.bincount(start, minlength=len(covered)).astype(np.int32)
            covered -= np.bincount(start + LENGTH, minlength=len(covered)).astype(np.int32)
        gone = np.cumsum(covered)[:-1] > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[batch.stops] - sums[batch.starts]
        begins = gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]
        some = batch.starts < batch.stops
        begins[batch.starts[some]] = gone[batch.starts[some]]
        runs = np.concatenate([[0], np.cumsum(begins)])
        kept = [batch.data[a:z][~gone[a:z]].tobytes() for a, z in zip(batch.starts, batch.stops)]
        out = group.select(columns)
        for name, values in (
            ("n_bytes", pa.array(batch.stops - batch.starts)),
            ("n_removed", pa.array(removed)),
            ("n_spans", pa.array(runs[batch.stops] - runs[batch.starts])),
            ("kept", pa.array(kept, type=pa.binary())),
        ):
            out = out.append_column(name, values)
        return out

    return mark


def remove_repeats(docs: DataFrame, text: str = "text", batch_bytes: int | None = None) -> DataFrame:
    """The input with ``n_bytes``, ``n_removed``, ``n_spans`` (longs) and ``kept`` (binary, the bytes that stay).

    A byte of a text (UTF-8) goes if some string of 50 bytes over it, inside the document, also starts in a document
    with a smaller doc_id. Strings are judged on the input. Null and empty texts have no bytes. Rows without a
    doc_id keep all and remove nothing elsewhere. Rows that share a doc_id do not remove from each other. Columns
    with the names of results are replaced.

    Texts are shuffled once, anchors once and contexts of repeated anchors once. Batches grow with the root of the
    corpus, so that the number of messages between batches and buckets grows in proportion to it.
    """
    columns = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    docs = docs.select(*columns)
    if batch_bytes is None:
        total = docs.agg(F.sum(text_bytes(F.col(text)))).first()[0] or 0
        batch_bytes = min(max(SMALLEST_BATCH, 64 * math.isqrt(total)), LARGEST_BATCH)
    parts = parts_for(docs, text_bytes(F.col(text)), batch_bytes)
    from_nobody = F.col("doc_id").isNull()
    dealt = docs.withColumns(
        {
            "__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            "__batch": F.pmod(F.xxhash64("doc_id", text), F.lit(parts)),
        }
    )
    alone = dealt.where(from_nobody)
    dealt = dealt.where(~from_nobody).repartition(parts, "__batch")
    of_batch = dealt.groupBy("__batch")
    anchors = of_batch.applyInArrow(_send_anchors(parts, text), _MESSAGE_DDL)
    repeated = anchors.groupBy("to").applyInArrow(_find_repeated, _MESSAGE_DDL)
    contexts = of_batch.cogroup(repeated.groupBy("to")).applyInArrow(_send_contexts(parts, text), _MESSAGE_DDL)
    answers = contexts.groupBy("to").applyInArrow(_compare_contexts, _MESSAGE_DDL)
    schema = docs.schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    marked = of_batch.cogroup(answers.groupBy("to")).applyInArrow(_mark(parts, text, columns), schema)
    own = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rest = alone.select(*columns, text_bytes(F.col(text)).alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), own.alias("kept"))
    return marked.unionByName(rest)
