"""Line dedup by a deletion-neighbourhood join: a line goes if an earlier line is within a few edits of it, one by default.

Two lines within one edit (a character put in, taken out or changed) become equal when the right character is left
out of one or both. Each line therefore emits hashed keys of itself and of all variants with one character less;
lines that share a key are compared, and the later one goes.

One edit touches one quarter of a line, so partners agree in the other three. Lines are first keyed by three
quarters at a time, and only where another line has the same key does a line emit variants, those of the fourth
quarter. No partner is lost by that, and lines unlike all others, which are nearly all, emit four keys each.

For two edits the same is done in three steps. One of a line's thirds is whole in every partner: lines that share a
third with another, at every place to which an edit can shift it, go on. Those are cut into cells of some sixteen
characters or an eighth of the line, and keyed by all but one cell, which then holds both edits, and by all but two,
which hold one each. A key of ``FEW`` lines or fewer, as nearly all are, has them compared as they are. Where more
share it, a cell alone emits its variants with two characters less (a long one is cut into cells itself first); of two
cells the first emits those with one character less, and only where another text has the same does the second.
An edit touches neither what a cell's start nor what its end has in common with its partner's, and in sorted order a
neighbour has most in common: only places that such starts and ends leave over are left out, few of each cell.
Lines with one variant are compared through their first place only, by how many
characters they leave out and where, which tells two edits apart from more; so no step compares all with all.

Three edits or more have too many variants. Lines are cut into e + 2 pieces there, of which two at least are left
whole. Keys are of two whole pieces, at every place to which the other edits can shift them, and lines that share a
key are compared by edit distance, large groups in blocks: the work grows with the square of such a group.
"""

from functools import reduce
from itertools import chain, combinations, islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import GAPS, in_filter, materialised, mixed64, prefiltered, written

#: Lines with fewer characters besides white space say too little to be called near copies. They stay, unless
#: ``exact_chars`` has their exact repeats dropped.
MIN_CHARS = 20
QUARTERS, STEP = 4, 8
U64 = np.uint64
#: Lines that share a key are compared all with all in blocks of so many.
BLOCK_LINES = 64
FACTOR = 0xD1342543DE82EF95
#: Characters of a cell, how many cells a line has at least and at most, lines of one key that meet without variants,
#: and characters of a cell that emits its variants with two characters less.
CELL, CELLS, FEW, LONG = 16, (4, 8), 8, 16
_LINES = "doc_id long, text_hash long, line_no int, h1 long, h2 long, keys array<long>"


def _shared_pieces(edits: int) -> list[tuple[int, int, int, int]]:
    """Pieces i < j with the shifts at which a partner may have them, if i is the first whole piece and j the next.

    Pieces of the front half keep their place from the front up to the edits before them, the others theirs from the
    back up to the edits behind them. What a length is more than its rounded value lies between the halves.
    """
    pieces = edits + 2
    front, found = pieces // 2, set()
    for i, j in combinations(range(pieces), 2):
        near = j < front or i >= front
        for before in range(i, edits + 1) if i else [0]:
            for between in [0] if near and j == i + 1 else range(j - i - 1, edits - before + 1):
                behind = 0 if j == pieces - 1 else edits - before - between
                if behind < 0:
                    continue
                moved = lambda n: range(-n, n + 1)
                if j < front:
                    found |= {(i, j, x, x + d) for x in moved(before) for d in moved(between)}
                elif i >= front:
                    found |= {(i, j, x + d, x) for x in moved(behind) for d in moved(between)}
                else:
                    found |= {(i, j, x, y) for x in moved(before) for y in moved(behind)}
    return sorted(found)


def _piece_keys(points: np.ndarray, place: np.ndarray, starts: np.ndarray, n: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two pieces for each line, and which of them are used: those for a shorter line's cuts only where one is in reach."""
    longest, pieces = int(place.max()) + 2, edits + 2
    powers, inverse = (np.cumprod(np.concatenate([[U64(1)], np.full(longest, x, U64)]), dtype=U64) for x in (FACTOR, pow(FACTOR, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed64(points + U64(1)) * powers[place], dtype=U64)])
    plan = _shared_pieces(edits)
    keys = np.zeros((len(n), 2 * len(plan)), dtype=U64)
    used = np.ones(keys.shape, dtype=bool)
    used[:, len(plan) :] = (n % STEP < edits)[:, None]
    for at in range(2 * len(plan)):
        i, j, *shifts = plan[at % len(plan)]
        base = np.maximum(n // STEP * STEP - STEP * (at // len(plan)), 0)
        key = mixed64(base.astype(U64) * U64(pieces * pieces) + U64(i * pieces + j))
        for piece, shift in zip((i, j), shifts):
            moved = shift if piece < pieces // 2 else n - base - shift
            head, tail = (np.clip(base * x // pieces + moved, 0, n) for x in (piece, piece + 1))
            key = mixed64(key + (sums[starts + tail] - sums[starts + head]) * inverse[head])
        keys[:, at] = key
    return keys, used


def _third_keys(points: np.ndarray, place: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the thirds of each line, for the cuts of its length and those of a shorter partner's, and which are used.

    The first third keeps its place from the front and the last from the back. If neither is whole there is an edit in
    each, and the middle is shifted by one at most: both partners key it at its place and one further.
    """
    longest = int(place.max()) + 2
    powers, inverse = (np.cumprod(np.concatenate([[U64(1)], np.full(longest, x, U64)]), dtype=U64) for x in (FACTOR, pow(FACTOR, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed64(points + U64(1)) * powers[place], dtype=U64)])
    keys, used = np.zeros((len(n), 8), dtype=U64), np.ones((len(n), 8), dtype=bool)
    used[:, 4:] = (n % STEP < 2)[:, None]
    for at in range(8):
        base = np.maximum(n // STEP * STEP - STEP * (at // 4), 0)
        third, shift = ((0, 0), (1, 0), (1, 1), (2, 0))[at % 4]
        head, tail = base * third // 3 + shift, base * (third + 1) // 3 + shift
        if third == 2:
            head, tail = head + n - base, n
        head, tail = np.minimum(head, n), np.minimum(tail, n)
        cut = (sums[starts + tail] - sums[starts + head]) * inverse[head]
        keys[:, at] = mixed64(mixed64(base.astype(U64) * U64(4) + U64(third)) + cut)
    return keys, used


def _line_rows(texts: list[str], min_chars: int, exact_chars: int, max_edits: int):
    """Per line that counts: number of its text, of the line in it, two hashes, and its keys with their number.

    Lines below ``min_chars`` have hashes but no keys: only their equals find them. Without edits there are no keys.

    A line's hashes are sums of characters weighed by their place from the front and from the back, so that those of
    beginnings and ends come from running sums. A key covers all but a quarter. Lines of n and n + 1 characters must
    be cut alike to meet, so cuts depend on a length rounded down to a multiple of ``STEP``; a line of such a length
    may meet one that is shorter by one and is keyed like that as well.
    """
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype="<u4").astype(U64)
    stops = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = stops - starts
    counts = np.array([t.count("\n") + 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts)
    solid = np.concatenate([[0], np.cumsum(~np.isin(points, [ord(c) for c in GAPS]))])
    weights = mixed64(np.arange(1, int(n.max()) + 2, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
    place = np.arange(len(points)) - np.repeat(starts, n + 1)
    front = np.concatenate([np.zeros(1, U64), np.cumsum((points + U64(1)) * weights[place], dtype=U64)])
    back = np.concatenate([np.zeros(1, U64), np.cumsum((points + U64(7)) * weights[np.maximum(np.repeat(n, n + 1) - 1 - place, 0)], dtype=U64)])
    held = solid[stops] - solid[starts]
    own = np.flatnonzero(held >= exact_chars)
    starts, stops, n, keyed = starts[own], stops[own], n[own], held[own] >= min_chars
    sized = n.astype(U64) * U64(0x9FB21C651E98DF25)
    h1, h2 = mixed64(front[stops] - front[starts] + sized), mixed64((back[stops] - back[starts]) ^ sized)
    if not max_edits:
        return text[own], number[own], h1, h2, np.zeros(0, U64), np.zeros(len(own), np.int64)
    if max_edits > 1:
        keys, used = _third_keys(points, place, starts, n) if max_edits == 2 else _piece_keys(points, place, starts, n, max_edits)
        used &= keyed[:, None]
        return text[own], number[own], h1, h2, keys[used], used.sum(axis=1)
    keys = np.zeros((len(own), 2 * QUARTERS), dtype=U64)
    for i in range(2 * QUARTERS):
        base, j = np.maximum(n // STEP * STEP - STEP * (i // QUARTERS), 0), i % QUARTERS
        before, after = base * j // QUARTERS, base - base * (j + 1) // QUARTERS
        head, tail = front[starts + before] - front[starts], back[stops] - back[stops - after]
        keys[:, i] = mixed64(mixed64(head + base.astype(U64) * U64(4) + U64(j)) + tail)
    twice = n % STEP == 0
    used = np.ones(keys.shape, dtype=bool)
    used[:, QUARTERS:] = twice[:, None]
    used &= keyed[:, None]
    return text[own], number[own], h1, h2, keys[used], used.sum(axis=1)


def _emit_lines(min_chars: int, exact_chars: int, max_edits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def emit(batches):
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and (not part or size < 1 << 19):
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1])
                text, number, h1, h2, keys, counts = _line_rows(part, min_chars, exact_chars, max_edits)
                rows = pa.array(text + at)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("text_hash").take(rows),
                        pa.array(number.astype(np.int32)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64))),
                    ],
                    schema=schema,
                )
                at += len(part)

    return emit


def _wanted_lines(docs: DataFrame, text: str, per_doc: DataFrame) -> DataFrame:
    """``w, line``: the members of ``wanted`` of each document and the line at their place."""
    some = prefiltered(docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).where("text is not null"), "text_hash", per_doc)
    found = some.dropDuplicates(["doc_id", "text_hash"]).join(per_doc.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    return found.select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w")).select("w", F.get("all", F.col("w.place.line_no")).alias("line"))


def _near_lines(docs: DataFrame, text: str, lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """``h1, h2`` of the different lines that have another, earlier line within one edit."""
    each = lines.select("h1", "h2", "doc_id", "text_hash", "line_no", F.posexplode("keys").alias("q", "k"))
    shared = each.groupBy("k").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("k")
    shared = materialised(shared)
    # Lines that agree with a different line in three quarters: few, and all that goes on. Once each, at their first place.
    likely = prefiltered(each, "k", shared).join(shared, "k")
    place = F.struct("doc_id", "text_hash", "line_no").alias("place")
    first = likely.select("h1", "h2", "k", "q", place).join(distinct.select("h1", "h2", F.col("first").alias("place")), ["h1", "h2", "place"], "left_semi")
    per_doc = materialised(first.distinct().groupBy("place.doc_id", "place.text_hash").agg(F.collect_list(F.struct("h1", "h2", "place", "k", "q")).alias("wanted")))
    found = _wanted_lines(docs, text, per_doc).select("w.h1", "w.h2", "w.place", "w.k", "w.q", "line")
    full = materialised(found)
    n, j = F.length("line"), F.col("q") % QUARTERS
    base = F.floor(n / STEP) * STEP - F.when(F.col("q") >= QUARTERS, STEP).otherwise(0)
    before, after = F.floor(base * j / QUARTERS), base - F.floor(base * (j + 1) / QUARTERS)
    cut = full.select("h1", "h2", "place", "k", F.substring("line", (before + 1).cast("int"), (n - before - after).cast("int")).alias("part"))
    own = F.array(F.struct(F.lit(-1).alias("i"), F.xxhash64("part").alias("v")))
    without = F.transform(
        F.sequence(F.lit(1), F.length("part")),
        lambda i: F.struct(i.alias("i"), F.xxhash64(F.concat(F.substring("part", F.lit(1), i - 1), F.substring("part", i + 1, F.length("part")))).alias("v")),
    )
    variants = F.when(F.length("part") > 0, F.concat(own, without)).otherwise(own)
    emitted = cut.select("h1", "h2", "place", "k", F.explode(variants).alias("x")).select("h1", "h2", "place", "k", "x.i", "x.v")
    # Lines that lose a character at the same place differ in that character only; a line equal to another's
    # variant is that other line less a character. There are at most as many such lines as characters and places.
    same, one = Window.partitionBy("k", "v", "i"), Window.partitionBy("k", "v")
    changed = F.when(F.col("i") > 0, F.min("place").over(same))
    shorter = F.when(F.col("i") > 0, F.min(F.when(F.col("i") < 0, F.col("place"))).over(one))
    longer = F.when(F.col("i") < 0, F.min(F.when(F.col("i") > 0, F.col("place"))).over(one))
    pairs = emitted.select("h1", "h2", "place", F.least(changed, shorter, longer).alias("other")).where("other < place").distinct()
    text_of = full.select(F.col("place").alias("other"), F.col("line").alias("other_line")).dropDuplicates(["other"])
    both = pairs.join(full.select("h1", "h2", "line").dropDuplicates(["h1", "h2"]), ["h1", "h2"]).join(text_of, "other")
    return both.where(F.levenshtein("line", "other_line") <= 1).select("h1", "h2").distinct()


def _near_by_pieces(docs: DataFrame, text: str, lines: DataFrame, distinct: DataFrame, max_edits: int) -> DataFrame:
    """``h1, h2`` of the different lines that have another, earlier line within ``max_edits`` edits."""
    each = lines.select("h1", "h2", "doc_id", "text_hash", "line_no", F.explode("keys").alias("k"))
    shared = each.groupBy("k").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("k")
    shared = materialised(shared)
    place = F.struct("doc_id", "text_hash", "line_no").alias("place")
    likely = prefiltered(each, "k", shared).join(shared, "k").select("h1", "h2", place, "k")
    first = likely.join(distinct.select("h1", "h2", F.col("first").alias("place")), ["h1", "h2", "place"], "left_semi")
    per_line = first.groupBy("h1", "h2", "place").agg(F.collect_set("k").alias("keys"))
    per_doc = materialised(per_line.groupBy("place.doc_id", "place.text_hash").agg(F.collect_list(F.struct("h1", "h2", "place", "keys")).alias("wanted")))
    full = materialised(_wanted_lines(docs, text, per_doc).select("w.h1", "w.h2", "w.place", "w.keys", "line"))
    # Blocks of a key meet each other two by two, so no task holds all lines of a key.
    many = full.select(F.explode("keys").alias("k")).groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINES).cast("int").alias("blocks")).where("blocks > 1")
    keyed = full.select("h1", "h2", "place", "line", F.explode("keys").alias("k")).join(many, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.col("h2"), F.col("blocks")).cast("int")
    met = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = met.groupBy("k", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    held = group.agg(F.collect_list(F.struct("h1", "h2", "place", "line")).alias("held")).where(F.size("held") > 1)
    earlier = lambda x: lambda y: (y["place"] < x["place"]) & (F.levenshtein(y["line"], x["line"], max_edits) >= 0)
    near = F.filter("held", lambda x: F.exists(F.col("held"), earlier(x)))
    return held.select(F.explode(near).alias("x")).select("x.h1", "x.h2").distinct()


def _shared_thirds(min_chars: int):
    """Keys of thirds with a tag of their line: what is needed to see which of them different lines share."""
    schema, emit = pa.schema([("k", pa.int64()), ("tag", pa.int32())]), _emit_lines(min_chars, min_chars, 2)

    def rows(batches):
        for batch in emit(batches):
            keys, tags = batch.column("keys"), batch.column("h1").to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys.flatten(), pa.array(np.repeat(tags, np.diff(keys.offsets.to_numpy())))], schema=schema)

    return rows


def _cells(line: str):
    """Per choice of cells and shift: number, shift, all but the cells, and the text in them; one cell for both edits, or two for one each.

    Cells before the first edit keep their place from the front, those behind the last one theirs from the back, and
    what lies between, even nothing, may be shifted by one; what the length is more than its rounded value is in the
    last cell of the choice.
    """
    n, number = len(line), 0
    for base in (n // STEP * STEP, *([n // STEP * STEP - STEP] if n % STEP < 2 else [])):
        count = min(max(base // CELL, CELLS[0]), CELLS[1])
        cuts = [base * i // count for i in range(count + 1)]
        for a in range(count):
            head = line[: cuts[a]]
            for b in range(a, count):
                end = n - base + cuts[b + 1]
                for shift in (0, 1) if b > a else (0,):
                    one, two = cuts[a + 1] + shift, cuts[b] + shift
                    between, parts = ("", (line[cuts[a] : end],)) if b == a else (line[one:two], (line[cuts[a] : one], line[two:end]))
                    yield number, shift, f"{base} {a} {b}\n{head}\n{between}\n{line[end:]}", parts
                    number += 1


def _key(text: str, seed: int = 0) -> int:
    import xxhash

    key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return key - (1 << 64) if key >> 63 else key


def _short(text: str) -> int:
    return (_key(text) & 0xFFFFFFFF) - (1 << 31)


def _in_batches(rows, schema: pa.Schema, size: int = 1 << 16):
    """Arrow batches of the tuples."""
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*part), schema)], schema=schema)


def _outer_keys(told: bool):
    """Keys of all but the chosen cells of a text: with hashes of its line and of the cells and the shift, or with the choice's number."""
    names = ("k", "tag", "one", "two", "shift") if told else ("id", "salt", "k", "c")
    schema = pa.schema([(n, pa.int64() if n in ("id", "salt", "k") else pa.int32()) for n in names])

    def keyed(batches):
        for batch in batches:
            for own, salt, line in zip(*(batch.column(c).to_pylist() for c in ("id", "salt", "line"))):
                tag = (own & 0xFFFFFFFF) - (1 << 31)
                for c, shift, rest, parts in _cells(line):
                    k = _key(rest, salt % (1 << 64))
                    yield (k, tag, _short(parts[0]), _short(parts[-1]), shift) if told else (own, salt, k, c)

    return lambda batches: _in_batches(keyed(batches), schema)


def _wanted_cells(batches):
    """The text in the wanted cells; ``two`` is null where both edits are in one cell."""
    schema = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("shift", pa.int32()), ("one", pa.string()), ("two", pa.string())])

    def cells():
        for batch in batches:
            for own, line, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "line", "wanted"))):
                by_number = {w["c"]: w["k"] for w in wanted}
                for c, shift, _, parts in _cells(line):
                    if c in by_number:
                        yield own, by_number[c], shift, parts[0], parts[1] if len(parts) > 1 else None

    return _in_batches(cells(), schema)


def _nearest(shared: str):
    """Fills ``shared`` with how many characters a text's start, or its end, has in common with another text of its group at most.

    Rows come ordered by group and by the text as it is compared. Where the neighbour is in another partition, the
    whole text counts as common: that leaves out no place.
    """
    schema = pa.schema([("g", pa.int64()), ("shift", pa.int32()), ("part", pa.string()), ("ahead", pa.int32()), ("behind", pa.int32())])

    def compared(row: dict) -> tuple[int, str]:
        return row["g"], row["part"][::-1] if shared == "behind" else row["part"][: len(row["part"]) - row["shift"]]

    def filled(batches):
        own, before, held = None, None, []
        for row in chain((r for batch in batches for r in batch.to_pylist()), [None]):
            key = row and compared(row)
            if held and key != own:
                after = None if row is None else len(commonprefix((own[1], key[1]))) if own[0] == key[0] else 0
                n = len(own[1]) if before is None or after is None else max(before, after)
                yield from ((*(x | {shared: n}).values(),) for x in held)
                before, held = after, []
            own = key
            held.append(row)

    return lambda batches: _in_batches(filled(batches), schema)


def _reached(texts: DataFrame) -> DataFrame:
    """Of different ``g, shift, part``: with what their starts (less the shift) and ends have in common with others of the group."""
    schema, none = "g long, shift int, part string, ahead int, behind int", F.lit(0).alias
    start = F.expr("substring(part, 1, length(part) - shift)")
    rows = texts.select("g", "shift", "part", none("ahead"), none("behind")).orderBy("g", start).mapInArrow(_nearest("ahead"), schema)
    return rows.orderBy("g", F.reverse("part")).mapInArrow(_nearest("behind"), schema)


def _variants(x: str, seed: int, ahead: int, behind: int):
    """Key, number of characters left out, and their places (-1: none) of a text less none, one or two characters.

    Of two, the first is not behind the start that another text shares and the second not before the end.
    """
    yield _key(x, seed), 0, -1, -1
    for p in range(len(x)):
        left = x[:p] + x[p + 1 :]
        yield _key(left, seed), 1, p, -1
        for q in range(max(p + 1, len(x) - 1 - behind), len(x)) if p <= ahead else ():
            yield _key(left[: q - 1] + left[q:], seed), 2, p, q


def _emit_variants(batches):
    """The variants of texts that may hold both edits."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.int64()), ("d", pa.int8()), ("p", pa.int32()), ("q", pa.int32())])
    columns = ([batch.column(c).to_pylist() for c in ("id", "g", "part", "ahead", "behind")] for batch in batches)
    return _in_batches(((own, *v) for part in columns for own, k, x, *common in zip(*part) for v in _variants(x, k % (1 << 64), *common)), schema)


def _emit_one(cells: DataFrame) -> DataFrame:
    """``id, v, d, p, q`` of ``id, k, one``: lines less two characters at most in a cell."""
    own = cells.select("id", F.col("k").alias("g"), F.col("one").alias("part"))
    texts = _reached(own.select("g", F.lit(0).alias("shift"), "part").distinct())
    return own.join(texts, ["g", "part"]).mapInArrow(_emit_variants, "id long, v long, d byte, p int, q int")


def _emit_two(cells: DataFrame) -> DataFrame:
    """``id, v, d, p, q`` of lines less one character at most in either of two cells. Places in the second are below -1.

    A partner's cell differs by one edit in both. First cells that are not shifted against each other have one length,
    so a character is changed, and both leave it out; a shifted one has the character more that it leaves out, which is not its last.
    The second cell emits only where a first cell of different text has the same variant.
    """
    part, n = F.col("part"), F.length("part")
    less = lambda i: F.concat(F.substring(part, F.lit(1), i), F.substring(part, i + 2, n))
    low = F.greatest(n - 1 - F.col("behind"), F.lit(0))
    places = lambda high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    own = _reached(cells.select(F.col("k").alias("g"), "shift", F.col("one").alias("part")).distinct())
    moved = F.col("shift") == 1
    left = F.transform(places(F.least("ahead", n - 1 - F.col("shift"))), lambda i: F.struct(i.alias("i"), F.xxhash64("g", F.when(moved, -1).otherwise(i), less(i)).alias("v")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.xxhash64("g", F.lit(-1), part).alias("v")))
    first = written(own.select("g", "shift", "part", F.explode(F.when(moved, left).otherwise(F.concat(whole, left))).alias("x")).select("g", "shift", "part", "x.i", "x.v"), "first-variants")
    text = F.xxhash64("part")
    shared = first.groupBy("v").agg(F.min(text).alias("x"), F.max(text).alias("y"), F.min("shift").alias("shift")).where("x <> y and shift = 0").select("v")
    live = written(first.join(shared, "v", "left_semi"), "live-variants")
    held = cells.join(live.withColumnsRenamed({"g": "k", "part": "one"}), ["k", "shift", "one"])
    held = written(held.select("id", F.col("v").alias("g"), "i", F.col("two").alias("part")), "second-cells")
    second = _reached(held.select("g", F.lit(0).alias("shift"), "part").distinct())
    none = F.when(F.col("ahead") + F.col("behind") >= n, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    second = second.select("g", "part", F.explode(F.concat(none, places(F.least("ahead", n - 1)))).alias("j"))
    second = second.withColumn("v", F.xxhash64("g", F.when(F.col("j") < 0, part).otherwise(less(F.col("j")))))
    one, two, after = F.col("i"), F.col("j"), -2 - F.col("j")
    return held.join(second, ["g", "part"]).select(
        "id",
        "v",
        ((one >= 0).cast("byte") + (two >= 0).cast("byte")).cast("byte").alias("d"),
        F.when(one >= 0, one).when(two >= 0, after).otherwise(-1).alias("p"),
        F.when((one >= 0) & (two >= 0), after).otherwise(-1).alias("q"),
    )


def _cells_shared(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``id, salt, line``: the lines that meet in keys of few lines, and the cells of those that meet in others.

    Lines that agree in one of two cells too are left out there: they meet where the other is alone. One of two lines
    is not shifted.
    """
    told = texts.mapInArrow(_outer_keys(True), "k long, tag int, one int, two int, shift int")
    ends = [f(c).alias(f"{n}_{c}") for c in ("tag", "one", "two") for n, f in (("x", F.min), ("y", F.max))]
    apart = F.expr("x_tag <> y_tag and x_one <> y_one and x_two <> y_two and shift = 0")
    common = written(told.groupBy("k").agg(*ends, F.min("shift").alias("shift"), F.count(F.lit(1)).alias("n")).where(apart).select("k", (F.col("n") <= FEW).alias("few")), "common-keys")
    outer = prefiltered(texts.mapInArrow(_outer_keys(False), "id long, salt long, k long, c int"), "k", common)
    outer = written(outer.join(common, "k"), "outer-keys")
    held = outer.where("few").groupBy("k").agg(F.collect_set("id").alias("ids"))
    met = held.select("ids", F.explode("ids").alias("x")).select("x", F.explode("ids").alias("y")).where("x < y")
    wanted = outer.where("not few").groupBy("id", "salt").agg(F.collect_set(F.struct("k", "c")).alias("wanted"))
    return met, texts.join(wanted, ["id", "salt"]).select("id", "line", "wanted").mapInArrow(_wanted_cells, "id long, k long, shift int, one string, two string")


def _near_by_variants(docs: DataFrame, text: str, read: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2`` of the different lines that have another, earlier line within two edits."""
    tagged = read.mapInArrow(_shared_thirds(min_chars), "k long, tag int").groupBy("k").agg(F.min("tag").alias("x"), F.max("tag").alias("y"))
    # Slim tables are written as Parquet, which packs small files into few partitions when it is read.
    thirds = written(tagged.where("x <> y").select("k"), "shared-thirds")
    each = read.mapInArrow(_emit_lines(min_chars, min_chars, 2), _LINES).select("h1", "h2", F.struct("doc_id", "text_hash", "line_no").alias("place"), F.explode("keys").alias("k"))
    likely = prefiltered(each, "k", thirds).join(thirds, "k", "left_semi")
    # All places of a line have its keys, so the first of them is its first place.
    first = written(likely.groupBy("h1", "h2").agg(F.min("place").alias("place")), "first-places")
    per_doc = written(first.groupBy("place.doc_id", "place.text_hash").agg(F.collect_list(F.struct("h1", "h2", "place")).alias("wanted")), "wanted-lines")
    full = _wanted_lines(docs, text, per_doc).select("w.h1", "w.h2", "w.place", "line")
    full = written(full.withColumn("id", F.xxhash64("h1", "h2")), "likely-lines")
    # A long cell that may hold both edits is cut into cells itself, until all are short.
    texts, found, parts = full.select("id", F.lit(0).cast("long").alias("salt"), "line"), [], []
    while texts is not None:
        met, cells = _cells_shared(texts)
        cells = written(cells, "line-cells")
        alone, long = cells.where("two is null"), F.length("one") > LONG
        found.append(met)
        # Partners differ in length by two at most, and of those on either side of the bound both emit variants.
        parts += [_emit_one(alone.where(F.length("one") <= LONG + 2)), _emit_two(cells.where("two is not null"))]
        rest = alone.where(long).select("id", F.col("k").alias("salt"), F.col("one").alias("line"))
        texts = None if rest.isEmpty() else rest
    two = reduce(DataFrame.unionByName, found).distinct()
    side = lambda n: full.select(*[F.col(c).alias(f"{n}_{c}") for c in ("id", "h1", "h2", "place", "line")])
    met = two.join(side("x"), F.col("x") == F.col("x_id")).join(side("y"), F.col("y") == F.col("y_id"))
    met = met.where(F.levenshtein("x_line", "y_line", 2) >= 0)
    late = lambda c: F.when(F.col("x_place") > F.col("y_place"), F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(c)
    near = met.select(late("h1"), late("h2")).distinct()
    emitted = written(reduce(DataFrame.unionByName, parts), "line-variants")
    met = emitted.groupBy("v").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("v")
    rows = written(emitted.join(met, "v", "left_semi").distinct().join(full.select("id", "place"), "id"), "met-variants")
    # Lines of one variant are within two edits if neither leaves out more than one character, if one leaves out none,
    # if both leave out two at the same places, or if the one place of one is a place of the other's two.
    least = lambda cond, w: F.min(F.when(cond, F.col("place"))).over(w)
    one, same, place = Window.partitionBy("v"), Window.partitionBy("v", "p", "q", "d"), Window.partitionBy("v", "r")
    d, p, q = F.col("d"), F.col("p"), F.col("q")
    later = F.when((p >= 0) & (q >= 0), q - 1).otherwise(q)
    spread = rows.withColumn("r", F.explode(F.when(d == 2, F.array(p, later)).otherwise(F.array(p))))
    others = F.array(
        F.when(d <= 1, least(d <= 1, one)),
        F.when(d == 2, least(d == 0, one)),
        F.when(d == 0, least(d == 2, one)),
        F.when(d == 2, least(d == 2, same)),
        F.when(d == 2, least(d == 1, place)),
        F.when(d == 1, least(d == 2, place)),
    )
    pairs = spread.select("id", "place", others.alias("others")).select("id", "place", F.explode("others").alias("other")).where("other < place").select("id", "other").distinct()
    mine = full.select("id", "h1", "h2", "line")
    both = pairs.join(mine, "id").join(full.select(F.col("place").alias("other"), F.col("line").alias("other_line")), "other")
    return both.where(F.levenshtein("line", "other_line", 2) >= 0).select("h1", "h2").unionByName(near).distinct()


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, exact_chars: int | None = None, max_edits: int = 1) -> DataFrame:
    """The input with ``text`` less its repeated lines, ``n_lines`` and ``n_removed`` (longs).

    A line goes if an earlier line of any document equals it or is within ``max_edits`` edits of it (1 to 7),
    whether or not that earlier line itself goes. Lines are ordered by doc_id (null first) and line number; documents that share a
    doc_id are ordered by a hash of their texts, and rows that repeat id and text count as one document and stay
    alike. Only lines with ``min_chars`` characters besides white space or more are held against near ones. Exact
    repeats go from ``exact_chars`` such characters on (as many as ``min_chars`` if not given; with 1, all but blank
    lines), so lines with fewer stay. What is left is joined by line ends again. Null texts stay null with 0 lines. Columns named ``n_lines`` or ``n_removed`` are replaced.

    Equal lines are counted with partial sums before the shuffle and only their first place is compared on. Whole
    texts are shuffled only for documents that lose lines or have a line that another nearly equals.
    """
    exact_chars = min_chars if exact_chars is None else exact_chars
    if exact_chars > min_chars:
        raise ValueError("exact_chars must not be above min_chars")
    if not 1 <= max_edits < STEP:
        raise ValueError(f"max_edits must be 1 to {STEP - 1}")
    docs = docs.drop("n_lines", "n_removed")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("text is not null")
    emitted = read.mapInArrow(_emit_lines(min_chars, exact_chars, max_edits if max_edits != 2 else 0), _LINES)
    lines = written(emitted.drop("keys"), "lines") if max_edits == 2 else materialised(emitted)
    place = F.struct("doc_id", "text_hash", "line_no")
    distinct = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct, "distinct-lines") if max_edits == 2 else materialised(distinct)
    if max_edits == 2:
        near = _near_by_variants(docs, text, read, min_chars)
    else:
        near = _near_lines(docs, text, lines, distinct) if max_edits == 1 else _near_by_pieces(docs, text, lines, distinct, max_edits)
    # A line that comes once and is near no other costs nothing from here on.
    gone = materialised(distinct.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or near"))
    removed = prefiltered(lines.select("h1", "h2", place.alias("place")), "h1", gone).join(gone, ["h1", "h2"]).where("near or place > first")
    per_doc = removed.groupBy(F.col("place.doc_id").alias("__d"), F.col("place.text_hash").alias("__h")).agg(F.collect_set("place.line_no").alias("__gone"))
    per_doc = materialised(per_doc)
    flagged = in_filter(docs.withColumn("__h", F.xxhash64(text)), "__h", per_doc, "__may")
    untouched = flagged.where("not __may").withColumn("__gone", F.lit(None).cast("array<int>")).drop("__h", "__may")
    touched = flagged.where("__may").withColumnRenamed("__h", "__own").drop("__may")
    touched = touched.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__own") == F.col("__h")), "left").drop("__d", "__h", "__own")
    every = F.col("__all")
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("__gone"))
    rest = F.when(F.size(stay) == 0, F.lit("")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(every, i)), "\n"))
    none = F.col("__gone").isNull()
    return (
        untouched.unionByName(touched)
        .withColumn("__all", F.split(F.col(text), "\n"))
        .withColumns(
            {
                text: F.when(none, F.col(text)).otherwise(rest),
                "n_lines": F.when(every.isNull(), 0).otherwise(F.size(every)).cast("long"),
                "n_removed": F.when(none, 0).otherwise(F.size("__gone")).cast("long"),
            }
        )
        .select(*docs.columns, "n_lines", "n_removed")
    )
