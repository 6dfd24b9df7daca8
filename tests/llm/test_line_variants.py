"""Line dedup at two edits: pairs of every kind of edit against plain edit distance, and boilerplate that many lines share."""

import random
import time

import pytest

from jobtrail.llm import linededup


def distance(a, b, most=2):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, n, letters):
    for _ in range(n):
        i = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        line = line[:i] + (rng.choice(letters) if kind != 1 else "") + line[i + (kind > 0) :]
    return line


def removed(lines):
    """Which of the lines, in order, have an earlier one that equals them or, if long enough, is within two edits."""
    solid = [len("".join(x.split())) for x in lines]
    out = []
    for i, line in enumerate(lines):
        near = (line == b or (solid[i] >= 20 and solid[j] >= 20 and distance(line, b) <= 2) for j, b in enumerate(lines[:i]))
        out.append(solid[i] > 0 and any(near))
    return out


def dedup(spark, lines, per_doc=7):
    docs = [(i, "\n".join(lines[i * per_doc : (i + 1) * per_doc])) for i in range(-(-len(lines) // per_doc))]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), exact_chars=1, max_edits=2)
    return {r.doc_id: (r.text, r.n_removed) for r in got.collect()}, docs


def wanted(lines, per_doc=7):
    gone = removed(lines)
    out = {}
    for i in range(-(-len(lines) // per_doc)):
        part = [(x, g) for x, g in zip(lines[i * per_doc : (i + 1) * per_doc], gone[i * per_doc : (i + 1) * per_doc])]
        out[i] = ("\n".join(x for x, g in part if not g), sum(g for _, g in part))
    return out


@pytest.mark.parametrize("seed,few", [(1, 0), (2, 0), (3, linededup.FEW)])
def test_edits_of_every_kind_and_place(spark, monkeypatch, seed, few):
    monkeypatch.setattr(linededup, "FEW", few)
    rng = random.Random(seed)
    lines = []
    for _ in range(45):
        letters = rng.choice(["ab", "abcdefgh ", "aé中🙂"])
        line = "".join(rng.choice(letters) for _ in range(rng.choice([20, 21, 23, 24, 25, 31, 32, 33, 47, 48, 64, 65, 130])))
        lines.append(line)
        lines += [edited(rng, line, rng.choice([1, 2, 2, 2, 3]), letters) for _ in range(3)]
    rng.shuffle(lines)
    got, _ = dedup(spark, lines)
    assert got == wanted(lines)


def test_edits_at_borders(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FEW", 2)
    base = "".join(chr(97 + i * 7 % 26) for i in range(80))
    lines = [base]
    for i in range(0, 80, 3):
        for j in (0, 1, 40, 79):
            lines += [base[:i] + base[i + 1 :], base[:i] + "#" + base[i:]]
            x = base[:i] + "%" + base[i + 1 :]
            lines += [x[:j] + x[j + 1 :], x[:j] + "!" + x[j:], x[: j + 1] + "?" * 2 + x[j + 1 :]]
    for first in range(0, len(lines), 60):
        # Each part alone: the base takes all within two edits, others only what they are near to themselves.
        part = [base, *lines[first : first + 60]]
        got, _ = dedup(spark, part)
        assert got == wanted(part)


def test_many_lines_share_all_but_their_end(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = [f"this common sentence begins a line of many documents, {word(16)}" for _ in range(4000)]
    lines += [lines[5][:-1] + "#", "X" + lines[9], lines[9][:-2]]
    began = time.time()
    got, docs = dedup(spark, lines, 1)
    assert [i for i, (_, n) in got.items() if n] == [] or sorted(i for i, (_, n) in got.items() if n) == [4000, 4001, 4002]
    assert sum(n for _, n in got.values()) == 3 and time.time() - began < 120


def test_many_lines_differ_in_two_characters(spark):
    lines = [f"page {a}{b} of the same long list of numbered pages" for a in "0123456789abcdefgh" for b in "0123456789abcdefgh"]
    got, _ = dedup(spark, lines, 1)
    assert sum(n for _, n in got.values()) == len(lines) - 1 and got[0][1] == 0


def test_cells_of_long_lines_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FEW", 0)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    # Changes of one word each in the same cell: the lines share all but that cell. Plain distance finds four pairs.
    lines = [base[:200] + "".join(rng.choice("abcdefgh") for _ in range(6)) + base[206:] for _ in range(12)]
    lines += [lines[3][:190] + "#" + lines[3][191:230] + "%" + lines[3][230:], lines[5][:180] + lines[5][182:], lines[7][:185] + "!!!" + lines[7][188:]]
    got, _ = dedup(spark, lines)
    assert got == wanted(lines) and sum(n for _, n in got.values()) == 4


def test_cells_on_either_side_of_the_bound_meet(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FEW", 0)
    rng = random.Random(8)
    # Cells of the lengths 16 and 18, 32 and 34: two characters put into one cell, where no other cut has both edits.
    for n, at in ((66, 20), (130, 36), (258, 70)):
        longer = "".join(rng.choice("abcdefgh ") for _ in range(n))
        lines = [longer[: at - 1] + longer[at : at + 4] + longer[at + 5 :], longer]
        got, _ = dedup(spark, lines, 1)
        assert len(lines[0]) == n - 2 and got[1] == ("", 1)


def test_variants_of_a_group_stay_few(spark, monkeypatch):
    rng, made, write = random.Random(9), {}, linededup.written

    def counted(df, name):
        kept = write(df, name)
        made[name] = made.get(name, 0) + kept.count()
        return kept

    monkeypatch.setattr(linededup, "written", counted)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(28)) for _ in range(300)]
    # All share everything but one cell of 32 characters; the last is two edits from the first.
    lines = [f"{'head of a common line, ' * 12}"[:224] + f"{w}    " for w in words]
    lines.append(lines[0][:230] + "##" + lines[0][232:])
    assert len(lines[0]) == 256
    got, _ = dedup(spark, lines, 1)
    assert [i for i, (_, n) in got.items() if n] == [300]
    assert made["line-variants"] < 100 * len(lines)


def test_first_cells_emit_few_variants(spark, monkeypatch):
    rng, made, write = random.Random(10), {}, linededup.written

    def counted(df, name):
        kept = write(df, name)
        made[name] = made.get(name, 0) + kept.count()
        return kept

    monkeypatch.setattr(linededup, "written", counted)
    base = [chr(97 + i * 11 % 26) for i in range(400)]
    # A common text with one random word in each of two cells of 50 characters; two edits apart: the last from the first.
    lines = []
    for _ in range(300):
        line, word = list(base), lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(6))
        line[120:126], line[270:276] = word(), word()
        lines.append("".join(line))
    lines.append(lines[0][:121] + "#" + lines[0][122:273] + lines[0][274:])
    lines.append(lines[1][:122] + lines[1][123:272] + "#" + lines[1][272:])
    got, _ = dedup(spark, lines, 1)
    assert [i for i, (_, n) in got.items() if n] == [300, 301]
    # With all one-character variants of the first cells it would be some 50 a line.
    assert made["first-variants"] < 20 * len(lines)


def test_edits_of_common_texts(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FEW", 0)
    rng = random.Random(11)
    # Few letters, so that runs let one edit stand at several places; many lines share each cell's rest.
    lines = []
    for n in (34, 66):
        base = "".join(rng.choice("aab ") for _ in range(n)) + "." * 20
        lines += [base] + [edited(rng, edited(rng, base, 1, "ab"), rng.choice([1, 2, 3]), "ab") for _ in range(30)]
    rng.shuffle(lines)
    got, _ = dedup(spark, lines)
    assert got == wanted(lines)


def test_common_starts_and_ends_across_partitions(spark):
    texts = ["abcxef", "abcyef", "abzzef", "q", "abc"]
    rows = [(g, 0, x) for g in (1, 2) for x in texts]
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = {(r.g, r.part): (r.ahead, r.behind) for r in linededup._reached(spark.createDataFrame(rows, "g long, shift int, part string")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        for (_, x), (ahead, behind) in got.items():
            others = [y for y in texts if y != x]
            common = lambda a, b: next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert max(common(x, y) for y in others) <= ahead <= len(x) and max(common(x[::-1], y[::-1]) for y in others) <= behind <= len(x)
        assert len(got) == 10 and (parts > 1 or got[1, "abzzef"] == (2, 2))
