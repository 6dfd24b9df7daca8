"""The trie of conversations against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from jobtrail.llm import prefixtrie
from jobtrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    talks = {c: [said for _, said in sorted(x, key=lambda y: y[0])] for c, x in talks.items()}
    built = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(talks.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, held in members.items():
        text = node[-1][1] if node else ""
        for gap in "\t\n\x0b\x0c\r":
            text = text.replace(gap, " ")
        n = (len(held) - 1) * len([w for w in text.split(" ") if w])
        for d in range(len(node) + 1):
            saved[node[:d]] += n
            leaves[node[:d]] += node not in kids
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def talks(seed):
    """Families that share much: long common beginnings, copies, ends inside and on the border of a block."""
    rng = random.Random(seed)
    scripts = [[(rng.choice(["user", "assistant", None]), rng.choice(["", None, "one", "two words", "a b\tc\nd"]) if rng.random() < 0.3 else f"text {rng.randrange(9)}") for _ in range(14)] for _ in range(6)]
    rows = []
    for c in rng.sample(range(-45, 400), 150):
        script = list(rng.choice(scripts))[: rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 13, 14])]
        if rng.random() < 0.4:
            script[rng.randrange(len(script))] = ("user", f"change {rng.randrange(3)}")
        rows += [(c, None if i == 0 and rng.random() < 0.2 else i * 3 - 4, role, text) for i, (role, text) in enumerate(script)]
    rng.shuffle(rows)
    return rows + [(None, 1, "user", "of no conversation")]


@pytest.mark.parametrize("block,reach", [(4, 4096), (1, 3), (3, 2)])
def test_nodes_are_those_of_plain_dictionaries(spark, monkeypatch, block, reach):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    monkeypatch.setattr(prefixtrie, "REACH", reach)
    rows = talks(block)
    assert found(prefixtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "REACH", 64)
    rows = [(20, i, "user", f"turn {i % 7} of many") for i in range(700)]
    rows += [(c, i, "user", "the same text") for c in range(1000, 1600) for i in range(5)]
    assert found(prefixtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_conversations_without_turns(spark):
    # 1..40 are cut to nothing where their first turns go and no base lends others.
    rows = [(c, 1, "user", "only") for c in range(1, 20)]
    got = found(prefixtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    turnless = [(c, 1, "u", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    got = found(prefixtrie.conversation_trie(spark.createDataFrame(turnless, SCHEMA)))
    assert got == plain(turnless) and len(got) == 1 and got[0][5] == 1


def test_nothing_nulls_and_other_columns(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefixtrie.conversation_trie(spark.createDataFrame([(None, None, None, None)], SCHEMA)).collect() == []
    rows = [(0, None, None, None), (0, 1, "user", "x y"), (3, 1, "user", "z"), (3, 2, "user", "x y")]
    more = spark.createDataFrame([(*r, 5, "n") for r in rows], SCHEMA + ", depth int, key string")
    assert found(prefixtrie.conversation_trie(more)) == plain(rows)


def test_rows_of_one_turn_have_an_order(spark):
    rows = [(0, 1, "user", t) for t in ("b", "a", "c", "a")] + [(40, 1, "user", t) for t in ("a", "c", "a", "b")]
    one = found(prefixtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    two = found(prefixtrie.conversation_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)))
    assert one == two and sum(r[1] == 4 for r in one) >= 1


def test_query_over_its_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_prefix_trie"](spark, SF)) == plain(rows)
