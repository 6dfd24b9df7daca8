"""The trie of turn prefixes of conversations, by digests of fixed-length blocks of turns.

A prefix is named by its length and by sums of hashes of its turns with their places, so names come from running sums
and no conversation has to be in one place. Conversations are first grouped by the names of prefixes that end with a
block of ``BLOCK`` turns. Where all that go on from one such prefix have the same next block, its turns are inner nodes
with the same members, and only the smallest conversation of the group names them. Only where siblings diverge, or end,
inside a block are its turns grouped one by one.

What a node sums over its subtree is a sum over its members. A conversation that is the smallest of a leaf stands for
it. A turn counts as saved for all its members but the smallest, and a conversation, once it is the smallest of a node,
is that of all its nodes below; so up to there all its words are saved, and none from there on.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import attached, materialised, n_words
from jobtrail.operators.ordered import numbered

#: Turns of a block, turns of a long conversation that one task adds up, and ids of a part of a list of ends.
BLOCK, REACH, PART = 4, 4096, 256
LOW = (1 << 32) - 1
_SUMS = ["s0", "s1", "s2", "s3"]
NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """``conv_id, at, d1, d2, words``: slim rows with digests of role and text; rows without a conversation are left out."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    digests = {"d1": F.xxhash64(*said), "d2": F.xxhash64(F.lit("again"), *said)}
    at = F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63)))
    named = conversations.where(F.col(conv).isNotNull())
    return named.select(F.col(conv).cast("long").alias("conv_id"), at.alias("at"), *[d.alias(n) for n, d in digests.items()], n_words(F.col(text)).alias("words"))


def with_shared_heads(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to begin with turns of the first of their family: ``conv_id, pos, d1, d2, words``, and ``conv_id, length`` of all.

    Conversation c takes the first h turns of c - c % ``family``, h = crc32(c) % ``most``, then its own after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", "n", base.alias("base"), heads.alias("h"))
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = convs.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialised(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    block = F.floor(F.col("at") / REACH)
    placed = materialised(numbered(turns, ["conv_id"], ["at", "d1", "d2"], [block], name="p", per_key=convs.select("conv_id", "h", "taken")))
    own = placed.where("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("pos"), "d1", "d2", "words")
    first = placed.where((F.col("p") < most) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), F.col("p").alias("pos"), "d1", "d2", "words")
    lent = first.join(convs.select("conv_id", "base", "taken"), "base").where("pos <= taken").select("conv_id", "pos", "d1", "d2", "words")
    return own.unionByName(lent), convs.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, block, key, parent, words, through``: names of each prefix and of the one before, and words up to here.

    Sums run inside stretches of ``REACH`` turns; only conversations with more carry the sums of earlier stretches over.
    """
    one, two = F.xxhash64("pos", "d1", "d2"), F.xxhash64("d2", "pos", "d1")
    halves = [F.shiftrightunsigned(one, 32), one.bitwiseAND(LOW), F.shiftrightunsigned(two, 32), two.bitwiseAND(LOW)]
    columns = [*_SUMS, "words"]
    rows = turns.select("conv_id", "pos", "words", *[h.alias(f"own_{s}") for h, s in zip(halves, _SUMS)], F.floor((F.col("pos") - 1) / REACH).alias("stretch"))
    rows = rows.withColumn("own_words", F.col("words"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"to_{c}": F.sum(f"own_{c}").over(inside) for c in columns})
    tops = rows.groupBy("conv_id", "stretch").agg(*[F.sum(f"own_{c}").alias(f"top_{c}") for c in columns])
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("conv_id", "stretch", *[F.sum(f"top_{c}").over(before).alias(f"top_{c}") for c in columns]).where("stretch > 0")
    far = local.where("stretch > 0").join(carried, ["conv_id", "stretch"]).withColumns({f"to_{c}": F.col(f"to_{c}") + F.col(f"top_{c}") for c in columns})
    run = local.where("stretch = 0").unionByName(far.select(*local.columns))
    name = lambda sums: [F.shiftleft(a, 32).bitwiseOR(b.bitwiseAND(LOW)) for a, b in (sums[:2], sums[2:])]
    key = name([F.col(f"to_{s}") for s in _SUMS])
    parent = name([F.col(f"to_{s}") - F.col(f"own_{s}") for s in _SUMS])
    node = lambda depth, k: F.struct(depth.cast("long").alias("depth"), k[0].alias("a"), k[1].alias("b"))
    block = F.floor((F.col("pos") - 1) / BLOCK).alias("block")
    return run.select("conv_id", "pos", block, node(F.col("pos"), key).alias("key"), node(F.col("pos") - 1, parent).alias("parent"), "words", F.col("to_words").alias("through"))


def _hashed_ends(batches):
    """One hash per key over its parts in order; a hash is carried from batch to batch, so a key may have any number of them."""
    kind = pa.schema([("text_key", pa.string()), ("ends_sha256", pa.string())])
    now, state = None, None
    for batch in batches:
        keys, hashes = [], []
        for key, part in zip(batch.column("text_key").to_pylist(), batch.column("ids").to_pylist()):
            if key != now:
                if now is not None:
                    keys.append(now)
                    hashes.append(state.hexdigest())
                now, state = key, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], schema=kind)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], schema=kind)


def ends_of(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of the ids ending at a node, ascending and joined by commas; ``ends``: ``conv_id, key``.

    Ids are joined in parts of ``PART`` first. A hash over a sequence has to be taken in order, so one task reads the
    parts of a node, however many ids that are, but holds few at a time.
    """
    part = F.shiftright("conv_id", PART.bit_length() - 1)
    ids = F.concat_ws(",", F.sort_array(F.collect_set("conv_id")).cast("array<string>"))
    parts = ends.withColumn("text_key", F.concat_ws(":", "key.depth", "key.a", "key.b")).groupBy("text_key", part.alias("part")).agg(ids.alias("ids"))
    dealt = parts.repartition("text_key").sortWithinPartitions("text_key", "part").select("text_key", "ids")
    hashed = dealt.mapInArrow(_hashed_ends, "text_key string, ends_sha256 string")
    of = [F.split_part("text_key", F.lit(":"), F.lit(i)).cast("long").alias(n) for i, n in ((1, "depth"), (2, "a"), (3, "b"))]
    return hashed.select(F.struct(*of).alias("key"), "ends_sha256")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node; ``turns``: ``conv_id, pos, d1, d2, words`` with places from 1, ``lengths``: ``conv_id, length`` of all conversations.

    Nodes are the different sequences of first turns, from the root without turns. ``conv_id`` is the smallest
    conversation that starts with it, ``n_convs`` their number; ``n_leaves`` counts childless nodes of its subtree and
    ``saved_tokens`` adds up, over that, the words of a node's last turn as often as it has members beyond one.
    ``ends_sha256`` hashes the conversations that end there. No conversations, no nodes.
    """
    rows = materialised(_prefixes(turns))
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    # Conversations by successive blocks: from which prefix into which block.
    blocks = rows.groupBy("conv_id", "block").agg(F.min_by("parent", "pos").alias("start"), F.max_by("key", "pos").alias("stop"))
    blocks = materialised(blocks)
    groups = blocks.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.min("stop").alias("x"), F.max("stop").alias("y"))
    groups = materialised(groups.select("start", "n", "n", "first", (F.col("x") == F.col("y")).alias("alike")).toDF("start", "n", "held", "first", "alike"))
    grouped = materialised(attached(blocks, groups, "start", "held"))
    met = rows.join(grouped.where("not alike or conv_id = first").select("conv_id", "block", "alike", "n"), ["conv_id", "block"])
    met = materialised(met)
    shown = ["key", "parent", "words", "through"]
    whole = met.where("alike").select(*shown, "n", "conv_id", "block", "alike")
    apart = met.where("not alike")
    named = apart.groupBy("key").agg(*[F.any_value(c).alias(c) for c in shown[1:]], F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("block").alias("block"))
    nodes = materialised(whole.unionByName(named.withColumn("alike", F.lit(False))))

    # A node's children, and what the members of a node stand for.
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    top = total.select(root.alias("key"), F.lit(None).cast(nodes.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("through"), "n", "conv_id", F.lit(-1).cast("long").alias("block"), F.lit(True).alias("alike"))
    every = materialised(nodes.unionByName(top))
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    every = materialised(every.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    owners = every.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("held"))
    led = nodes.groupBy("conv_id").agg(F.min_by(F.col("through") - F.col("words"), "key.depth").alias("before"))
    leaf = every.where("n_children = 0").select("conv_id", F.lit(1).alias("leaf")).distinct()
    last = rows.groupBy("conv_id").agg(F.max("through").alias("all"), F.max_by("key", "pos").alias("end"))
    convs = lengths.join(last, "conv_id", "left").join(led, "conv_id", "left").join(leaf, "conv_id", "left")
    convs = convs.select("conv_id", F.col("length").alias("held"), F.coalesce("before", "all", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("end", root).alias("end"))
    convs = materialised(convs)
    sums = [F.sum("saved").alias("saved"), F.sum("leaf").alias("n_leaves")]
    told = convs.select("conv_id", "held", "saved", "leaf")
    of_block = attached(grouped.where("alike").select("conv_id", "block", "first"), told, "conv_id", "held").groupBy(F.col("first").alias("conv_id"), "block").agg(*sums)
    of_node = attached(apart.select("conv_id", "key"), told, "conv_id", "held").groupBy("key").agg(*sums)
    of_root = convs.agg(*sums).select("saved", "n_leaves", root.alias("key"))
    inner = every.where("alike and key.depth > 0").join(of_block, ["conv_id", "block"])
    outer = every.where("not alike or key.depth = 0").join(of_node.unionByName(of_root), "key")
    # The smallest member saves nothing from here on; the others' words before this node are those of the path to it.
    own = told.select("conv_id", F.col("saved").alias("own"), "held")
    summed = materialised(inner.unionByName(outer.select(*inner.columns)))
    summed = attached(summed, own, "conv_id", "held")
    saved = F.col("saved") - F.col("own") - (F.col("n") - 1) * (F.col("through") - F.col("words"))
    summed = materialised(summed.withColumn("saved_tokens", saved))
    below = attached(summed.where("key.depth > 0"), owners, "parent", "held")
    above = summed.where("key.depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = below.unionByName(above.select(*below.columns)).join(ends_of(convs.select("conv_id", F.col("end").alias("key"))), "key", "left")
    longs = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    out = out.withColumn("n_convs", F.col("n")).select("conv_id", F.col("key.depth").alias("depth"), "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in longs], F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, from rows ``conv_id, turn, role, text``.

    Turns are ordered by ``turn``, null first; rows of one conversation that share a turn by a hash of role and text.
    Null roles and texts count as empty; rows without a conv_id belong to no conversation; repeated rows are turns of
    their own. Other columns are not read.
    """
    turns = materialised(ordered_turns(conversations.select("conv_id", "turn", "role", "text")))
    rebuilt, lengths = with_shared_heads(turns)
    return trie(rebuilt, lengths)
