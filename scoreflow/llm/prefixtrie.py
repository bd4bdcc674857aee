"""Conversation prefix trie: totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns; it is named by (conv_id, depth), the smallest
conversation that starts with it and its length. Rows of a conversation are ordered by turn (null
first), then role and text. With ``stitch``, conversations are first rebuilt from the head of
another one.

1. Order. Rows are range-partitioned by (conv_id, turn, role, leading text), ranked inside their
   partition, and shifted by the conversation's rows in the partitions before. So one conversation of
   any length is spread over many tasks.
2. Prefixes. A turn at a place has two 64-bit hashes of (place, role, text); the prefix of length d is
   the exclusive-or of the first d, carried over partitions in the same way. Equal prefixes are one node: exact
   up to a collision of 128 bits. A node's parent is its prefix without its last turn.
3. Contraction. Each round has two exchanges. Rake: every leaf adds its total to its parent and goes.
   Compress: of the nodes left with one child, those whose hash of this round is below that of their
   parent and of their child are spliced out (so no two neighbours); the child hangs on the grandparent and
   carries what the spliced node had. A third of a chain goes in each round, so rounds grow with the
   logarithm of depth and size. Messages to a node are summed in each task before they are shuffled, so a node
   with very many children costs one row for each task.
4. Expansion. A raked node's total is known. A spliced node's is that of its child at that time and a known
   sum; these references are doubled until all end in known totals.

Digests of the members that end at a node are built from blocks of ids, streamed in order.

Defined cases: a null role or text is empty; rows without conv_id belong to no conversation and are left
out; repeated rows are turns of their own; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreflow.llm.common import stored

#: Code points of a text by which rows of one conversation and turn are dealt to partitions.
LEADING = 64
#: Ids of a block are in one row; a block spans this many consecutive numbers.
BLOCK_BITS = 12
#: Heads are at most this long; conversations of one hundred share them.
HEAD = 5
SHARE = 100


def head_length(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first conversation of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("long")


def own_head(conv_id: Column) -> Column:
    """No turns from elsewhere: conversations stay as they are."""
    return F.lit(0).cast("long")


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, part, at, f1, f2, chars): place inside the partition, hashes and code points of the turn."""

    def rank(batches):
        last, seen = None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv)))) + 1
            if conv[0] == last:
                at[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    text = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    dealt = text.repartitionByRange(*order, F.left("text", F.lit(LEADING))).sortWithinPartitions(*order, "text")
    turns = dealt.select(
        "conv_id", F.spark_partition_id().cast("long").alias("part"),
        F.xxhash64(F.lit(1), "role", "text").alias("f1"), F.xxhash64(F.lit(2), "role", "text").alias("f2"),
        F.char_length("text").cast("long").alias("chars"),
    )
    return turns.mapInArrow(rank, "conv_id long, part long, f1 long, f2 long, chars long, at long")


def _marks(place: Column, f1: Column, f2: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(3), place, f1), F.xxhash64(F.lit(4), place, f2)


def _stretches(ranked: DataFrame, head: Column) -> DataFrame:
    """One row for each conversation and partition: rows before it, all rows, head length."""
    counts = ranked.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("conv_id")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(
        "conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"),
        head.alias("wanted"),
    )


def _rebuilt(ranked: DataFrame, head: Column) -> DataFrame:
    """Rows (conv_id, depth, k1, k2, v1, v2, chars, last): prefix, its last turn's marks, whether it is the whole."""
    spans = stored(_stretches(ranked, head))
    base = F.col("conv_id") - F.col("conv_id") % SHARE
    spots = ranked.join(spans.drop("wanted"), ["conv_id", "part"]).withColumn("place", F.col("before") + F.col("at"))
    heads = (
        spots.where((F.col("conv_id") == base) & (F.col("at") <= HEAD) & (F.col("place") <= HEAD))
        .select(F.col("conv_id").alias("base"), F.struct("place", "f1", "f2", "chars").alias("turn"))
        .groupBy("base").agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # at most HEAD rows
    )
    taken = F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), F.col("wanted").cast("int"))
    spans = stored(spans.withColumn("base", base).join(heads, "base", "left").withColumn("head", taken).drop("base", "turns"))

    size = F.size("head").cast("long")
    head_marks = [F.aggregate(
        F.transform("head", lambda t: _marks(t["place"], t["f1"], t["f2"])[i]),
        F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v),
    ) for i in (0, 1)]
    info = spans.select(
        "conv_id", "part", "before", "wanted", size.alias("size"), head_marks[0].alias("h1"), head_marks[1].alias("h2"),
        (size + F.greatest(F.col("total") - F.col("wanted"), F.lit(0))).alias("length"),
    )
    own = ranked.join(info, ["conv_id", "part"]).withColumn("place", F.col("before") + F.col("at"))
    own = own.where("place > wanted").withColumn("depth", F.col("size") + F.col("place") - F.col("wanted"))
    v1, v2 = _marks(F.col("depth"), F.col("f1"), F.col("f2"))
    along = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = stored(own.withColumns({"v1": v1, "v2": v2}).select(
        "conv_id", "part", "at", "depth", "v1", "v2", "chars", (F.col("depth") == F.col("length")).alias("last"),
        F.bit_xor("v1").over(along).bitwiseXOR(F.col("h1")).alias("k1"),
        F.bit_xor("v2").over(along).bitwiseXOR(F.col("h2")).alias("k2"),
    ))
    # What the partitions before add; only conversations that stand in several have such rows.
    sums = own.groupBy("conv_id", "part").agg(F.bit_xor("v1").alias("c1"), F.bit_xor("v2").alias("c2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv_id", "part", *[F.bit_xor(c).over(earlier).alias(c) for c in ("c1", "c2")]).where("c1 IS NOT NULL")
    own = own.join(carry, ["conv_id", "part"], "left").select(
        "conv_id", "depth",
        F.col("k1").bitwiseXOR(F.coalesce("c1", F.lit(0).cast("long"))).alias("k1"),
        F.col("k2").bitwiseXOR(F.coalesce("c2", F.lit(0).cast("long"))).alias("k2"),
        "v1", "v2", "chars", "last",
    )

    first = spans.where("before = 0").select(
        "conv_id", "head", (size + F.greatest(F.col("total") - F.col("wanted"), F.lit(0))).alias("length"),
    )
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("depth"), *[zero.alias(c) for c in ("k1", "k2", "v1", "v2", "chars")])

    def step(path: Column, t: Column) -> Column:
        w1, w2 = _marks(t["place"], t["f1"], t["f2"])
        top = F.element_at(path, -1)
        return F.concat(path, F.array(F.struct(
            t["place"].alias("depth"), top["k1"].bitwiseXOR(w1).alias("k1"), top["k2"].bitwiseXOR(w2).alias("k2"),
            w1.alias("v1"), w2.alias("v2"), t["chars"].alias("chars"),
        )))

    shared = first.select("conv_id", "length", F.inline(F.aggregate("head", F.array(start), step)))
    shared = shared.select("conv_id", "depth", "k1", "k2", "v1", "v2", "chars", (F.col("depth") == F.col("length")).alias("last"))
    return own.unionByName(shared)


def _nodes(members: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, k1, k2, n_convs, chars)."""
    found = stored(members.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.max("v1").alias("v1"), F.max("v2").alias("v2"), F.max("chars").alias("chars"),
    ))
    above = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    links = found.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("v1")), "p2": F.col("k2").bitwiseXOR(F.col("v2"))})
    return links.join(above, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "k1", "k2", "n_convs", "chars"
    )


def _ends(members: DataFrame) -> DataFrame:
    """Rows (depth, k1, k2, ends_sha256) of nodes where conversations end."""

    def digest(batches):
        names = ["depth", "k1", "k2", "ends_sha256"]
        at = sha = None
        for batch in batches:
            keys, out = list(zip(*(batch.column(c).to_pylist() for c in names[:3]))), []
            for key, ids in zip(keys, batch.column("ids").to_pylist()):
                if key == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], kinds)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, sha.hexdigest())))], kinds)

    kinds = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    blocks = (
        members.where("last").groupBy("depth", "k1", "k2", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    )
    order = ["depth", "k1", "k2"]
    return blocks.repartition(*order).sortWithinPartitions(*order, "block").mapInArrow(
        digest, "depth long, k1 long, k2 long, ends_sha256 string"
    )


TREE = ("conv_id", "depth", "up_conv", "up_depth")
SUMS = ("leaves", "saved", "edge_leaves", "edge_saved")
#: What a node that is no leaf tells its parent: its name and the sums of nodes spliced out between the two.
KID = {"conv_id": "kid_conv", "depth": "kid_depth", "edge_leaves": "kid_leaves", "edge_saved": "kid_saved"}


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, leaves, saved): sums over the subtree of each node.

    ``nodes``: rows (conv_id, depth, up_conv, up_depth, kids, leaves, saved) of a tree; the root's parent
    is null, ``kids`` counts the children, ``leaves`` and ``saved`` are the node's own weights.
    """
    zero = F.lit(0).cast("long")
    alive = nodes.select(
        *TREE, "kids", "leaves", "saved", zero.alias("edge_leaves"), zero.alias("edge_saved")
    ).withColumns({c: F.col(c).cast("long") for c in (*TREE, "kids", "leaves", "saved")})
    gone, turn = [], 0
    while True:
        done = stored(_round(alive, turn))
        gone.append(done.where("fate <> 'alive'"))
        alive = done.where("fate = 'alive'").select(*TREE, "kids", *SUMS)
        turn += 1
        if alive.isEmpty():
            break
    removed = gone[0]
    for more in gone[1:]:
        removed = removed.unionByName(more)
    known = stored(removed.where("fate = 'raked'").select("conv_id", "depth", "leaves", "saved"))
    waiting = stored(removed.where("fate = 'spliced'").select(
        "conv_id", "depth", "to_conv", "to_depth", F.col("add_leaves").alias("leaves"), F.col("add_saved").alias("saved")
    ))
    return _expanded(known, waiting)


def _round(alive: DataFrame, turn: int) -> DataFrame:
    """One round of rake and compress. Nodes with their fate: raked (totals known), spliced (total is that
    of ``to`` and ``add``), or alive with their state for the next round."""
    nothing = F.lit(None).cast("long")
    is_leaf = F.col("kids") == 0
    # Rake: leaves send their total, others their name, to the parent.
    message = alive.where("up_conv IS NOT NULL").select(
        F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"), nothing.alias("up_conv"), nothing.alias("up_depth"),
        nothing.alias("kids"),
        F.when(is_leaf, F.col("leaves") + F.col("edge_leaves")).otherwise(0).alias("leaves"),
        F.when(is_leaf, F.col("saved") + F.col("edge_saved")).otherwise(0).alias("saved"),
        nothing.alias("edge_leaves"), nothing.alias("edge_saved"),
        *[F.when(~is_leaf, F.col(c)).alias(k) for c, k in KID.items()],
    )
    own = alive.select(*TREE, "kids", *SUMS, *[nothing.alias(k) for k in KID.values()])
    met = own.unionByName(message).groupBy("conv_id", "depth").agg(
        *[F.max(c).alias(c) for c in ("up_conv", "up_depth", "kids", "edge_leaves", "edge_saved", *KID.values())],
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("kid_conv").alias("left"),
    )
    # Compress: local minima of a hash among nodes with one child left.
    order = F.lit(turn)
    mine = F.xxhash64(order, "conv_id", "depth")
    below = F.xxhash64(order, "kid_conv", "kid_depth")
    above = F.xxhash64(order, "up_conv", "up_depth")
    unary = (F.col("kids") > 0) & (F.col("left") == 1) & F.col("up_conv").isNotNull()
    fate = F.when(F.col("kids") == 0, "raked").when(unary & (mine < below) & (mine < above), "spliced").otherwise("alive")
    judged = met.withColumn("fate", fate).withColumn("kids", F.when(F.col("kids") > 0, F.col("left")).otherwise(0))
    # A child is told its new parent and what the spliced node carried.
    told = judged.where("fate = 'spliced'").select(
        F.col("kid_conv").alias("conv_id"), F.col("kid_depth").alias("depth"),
        F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"),
        (F.col("leaves") + F.col("edge_leaves")).alias("more_leaves"), (F.col("saved") + F.col("edge_saved")).alias("more_saved"),
    )
    return judged.join(told, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("new_conv", "up_conv").alias("up_conv"), F.coalesce("new_depth", "up_depth").alias("up_depth"),
        "kids", "leaves", "saved",
        (F.col("edge_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("edge_leaves"),
        (F.col("edge_saved") + F.coalesce("more_saved", F.lit(0))).alias("edge_saved"),
        "fate", F.col("kid_conv").alias("to_conv"), F.col("kid_depth").alias("to_depth"),
        (F.col("leaves") + F.col("kid_leaves")).alias("add_leaves"), (F.col("saved") + F.col("kid_saved")).alias("add_saved"),
    )


def _expanded(known: DataFrame, waiting: DataFrame) -> DataFrame:
    """Totals of raked nodes and, by doubling of their references, of spliced ones."""
    while not waiting.isEmpty():
        ends = known.toDF("to_conv", "to_depth", "end_leaves", "end_saved")
        onward = waiting.toDF("to_conv", "to_depth", "on_conv", "on_depth", "on_leaves", "on_saved")
        reach = waiting.join(ends, ["to_conv", "to_depth"], "left").join(onward, ["to_conv", "to_depth"], "left")
        step = stored(reach.select(
            "conv_id", "depth", F.col("on_conv").alias("to_conv"), F.col("on_depth").alias("to_depth"),
            (F.col("leaves") + F.coalesce("end_leaves", "on_leaves")).alias("leaves"),
            (F.col("saved") + F.coalesce("end_saved", "on_saved")).alias("saved"),
        ))
        known = known.unionByName(step.where("to_conv IS NULL").drop("to_conv", "to_depth"))
        waiting = step.where("to_conv IS NOT NULL")
    return known


def prefix_trie(conversations: DataFrame, stitch: bool = False) -> DataFrame:
    """Nodes of the prefix trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``stitch``: a conversation's first turns come from the first one of its hundred (:func:`head_length`).
    ``saved_tokens``: over the subtree, code points of a node's last text for each member but one.
    """
    wanted = (head_length if stitch else own_head)(F.col("conv_id"))
    members = stored(_rebuilt(stored(_ranked(conversations)), wanted))
    nodes = stored(_nodes(members))
    kids = nodes.where("parent_conv_id IS NOT NULL").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count("*").alias("kids"))
    tree = stored(nodes.join(kids, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("parent_conv_id").alias("up_conv"), "k1", "k2", "n_convs",
        F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"),
        F.coalesce("kids", F.lit(0).cast("long")).alias("kids"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    ).withColumn("leaves", (F.col("kids") == 0).cast("long")))
    totals = subtree_totals(tree).select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    found = tree.drop("leaves", "saved").join(totals, ["conv_id", "depth"]).join(_ends(members), ["depth", "k1", "k2"], "left")
    return found.select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
