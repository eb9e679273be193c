"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. A prefix is named by its depth and the exclusive or of
SHA-256 digests of (position, role, text) over its turns: sums over positions, so that windows over blocks
of a conversation and one carry per block name the prefixes of a conversation of any length, and a
parent's name is the child's without its last turn.

Subtree totals come in rounds of two steps. Rake: every leaf adds its totals to its parent and goes.
Compress: in chains of nodes with one child, nodes that no neighbour outranks are spliced out, their
totals move to the parent and their child hangs below it. A chain loses half of its nodes in a round,
so the rounds are logarithmic also for a single conversation. Each round writes a smaller table. Then the
rounds are walked back: a spliced node's total is what it carried and the total of the child it had.

Defined results: a null role or text is empty; turns ascend, null first, and equal turn numbers by role
and text digest; turns without a conv_id belong to no conversation and are left out; repeated turns
count as turns; a long text is hashed whole by one task and never shuffled; an empty table has no
members and so no root, hence no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.ranks import numbered
from opsmetrics.session import ship_package, stage

LANES = ("p0", "p1", "p2", "p3")
BLOCK = 1024  # turns of a conversation in one window
IDS = 4096  # conversation ids in one string


def _zero() -> Column:
    return F.lit(0).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, chars): the turns of each conversation, numbered from 1. Narrow and written."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = stage(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.sha2(text, 256).alias("text_digest"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).cast("long").alias("chars")), "turns")
    return numbered(rows, ["conv_id"], ["turn", "role", "text_digest"]).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "digest", "chars")


def grafted(rows: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first `heads` turns of conversation `base` before its own turns after
    its first `heads`. Both are expressions of conv_id; `most` bounds `heads`. Returns all conversation
    ids, also those left without turns, and the turns."""
    counted = rows.groupBy("conv_id").agg(F.max("depth").alias("own"))
    ids = stage(counted.withColumns({"base": base.cast("long"), "heads": heads.cast("long")}), "conversations")
    of_base = ids.join(
        counted.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns")), "base", "left"
    ).withColumn("taken", F.least("heads", F.coalesce("base_turns", F.lit(0)))).drop("base_turns")
    of_base = stage(of_base, "bases")
    first = rows.where(F.col("depth") <= most)
    head = of_base.where("taken > 0").select(
        "base", F.col("conv_id").alias("member"), F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("depth"))
    heads_rows = head.join(first.withColumnRenamed("conv_id", "base"), ["base", "depth"]).select(
        F.col("member").alias("conv_id"), "depth", "digest", "chars")
    tail = rows.join(of_base.select("conv_id", "heads", "taken"), "conv_id").where("depth > heads").select(
        "conv_id", (F.col("depth") - F.col("heads") + F.col("taken")).alias("depth"), "digest", "chars")
    return ids.select("conv_id"), stage(heads_rows.unionAll(tail), "grafted")


def _lanes(depth: Column, digest: Column) -> dict[str, Column]:
    """256 bits of (position, turn) as four longs."""
    whole = F.sha2(F.concat(depth.cast("string"), F.lit(":"), digest), 256)
    return {f"t{k}": F.conv(F.substring(whole, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(4)}


def prefixes(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, depth, digest, chars) with the name of the prefix that ends there, p0 to p3, its
    parent's name q0 to q3, and `ends`, whether the conversation ends there."""
    cut = rows.withColumn("block", F.expr(f"(depth - 1) div {BLOCK}L")).withColumns(_lanes(F.col("depth"), F.col("digest")))
    blocks = cut.groupBy("conv_id", "block").agg(
        F.max("depth").alias("last"), *[F.expr(f"bit_xor(t{k})").alias(f"x{k}") for k in range(4)])
    mine = Window.partitionBy("conv_id")
    before = mine.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carries = blocks.select(
        "conv_id", "block", F.max("last").over(mine).alias("len"),
        *[F.coalesce(F.expr(f"bit_xor(x{k})").over(before), F.lit(0).cast("long")).alias(f"c{k}") for k in range(4)])
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = cut.withColumns({f"p{k}": F.expr(f"bit_xor(t{k})").over(upto) for k in range(4)}).join(carries, ["conv_id", "block"])
    named = named.withColumns({f"p{k}": F.col(f"p{k}").bitwiseXOR(F.col(f"c{k}")) for k in range(4)})
    return named.select(
        "conv_id", "depth", "chars", *LANES, *[F.col(f"p{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"q{k}") for k in range(4)],
        (F.col("depth") == F.col("len")).alias("ends"))


def trie(ids: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, parent, depth, conv_id, n_convs, chars), written, and the ends (node, conv_id)."""
    named = stage(prefixes(rows), "prefixes")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in LANES],
        *[F.lit(None).cast("long").alias(f"q{k}") for k in range(4)], "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    # all of these are the same for every member, or least of all: longs only, so one hash aggregate
    found = named.groupBy("depth", *LANES).agg(
        *[F.min(f"q{k}").alias(f"q{k}") for k in range(4)], F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    nodes = stage(root.unionByName(found).withColumn("node", F.monotonically_increasing_id()), "nodes")
    key = ["depth", *LANES]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(4)],
                           F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = stage(nodes.join(parents, ["depth", "q0", "q1", "q2", "q3"], "left").select(
        "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "chars", *LANES), "trie")
    last = named.where("ends").select("conv_id", *key)
    # conversations without turns end at the root
    empty = ids.join(last.select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in key])
    ends = last.unionByName(empty).join(linked.select(*key, "node"), key).select("node", "conv_id")
    return linked.drop(*LANES), ends


def _rake(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves go. Returns (the leaves, whose totals are final; the rest with theirs added)."""
    gone = (F.col("kids") == 0) & F.col("parent").isNotNull()
    leaves = active.where(gone)
    given = leaves.groupBy(F.col("parent").alias("_p")).agg(
        F.count(F.lit(1)).alias("_less"), F.bit_xor("node").alias("_ids"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    rest = active.where(~gone).join(given, F.col("node") == F.col("_p"), "left").select(
        "node", "parent", "depth", (F.col("kids") - F.coalesce("_less", _zero())).alias("kids"),
        F.col("child").bitwiseXOR(F.coalesce("_ids", _zero())).alias("child"), (F.col("leaves") + F.coalesce("_leaves", _zero())).alias("leaves"),
        (F.col("saved") + F.coalesce("_saved", _zero())).alias("saved"))
    return leaves, rest


def _splices(rest: DataFrame) -> DataFrame:
    """The nodes to splice out of chains: (node, parent, child, leaves, saved). Of two neighbours in a
    chain at most one."""
    unary = rest.where((F.col("kids") == 1) & F.col("parent").isNotNull())

    def rank(depth: str, node: str) -> Column:
        # by depth, odd before even and so on, so that a whole chain loses every second node
        return F.struct(F.col(depth).bitwiseAND(-F.col(depth)).alias("bit"), F.col(node).alias("node"))

    pairs = unary.select("node", "depth", "child").join(
        unary.select(F.col("node").alias("child"), F.col("depth").alias("child_depth")), "child")
    losers = pairs.select(F.when(rank("depth", "node") < rank("child_depth", "child"), F.col("child")).otherwise(
        F.col("node")).alias("node")).distinct()
    return unary.join(losers, "node", "left_anti").select("node", "parent", "child", "leaves", "saved")


def _spliced(rest: DataFrame, out: DataFrame) -> DataFrame:
    """`rest` without the nodes of `out`: their totals are the parent's, their child hangs below it."""
    nothing = F.lit(None).cast("long")
    changes = (
        out.select("node", F.lit(1).cast("long").alias("_out"), nothing.alias("_to"), _zero().alias("_ids"), _zero().alias("_leaves"), _zero().alias("_saved"))
        .unionAll(out.select(F.col("child"), _zero(), F.col("parent"), _zero(), _zero(), _zero()))
        .unionAll(out.select(F.col("parent"), _zero(), nothing, F.col("child").bitwiseXOR(F.col("node")), F.col("leaves"), F.col("saved")))
        .groupBy(F.col("node").alias("_n")).agg(
            F.bit_xor("_ids").alias("_ids"), F.max("_to").alias("_to"), *[F.sum(c).alias(c) for c in ("_out", "_leaves", "_saved")]))
    return rest.join(changes, F.col("node") == F.col("_n"), "left").where("coalesce(_out, 0) = 0").select(
        "node", F.coalesce("_to", "parent").alias("parent"), "depth", "kids", F.col("child").bitwiseXOR(F.coalesce("_ids", _zero())).alias("child"),
        (F.col("leaves") + F.coalesce("_leaves", _zero())).alias("leaves"), (F.col("saved") + F.coalesce("_saved", _zero())).alias("saved"))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(node, leaves, saved) summed over each subtree. `nodes` has node, parent (null: root), depth
    (a child's is its parent's and one), leaves and saved, own values; it may hold several trees.

    A node carries the number of its children and the exclusive or of their ids, kept up as they go: of
    an only child that is its id.
    """
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_p")).agg(
        F.count(F.lit(1)).alias("kids"), F.bit_xor("node").alias("child"))
    active = stage(nodes.join(kids, F.col("node") == F.col("_p"), "left").select(
        "node", "parent", "depth", F.coalesce("kids", _zero()).alias("kids"), F.coalesce("child", _zero()).alias("child"), "leaves", "saved"), "active")
    left = active.count()
    if not left:
        return nodes.select("node", "leaves", "saved")
    done, splices = [], []  # per round; the tables shrink from round to round
    while True:
        raked, rest = _rake(active)
        rest = stage(rest, "raked")
        out = stage(_splices(rest), "spliced")
        now = stage(_spliced(rest, out), "active")
        done.append(raked.select("node", "leaves", "saved"))
        splices.append(out)
        before, left = left, now.count()
        if left == before:  # only roots are left
            known = now.select("node", "leaves", "saved")
            break
        active = now
    while splices:
        # what was active after a round is known now, so the nodes it spliced out are found
        found = stage(splices.pop().join(known.select(
            F.col("node").alias("child"), F.col("leaves").alias("_l"), F.col("saved").alias("_s")), "child").select(
            "node", (F.col("leaves") + F.col("_l")).alias("leaves"), (F.col("saved") + F.col("_s")).alias("saved")), "found")
        known = known.unionByName(found).unionByName(done.pop())
    return known


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of each node's ids in ascending order, comma-joined.

    Ids are sorted by ranges and joined into strings of up to `IDS`; a task then reads a node's strings
    in order into a running digest, so a node where very many conversations end needs no more memory.
    """
    ship_package(ends.sparkSession)
    parts = numbered(stage(ends, "ends"), ["node"], ["conv_id"]).groupBy("node", F.expr(f"pos div {IDS}L").alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, ([], [])
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    out[0].append(now)
                    out[1].append(digest.hexdigest())
                now, digest = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["node", "ends_sha256"])
            out = ([], [])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(
        run, "node long, ends_sha256 string")


def report(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, ends = trie(ids, rows)
    kids = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    own = stage(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "own")
    totals = subtree_totals(own.select(
        "node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    digests = end_digests(ends)
    return own.join(totals, "node").join(digests, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
