"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction (Miller and Reif, 1985).

A node is a distinct sequence of first turns. It is known by the hash of its sequence, the exclusive or of the hashes of its
turns with their places, which is a prefix sum and so needs no task that walks a whole conversation. Subtree totals come from
rounds over the table of nodes: unary chains are compressed by pointer jumping, then all leaves are raked into their parents;
each round leaves less than half of the nodes, however deep the trie is. Compressed nodes get their totals back in reverse.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import mapped, stored
from .turns import numbered

#: Turns of a conversation whose prefix hashes one task works out.
CHUNK_TURNS = 1024
_NODE = ["depth", "p1", "p2"]


def n_words(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")).cast("long")


def rebuilt(conversations: DataFrame, block: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which each conversation begins with turns of another: (conv_id), (conv_id, depth, role, text).

    Conversation c takes its first h turns, h = crc32(decimal c) % 4, from conversation c - c % block: all of its turns if it
    has fewer, none if it is absent; c's own turns after its first h follow.
    """
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    placed = stored(numbered(own, "conv_id", ["turn", "role", "text"]).drop("turn"), "turns")
    sizes = stored(placed.groupBy("conv_id").agg(F.count("*").alias("n")), "conversation-sizes")
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    donors = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    plan = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("donor")).join(donors, "donor", "left")
    plan = stored(plan.select("conv_id", "donor", "h", F.least("h", F.coalesce("donor_n", F.lit(0))).alias("led")), "conversation-plans")
    heads = placed.where((F.col("pos") <= 3) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "donor")
    first = plan.join(heads, "donor").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "role", "text")
    rest = placed.where(F.col("pos") > h).join(plan.select("conv_id", "h", "led"), "conv_id")
    return sizes.select("conv_id"), first.unionByName(rest.select("conv_id", (F.col("led") + F.col("pos") - F.col("h")).alias("depth"), "role", "text"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, depth, role, text) -> (conv_id, depth, p1, p2, q1, q2, words): hashes of the sequence up to the turn, and
    up to the turn before it, 128 bits each."""
    own = {"x1": F.xxhash64("depth", "role", "text"), "x2": F.xxhash64("text", "role", "depth")}
    hashed = stored(turns.select("conv_id", "depth", *(x.alias(c) for c, x in own.items()), n_words("text").alias("words"), F.floor((F.col("depth") - 1) / CHUNK_TURNS).alias("chunk")), "turn-hashes")
    totals = hashed.groupBy("conv_id", "chunk").agg(*(F.expr(f"bit_xor({c})").alias(c) for c in own))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "chunk", *(F.expr(f"bit_xor({c})").over(earlier).alias(f"b{c}") for c in own)).where("chunk > 0")
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    run = hashed.withColumns({f"r{c}": F.expr(f"bit_xor({c})").over(within) for c in own}).join(before, ["conv_id", "chunk"], "left")
    ends = {f"p{k}": F.col(f"rx{k}").bitwiseXOR(F.coalesce(f"bx{k}", F.lit(0))) for k in (1, 2)}
    return run.withColumns(ends).select("conv_id", "depth", "p1", "p2", *(F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (1, 2)), "words")


def _joined_ids(batches):
    """Rows (depth, p1, p2, conv_id) in this order -> a row for each run of a node in a batch, its ids joined by commas."""
    for batch in batches:
        depth, p1, p2, ids = (x.to_numpy() for x in batch.columns)
        if not len(ids):
            continue
        new = np.flatnonzero((np.diff(depth) != 0) | (np.diff(p1) != 0) | (np.diff(p2) != 0)) + 1
        starts = np.concatenate(([0], new))
        texts = [",".join(map(str, x.tolist())).encode() for x in np.split(ids, new)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[starts]) for x in (depth, p1, p2, ids)), pa.array(texts, pa.binary())], ["depth", "p1", "p2", "first", "ids"])


def _hashed_ids(batches):
    """Rows (depth, p1, p2, ids) in the order of their ids -> the SHA-256 of each node's ids; nothing else is held."""
    node, running = None, None

    def row():
        return pa.RecordBatch.from_pylist([{"depth": node[0], "p1": node[1], "p2": node[2], "sha": running.hexdigest()}])

    for batch in batches:
        for x in batch.to_pylist():
            if (x["depth"], x["p1"], x["p2"]) != node:
                if node:
                    yield row()
                node, running = (x["depth"], x["p1"], x["p2"]), hashlib.sha256(x["ids"])
            else:
                running.update(b"," + x["ids"])
    if node:
        yield row()


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, conv_id) -> (depth, p1, p2, sha). The ids of a node with very many ends are put together by several tasks;
    the digest itself reads them in one, as it must, in pieces."""
    order = [*_NODE, "conv_id"]
    parts = mapped(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), _joined_ids, "depth long, p1 long, p2 long, first long, ids binary")
    parts = stored(parts, "trie-ends").repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return mapped(parts.drop("first"), _hashed_ids, "depth long, p1 long, p2 long, sha string")


def subtree_totals(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (c, d, pc, pd, the columns of sums): key, key of the parent (null of a root), values -> (c, d, sums) over subtrees.

    Round by round until only roots are left: nodes with one child are passed over by pointer jumping (a join for each doubling
    of the chains' length) and remember the node below their chain and what lies between; then leaves add what they hold to
    their parents and go. Values between a node and its parent, of nodes passed over, wait in columns e_*.
    """
    key, parent = ["c", "d"], ["pc", "pd"]
    waiting = [f"e_{s}" for s in sums]
    kids = nodes.where("pc IS NOT NULL").groupBy("pc", "pd").agg(F.count("*").alias("k")).select(F.col("pc").alias("c"), F.col("pd").alias("d"), "k")
    live = nodes.select(*key, *parent, *sums, *(F.lit(0).cast("long").alias(e) for e in waiting)).join(kids, key, "left")
    live = stored(live.withColumn("k", F.coalesce("k", F.lit(0))), "trie-live")
    done, passed = [], []
    while not live.where("pc IS NOT NULL").isEmpty():
        unary = live.where("k = 1 AND pc IS NOT NULL")
        if not unary.isEmpty():
            below = live.where("pc IS NOT NULL").select(F.col("c").alias("bc"), F.col("d").alias("bd"), F.col("pc").alias("c"), F.col("pd").alias("d"), F.expr("k = 1").alias("open"), *(F.col(e).alias(f"b{e}") for e in waiting))
            links = unary.join(below, key).select(*key, "bc", "bd", "open", *((F.col(s) + F.col(f"be_{s}")).alias(s) for s in sums))
            links = stored(links, "trie-links")
            while not links.where("open").isEmpty():
                ahead = links.select(F.col("c").alias("bc"), F.col("d").alias("bd"), F.col("bc").alias("nc"), F.col("bd").alias("nd"), F.col("open").alias("nopen"), *(F.col(s).alias(f"n_{s}") for s in sums))
                jumped = links.where("open").join(ahead, ["bc", "bd"])
                jumped = jumped.select(*key, F.col("nc").alias("bc"), F.col("nd").alias("bd"), F.col("nopen").alias("open"), *((F.col(s) + F.col(f"n_{s}")).alias(s) for s in sums))
                links = stored(links.where("NOT open").unionByName(jumped), "trie-links")
            passed.append(links)
            tops = unary.join(unary.select(F.col("c").alias("pc"), F.col("d").alias("pd")), parent, "left_anti")
            tops = tops.select(*key, *(F.col(c).alias(f"t{c}") for c in parent), *waiting).join(links.select(*key, "bc", "bd", *sums), key)
            tops = tops.select(F.col("bc").alias("c"), F.col("bd").alias("d"), "tpc", "tpd", *((F.col(s) + F.col(e)).alias(f"t{e}") for s, e in zip(sums, waiting, strict=True)))
            left = live.where("k <> 1 OR pc IS NULL").join(tops, key, "left")
            moved = {p: F.coalesce(f"t{p}", p) for p in parent} | {e: F.coalesce(f"t{e}", e) for e in waiting}
            live = stored(left.select(*key, *(x.alias(c) for c, x in moved.items()), *sums, "k"), "trie-live")
        leaves = live.where("k = 0 AND pc IS NOT NULL")
        done.append(stored(leaves.select(*key, *sums), "trie-raked"))
        raked = leaves.groupBy("pc", "pd").agg(F.count("*").alias("gone"), *(F.sum(F.col(s) + F.col(e)).alias(f"r_{s}") for s, e in zip(sums, waiting, strict=True)))
        raked = raked.select(F.col("pc").alias("c"), F.col("pd").alias("d"), "gone", *(f"r_{s}" for s in sums))
        rest = live.where("k > 0 OR pc IS NULL").join(raked, key, "left")
        fresh = [(F.col(s) + F.coalesce(f"r_{s}", F.lit(0))).alias(s) for s in sums]
        live = stored(rest.select(*key, *parent, *fresh, *waiting, (F.col("k") - F.coalesce("gone", F.lit(0))).alias("k")), "trie-live")
    known = live.select(*key, *sums)
    for part in done:
        known = known.unionByName(part)
    for links in reversed(passed):
        ends = known.select(F.col("c").alias("bc"), F.col("d").alias("bd"), *(F.col(s).alias(f"t_{s}") for s in sums))
        back = links.join(ends, ["bc", "bd"]).select(*key, *((F.col(s) + F.col(f"t_{s}")).alias(s) for s in sums))
        known = known.unionByName(stored(back, "trie-expanded"))
    return known


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id) and their turns (conv_id, depth from 1 without gaps, role, text): a row for each node.

    conv_id (the least member) and depth are a node's key; parent_conv_id is its parent's, at depth - 1, null of the root.
    Members are the conversations that begin with the node's sequence, those without turns members of the root. n_convs,
    n_children, n_leaves (childless nodes of the subtree, itself included), saved_tokens (over the subtree, words of a node's
    last turn times its members but one) and ends_sha256 (of the ids of those that end here, in order, joined by commas) are as
    named. Nulls in role and text are empty texts; rows of a null conv_id belong to no conversation. Equal conversations share
    all their nodes; a text of any length is one turn; no conversations, no nodes. Other columns are ignored.
    """
    clean = turns.where("conv_id IS NOT NULL").select("conv_id", "depth", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    ids = conversations.where("conv_id IS NOT NULL").select("conv_id").distinct()
    rows = stored(_prefixes(clean), "trie-prefixes")
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("at"))
    zero = F.lit(0).cast("long")
    ends = stored(ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col("at")[c], zero).alias(c) for c in _NODE)), "trie-last")
    root = ends.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(*(zero.alias(c) for c in _NODE), "n_convs", "conv_id", zero.alias("words"), *(F.lit(None).cast("long").alias(c) for c in ("q1", "q2")))
    found = rows.groupBy(*_NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    nodes = stored(found.unionByName(root), "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(above, ["depth", "q1", "q2"], "left").join(_end_hashes(ends), _NODE, "left").drop("p1", "p2", "q1", "q2"), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes")
    own = nodes.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"), F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"]).withColumnsRenamed({"c": "conv_id", "d": "depth"})
    out = nodes.join(totals, ["conv_id", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
