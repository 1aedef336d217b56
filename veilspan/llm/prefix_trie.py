"""Prefix trie of conversations: equal ones collapsed to weighted sequences, prefixes aggregated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import Stored, column, ship
from veilspan.operators.skew import hot_keys, spread_join

PART = 4096  # turns of one conversation that one task orders together
HEAD = 9  # heads have fewer turns than this
FAMILY = 5  # conversations with a common head
NODE = ("x1", "x2", "depth")  # a node's key: two hashes of all turns up to its depth


class Trie(NamedTuple):
    nodes: DataFrame  # key, conv, parent_conv, n_convs, n_children, n_leaves, saved
    ends: DataFrame  # key, conv: every conversation at the node where it ends


def running(df: DataFrame, key: str, at: str, sums: dict[str, str], xors: dict[str, str]) -> DataFrame:
    """Running sums and exclusive-ors over the rows of each key, in the order of ``at`` (0, 1 ... with gaps).

    ``sums`` and ``xors`` name new columns and what they run over. A long key is cut in parts by position,
    which are run through on their own and begin with what the parts before them come to.
    """
    cut = df.withColumn("_part", F.floor(F.col(at) / PART))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    made = [(out, src, F.sum) for out, src in sums.items()] + [(out, src, F.bit_xor) for out, src in xors.items()]
    totals = cut.groupBy(key, "_part").agg(*[f(src).alias(out) for out, src, f in made])
    bases = totals.select(key, "_part", *[
        F.coalesce(f(out).over(before), F.lit(0)).alias(f"_b_{out}") for out, _, f in made])
    rows = cut.withColumns({out: f(src).over(within) for out, src, f in made}).join(bases, [key, "_part"])
    return rows.withColumns({out: F.col(out) + F.col(f"_b_{out}") for out in sums} | {
        out: F.col(out).bitwiseXOR(F.col(f"_b_{out}")) for out in xors}).drop(
        "_part", *[f"_b_{out}" for out, _, _ in made])


def numbered_turns(df: DataFrame, store: Stored, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The place of every turn in its conversation, and hashes instead of the text.

    Order: turn (null first), role, hash of the text. Turns are dealt by ranges of that order, so a
    conversation of any length is numbered by many tasks. Returns conv, pos (from 0), t1, t2, size (UTF-8
    bytes of the text).
    """
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    hashed = store.put(df.select(
        column(conv_col).cast("long").alias("conv"), column(turn_col).alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("size")).filter("conv is not null"))
    order = ["turn", "role", "t1", "t2", "_tie"]
    # Numbers tell equal turns apart, so that ranges can part them.
    dealt = store.put(hashed.withColumn("_tie", F.monotonically_increasing_id())
                      .repartitionByRange("conv", *order).withColumn("_range", F.spark_partition_id()))
    store.drop(hashed)
    before = Window.partitionBy("conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("conv", "_range").count().select(
        "conv", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("conv", "_range").orderBy(*order)
    return store.put(dealt.withColumn("_in", F.row_number().over(within)).join(bases, ["conv", "_range"])
                     .select("conv", (F.col("_base") + F.col("_in") - 1).cast("long").alias("pos"),
                             "t1", "t2", "size"))


def head_length(conv: Column) -> Column:
    """Turns that a conversation takes from its family's first one."""
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def rebuilt(turns: DataFrame, store: Stored) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their family's first one in place of their own.

    Conversation c gets the first h turns of c - c % 5 (all if fewer, none if absent), then its own turns
    after its first h, with h of ``head_length``. Returns the turns, and one row ``conv`` for every
    conversation, also for those left without turns.
    """
    lengths = store.put(turns.groupBy("conv").agg(F.count("*").alias("n")))
    first = lengths.select(F.col("conv").alias("first"), F.col("n").alias("n_first"))
    plans = store.put(lengths.select("conv", head_length(F.col("conv")).alias("h"),
                                     (F.col("conv") - F.col("conv") % FAMILY).alias("first"))
                      .join(first, "first", "left").select(
        "conv", "first", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("n_head")))
    # At most 8 turns of a first conversation, and 5 conversations that take them.
    heads = turns.filter((F.col("pos") < HEAD - 1) & (F.col("conv") % FAMILY == 0)).withColumnRenamed(
        "conv", "first").join(plans, "first").filter("pos < h").select("conv", "pos", "t1", "t2", "size")
    own = spread_join(turns, plans.select("conv", "h", "n_head"), ["conv"],
                      hot_keys(lengths, ["conv"], "n"), "pos", "inner").filter("pos >= h").select(
        "conv", (F.col("n_head") + F.col("pos") - F.col("h")).alias("pos"), "t1", "t2", "size")
    return own.unionByName(heads), lengths.select("conv")


def trie(turns: DataFrame, convs: DataFrame, store: Stored) -> Trie:
    """Nodes of the prefix trie of conversations.

    ``turns``: conv, pos (0, 1 ...), t1, t2 (hashes of the turn), size; ``convs``: every conv once. A node's key
    is the exclusive-or of hashes of (place, turn) over its path, 128 bits, so any part of a long
    conversation gives its share. Identical conversations collapse to one weighted sequence, represented by its
    smallest conv; only these are expanded to prefixes. Leaves are the sequences that are no proper
    prefix of another, by anti-join. What a node saves, (n_convs - 1) times the size of its last turn, is
    summed over its subtree without visiting it: a node belongs to the sequence of its smallest conv, which
    owns the end of its own path from some depth on; so a node's sum is that of all sequences through it,
    less what the owner's path holds above it.
    """
    places = store.put(turns.select(
        "conv", (F.col("pos") + 1).alias("depth"), "size",
        *[F.xxhash64(F.lit(lane), "pos", "t1", "t2").alias(f"l{lane}") for lane in (1, 2)]))
    whole = places.groupBy("conv").agg(F.bit_xor("l1").alias("x1"), F.bit_xor("l2").alias("x2"),
                                       F.count("*").alias("depth"))
    ends = store.put(convs.join(whole, "conv", "left").select(
        "conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NODE]))
    sequences = store.put(ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv").alias("conv")))
    hot = hot_keys(sequences, ["conv"], "depth")
    kept = spread_join(places, sequences.select("conv", "weight"), ["conv"], hot, "depth", "inner")
    up = {f"p{lane}": F.col(f"x{lane}").bitwiseXOR(F.col(f"l{lane}")) for lane in (1, 2)}
    prefixes = store.put(running(kept, "conv", "depth", {}, {"x1": "l1", "x2": "l2"}).withColumns(up).select(
        "conv", *NODE, "p1", "p2", "weight", "size"))
    store.drop(places)
    root = sequences.agg(F.sum("weight").alias("n_convs"), F.min("conv").alias("conv")).filter(
        "conv is not null").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "n_convs", "conv",
                                   F.lit(0).cast("long").alias("size"),
                                   *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    nodes = store.put(prefixes.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv").alias("conv"), F.any_value("size").alias("size"),
        F.any_value("p1").alias("p1"), F.any_value("p2").alias("p2")).unionByName(root)
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("size")))
    children = nodes.filter("depth > 0").groupBy(
        F.col("p1").alias("x1"), F.col("p2").alias("x2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    leaves = sequences.join(children, list(NODE), "left_anti").select("conv", F.lit(1).alias("leaf"))
    owned = nodes.groupBy("conv").agg(F.sum("saved").alias("total"))
    facts = store.put(sequences.select("conv").join(leaves, "conv", "left").join(owned, "conv", "left").select(
        "conv", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("total", F.lit(0)).alias("total")))
    sums = [F.sum("leaf").cast("long").alias("n_leaves"), F.sum("total").alias("through")]
    below = spread_join(prefixes, facts, ["conv"], hot, "depth", "inner").groupBy(*NODE).agg(*sums)
    top = facts.agg(*sums).filter("through is not null").select(
        *[F.lit(0).cast("long").alias(c) for c in NODE], "n_leaves", "through")
    counted = running(nodes, "conv", "depth", {"upto": "saved"}, {}).join(
        below.unionByName(top), list(NODE)).join(children, list(NODE), "left").select(
        *NODE, "conv", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("through") - F.col("upto") + F.col("saved")).alias("saved"), "p1", "p2",
        (F.col("depth") - 1).alias("up"))
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("depth").alias("up"),
                           F.col("conv").alias("parent_conv"))
    # A node may have a large share of all nodes as its children.
    key = ["p1", "p2", "up"]
    many = hot_keys(children.toDF(*key, "n"), key, "n")
    return Trie(spread_join(counted, parents, key, many, "conv").drop(*key), ends)


def ends_digest(ends: DataFrame, out_col: str = "ends_sha256") -> DataFrame:
    """SHA-256 of the conversations that end at a node: decimal, ascending, joined by commas.

    A node where very many end is written out in pieces by many tasks; only the pieces, in order, go through
    the one hash, which holds none of them.
    """
    sorted_ = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[list(NODE)].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            convs, names = batch["conv"].to_numpy(), batch["conv"].astype(str).to_numpy()
            out = pd.DataFrame(keys[starts], columns=list(NODE))
            out["first"] = convs[starts]
            out["piece"] = [",".join(names[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(names)])]
            yield out

    cut = sorted_.mapInPandas(pieces, "x1 long, x2 long, depth long, first long, piece string")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for *key, _, piece in batch.itertuples(index=False, name=None):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(piece.encode())
            yield pd.DataFrame(done, columns=[*NODE, out_col])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*NODE, out_col])

    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(
        digest, f"x1 long, x2 long, depth long, {out_col} string")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", families: bool = False) -> Trie:
    """The trie of the conversations of a table, one row a turn; see ``trie``.

    Turns are ordered by turn (null first); turns with equal numbers, by role and a hash of the text. Null roles
    and texts count as empty; rows without a conversation are left out. Turns that repeat are turns of their
    own. With ``families`` conversations are first ``rebuilt``. Extra columns are not passed on; names of
    columns are free. Texts of any length are hashed where they are read and never shuffled. Nodes are told
    apart by 128 bits of hashes. An empty table has no nodes, not even a root.
    """
    ship(df.sparkSession)
    store = Stored(df.sparkSession, "trie")
    turns = numbered_turns(df, store, conv_col, turn_col, role_col, text_col)
    if families:
        return trie(*rebuilt(turns, store), store)
    return trie(turns, turns.select("conv").distinct(), store)
