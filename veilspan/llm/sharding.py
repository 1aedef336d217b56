"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Stored, ranked

CELL_BITS = 16  # the ring has 65,536 cells, however many rows there are
VIRTUAL_NODES = 128


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> np.ndarray:
    """Virtual nodes as (cell, shard), in clockwise order.

    A node's cell depends on its shard and number alone, so another shard adds
    its own nodes and moves none of the others.
    """
    nodes = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big") >> (64 - CELL_BITS), shard))
    return np.array(sorted(nodes), dtype=np.int64)


def capacities(total: int, shards: int) -> np.ndarray:
    """Rows each shard may hold: at most one apart, and all rows fit exactly."""
    return np.array([total // shards + (s < total % shards) for s in range(shards)],
                    dtype=np.int64)


def plan(counts: np.ndarray, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple]:
    """Runs (cell, from_rank, to_rank, shard, first_slot) for the rows of every cell.

    Cells are walked clockwise. A cell's rows go to the next virtual node; what its
    shard has no room for continues clockwise to the next shard that has.
    """
    nodes = ring(shards, virtual_nodes)
    room = capacities(int(counts.sum()), shards)
    filled = np.zeros(shards, dtype=np.int64)
    runs = []
    first = np.searchsorted(nodes[:, 0], np.arange(len(counts)), side="left")
    for cell in np.flatnonzero(counts):
        at, rank, left = int(first[cell]), 0, int(counts[cell])
        while left:
            shard = int(nodes[at % len(nodes), 1])
            take = min(left, int(room[shard] - filled[shard]))
            if take:
                runs.append((int(cell), rank, rank + take, shard, int(filled[shard])))
                filled[shard] += take
                rank, left = rank + take, left - take
            at += 1
    return runs


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
          virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Deal rows to shards so that no two shards' row counts differ by more than one.

    The key is the text: copies stand at one place of the ring, so a group of them
    shares a shard unless it is cut where the shard is full. A null text counts
    as the key null, a null id is hashed like any other, repeated rows are dealt
    one by one, and an empty table gives no rows. Columns of the input are not
    passed on. Only row counts of the fixed number of cells reach the driver; rows
    of a hot cell are numbered in parts.

    Returns id, size (UTF-8 bytes plus 1), text_crc32, shard, slot.
    """
    spark = df.sparkSession
    store = Stored(spark, "sharding")
    text = F.col(text_col)
    rows = store.put(df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    ).withColumn("_cell", F.shiftrightunsigned("_key", 64 - CELL_BITS).cast("int")))
    counts = rows.groupBy("_cell").agg(F.count("*").alias("n"))
    per_cell = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for cell, n in counts.collect():  # at most one row for each of the fixed cells
        per_cell[cell] = n
    runs = spark.createDataFrame(
        plan(per_cell, shards, virtual_nodes),
        "_cell int, _from long, _to long, shard int, _slot long")
    numbered = ranked(rows, counts, "_cell", ["_key", "doc_id", "size", "text_crc32"],
                      ["doc_id", "_key"])
    # The runs are at most the cells plus one for every time a shard fills up.
    return (numbered.join(F.broadcast(runs), "_cell")
            .filter((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
            .select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("_slot") + F.col("rank") - F.col("_from")).alias("slot")))
