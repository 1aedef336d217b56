"""Exact top-k search by inner product: lists of partial scores, a safe cutoff, and what it leaves open."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.common import Stored, column, ship, shuffles_dropped
from veilspan.operators.skew import hot_keys, spread_join

SLICES = 2  # parts of the dimensions; each keeps lists of its own partial scores
QUERY_BLOCK = 256
BLOCK = 8192  # candidates of a block, whose lists are as long as those of a smaller one
BLOCK_BYTES = 16 << 20  # or fewer, of this size
BLOCKS_TOGETHER = 8  # candidate blocks that meet the queries in one group
GROUPS = 64  # groups at least, where there are as many blocks
# Bytes that lists and partial scores take on their way at a time, or those of all blocks where these are more.
ROUND = 512 << 20
SENT_BYTES = 24  # of a score on its way, with what it is joined to
FIRST_SHARE = 0.125  # of all partial scores that a first round may send
ROUNDS = 1 << 20  # parts of all queries that rounds are made of
ROWS_A_BATCH = 8  # rows with whole blocks that a Python worker holds at a time
EXACT = float(1 << 53)  # integers up to here are exact in double precision


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows a batch while tables of blocks are made; the caller's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS_A_BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bounds(dim: int) -> list[int]:
    return [dim * i // SLICES for i in range(SLICES + 1)]


def _narrow(x: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them all."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    """So many integers again, as 64 bits."""
    return np.frombuffer(data, dtype=f"<i{len(data) // n}" if n else np.int64).astype(np.int64)


def _matrix(data: bytes, n: int, width: int) -> np.ndarray:
    return _wide(data, n * width).reshape(n, width)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 2.0 ** 63:
        raise OverflowError("inner products of these vectors do not fit in 64 bits")
    return a @ b.T


def _chosen(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the given pairs of rows, exactly."""
    out = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 1 << 14):
        x, y = a[i[at:at + (1 << 14)]], b[j[at:at + (1 << 14)]]
        if x.size and float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] >= 2.0 ** 63:
            raise OverflowError("inner products of these vectors do not fit in 64 bits")
        out[at:at + (1 << 14)] = np.einsum("ij,ij->i", x, y)
    return out


BLOCK_TYPE = "block long, slice int, n int, class_ids binary, firsts binary, data binary"


def blocks_of(classes: DataFrame, size: int, dim: int) -> DataFrame:
    """Cut a stored table of vectors into blocks of rows, and these into slices of dimensions."""
    bounds = _bounds(dim)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() << 32

        def block(rows: pd.DataFrame, number: int) -> pd.DataFrame:
            data = np.zeros((len(rows), dim), dtype=np.int64)
            for at, v in enumerate(rows["vector"]):
                data[at, :len(v)] = v
            ids = [rows[c].to_numpy(np.int64).tobytes() for c in ("class_id", "first")]
            return pd.DataFrame([
                (part + number, s, len(rows), *ids, _narrow(data[:, a:b]))
                for s, (a, b) in enumerate(zip(bounds, bounds[1:]))],
                columns=["block", "slice", "n", "class_ids", "firsts", "data"])

        rest, number = None, 0
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= size:
                yield block(rest.iloc[:size], number)
                rest, number = rest.iloc[size:], number + 1
        if rest is not None and len(rest):
            yield block(rest, number)

    return classes.select("class_id", "first", "vector").mapInPandas(make, BLOCK_TYPE)


def _whole(blocks: DataFrame, prefix: str) -> DataFrame:
    """Blocks with their slices side by side again."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("slice", "data"))), lambda s: s["data"])
    return blocks.groupBy(F.col("block").alias(prefix)).agg(
        F.first("n").alias(f"{prefix}_n"), F.first("class_ids").alias(f"{prefix}_ids"),
        F.first("firsts").alias(f"{prefix}_firsts"), parts.alias(f"{prefix}_data"))


def _meetings(queries: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """Every query block beside every candidate block of the same slice.

    Query blocks are copied to each group of a few candidate blocks, so a group has a bounded
    number of these and no vector travels alone. The copies are never broadcast: what Spark expects of
    their size leaves out that they are copies.
    """
    copied = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = blocks.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), "slice",
                          F.col("block").alias("c"), F.col("n").alias("c_n"),
                          F.col("data").alias("c_data"))
    return dealt.join(copied.hint("merge"), ["group", "slice"])


ENTRIES = "q long, c long, slice int, qi binary, ci binary, score binary"


def _entries(row, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> tuple:
    return row.q, row.c, row.slice, i.astype(np.int16).tobytes(), _narrow(j), _narrow(scores)


def _local_lists(batches: Iterator[pd.DataFrame], bounds: list[int], k: int) -> Iterator[pd.DataFrame]:
    """Phase one: the k highest partial scores of each query in each slice of a block."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            width = bounds[row.slice + 1] - bounds[row.slice]
            s = _products(_matrix(row.q_data, row.q_n, width), _matrix(row.c_data, row.c_n, width))
            best = min(k, row.c_n)
            j = np.argpartition(-s, best - 1, axis=1)[:, :best].ravel()
            i = np.repeat(np.arange(row.q_n), best)
            out.append(_entries(row, i, j, s[i, j]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRIES.split(", ")])


def _above_cutoff(batches: Iterator[pd.DataFrame], bounds: list[int]) -> Iterator[pd.DataFrame]:
    """Phase two: all partial scores that reach their share of the query's cutoff.

    A total at or above the cutoff has at least one partial score at or above an equal share of
    it, whatever the signs.
    """
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            width = bounds[row.slice + 1] - bounds[row.slice]
            s = _products(_matrix(row.q_data, row.q_n, width), _matrix(row.c_data, row.c_n, width))
            i, j = np.nonzero(s >= _share(np.asarray(row.cutoffs, dtype=np.int64))[:, None])
            if len(i):
                out.append(_entries(row, i, j, s[i, j]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRIES.split(", ")])


def _share(cutoff: np.ndarray) -> np.ndarray:
    """Smallest integer that is at least an equal share."""
    return -((-cutoff) // SLICES)


TOTALS = "q long, qi int, c long, ci int, class_id long, first long, score long"


def _joined(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a query and a candidate, the sum of their partial scores seen, and how many."""
    codes, scores = [], []
    for e in row.entries:
        i = np.frombuffer(e["qi"], dtype=np.int16).astype(np.int64)
        codes.append(i << 32 | _wide(e["ci"], len(i)))
        scores.append(_wide(e["score"], len(i)))
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    total, seen = np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=np.int64)
    np.add.at(total, place, np.concatenate(scores))
    np.add.at(seen, place, 1)
    return code >> 32, code & 0xFFFFFFFF, total, seen


def _best(row, i: np.ndarray, j: np.ndarray, total: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of each query of a block, ties to the smaller first id."""
    ids, first = (np.frombuffer(getattr(row, c), dtype=np.int64) for c in ("c_ids", "c_firsts"))
    order = np.lexsort((ids[j], first[j], -total, i))
    i, j, total = i[order], j[order], total[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    keep = rank < k
    return pd.DataFrame({"q": row.q, "qi": i[keep].astype(np.int32), "c": row.c,
                         "ci": j[keep].astype(np.int32), "class_id": ids[j[keep]],
                         "first": first[j[keep]], "score": total[keep]})


def _resolved(batches: Iterator[pd.DataFrame], bounds: list[int], k: int, prune: bool
              ) -> Iterator[pd.DataFrame]:
    """Exact totals of pairs: with ``prune`` only of those that can still reach the better cutoff."""
    widths = np.diff(bounds)
    for batch in batches:
        for row in batch.itertuples(index=False):
            i, j, total, seen = _joined(row)
            if prune:
                cutoff, better = (np.asarray(x, dtype=np.int64) for x in (row.cutoffs, row.better))
                # A partial score that was not sent is below the share.
                most = total + (SLICES - seen) * (_share(cutoff) - 1)[i]
                open_ = most >= better[i]
                i, j, total, seen = i[open_], j[open_], total[open_], seen[open_]
            part = np.flatnonzero(seen < SLICES)
            if len(part):
                a, b = (np.concatenate([_matrix(d, n, w) for d, w in zip(data, widths)], axis=1)
                        for data, n in ((row.q_data, row.q_n), (row.c_data, row.c_n)))
                total[part] = _chosen(a, b, i[part], j[part])
            yield _best(row, i, j, total, k)


def _seen_whole(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Totals that phase two alone makes known: of pairs that every slice has sent."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            i, j, total, seen = _joined(row)
            all_ = seen == SLICES
            yield _best(row, i[all_], j[all_], total[all_], k)


def _cutoffs(totals: DataFrame, sizes: DataFrame, k: int, out: str) -> DataFrame:
    """The k-th best known total of each query, as one array for each query block.

    Queries with fewer than k known totals have the lowest possible cutoff.
    """
    by_score = Window.partitionBy("q", "qi").orderBy(F.desc("score"), "first", "class_id")
    best = totals.withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") <= k)
    kth = best.groupBy("q", "qi").agg(F.when(F.count("*") == k, F.min("score")).alias("score"))
    known = kth.filter("score is not null").groupBy("q").agg(F.map_from_entries(
        F.collect_list(F.struct("qi", "score"))).alias("_known"))
    lowest = F.lit(-(1 << 62))
    return sizes.join(known, "q", "left").select("q", F.transform(
        F.sequence(F.lit(0), F.col("q_n") - 1), lambda i: F.coalesce(
            F.try_element_at(F.col("_known"), i), lowest)).alias(out))


def _round(store: Stored, asked: DataFrame, blocks: DataFrame, groups: int, bounds: list[int], k: int
           ) -> tuple[DataFrame, int]:
    """The three phases for some query blocks: their k best, stored, and the number of partial scores sent."""
    q_slices = asked.select("slice", F.col("block").alias("q"), F.col("n").alias("q_n"),
                            F.col("data").alias("q_data"))
    sizes = q_slices.filter("slice = 0").select("q", "q_n")
    q_whole, c_whole = _whole(asked, "q"), _whole(blocks, "c")
    grouped = F.collect_list(F.struct("slice", "qi", "ci", "score")).alias("entries")
    c_names = c_whole.select("c", "c_ids", "c_firsts")

    def run(df: DataFrame, function, schema: str, **given) -> DataFrame:
        return store.put(df.mapInPandas(partial(function, **given), schema))

    lists = run(_meetings(q_slices, blocks, groups), _local_lists, ENTRIES, bounds=bounds, k=k)
    listed = run(lists.groupBy("q", "c").agg(grouped).join(q_whole, "q").join(c_whole, "c"),
                 _resolved, TOTALS, bounds=bounds, k=k, prune=False)
    store.drop(lists)
    cutoffs = store.put(_cutoffs(listed, sizes, k, "cutoffs"))
    sent = run(_meetings(q_slices.join(cutoffs, "q"), blocks, groups), _above_cutoff, ENTRIES,
               bounds=bounds)
    n_sent = (sent.agg(F.sum(F.octet_length("qi"))).first()[0] or 0) // np.dtype(np.int16).itemsize
    pairs = sent.groupBy("q", "c").agg(grouped)
    whole = run(pairs.join(c_names, "c"), _seen_whole, TOTALS, k=k)
    # The same pair may be known from both phases.
    better = store.put(_cutoffs(listed.unionByName(whole).distinct(), sizes, k, "better"))
    store.drop(listed)
    store.drop(whole)
    totals = run(pairs.join(cutoffs, "q").join(better, "q").join(q_whole, "q").join(c_whole, "c"),
                 _resolved, TOTALS, bounds=bounds, k=k, prune=True)
    store.drop(sent)
    store.drop(cutoffs)
    store.drop(better)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.class_ids, dtype=np.int64)
                yield pd.DataFrame({"q": row.q, "qi": np.arange(len(ids), dtype=np.int32),
                                    "query": ids})

    names = asked.filter("slice = 0").select(F.col("block").alias("q"), "class_ids").mapInPandas(
        named, "q long, qi int, query long")
    by_score = Window.partitionBy("q", "qi").orderBy(F.desc("score"), "first", "class_id")
    best = totals.withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") <= k)
    answers = store.put(best.join(names, ["q", "qi"]).select("query", "class_id", "score"))
    store.drop(totals)
    return answers, n_sent


def top_classes(store: Stored, classes: DataFrame, k: int) -> DataFrame:
    """The k best other or own vectors of each query vector: query, class_id, score.

    ``classes`` is a stored table of distinct vectors: class_id, vector (array of long, shorter
    ones count as ending in zeros), first (id that decides ties) and is_query. Every
    phase works on blocks; what is sent between them are lists and single scores. How many scores there
    are depends on the vectors, so query blocks are taken some at a time, as many as those before them allow.
    """
    dim = classes.agg(F.max(F.size("vector"))).first()[0] or 0
    bounds = _bounds(dim)
    blocks = store.put(blocks_of(classes, max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim)))), dim))
    asked = store.put(blocks_of(classes.filter("is_query"), QUERY_BLOCK, dim))
    counts = (F.coalesce(F.sum(F.when(F.col("slice") == 0, F.col("n"))), F.lit(0)),
              F.count(F.when(F.col("slice") == 0, 1)), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)))
    n, n_blocks, size = blocks.agg(*counts).first()
    n_asked, n_asked_blocks, _ = asked.agg(*counts).first()
    groups = max(1, -(-n_blocks // BLOCKS_TOGETHER), min(n_blocks, GROUPS))
    at_once = max(ROUND, size) / SENT_BYTES
    listed = n_blocks * SLICES * k

    def share(each: float) -> int:
        """Of ROUNDS, as many as have room if a query sends so many scores; a query block at least."""
        return int(min(ROUNDS, max(ROUNDS / max(1, n_asked_blocks), ROUNDS * at_once / max(1, n_asked * each))))

    parts, low, width = [], 0, share(n * SLICES * FIRST_SHARE + listed)
    with _small_batches(store.spark):
        while low < ROUNDS:
            if ROUNDS - low <= 1.25 * width:
                width = ROUNDS - low
            part = asked.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)).between(low, low + width - 1))
            low += width
            n_part = part.agg(counts[0]).first()[0]
            if not n_part and (parts or low < ROUNDS):
                width *= 2
                continue
            answers, n_sent = _round(store, part, blocks, groups, bounds, k)
            parts.append(answers)
            if n_part:
                # Half as many again, as others may send more.
                width = min(share(1.5 * n_sent / n_part + listed), 64 * width)
    return store.together(parts)


def top_k(df: DataFrame, is_query: Column, id_col: str = "id", vector_col: str = "vector",
          k: int = 5) -> DataFrame:
    """The k rows with the highest inner product for each query row, exactly.

    ``vector_col`` holds arrays of integers; ``is_query`` is a condition on the table's columns. All rows
    but the query's own are candidates. Ties go to the smaller id. The dimensions are cut in slices that
    keep their own lists of partial scores: (1) each sends its best of every block, whose exact totals give
    a safe cutoff, the k-th best of them; (2) each sends all partial scores of at least an equal share of
    the cutoff, and the totals then complete raise it; (3) pairs that can still reach it are resolved
    exactly. Equal vectors are one class with its k+1 smallest ids, so copies are searched for once.

    Vectors that are null or hold nulls, and rows without an id, take no part; shorter vectors
    count as ending in zeros; empty ones score 0. Rows that repeat an id, with equal vectors or others,
    are rows of their own: each is a candidate of the other. Fewer candidates than k give
    fewer rows, an empty table or no query none. Inner products must fit in 64 bits, or the job
    fails and says so. Extra columns are not passed on. Returns query_id, rank (from 1), id_col, score.
    """
    spark = df.sparkSession
    ship(spark)
    store = Stored(spark, "topk")
    vector = column(vector_col).cast("array<long>")
    with shuffles_dropped(spark):
        rows = store.put(df.select(column(id_col).cast("long").alias("id"), vector.alias("vector"),
                                   F.coalesce(is_query, F.lit(False)).alias("asks")).filter(
            F.col("id").isNotNull() & F.coalesce(F.forall("vector", lambda v: v.isNotNull()), F.lit(False)))
            .withColumn("key", F.sha2(F.col("vector").cast("string"), 256)))
        # The row number cuts a class before it is shuffled: a hot one sends k+1 rows a task.
        by_id = Window.partitionBy("key").orderBy("id")
        smallest = (rows.select("key", "id").withColumn("_r", F.row_number().over(by_id))
                    .filter(F.col("_r") <= k + 1).groupBy("key")
                    .agg(F.array_sort(F.collect_list("id")).alias("ids")))
        vectors = rows.groupBy("key").agg(F.any_value("vector").alias("vector"),
                                          F.bool_or("asks").alias("is_query"))
        classes = store.put(vectors.join(smallest, "key").select(
            F.monotonically_increasing_id().alias("class_id"), "key", "vector", "is_query", "ids",
            F.get("ids", F.lit(0)).alias("first")))
        found = top_classes(store, classes, k + 1)
    entry = F.struct((-F.col("score")).alias("s"), F.col("id"), (F.col("query") == F.col("class_id")).alias("own"))
    # At most k+1 classes of at most k+1 ids each.
    lists = (found.join(classes.select("class_id", "ids"), "class_id")
             .select("query", "class_id", "score", F.explode("ids").alias("id"))
             .groupBy("query").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("best")))
    answers = lists.join(classes.select(F.col("class_id").alias("query"), "key"), "query").select("key", "best")
    queries = rows.filter("asks").select("id", "key")
    joined = spread_join(queries, answers, ["key"], hot_keys(queries, ["key"]), "id", "inner")
    own = F.array_position(F.transform("best", lambda b: b["own"] & (b["id"] == F.col("id"))), True)
    rest = F.filter("best", lambda b, i: (own == 0) | (i != own - 1))
    return joined.select(F.col("id").alias("query_id"), F.posexplode(F.slice(rest, 1, k)).alias("_at", "_b")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_b.id").alias(id_col),
        (-F.col("_b.s")).alias("score"))
