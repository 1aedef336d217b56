"""Near-duplicate vectors by random-hyperplane signs in several tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from veilspan.llm.common import Stored, shuffles_dropped
from veilspan.llm.components import components

COSINE = 0.9
RECALL = 0.9995  # chance that a pair at the threshold shares a bucket of some table
PER_BUCKET = 16  # vectors that chance brings to a bucket
BLOCK = 256  # vectors of a bucket that are compared at a time
SEED = 20
# Bytes dealt to buckets at a time, or those of all vectors where these are more.
ROUND = 512 << 20
SPOT = 48  # bytes of a vector's place in a bucket besides the vector
LIGHT = 32  # bytes of a bucket's count
HEAVY_KNOWN = 10_000  # buckets larger than a block that every task may know
FOLD = 8  # rows of links for each vector that are kept before they are summed
TOGETHER = 8192  # rows whose buckets a worker compares at a time
TOGETHER_BYTES = 16 << 20  # or fewer, of this size
CODES_AHEAD = 16  # tables whose codes are compared at a time
PRODUCTS = 1 << 21  # inner products made at a time


def tables_for(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Signs a code and number of tables.

    Codes grow with the logarithm of the rows, so that chance fills a bucket with as many
    rows at any size; tables follow from the chance that two vectors at the threshold
    agree in all signs of a code.
    """
    bits = max(4, math.ceil(math.log2(max(rows, 1) / PER_BUCKET + 1)))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def planes(dimension: int, bits: int, tables: int) -> np.ndarray:
    """Normals of all tables' hyperplanes; the same for all tasks."""
    return np.random.default_rng([SEED, dimension]).standard_normal((dimension, tables * bits))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision, without overflow or underflow on the way."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes_of(x: np.ndarray, normals: np.ndarray, bits: int) -> np.ndarray:
    """Codes of unit vectors by the given tables' normals: a number for each row and table.

    A row's codes do not depend on the rows beside it: products too near to zero for the sign to be
    certain, whatever the order of their sums, are summed exactly.
    """
    found = x @ normals
    for i, j in np.argwhere(np.abs(found) < 1e-15 * x.shape[1] ** 1.5):
        found[i, j] = math.fsum(x[i] * normals[:, j])
    weight = 2.0 ** np.arange(bits)
    return ((found > 0).astype(np.float64).reshape(-1, bits) @ weight).astype(np.int64).reshape(len(x), -1)


def _matrices(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each dimension, and their vectors, from lists or from bytes."""
    if not len(column):
        return
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        _, starts, data = column.buffers()
        values = np.frombuffer(data, dtype=kind)
        starts = np.frombuffer(starts, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        starts = starts // np.dtype(kind).itemsize
    else:
        values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
        starts = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    sizes = np.diff(starts)
    for dimension in np.unique(sizes):
        rows = np.flatnonzero(sizes == dimension)
        yield rows, values[starts[rows][:, None] + np.arange(dimension)]


def with_codes(classes: DataFrame, bits: int, tables: int, first: int, last: int, kind: str,
               light: bool = False) -> DataFrame:
    """Vectors as bytes, and their codes of the tables from ``first`` to before ``last``.

    ``light`` leaves out all but what tells buckets apart.
    """
    given = ["vector"] if light else ["class_id", "n", "vector"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = {}
        for batch in batches:
            for rows, vectors in _matrices(batch.column("vector"), kind):
                dimension = vectors.shape[1]
                if dimension not in normals:
                    normals[dimension] = planes(dimension, bits, tables)[:, first * bits:last * bits]
                codes = codes_of(unit(vectors.astype(np.float64)), normals[dimension], bits)
                n, width = codes.shape
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(codes.ravel()))
                size = vectors.itemsize * dimension
                if light:
                    yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(n, size, dtype=np.int32)),
                                                      "codes": lists})
                    continue
                data = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)),
                    pa.py_buffer(np.ascontiguousarray(vectors))])
                yield pa.RecordBatch.from_pydict({
                    "class_id": batch.column("class_id").take(pa.array(rows)),
                    "n": batch.column("n").take(pa.array(rows)), "data": data, "codes": lists})

    made = classes.select(*given).mapInArrow(
        emit, "size int, codes array<long>" if light else "class_id long, n long, data binary, codes array<long>")
    kept = ["size"] if light else ["class_id", "n", "data", F.octet_length("data").alias("size")]
    return made.select(*kept, F.posexplode("codes").alias("_at", "code")).withColumn(
        "table", (F.col("_at") + first).cast("int")).drop("_at")


def near_pairs(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, halves: np.ndarray, paired: np.ndarray,
               cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of one group that are near each other.

    Groups are runs of rows. Where a group is ``paired`` it holds two blocks, told apart by
    ``halves``, and rows of the one are compared with those of the other alone. Groups of like size
    are compared in one product.
    """
    step = np.where(sizes <= 64, 8, 64)
    widths = -(-sizes // step) * step
    found = [(np.empty(0, dtype=np.int64),) * 2]
    for width in np.unique(widths):
        of_width = np.flatnonzero(widths == width)
        upper = np.triu(np.ones((width, width), dtype=bool), 1)
        several = max(1, PRODUCTS // int(width * max(width, x.shape[1])))
        for at in range(0, len(of_width), several):
            of = of_width[at:at + several]
            inside = np.arange(width) < sizes[of][:, None]
            rows = starts[of][:, None] + np.where(inside, np.arange(width), 0)
            y = x[rows]
            near = np.matmul(y, y.transpose(0, 2, 1)) >= cosine
            near &= inside[:, :, None] & inside[:, None, :]
            half = halves[rows]
            near &= np.where(paired[of][:, None, None], ~half[:, :, None] & half[:, None, :], upper)
            group, i, j = np.nonzero(near)
            found.append((rows[group, i], rows[group, j]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def first_met(x: np.ndarray, i: np.ndarray, j: np.ndarray, normals: np.ndarray, bits: int, table: int) -> np.ndarray:
    """Which pairs share no bucket of a table before this one, where they would have been linked."""
    left = np.arange(len(i))
    for at in range(0, table, CODES_AHEAD):
        if not len(left):
            break
        rows, place = np.unique(np.concatenate([i[left], j[left]]), return_inverse=True)
        codes = codes_of(x[rows], normals[:, at * bits:min(at + CODES_AHEAD, table) * bits], bits)[place]
        left = left[(codes[:len(left)] != codes[len(left):]).all(axis=1)]
    return left


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that links within a block lead to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def near_links(spots: DataFrame, heavy: DataFrame, bits: int, tables: int, cosine: float, kind: str) -> DataFrame:
    """Verified links of each bucket, summed by class: class_id, links, root.

    Buckets larger than a block, those of ``heavy``, are cut in blocks, and each pair of blocks is a group of
    its own, so a dense cluster is compared completely by many tasks. A pair counts in the first table that
    brings it together. Groups leave sums and a spanning forest of their links, never the pairs themselves.
    """
    placed = spots.join(heavy, ["size", "table", "code"], "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    # Block b meets the blocks b .. blocks-1 as the first, and 0 .. b as the second.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(F.col("block"), other).alias("a"), F.greatest(F.col("block"), other).alias("b")))
    group = ["size", "table", "code", "a", "b"]
    dealt = placed.withColumn("_pair", F.explode(pairs)).select(
        "size", "table", "code", "_pair.a", "_pair.b", (F.col("block") != F.col("_pair.a")).alias("half"),
        "class_id", "n", "data")
    ordered = dealt.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = {}
        for rows, starts in _whole_groups(batches, group):
            number = {c: rows.column(c).to_numpy(zero_copy_only=False)
                      for c in ("table", "a", "b", "half", "class_id", "n")}
            sizes = np.diff(np.r_[starts, len(rows)])
            for of_size, vectors in _matrices(rows.column("data"), kind):
                # Rows of one dimension stand together, as whole groups.
                dimension = vectors.shape[1]
                if dimension not in normals:
                    normals[dimension] = planes(dimension, bits, tables)
                x = unit(vectors.astype(np.float64))
                mine = (starts >= of_size[0]) & (starts <= of_size[-1]) & (sizes > 1)
                at = {c: v[of_size] for c, v in number.items()}
                first = starts[mine] - of_size[0]
                i, j = near_pairs(x, first, sizes[mine], at["half"], (at["a"] != at["b"])[first], cosine)
                new = [np.empty(0, dtype=np.int64)]
                for table in np.unique(at["table"][i]):
                    here = np.flatnonzero(at["table"][i] == table)
                    new.append(here[first_met(x, i[here], j[here], normals[dimension], bits, int(table))])
                i, j = (side[np.concatenate(new)] for side in (i, j))
                if not len(i):
                    continue
                ids, n = at["class_id"], at["n"]
                count = np.zeros(len(ids), dtype=np.int64)
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                order = np.argsort(ids, kind="stable")
                place = np.argsort(order, kind="stable")
                root = ids[order][_local_roots(len(ids), place[i], place[j])][place]
                linked = np.unique(np.concatenate([i, j]))
                yield pa.RecordBatch.from_pydict({"class_id": pa.array(ids[linked]), "links": pa.array(count[linked]),
                                                  "root": pa.array(root[linked])})

    return ordered.mapInArrow(compare, "class_id long, links long, root long")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]
                  ) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of some whole groups, runs with equal keys, and where each begins."""
    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        values = [rows.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.any([v[1:] != v[:-1] for v in values], axis=0)
        return rows, np.flatnonzero(np.r_[True, changed])

    kept, n, size = [], 0, 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append(batch)
        n += len(batch)
        size += batch.nbytes
        if n >= TOGETHER or size >= TOGETHER_BYTES:
            rows, starts = cut(kept)
            if len(starts) > 1:
                yield rows.slice(0, starts[-1]), starts[:-1]
            # The last group may go on in the next batch.
            kept = [rows.slice(starts[-1])]
            n, size = len(kept[0]), kept[0].nbytes
    if n:
        yield cut(kept)


def _folded(parts: list[DataFrame], store: Stored) -> DataFrame:
    """Stored links with one row for each class, its links summed and its root the smallest class reached."""
    found = store.together(parts)
    roots = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")), store)
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    folded = store.put(links.join(roots.withColumnRenamed("node", "class_id"), "class_id"))
    for part in parts:
        store.drop(part)
    return folded


def _all_links(classes: DataFrame, cosine: float, kind: str, store: Stored) -> DataFrame:
    """Links and root of every class that has links: class_id, links, root.

    Some tables at a time, so that what is dealt to buckets on the way has a size in proportion to the
    vectors, however many tables there are. Nothing of a round stays but its links.
    """
    n, size = classes.agg(F.count("*"), F.sum(F.size("vector").cast("long"))).first()
    size = (size or 0) * np.dtype(kind).itemsize
    bits, tables = tables_for(n, cosine)
    at_once = max(ROUND, size)
    step, light = (max(1, at_once // max(1, b)) for b in (size + SPOT * n, LIGHT * n))
    parts, rows = [], 0
    for low in range(0, tables, max(light, step)):
        high = min(low + max(light, step), tables)
        heavy = store.put(with_codes(classes, bits, tables, low, high, kind, light=True)
                          .groupBy("size", "table", "code").count().filter(F.col("count") > BLOCK)
                          .select("size", "table", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
        # Counted, so broadcast by its rows and not by what Spark expects.
        known = F.broadcast(heavy) if heavy.count() <= HEAVY_KNOWN else heavy.hint("merge")
        for first in range(low, high, step):
            last = min(first + step, high)
            spots = with_codes(classes, bits, tables, first, last, kind)
            parts.append(store.put(near_links(spots, known, bits, tables, cosine, kind)))
            rows += parts[-1].count()
            if rows > FOLD * n:
                parts = [_folded(parts, store)]
                rows = parts[0].count()
        store.drop(heavy)
    return _folded(parts, store)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    cosine: float = COSINE) -> DataFrame:
    """Links and components of vectors with at least the given cosine.

    Equal vectors fall together as one class before any comparison. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, and so do vectors of
    different lengths. Rows that repeat an id count as vectors of their own. Extra columns
    are not passed on; an empty table gives no rows.

    Returns id, n_links (other vectors linked directly), component_id (smallest id
    reachable), kept (whether the two are the same).
    """
    store = Stored(df.sparkSession, "embeddings")
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))
                      & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    good = finite & F.exists(vector, lambda v: v != 0)
    # Single precision is kept as it is given, which halves what is stored and sent.
    single = isinstance(df.select(vector).schema[0].dataType.elementType, FloatType)
    rows = df.select(F.col(id_col).alias("vec_id"), (vector if single else vector.cast("array<double>")).alias("vector"),
                     F.coalesce(good, F.lit(False)).alias("good"))
    known = rows.filter("good")
    with shuffles_dropped(df.sparkSession):
        # Numbers of their own, fixed by being stored: ids may be null or stand on several vectors.
        classes = store.put(known.groupBy("vector").agg(F.min("vec_id").alias("first"),
                                                        F.count("*").alias("n"))
                            .select(F.monotonically_increasing_id().alias("class_id"), "first", "n", "vector"))
        found = _all_links(classes, cosine, "<f4" if single else "<f8", store)
    links, rooted = found.select("class_id", "links"), found.select("class_id", "root")
    smallest = (classes.select("class_id", "first").join(rooted, "class_id").groupBy("root")
                .agg(F.min("first").alias("smallest")))
    named = rooted.join(smallest, "root").select("class_id", "smallest")
    labelled = (classes.join(links, "class_id", "left").join(named, "class_id", "left")
                .select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                        F.coalesce("smallest", "first").alias("component_id")))
    linked = known.join(labelled, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("vec_id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
