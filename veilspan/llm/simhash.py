"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Stored, column, free_name
from veilspan.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
# Generator polynomial of the binary Golay code (23, 12, 7): fixed value.
GOLAY = 0b101011100011
# Lowest bit and width of the fingerprint's segments; each fits a code word of 23 bits.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[:last - 1] + 1).tolist()]
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint",
                     shingle: int = SHINGLE) -> DataFrame:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return df.withColumn(out, hashed(F.col(text_col)))


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of every 12-bit message, and the error word of every syndrome.

    The code is perfect: each of the 2,048 syndromes has one error of at most three bits.
    """
    check = np.zeros(1 << 12, dtype=np.int64)
    for message in range(1 << 12):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GOLAY << (bit - 11)
        check[message] = rest
    error = np.zeros(1 << 11, dtype=np.int64)
    one = [1 << i for i in range(23)]
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                # Equal bits fold to one, so that errors of one and two bits are met as well.
                e = one[a] | one[b] | one[c]
                error[check[e >> 11] ^ (e & 0x7FF)] = e
    return check, error


_tables: list = []


def indices(words: np.ndarray, width: int) -> np.ndarray:
    """Messages of the code words within reach of one flipped bit, a column for each flip.

    Two words at most two bits apart have a word between them at most one bit from
    both; the code word that it decodes to is among the columns of either.
    """
    if not _tables:
        _tables.extend(golay_tables())
    check, error = _tables
    flips = np.array([0, *(1 << i for i in range(width))], dtype=np.int64)
    near = words[:, None] ^ flips[None, :]
    return (near ^ error[check[near >> 11] ^ (near & 0x7FF)]) >> 11


def golay_keys(prints: DataFrame) -> DataFrame:
    """Keys (fp, key): a segment as it is, with a code index of the next segment.

    Two differing bits leave one of the three segments free of errors, and give its
    neighbour at most two: fingerprints that far apart share a key.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(dtype=np.int64)
            part = [(fp.view(np.uint64) >> np.uint64(low) & np.uint64((1 << width) - 1))
                    .astype(np.int64) for low, width in SEGMENTS]
            for i in range(3):
                j = (i + 1) % 3
                index = np.sort(indices(part[j], SEGMENTS[j][1]), axis=1)
                new = np.ones(index.shape, dtype=bool)
                new[:, 1:] = index[:, 1:] != index[:, :-1]
                row, column = np.nonzero(new)
                key = (np.int64(i) << 40) | (part[i][row] << 12) | index[row, column]
                yield pd.DataFrame({"fp": fp[row], "key": key})

    return prints.select("fp").mapInPandas(emit, "fp long, key long")


def links(prints: DataFrame, store: Stored) -> DataFrame:
    """Edges that connect all fingerprints (distinct, column fp) at most two bits apart.

    Fingerprints that share a key are candidates. A key of two holds one pair, which is
    verified by its differing bits. Larger keys are not paired off: their members meet
    at the words at most one bit from both. Fingerprints that meet there are at most two
    bits apart and no more than 65 can meet at a word, so work stays linear in a group.
    """
    keys = store.put(golay_keys(prints))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"),
                                     F.max("fp").alias("b")).filter("n > 1")
    shared = store.put(shared)
    pairs = shared.filter(F.col("n") == 2).filter(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    crowd = keys.join(shared.filter("n > 2").select("key"), "key", "left_semi").select(
        "fp").distinct()
    between = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i))
                                     for i in range(64)])
    met = (crowd.select("fp", F.explode(between).alias("between")).groupBy("between")
           .agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1))
    hubs = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    return pairs.unionByName(hubs)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE) -> DataFrame:
    """Documents with the smallest id that links lead to.

    Copies fall together as one fingerprint before any key is made. A text without
    words (null, empty, white space) has fingerprint 0 and is linked like any other. Null
    ids are members of their groups but never name one, unless it has no other. Repeated
    rows stay repeated, extra columns are not passed on, and an empty table gives no rows.
    Returns id, fingerprint (16 hex digits), component_id.
    """
    return _grouped(df, id_col, text_col, shingle).select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component) and component_id."""
    store = Stored(df.sparkSession, "simhash")
    docs = store.put(with_fingerprint(
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text",
        "fp", shingle).select("doc_id", "fp"))
    prints = store.put(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints, store), store)
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = store.put(rooted.join(smallest, "root").select("fp", "root", "component_id"))
    return docs.join(groups, "fp")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = SHINGLE) -> DataFrame:
    """Keep one row of each group, with all its columns: one with the smallest id.

    Rows that repeat an id may belong to several groups: each keeps its own. Where a group has no id at
    all, one of its rows stays.
    """
    groups = _grouped(df, id_col, text_col, shingle)
    # Of the rows with the smallest id, those with the smallest fingerprint.
    firsts = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(
        F.min(F.struct("doc_id", "fp")).alias("f")).select("f.doc_id", "f.fp")
    counts = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    store = Stored(df.sparkSession, "kept")
    several = store.put(counts.filter("n > 1").select("doc_id"))
    made, own = free_name(df, "_print"), free_name(df, "_id")
    columns = [column(c) for c in df.columns]
    single = firsts.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias(own))
    kept = df.join(single, column(id_col) == F.col(own), "left_semi").select(*columns)
    nameless = groups.filter("component_id is null").groupBy("root").agg(
        F.min(F.struct("doc_id", "fp")).alias("f")).select("f.doc_id", "f.fp")
    stays = store.put(firsts.join(several, "doc_id", "left_semi").unionByName(nameless).select(
        F.col("doc_id").alias(own), F.col("fp").alias("_stays")))
    if not stays.count():
        return kept
    # Where an id stands on several rows, or on none, their fingerprints tell which of them stays.
    unclear = store.put(df.join(several.select(F.col("doc_id").alias(own)), column(id_col) == F.col(own),
                                "left_semi").unionByName(df.filter(column(id_col).isNull())))
    printed = with_fingerprint(unclear, text_col, made, shingle)
    rest = printed.join(stays, column(id_col).eqNullSafe(F.col(own)) & (F.col(made) == F.col("_stays")),
                        "left_semi").dropDuplicates([id_col, made])
    return kept.unionByName(rest.select(*columns))
