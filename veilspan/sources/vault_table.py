"""The vault as a Parquet table, partitioned by a bucket of the session id and a batch.

Batch writes and streams share the layout: a stream's batch has its own id in
every bucket, so that a replay replaces what the first attempt wrote. The number of
buckets is kept with the table. Deleting a session leaves one marker row without
a session in each of its partitions: a dynamic overwrite replaces only
partitions that get rows, and without the marker an emptied one would keep its old files.

Beside the rows lie bits of their keys, as Bloom filters do: 64-bit words for each bucket, written before
the rows, so that a key without its bits is certainly not in the table. An upsert tests its keys
against these, and reads rows only of buckets in which some key may be known.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.vault import (BY_TYPE, VAULT_COLUMNS, VAULT_SCHEMA, base_of, first_per_key,
                                      rename_collisions)
from veilspan.session import shared_dir

BUCKETS = 256  # of a new table, unless its first write says otherwise
BATCH = -1  # of rows that no stream has written
SPREAD = 64
TABLE_SCHEMA = VAULT_SCHEMA + ", bucket int, batch_id bigint"
LAYOUT = "/_layout"
KEYS = "/_keys"
KEYS_SCHEMA = "bucket int, word int, bits bigint, batch_id bigint"
WORDS = 1 << 12  # of 64 bits for each bucket; more keys make more of them look known, never fewer
LANES = 4  # bits a key sets in its word


def bucket_of(session_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, path: str) -> int | None:
    """Buckets of an existing table; None if there is none."""
    try:
        return spark.read.parquet(path + LAYOUT).first()["buckets"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _bucketed(vault: DataFrame, buckets: int, *more: str) -> DataFrame:
    """Rows with their bucket, several files per bucket so a large session is no one task's."""
    return (vault.select(*VAULT_COLUMNS, *more)
            .withColumn("bucket", bucket_of(F.col("session_id"), buckets))
            .repartition("bucket", F.pmod(F.xxhash64("real"), F.lit(SPREAD))))


def _with_spot(df: DataFrame, buckets: int, name: str, *key: str | Column) -> DataFrame:
    """Add the word of a key's bits, and the bits, as ``name_word`` and ``name_bits``."""
    parts = [F.lit(name), F.col("session_id"), *key]
    bits = F.lit(0).cast("bigint")
    spread = F.xxhash64(F.lit("bits"), *parts)
    for lane in range(LANES):
        at = F.shiftright(spread, 6 * lane).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return df.withColumns({
        "bucket": bucket_of(F.col("session_id"), buckets),
        f"{name}_word": F.pmod(F.xxhash64(*parts), F.lit(WORDS)).cast("int"), f"{name}_bits": bits})


def _with_spots(rows: DataFrame, buckets: int) -> DataFrame:
    """The two keys an upsert asks for: the real value of a type, and the base of the synthetic one."""
    real = _with_spot(rows, buckets, "real", "pii_type", "real")
    return _with_spot(real, buckets, "base", base_of())


def _write_keys(rows: DataFrame, path: str, buckets: int, batch_id: int) -> None:
    """Set the bits of rows. Those of a stream's batch replace its own earlier attempt."""
    spots = _with_spots(rows, buckets)
    words = spots.select("bucket", F.explode(F.array(*[
        F.struct(F.col(f"{n}_word").alias("word"), F.col(f"{n}_bits").alias("bits"))
        for n in ("real", "base")])).alias("s")).groupBy("bucket", "s.word").agg(F.bit_or("s.bits").alias("bits"))
    writer = words.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.partitionBy("batch_id")
    if batch_id == BATCH:
        writer.mode("append").parquet(path + KEYS)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path + KEYS)


def write_vault(vault: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS,
                batch_id: int = BATCH) -> None:
    """Append mappings to the table (or replace it with ``mode='overwrite'``).

    A batch of a stream replaces its own earlier attempt. ``buckets`` counts for a new
    table only.
    """
    shared_dir(vault.sparkSession)
    # Written twice, as rows and as bits of their keys.
    _write(vault.select(*VAULT_COLUMNS).checkpoint(), path, mode, buckets, batch_id)


def _write(vault: DataFrame, path: str, mode: str, buckets: int, batch_id: int) -> None:
    """``write_vault`` of rows that are kept and can be read twice."""
    spark = vault.sparkSession
    known = None if mode == "overwrite" else buckets_of(spark, path)
    rows = _bucketed(vault, known or buckets).withColumn(
        "batch_id", F.lit(batch_id).cast("bigint"))
    writer = rows.write.partitionBy("bucket", "batch_id")
    if known is None and mode == "overwrite":
        writer.mode(mode).parquet(path)
        _write_keys(vault, path, buckets, batch_id)
    else:
        # Bits first: with rows alone, a writer that breaks off would leave keys that look new.
        _write_keys(vault, path, known or buckets, batch_id)
        if batch_id == BATCH:
            writer.mode(mode).parquet(path)
        else:
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    if known is None:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode(
            "overwrite").parquet(path + LAYOUT)


def tested(mappings: DataFrame, path: str, buckets: int, batch_id: int = BATCH) -> DataFrame:
    """Mappings with ``real_maybe`` and ``base_maybe``: false if the table certainly has no such key.

    Asks the bits alone, at most WORDS for each bucket; a stream's batch those of earlier batches.
    """
    spark = mappings.sparkSession
    before = F.lit(True) if batch_id == BATCH else F.col("batch_id") < batch_id
    bits = spark.read.schema(KEYS_SCHEMA).parquet(path + KEYS).filter(before).groupBy(
        "bucket", "word").agg(F.bit_or("bits").alias("_bits"))
    out = _with_spots(mappings, buckets)
    for name in ("real", "base"):
        out = out.join(bits.withColumnRenamed("word", f"{name}_word"), ["bucket", f"{name}_word"], "left").withColumn(
            f"{name}_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col(f"{name}_bits"))
                                        == F.col(f"{name}_bits"), F.lit(False))).drop("_bits")
    return out.select(*mappings.columns, "bucket", "real_maybe", "base_maybe")


def maybe_known(keys: DataFrame, path: str, batch_id: int = BATCH) -> DataFrame:
    """Rows of the buckets in which some of the ``tested`` keys may be known.

    The numbers of these buckets, at most as many as the table has, come to the driver, so that the scan
    reads no other. A stream's batch sees earlier batches alone, also when it is replayed.
    """
    spark = keys.sparkSession
    touched = [r[0] for r in keys.filter("real_maybe or base_maybe").select("bucket").distinct().collect()]
    if not touched:
        return spark.createDataFrame([], VAULT_SCHEMA)
    before = F.lit(True) if batch_id == BATCH else F.col("batch_id") < batch_id
    return _table(spark, path).filter(F.col("bucket").isin(touched) & before & F.col("session_id").isNotNull()
                                      ).select(*VAULT_COLUMNS)


def upsert(mappings: DataFrame, path: str, batch_id: int = BATCH, buckets: int = BUCKETS) -> DataFrame:
    """Add the mappings that the table does not have, named so that it stays injective; returns them.

    Known ones keep their names. Reads the bits of all keys and the rows of the buckets that may hold one
    of the given keys or a synthetic value like theirs; never the whole table.
    """
    spark = mappings.sparkSession
    shared_dir(spark)
    first = first_per_key(mappings)
    known_buckets = buckets_of(spark, path)
    if known_buckets is None:
        # Spark sees that this side has no rows, and makes the new ones once.
        added = rename_collisions(first.filter(F.lit(False)), first).checkpoint()
    else:
        keys = tested(first, path, known_buckets, batch_id).checkpoint()
        rows = maybe_known(keys, path, batch_id)
        new = keys.filter("not real_maybe").unionByName(
            keys.filter("real_maybe").join(rows.select(*BY_TYPE), list(BY_TYPE), "left_anti"))
        added = rename_collisions(rows, new).checkpoint()
    _write(added, path, "append", buckets, batch_id)
    return added


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path).filter(F.col("session_id").isNotNull()).select(*VAULT_COLUMNS)


def read_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """One session's mappings; reads its bucket only."""
    bucket = bucket_of(F.lit(session_id), buckets_of(spark, path))
    return (_table(spark, path).filter((F.col("bucket") == bucket)
                                       & (F.col("session_id") == session_id))
            .select(*VAULT_COLUMNS))


def read_of(sessions: DataFrame, path: str, upto: int | None = None) -> DataFrame:
    """The table's rows of some sessions (column session_id), of batches up to one if it is given.

    The distinct buckets, at most as many as the table has, come to the driver, so that the
    scan reads no other.
    """
    spark = sessions.sparkSession
    buckets = buckets_of(spark, path)
    if buckets is None:
        return spark.createDataFrame([], VAULT_SCHEMA)
    own = sessions.select("session_id").distinct()
    touched = [r[0] for r in own.select(
        bucket_of(F.col("session_id"), buckets).alias("bucket")).distinct().collect()]
    seen = F.lit(True) if upto is None else F.col("batch_id") <= upto
    return _table(spark, path).filter(F.col("bucket").isin(touched) & seen).join(
        own, "session_id", "left_semi").select(*VAULT_COLUMNS)


def delete_session(spark: SparkSession, path: str, session_id: str) -> None:
    """Delete a session's rows from the table, whatever wrote them; rewrites its bucket only."""
    buckets = buckets_of(spark, path)
    if buckets is None:
        return
    bucket = bucket_of(F.lit(session_id), buckets)
    own = _table(spark, path).filter(F.col("bucket") == bucket)
    rest = own.filter(F.col("session_id").isNotNull() & (F.col("session_id") != session_id))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in
               (f.split() for f in VAULT_SCHEMA.split(", "))]
    markers = own.filter((F.col("session_id") == session_id) | F.col("session_id").isNull()).select(
        "bucket", "batch_id").distinct().select(*nothing, "bucket", "batch_id")
    rows = (_bucketed(rest, buckets, "batch_id").select(*VAULT_COLUMNS, "bucket", "batch_id")
            .unionByName(markers))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "batch_id").parquet(path))
