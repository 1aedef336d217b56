"""Joins that survive one key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def hot_keys(df: DataFrame, keys: Sequence[str], count_col: str | None = None) -> DataFrame:
    """Keys with more than 1/HOT_SHARE of all rows: by definition fewer than HOT_SHARE.

    ``count_col`` names a column with ready-made counts, if ``df`` has one row per key.
    """
    n = F.count(F.lit(1)) if count_col is None else F.sum(count_col)
    counts = df.groupBy(*keys).agg(n.alias("_n"))
    total = (df.agg(n.alias("t")).first() or [0])[0] or 0
    return counts.filter(F.col("_n") * HOT_SHARE > F.lit(total)).select(*keys)


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame,
                row_key: str, how: str = "left") -> DataFrame:
    """Join to a side that is unique on ``keys``, spreading hot keys over many tasks.

    Rows of a hot key get a salt from ``row_key`` (so a retried task repeats it) and
    the one matching row is copied to every salt. ``hot`` has fewer than HOT_SHARE
    rows by construction, so broadcasting it is safe at any scale.
    """
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flags = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    salted = left.join(flags, list(keys), "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int"))
        .otherwise(0)).drop("_hot")
    copies = right.join(flags, list(keys), "left").withColumn("_salt", F.explode(
        F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
            F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
