"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import shared_dir

# Words are runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
# Rows of a hot key that one task ranks together.
RANKED_TOGETHER = 500


# Rows that a Python worker holds at a time where the session has Spark's own default.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context.

    Functions that run in tasks name others by their module, so workers must be able to
    import it wherever the driver was started. Texts are long rows: batches of Spark's
    default number of them would take much of a worker's memory.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    if context in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):
        path = os.path.join(tempfile.mkdtemp(), "veilspan.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, files in os.walk(package):
                for file in files:
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(path)
    _shipped.add(context)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


class Stored:
    """Tables written to the folder that all executors share.

    A stored table cuts the lineage: tasks of lost executors start from it.
    Tables that a later step has replaced are deleted with ``drop``; those that
    a result still reads stay for as long as the shared folder does.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/veilspan-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Stored tables of one schema as one."""
        return self.spark.read.schema(tables[0].schema).parquet(*[self.paths[id(t)] for t in tables])

    def drop(self, table: DataFrame) -> None:
        path = self.paths.pop(id(table), None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(
                target, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each write in here deletes its shuffle files when it ends; the caller's own setting comes back.

    Else they stay until the driver happens to collect its garbage, so those of many writes lie side by side.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def n_words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, counts: DataFrame, key: str, order: list[str], salt: list[str],
           out: str = "rank") -> DataFrame:
    """Number the rows of each key from 0, without bringing a key's rows together.

    ``counts`` has one row for each key with its rows ``n``, and a number of keys that does
    not depend on the data, as it is broadcast; a key is dealt to one part per
    RANKED_TOGETHER rows by a hash of ``salt``. Parts are numbered after each other, rows
    within a part by ``order``.
    """
    from pyspark.sql import Window
    parts = counts.select(key, F.ceil(F.col("n") / RANKED_TOGETHER).cast("long").alias("_parts"))
    # Broadcast, lest the rows of a key be brought together for this join.
    dealt = df.join(F.broadcast(parts), key).withColumn(
        "_part", F.pmod(F.xxhash64(*salt), F.col("_parts"))).drop("_parts")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = dealt.groupBy(key, "_part").count().select(
        key, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_part").orderBy(*order)
    return (dealt.withColumn("_row", F.row_number().over(within)).join(bases, [key, "_part"])
            .withColumn(out, (F.col("_base") + F.col("_row") - 1).cast("long"))
            .drop("_row", "_base", "_part"))
