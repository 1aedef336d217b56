"""Mix sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import Stored, column, n_words

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3.0
PER_BAND = 2000  # rows of a source that one task sums
PASSES = 3
# Marks that stand in prose seldom; their share lowers the quality weight.
MARKS = "!#$%&*|<>{}=_~^"


def quality_weight(text: Column) -> Column:
    """Weight of a document from 0.05 to 1: one less four times its share of marks."""
    n = F.length(text)
    marks = n - F.length(F.translate(text, MARKS, ""))
    return F.greatest(F.lit(0.05), 1 - F.coalesce(4 * marks / F.nullif(n, F.lit(0)), F.lit(0.0)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS,
            most: float = MOST_EPOCHS) -> DataFrame:
    """Words that the mix takes of each source.

    ``sizes`` has source and source_size. The sources in order of their code
    points (null last) get the weights in turn. A target stops at ``most`` times the
    source's size and the excess is shared by weight among the others. If level t
    gives each source min(weight x t, most x size), the sources that stop are those
    with the smallest most x size / weight: a running sum finds the level. One row for
    each source; sources are few beside documents, and their count is not collected.
    """
    # A source's number among all sources: bytes of UTF-8 sort as code points do.
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    rows = sizes.withColumn("weight", w).withColumn(
        "stop", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("stop") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.select(
        "*", F.coalesce(F.sum("stop").over(upto), F.lit(0.0)).alias("stopped"),
        (F.sum("weight").over(whole)
         - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("open"),
        F.sum("source_size").over(whole).alias("total"), F.row_number().over(order).alias("no"))
    rows = rows.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    # The level is that of the first source whose stop it doesn't reach.
    level = F.min(F.when(F.col("ratio") >= F.col("level"),
                         F.struct("no", "level"))).over(whole)["level"]
    return rows.select("source", "source_size", F.least(
        F.col("weight") * F.coalesce(level, F.lit(float("inf"))), F.col("stop")).alias("target"))


def running_sums(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Add ``before``, the words of a source's documents that come before one by key.

    ``bands`` has for each source ("src") the number of bands that its rows are dealt to.
    Sums run within a band, and over the sums of the bands: no task sees a whole source.
    """
    # 1 - exp(-key) grows with the key and is nearly uniform.
    banded = rows.join(bands, "src").withColumn("band", F.least(
        F.floor((1 - F.exp(-F.col("key"))) * F.col("bands")), F.col("bands") - 1)).drop("bands")
    upto = Window.partitionBy("src").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bases = banded.groupBy("src", "band").agg(F.sum("size").alias("_words")).select(
        "src", "band", F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_base"))
    within = Window.partitionBy("src", "band").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    return (banded.withColumn("_sum", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(bases, ["src", "band"])
            .withColumn("before", F.col("_base") + F.col("_sum")).drop("_base", "_sum", "band"))


def mix(df: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
        most: float = MOST_EPOCHS) -> DataFrame:
    """Times that each document is taken so that every source meets its target.

    A source first gives complete epochs (every document as often); for the rest of its
    budget its documents are sorted by an exponential variate, keyed by seed, id and text, over
    their quality weight, and taken as long as the sum of their words stays within the
    budget. The gap before the first that doesn't fit goes, in PASSES passes of the same
    kind, to later ones that fit it.

    Null texts and texts without words have size 0 and are taken with the epochs only;
    documents with null source form a source of their own. Repeated rows are documents of
    their own with the same key. An empty table gives no rows, extra columns are not
    passed on. Returns id, size, source_size, target, times, taken.
    """
    return _taken(df, seed, id_col, text_col, source_col, weights, most).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", "times",
        (F.col("times") * F.col("size")).alias("taken"))


def _taken(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str,
           weights: tuple[float, ...], most: float) -> DataFrame:
    """The mix with the hash of each text: doc_id, _text, size, source_size, target, times."""
    spark = df.sparkSession
    store = Stored(spark, "mixing")
    text, source = F.col(text_col), F.col(source_col)
    # Uniform in (0, 1] from 52 bits of a hash: reruns agree whatever the partitions.
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), text)
    uniform = (F.shiftrightunsigned(hashed, 12).cast("double") + 1) / F.lit(float(1 << 52))
    rows = store.put(df.select(
        F.col(id_col).alias("doc_id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("src"),
        F.xxhash64(text).alias("_text"), n_words(text).alias("size"),
        F.coalesce(-F.log(uniform) / quality_weight(text), F.lit(0.0)).alias("key"),
        F.lit(False).alias("again")))
    sizes = rows.groupBy("src").agg(F.first("source").alias("source"),
                                    F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = store.put(sizes)
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    aims = store.put(targets(sizes.select("source", "source_size"), weights, most)
                     .withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
                     .withColumn("epochs", epochs.cast("long")).drop("source")
                     .join(sizes.select("src", F.ceil(F.col("n") / PER_BAND).alias("bands")),
                           "src"))
    bands = aims.select("src", "bands")
    left = aims.select("src", (F.col("target") - F.col("epochs") * F.col("source_size"))
                       .alias("left"))
    for _ in range(PASSES):
        open_rows = rows.join(left, "src").withColumn("_fits", ~F.col("again") & (
            F.col("size") > 0) & (F.col("size") <= F.col("left")))
        summed = running_sums(open_rows.filter("_fits"), bands)
        passed = summed.withColumn("again", F.col("before") + F.col("size") <= F.col("left"))
        rows = store.put(passed.select(rows.columns).unionByName(
            open_rows.filter("not _fits").select(rows.columns)))
        used = rows.groupBy("src").agg(F.sum(F.when(F.col("again"), F.col("size"))
                                             .otherwise(0)).alias("used"))
        left = aims.join(used, "src").select("src", (
            F.col("target") - F.col("epochs") * F.col("source_size") - F.col("used"))
            .alias("left"))
    times = F.col("epochs") + F.col("again").cast("long")
    return rows.join(aims, "src").select("doc_id", "_text", "size", "source_size", "target",
                                         times.alias("times"))


def mixed(df: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
          most: float = MOST_EPOCHS) -> DataFrame:
    """The rows of the mix, with all their columns: each as often as it is taken.

    Rows of equal id and text share what is taken of them as evenly as whole
    rows allow.
    """
    # The row as one struct, so that no name of its columns meets one made here.
    named = df.select(F.struct(*[column(c) for c in df.columns]).alias("whole"),
                      F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    times = (_taken(df, seed, id_col, text_col, source_col, weights, most)
             .groupBy("doc_id", "_text").agg(F.sum("times").alias("all"),
                                             F.count("*").alias("rows"))
             .filter(F.col("all") > 0))
    together = named.join(times, F.col("id").eqNullSafe(F.col("doc_id"))
                          & (F.col("text_hash") == F.col("_text")))
    # Only rows that repeat need a number; the others stay where the join has put them.
    order = Window.partitionBy("doc_id", "_text").orderBy(F.col("whole")[source_col])
    many = together.filter(F.col("rows") > 1).withColumn("row", F.row_number().over(order) - 1)
    single = together.filter(F.col("rows") == 1).withColumn("row", F.lit(0))
    each = F.floor(F.col("all") / F.col("rows")) + (
        F.col("row") < F.col("all") % F.col("rows")).cast("int")
    return (single.unionByName(many)
            .withColumn("copies", F.array_repeat(F.lit(0), each.cast("int")))
            .select("whole", F.explode("copies")).select("whole.*"))
