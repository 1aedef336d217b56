"""Streaming: live redaction, dashboard, session summary and vault upkeep.

Everything per message is the same stateless expression as in batch. Only keyed
values are used: they need no state and repeat under replay.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from veilspan.functions.arrays import unnest
from veilspan.functions.synth import salt_of
from veilspan.operators.detect import SPANS, with_regex_spans, with_resolved_spans
from veilspan.operators.redact import redact_keyed, redact_with_vault, with_keyed_spans
from veilspan.operators.routing import route
from veilspan.operators.vault import collisions
from veilspan.sources import vault_table

LATENESS = "10 minutes"


def table_stream(spark: SparkSession, directory: str, name: str, options: dict | None = None) -> DataFrame:
    """A table of the data folder as a stream: of its one file, or of its part files."""
    path = os.path.join(directory, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    # A stream's path is a folder or a pattern; this pattern matches the table alone.
    return spark.readStream.schema(schema).options(**(options or {})).parquet(
        os.path.join(directory, f"[{name[0]}]{name[1:]}.parquet"))


def stream_redact(stream: DataFrame, salt: str | None = None, text_col: str = "text",
                  scope_col: str = "session_id") -> DataFrame:
    """Redact each message: detection, overlap resolution, keyed values, splice."""
    found = with_resolved_spans(with_regex_spans(stream, text_col=text_col))
    return redact_keyed(found, salt, scope_col, text_col).drop(SPANS, "named")


def _routed(stream: DataFrame, text_col: str) -> DataFrame:
    """Messages with their pattern hits and the route that the rules give them."""
    return route(with_regex_spans(stream, text_col=text_col), text_col, None, SPANS, "rules")


def stream_dashboard(stream: DataFrame, window: str = "1 day", slide: str | None = None,
                     ts_col: str = "ts", text_col: str = "text",
                     by: tuple[str, ...] = ("pii_type",)) -> DataFrame:
    """Found items per time window and type; late rows are dropped past the watermark.

    Windows tumble, or slide by ``slide``: an item then counts in each window over it. ``by`` may hold pii_type
    and route. In update mode each batch returns the windows it changed, and closed ones leave the state.
    """
    messages = _routed(stream, text_col) if "route" in by else with_regex_spans(stream, text_col=text_col)
    found = unnest(messages.withWatermark(ts_col, LATENESS), SPANS, "s", ts_col,
                   *[c for c in by if c != "pii_type"])
    keys = [F.col("s.pii_type").alias(c) if c == "pii_type" else F.col(c) for c in by]
    return (found.groupBy(F.window(ts_col, window, slide), *keys)
            .agg(F.count(F.lit(1)).alias("n_items"),
                 F.approx_count_distinct("s.value").alias("n_distinct_about"))
            .select(F.col("window.start").alias("window_start"), *by, "n_items",
                    "n_distinct_about"))


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", ts_col: str = "ts",
                    text_col: str = "text") -> DataFrame:
    """Messages, found items and routes per session of activity.

    In append mode a session is returned once, when the watermark has passed its end.
    """
    counted = (_routed(stream, text_col).withWatermark(ts_col, LATENESS)
               .select(ts_col, "session_id", F.size(SPANS).alias("n"), "route"))
    share = F.floor(100 * F.col("n_local") / F.col("n_messages")).cast("int")
    return (counted.groupBy("session_id", F.session_window(ts_col, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_messages"), F.sum("n").alias("n_items"),
                 F.count_if(F.col("n") > 0).alias("n_protected"),
                 F.count_if(F.col("route") == "local").alias("n_local"))
            .select("session_id", F.col("w.start").alias("session_start"), "n_messages", "n_items",
                    "n_protected", "n_local", (F.col("n_messages") - F.col("n_local")).alias("n_cloud"),
                    share.alias("on_device_pct")))


def mappings_of(df: DataFrame, salt: str | None = None, text_col: str = "text",
                ts_col: str = "ts") -> DataFrame:
    """Keyed mappings of messages, as vault rows (one per occurrence)."""
    found = with_resolved_spans(with_regex_spans(df, text_col=text_col))
    return (unnest(with_keyed_spans(found, salt), "named", "s", "session_id",
                   F.col(ts_col).alias("first_seen_ts"))
        .select("session_id", F.col("s.pii_type").alias("pii_type"),
                F.col("s.value").alias("real"), F.col("s.synthetic").alias("synthetic"),
                "first_seen_ts"))


def upsert_batch(batch: DataFrame, batch_id: int, path: str, salt: str | None = None) -> None:
    """Add a batch's unknown mappings, injectively. Replaying a batch rewrites its own partitions."""
    vault_table.upsert(mappings_of(batch, salt), path, batch_id)


def stream_vault(stream: DataFrame, path: str, checkpoint: str, salt: str | None = None,
                 trigger: dict | None = None) -> StreamingQuery:
    """Keep the vault up to date from a message stream."""
    salt = salt_of(salt)
    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(lambda df, i: upsert_batch(df, i, path, salt)).start())


def redact_batch(batch: DataFrame, batch_id: int, path: str, vault: str, salt: str | None = None,
                 id_col: str = "event_id", text_col: str = "text", ts_col: str = "ts") -> None:
    """Name a batch's new values in the vault, then redact its texts with the names that hold there.

    Vault and texts are written as partitions of the batch, and a batch reads the vault as it stood after
    it: a replay writes what the first attempt did, whatever came later.
    """
    vault_table.upsert(mappings_of(batch, salt, text_col, ts_col), vault, batch_id)
    names = vault_table.read_of(batch, vault, batch_id)
    found = with_resolved_spans(with_regex_spans(batch, text_col=text_col))
    out = redact_with_vault(found, names, salt, id_col=id_col, text_col=text_col).drop(SPANS, "named", text_col)
    (out.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.partitionBy("batch_id")
     .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def stream_redact_with_vault(stream: DataFrame, path: str, vault: str, checkpoint: str,
                             salt: str | None = None, id_col: str = "event_id", text_col: str = "text",
                             ts_col: str = "ts", trigger: dict | None = None) -> StreamingQuery:
    """Redact a stream with injective names: replies to its texts restore to the right person.

    ``stream_redact`` needs no table, but two real values of a session may get one synthetic value
    there. The text itself is not written.
    """
    salt = salt_of(salt)
    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(lambda df, i: redact_batch(df, i, path, vault, salt, id_col, text_col, ts_col)).start())


def vault_collisions(spark: SparkSession, path: str) -> DataFrame:
    """Report of mappings a stream could not tell apart."""
    return collisions(vault_table.read_vault(spark, path))


def upsert_rows(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write the rows a batch has changed as a partition of that batch; a replay writes them again."""
    (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.partitionBy("batch_id")
     .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def latest_rows(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """What ``upsert_rows`` has written, as it is now: the last version of each key."""
    rest = [f for f in schema.fieldNames() if f not in keys]
    table = spark.read.schema(StructType(schema.fields).add("batch_id", LongType())).parquet(path)
    last = F.max_by(F.struct(*rest), "batch_id").alias("_last")
    return table.groupBy(*keys).agg(last).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def run_to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all input there is, and read back what it wrote.

    ``append`` writes rows that are final; ``update`` those that each batch has changed, of which the last
    version of each key counts. Readers never meet a table that is being replaced.
    """
    if mode not in ("append", "update"):
        raise ValueError(f"unknown mode: {mode}")
    spark = result.sparkSession
    writer = result.writeStream.option("checkpointLocation", checkpoint).trigger(
        availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, i: upsert_rows(df, i, path)).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(result.schema).parquet(path)
    return latest_rows(spark, path, result.schema, keys)
