"""Streams, run over all their input and compared with the same result in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import restore
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.oracle_parts import (SRC_MESSAGES, keyed_cte, resolved_ctes, span_ctes,
                                         spliced_cte, with_)
from veilspan.plans.routes import RULES
from veilspan.sources import vault_table
from veilspan.sources.tables import table
from veilspan.sources.forms import as_messages
from veilspan.streaming import redaction as streams

DELETED = "7"
CTES = [SRC_MESSAGES, *span_ctes()]
KEYED = [*CTES, *resolved_ctes(), keyed_cte()]


def message_stream(spark: SparkSession, d: str) -> DataFrame:
    return as_messages(streams.table_stream(spark, d, "events"))


def live(build, mode: str, *columns: str, keys: tuple[str, ...] = ()):
    def run(spark: SparkSession, d: str) -> DataFrame:
        base = common.fresh_dir(spark, "stream")
        out = streams.run_to_table(build(message_stream(spark, d)), base + "/out",
                                   base + "/state", mode, keys)
        return out.select(*columns)
    return run


CLOSING = "closing"


def closed_stream(spark: SparkSession, d: str) -> DataFrame:
    """All messages, and one of a session of its own long after them, which moves the watermark past all."""
    base = common.fresh_dir(spark, "closing")
    events = table(spark, d, "events")
    events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"),
        (F.coalesce(F.col("ts").cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))
         + F.expr("interval 1 year")).alias("ts"), F.lit(CLOSING).alias("session_id"),
        F.lit("").alias("text")).write.parquet(base + "/last.parquet")
    last = streams.table_stream(spark, base, "last")
    return message_stream(spark, d).unionByName(last)


def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    base = common.fresh_dir(spark, "stream")
    found = streams.stream_sessions(closed_stream(spark, d)).withColumn(
        "started", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return streams.run_to_table(found, base + "/out", base + "/state").filter(
        F.col("session_id") != CLOSING).select(
        "session_id", "started", "n_messages", "n_items", "n_protected", "n_local", "n_cloud", "on_device_pct")


def live_vault(spark: SparkSession, d: str) -> DataFrame:
    base = common.fresh_dir(spark, "stream")
    streams.stream_vault(message_stream(spark, d), base + "/vault", base + "/state",
        common.QUERY_SALT).awaitTermination()
    return shown(vault_table.read_vault(spark, base + "/vault"))


def shown(vault: DataFrame) -> DataFrame:
    return vault.select("session_id", "pii_type", "real", "synthetic", F.date_format(
        "first_seen_ts", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


def one_session(messages: DataFrame) -> DataFrame:
    """All messages in one session, so that many real values meet in one synthetic value."""
    return messages.withColumn("session_id", F.lit("one"))


def live_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Messages redacted batch by batch with names from the vault, and restored from it.

    The events come in four batches; the last one is run twice, as after a failure.
    """
    base = common.fresh_dir(spark, "stream")
    table(spark, d, "events").repartitionByRange(4, "ts").write.parquet(base + "/events.parquet")

    def stream() -> DataFrame:
        return one_session(as_messages(streams.table_stream(
            spark, base, "events", {"maxFilesPerTrigger": "1"})))
    streams.stream_redact_with_vault(stream(), base + "/out", base + "/vault", base + "/state",
        common.QUERY_SALT).awaitTermination()
    sanitized = spark.read.parquet(base + "/out")
    last = sanitized.agg(F.max("batch_id")).first()[0]
    if last is not None:
        again = one_session(as_messages(table(spark, d, "events"))).join(
            sanitized.filter(F.col("batch_id") == last).select("event_id"), "event_id", "left_semi")
        streams.redact_batch(again, last, base + "/out", base + "/vault", common.QUERY_SALT)
    out = spark.read.parquet(base + "/out").select("event_id", "session_id", "sanitized")
    return restore.restore_keyed(out, vault_table.read_vault(spark, base + "/vault"), "event_id",
                                 text_col="sanitized").select("event_id", "restored")


def live_vault_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """A vault kept by a stream, without one of its sessions."""
    base = common.fresh_dir(spark, "stream")
    streams.stream_vault(message_stream(spark, d), base + "/vault", base + "/state",
        common.QUERY_SALT).awaitTermination()
    vault_table.delete_session(spark, base + "/vault", DELETED)
    return shown(vault_table.read_vault(spark, base + "/vault"))


def register(c: Catalog) -> None:
    c.add("live_redacted_messages", live(lambda m: streams.stream_redact(m, common.QUERY_SALT), "append", "event_id", "sanitized"),
          with_([*KEYED, spliced_cte()], "select doc_id as event_id, sanitized from sanitized"))
    c.add("live_dashboard", live(lambda m: streams.stream_dashboard(m).withColumn(
        "day", F.date_format("window_start", "yyyy-MM-dd")), "update", "day", "pii_type", "n_items",
        keys=("window_start", "pii_type")),
        with_(CTES, "select strftime(ts, '%Y-%m-%d') as day, pii_type, count(*) as n_items "
              "from spans join src using (doc_id) group by all"))
    # An item counts in both windows of a day that begin in the 24 hours before it, noon and midnight.
    by_route = ("pii_type", "route")
    c.add("live_dashboard_by_route", live(lambda m: streams.stream_dashboard(
        m, "24 hours", "12 hours", by=by_route).withColumn(
        "opened", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")), "update", "opened", *by_route, "n_items",
        keys=("window_start", *by_route)),
        with_([*CTES, *RULES], "select strftime(w.opened, '%Y-%m-%d %H:%M:%S') as opened, pii_type, route, "
              "count(*) as n_items from (select pii_type, route, unnest([time_bucket(interval 12 hours, "
              "cast(ts as timestamp), timestamp '1970-01-01'), time_bucket(interval 12 hours, cast(ts as timestamp), "
              "timestamp '1970-01-01') - interval 12 hours]) as opened from spans join ruled using (doc_id)) w "
              "group by all"))
    # 30-minute gaps start a new session of activity.
    c.add("live_sessions", live_sessions, with_(
        [*CTES, *RULES, "counted as (select s.doc_id, s.session_id, s.ts, s.route, count(x.value) as n from "
         "ruled s left join spans x using (doc_id) group by all)",
         "gaps as (select *, case when ts - lag(ts) over (partition by session_id order by ts) "
         "< interval 30 minutes then 0 else 1 end as opens from counted)",
         "numbered as (select *, sum(opens) over (partition by session_id order by ts) as k from gaps)"],
        "select session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as started, count(*) as n_messages, "
        "cast(sum(n) as bigint) as n_items, count(*) filter (n > 0) as n_protected, "
        "count(*) filter (route = 'local') as n_local, count(*) filter (route = 'cloud') as n_cloud, "
        "cast(floor(100 * count(*) filter (route = 'local') / count(*)) as integer) as on_device_pct "
        "from numbered group by session_id, k"))
    # Values of a session that share a synthetic value are numbered.
    rows = ("select session_id, pii_type, value as real, synthetic || case when n > 0 then '~' || cast(n as "
            "varchar) else '' end as synthetic, first_seen from (select *, row_number() over (partition by "
            "session_id, synthetic order by sha256(pii_type || '|' || value)) - 1 as n from (select n.session_id, "
            "pii_type, value, any_value(synthetic) as synthetic, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as "
            "first_seen from named n join src using (doc_id) group by all) d) r")
    c.add("live_vault_round_trip", live_round_trip, with_(
        [SRC_MESSAGES], "select doc_id as event_id, text as restored from src"))
    c.add("live_vault", live_vault, with_(KEYED, rows))
    c.add("live_vault_after_delete", live_vault_after_delete, with_(
        KEYED, f"select * from ({rows}) v where session_id <> '{DELETED}'"))
