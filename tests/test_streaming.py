import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from veilspan.operators.detect import with_regex_spans, with_resolved_spans
from veilspan.operators.redact import redact_keyed
from veilspan.sources import vault_table
from veilspan.streaming import redaction as streams

SCHEMA = "event_id bigint, ts timestamp, session_id string, text string"
DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


ROWS = [(1, at(0), "s", "mail ann@mail.example.org"), (2, at(5), "s", "SSN 612-45-9083"),
        (3, at(50), "s", "SSN 612-45-9083 again"), (4, at(7), "t", "nothing")]


@pytest.fixture()
def folder(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(ROWS)
    return tmp_path, add


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))


def test_stream_equals_batch(spark, folder):
    path, _ = folder
    live = streams.run_to_table(streams.stream_redact(stream(spark, path)), str(path / "out"), str(path / "cp"))
    batch = redact_keyed(with_resolved_spans(with_regex_spans(
        spark.read.schema(SCHEMA).parquet(str(path / "in")))))
    rows = live.select("event_id", "sanitized").collect()
    assert sorted(rows) == sorted(batch.select("event_id", "sanitized").collect())
    assert not any("612-45-9083" in r.sanitized for r in rows)


def test_windows_close_and_late_rows_are_dropped(spark, folder):
    path, add = folder
    out, state = str(path / "out"), str(path / "cp")

    def run():
        return streams.run_to_table(streams.stream_dashboard(stream(spark, path), "30 minutes"), out, state)
    assert run().count() <= 2
    add([(9, at(60 * 24), "s", "SSN 123-45-6789")])   # moves the watermark on
    run()
    add([(10, at(1), "s", "SSN 123-45-6789")])        # far too late
    rows = {(r.window_start, r.pii_type): r.n_items for r in run().collect()}
    assert rows == {(at(0), "EMAIL"): 1, (at(0), "SSN"): 1, (at(30), "SSN"): 1}


def test_sessions_of_activity(spark, folder):
    path, add = folder
    add([(8, at(60 * 24 * 9), "closing", "")])

    def run():
        return streams.run_to_table(streams.stream_sessions(stream(spark, path)), str(path / "out"), str(path / "cp"))
    run()
    rows = {(r.session_id, r.session_start): (r.n_messages, r.n_items, r.n_protected, r.n_local, r.n_cloud,
                                              r.on_device_pct) for r in run().collect()}
    assert rows == {("s", at(0)): (2, 2, 2, 0, 2, 0), ("s", at(50)): (1, 1, 1, 0, 1, 0),
                    ("t", at(7)): (1, 0, 0, 1, 0, 100)}


def test_sliding_windows_by_route_are_upserted(spark, folder):
    path, add = folder
    out, state = str(path / "out"), str(path / "cp")
    keys = ("window_start", "pii_type", "route")

    def run():
        df = streams.stream_dashboard(stream(spark, path), "30 minutes", "15 minutes", by=keys[1:])
        return {tuple(r[k] for k in keys): r.n_items
                for r in streams.run_to_table(df, out, state, "update", keys).collect()}
    expected = {(at(-15), "EMAIL", "cloud"): 1, (at(0), "EMAIL", "cloud"): 1, (at(-15), "SSN", "cloud"): 1,
                (at(0), "SSN", "cloud"): 1, (at(30), "SSN", "cloud"): 1, (at(45), "SSN", "cloud"): 1}
    assert run() == expected
    add([(30, at(52), "s", "SSN 612-45-9083 once more")])
    expected |= {(at(30), "SSN", "cloud"): 2, (at(45), "SSN", "cloud"): 2}
    assert run() == expected
    # A batch that is written again changes nothing.
    last = spark.read.parquet(out)
    again = last.filter(F.col("batch_id") == last.agg(F.max("batch_id")).first()[0])
    rows = again.drop("batch_id").collect()
    streams.upsert_rows(spark.createDataFrame(rows, again.drop("batch_id").schema), again.first().batch_id, out)
    assert run() == expected
    add([(31, at(60 * 48), "s", "SSN 612-45-9083")])
    run()
    add([(32, at(3), "s", "SSN 777-45-9083")])  # far too late: its windows are closed
    expected |= {(at(60 * 48), "SSN", "cloud"): 1, (at(60 * 48 - 15), "SSN", "cloud"): 1}
    assert run() == expected
    with pytest.raises(ValueError):
        streams.run_to_table(streams.stream_redact(stream(spark, path)), out, state, "complete")


def test_vault_upkeep_survives_a_replay(spark, folder):
    path, add = folder
    vault, state = str(path / "vault"), str(path / "cp")
    streams.stream_vault(stream(spark, path), vault, state).awaitTermination()
    add([(5, at(90), "s", "SSN 612-45-9083 and SSN 777-45-9083"), (6, at(91), "t", "SSN 612-45-9083")])
    streams.stream_vault(stream(spark, path), vault, state).awaitTermination()

    def rows():
        return sorted((r.session_id, r.real, r.synthetic, r.first_seen_ts)
                      for r in vault_table.read_vault(spark, vault).collect())
    before = rows()
    assert [(s, r) for s, r, *_ in before] == [
        ("s", "612-45-9083"), ("s", "777-45-9083"), ("s", "ann@mail.example.org"), ("t", "612-45-9083")]
    assert before[0][3] == at(5)
    second = spark.read.schema(SCHEMA).parquet(str(path / "in")).filter("event_id >= 5")
    streams.upsert_batch(second, 1, vault)
    assert rows() == before
    assert streams.vault_collisions(spark, vault).count() == 0


def test_deleted_session_of_a_stream_vault(spark, folder):
    path, add = folder
    vault, state = str(path / "vault"), str(path / "cp")
    streams.stream_vault(stream(spark, path), vault, state).awaitTermination()
    assert vault_table.read_session(spark, vault, "s").count() == 2
    vault_table.delete_session(spark, vault, "s")
    assert vault_table.read_vault(spark, vault).count() == 0
    add([(7, at(95), "s", "SSN 777-45-9083"), (8, at(96), "t", "SSN 612-45-9083")])
    streams.stream_vault(stream(spark, path), vault, state).awaitTermination()
    rows = sorted((r.session_id, r.real) for r in vault_table.read_vault(spark, vault).collect())
    assert rows == [("s", "777-45-9083"), ("t", "612-45-9083")]
    vault_table.delete_session(spark, vault, "t")
    assert [r.real for r in vault_table.read_vault(spark, vault).collect()] == ["777-45-9083"]


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_reads_files_and_folders(spark, tmp_path, parts):
    df = spark.range(1000).select(F.col("id").alias("event_id"))
    target = str(tmp_path / "events.parquet")
    if parts:
        df.repartition(parts).write.parquet(target)
    else:
        df.toPandas().to_parquet(target)
    spark.range(5).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events_old.parquet"))
    out = streams.run_to_table(streams.table_stream(spark, str(tmp_path), "events"), str(tmp_path / "out"),
                               str(tmp_path / "cp"))
    assert out.count() == 1000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vault_rows(spark, n, session="s", first=0):
    rows = [(session, "SSN", f"real {i}", f"base {i % 7}", DAY) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "session_id string, pii_type string, real string, synthetic string, "
                                       "first_seen_ts timestamp")


def test_an_upsert_reads_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "vault")
    for i in range(4):
        vault_table.upsert(vault_rows(spark, 5, f"s{i}"), path, buckets=16)
    buckets = vault_table.buckets_of(spark, path)
    assert buckets == 16
    # Sessions never seen: their keys have no bits, and no row is read at all.
    unknown = vault_table.tested(vault_rows(spark, 50, "new"), path, buckets)
    assert unknown.filter("real_maybe or base_maybe").count() == 0
    assert "parquet" not in plan(vault_table.maybe_known(unknown, path))
    known = vault_table.tested(vault_rows(spark, 5, "s3"), path, buckets)
    assert known.filter("real_maybe and base_maybe").count() == 5
    own = known.first().bucket
    rows = vault_table.maybe_known(known, path)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan(rows)) and rows.count() == 5
    read = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]
    assert read and all(f"/bucket={own}/" in f for f in read)


def test_a_second_upsert_keeps_names_and_stays_injective(spark, tmp_path):
    path = str(tmp_path / "vault")
    vault_table.upsert(vault_rows(spark, 14), path)
    before = {r.real: r.synthetic for r in vault_table.read_vault(spark, path).collect()}
    added = vault_table.upsert(vault_rows(spark, 30), path)
    after = {r.real: r.synthetic for r in vault_table.read_vault(spark, path).collect()}
    assert added.count() == 16 and len(after) == 30 == len(set(after.values()))
    assert all(after[k] == v for k, v in before.items())
    assert sorted(v for v in after.values() if v.startswith("base 2")) == ["base 2"] + [f"base 2~{i}" for i in range(1, 4)]
    assert vault_table.upsert(vault_rows(spark, 30), path).count() == 0
    vault_table.write_vault(vault_rows(spark, 3, "other"), path, mode="overwrite")
    assert vault_table.upsert(vault_rows(spark, 4, "other"), path).count() == 1
    assert vault_table.read_vault(spark, path).count() == 4


def test_a_writer_that_breaks_off_leaves_no_key_that_looks_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vault")
    vault_table.upsert(vault_rows(spark, 3), path, 0)

    def broken(*args):
        raise RuntimeError("executor lost")
    monkeypatch.setattr(vault_table, "_bucketed", broken)
    with pytest.raises(RuntimeError):
        vault_table.upsert(vault_rows(spark, 9), path, 1)
    monkeypatch.undo()
    vault_table.upsert(vault_rows(spark, 9), path, 1)  # the replay of the batch
    vault_table.upsert(vault_rows(spark, 9), path, 2)
    assert vault_table.read_vault(spark, path).count() == 9


def test_redacting_a_stream_with_names_that_collide(spark, folder):
    from veilspan.functions.synth import keyed_value
    from veilspan.operators.restore import restore_keyed
    path, add = folder
    # Two SSNs of one session with the same keyed value.
    numbers = spark.range(300_000).select(F.concat_ws("-", F.lit("612"), F.lpad((F.col("id") % 90 + 10).cast("string"), 2, "0"),
                                                     F.lpad((F.col("id") % 10000).cast("string"), 4, "0")).alias("v")).distinct()
    named = numbers.select("v", keyed_value("change-me", F.lit("s"), F.lit("INCOME_AMOUNT"), F.concat(
        F.lit("$1,"), F.substring("v", -3, 3))).alias("k"), F.concat(F.lit("$1,"), F.substring("v", -3, 3)).alias("real"))
    pair = (named.select("k", "real").distinct().groupBy("k").agg(F.sort_array(F.collect_set("real")).alias("r"))
            .filter(F.size("r") > 1).orderBy("k").first().r)
    add([(20, at(60), "s", f"paid {pair[0]} today"), (21, at(61), "t", f"paid {pair[1]} today")])
    out, vault, state = (str(path / p) for p in ("out", "vault", "cp"))

    def run():
        streams.stream_redact_with_vault(stream(spark, path), out, vault, state).awaitTermination()
        return spark.read.parquet(out)
    run()
    add([(22, at(90), "s", f"paid {pair[1]} today, {pair[0]} before")])
    texts = run()
    rows = {r.event_id: r.sanitized for r in texts.collect()}
    assert rows[22].count("~1") == 1 and "~" not in rows[20] and "~" not in rows[21]

    def restored():
        back = restore_keyed(spark.read.parquet(out), vault_table.read_vault(spark, vault), "event_id", "sanitized")
        return {r.event_id: r.restored for r in back.collect()}
    source = {r.event_id: r.text for r in spark.read.schema(SCHEMA).parquet(str(path / "in")).collect()}
    assert restored() == source
    # A replayed batch writes what it wrote, though later batches are in the vault.
    first = spark.read.schema(SCHEMA).parquet(str(path / "in")).filter("event_id < 22")
    streams.redact_batch(first, 0, out, vault)
    assert {r.event_id: r.sanitized for r in spark.read.parquet(out).collect()} == rows
    assert restored() == source and streams.vault_collisions(spark, vault).count() == 0
