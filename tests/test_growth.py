"""Work over larger tables is spread over tasks and does not depend on estimated sizes."""

import os

from pyspark.sql import functions as F

from veilspan.operators import audit, redact, restore
from veilspan.operators.detect import explode_spans, with_regex_spans
from veilspan.operators.vault import VAULT_SCHEMA
from veilspan.plans import common, redaction, restoration
from veilspan.session import shared_dir
from veilspan.sources import vault_table
from veilspan.sources.tables import ROWS_A_TASK


def customers(spark, folder, n):
    """A customer table of one file and row group, with keys that are null or repeat."""
    spark.range(n).select(
        F.when(F.col("id") % 10 > 0, F.col("id") % 3000).alias("c_custkey"),
        F.concat(F.lit("Customer#"), "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.col("id").cast("double").alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"),
    ).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_forms_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    n = 3 * ROWS_A_TASK + 5
    found = common.answered(spark, customers(spark, tmp_path, n))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) == 4 and max(sizes) <= ROWS_A_TASK + 8
    assert found.filter("doc_id = 7").count() == sum(1 for i in range(n) if i % 10 and i % 3000 == 7)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_of_words_are_made_once(spark):
    vault = spark.createDataFrame([("EMPLOYER", "Acme Works"), ("SSN", "612-45-9083")], "pii_type string, real string")
    out = spark.createDataFrame([("at ACME works", 1), (None, 2), ("", 3)], "a string, i int")
    found = audit.value_leaks(out, vault, ["a"])
    # No filter on the number of runs, for which they would be made a second time.
    assert executed(found).count("array_distinct(") == 1
    assert "Broadcast" not in executed(found)
    assert [tuple(r) for r in found.collect()] == [("a", "EMPLOYER", "Acme Works", 1)]


def test_found_values_are_counted_before_they_meet_the_vault(spark, docs):
    out = docs("SSN 612-45-9083", "SSN 612-45-9083, 612-45-9084", None)
    vault = spark.createDataFrame([("612-45-9083",), ("612-45-9083",), (None,)], "real string")
    found = audit.leak_check(out, vault, ["text"])
    text = executed(found)
    assert "LeftSemi" not in text and "Broadcast" not in text
    assert [(r.outbound, r.pii_type, r.value, r.n_texts) for r in found.collect()] == [
        ("text", "SSN", "612-45-9083", 2)]


def test_texts_and_spans_that_seem_small_are_not_broadcast(spark, docs, tmp_path):
    docs("SSN 612-45-9083 and 612-45-9084", "nothing", None).write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    found = explode_spans(with_regex_spans(texts))
    maps = redact.assign_synthetic(found, "ordinal", "s")
    rewritten = redact.redact(texts, found, maps)
    assert "Broadcast" not in executed(rewritten)
    rows = {r.doc_id: r.sanitized for r in rewritten.collect()}
    assert "612-45" not in rows[0] and rows[1] == "nothing" and rows[2] is None
    back = restore.restore(rewritten, maps, text_col="sanitized")
    assert "Broadcast" not in executed(back.select("restored"))
    assert {r.doc_id: r.restored for r in back.collect()} == {r.doc_id: r.text for r in texts.collect()}


def test_forms_that_seem_small_are_not_broadcast_to_their_redacted_texts(spark, tmp_path):
    folder = customers(spark, tmp_path, 60)
    found = restoration.ordinal_round_trip(spark, folder)
    assert "Broadcast" not in executed(found)
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == found.count() == 54 and None not in rows
    texts = {r.doc_id: r.text for r in common.forms(spark, folder).collect()}
    back = restore.restore(redaction.ordinal_redacted(spark, folder), redaction.ordinal(spark, folder),
                           text_col="sanitized")
    restored = {r.doc_id: r.restored for r in back.collect() if r.doc_id is not None}
    assert {k: r.is_equal for k, r in rows.items()} == {k: restored[k] == texts[k] for k in rows}
    assert all(r.n_mappings > 5 for r in rows.values())


def test_both_upserts_use_spans_found_once(spark, tmp_path, monkeypatch):
    resolved, calls = common.resolved, []
    monkeypatch.setattr(common, "resolved", lambda df: calls.append(df) or resolved(df))
    folder = customers(spark, tmp_path, 60)
    out = {(r.pii_type, r.real): r.synthetic for r in restoration.second_upsert(spark, folder).collect()}
    assert len(calls) == 1
    texts = common.forms(spark, folder).withColumn("session_id", F.lit("one"))
    found = explode_spans(resolved(texts), ("session_id",))
    want = {(r.pii_type, r.real): r.synthetic for r in redact.assign_synthetic(found, salt=common.QUERY_SALT).collect()}
    assert out.keys() == want.keys() and len(set(out.values())) == len(out)
    assert all(v.split("~")[0] == want[k] for k, v in out.items())


def test_an_upsert_keeps_new_rows_once(spark, tmp_path, monkeypatch):
    def kept():
        shared_dir(spark)
        at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return {f for f in os.listdir(at) if f.startswith("rdd-")}

    rename, known = vault_table.rename_collisions, []
    monkeypatch.setattr(vault_table, "rename_collisions", lambda vault, new: known.append(vault) or rename(vault, new))
    rows = [("s", "SSN", r, f"b{(r or '')[-1:]}", None) for r in ("1", "2", "11", "", None, "1")]
    before = kept()
    added = vault_table.upsert(spark.createDataFrame(rows, VAULT_SCHEMA), str(tmp_path / "vault"))
    assert len(kept() - before) == 1
    # The side without rows is one that Spark knows to be empty.
    assert executed(known[0]).startswith("LocalTableScan <empty>")
    names = {r.real: r.synthetic for r in added.collect()}
    assert names.keys() == {"1", "2", "11", "", None} and len(set(names.values())) == 5


def test_vault_of_one_type_names_no_other_spans(spark, tmp_path, monkeypatch):
    named, given = common.with_keyed_spans, []
    monkeypatch.setattr(common, "with_keyed_spans", lambda df, salt: given.append(df) or named(df, salt))
    folder = customers(spark, tmp_path, 60)
    every = {tuple(r) for r in common.keyed_vault(spark, folder).collect()}
    for pii_type, name in redaction.GENERATORS.items():
        given.clear()
        rows = redaction.keyed_of(pii_type)(spark, folder).collect()
        types = given[0].select(F.explode("spans.pii_type").alias("t")).distinct().collect()
        assert [r.t for r in types] == [pii_type], name
        assert sorted(map(tuple, rows)) == sorted((r[0], r[2], r[3]) for r in every if r[1] == pii_type)
