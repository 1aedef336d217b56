import re

import pytest
from pyspark.sql import functions as F

from samples import HEALTH, LEASE, WAGES
from veilspan.functions import fixed_values as fv
from veilspan.functions.synth import keyed_value
from veilspan.operators import redact, restore, vault
from veilspan.operators.detect import explode_spans, with_regex_spans, with_resolved_spans
from veilspan.sources import vault_table


def resolved(df):
    return with_resolved_spans(with_regex_spans(df))


def ordinal(df):
    spans = explode_spans(resolved(df), ("doc_id", "session_id"))
    maps = redact.assign_synthetic(spans, "ordinal")
    return maps, redact.redact(df, spans, maps)


def test_ordinals_run_from_the_right(docs):
    maps, out = ordinal(docs(WAGES, "no data"))
    by_real = {r.real: r.synthetic for r in maps.collect()}
    assert by_real["900 Harbor View Blvd, Ostend, ME 04401"] == fv.ORDINAL_POOLS["ADDRESS"][0]
    assert by_real["77 Quarry Path, Lindale, TX 75771"] == fv.ORDINAL_POOLS["ADDRESS"][1]
    assert by_real["ada.brandt@mail.example.org"] == "synthetic.user1@placeholder.com"
    assert by_real["11/02/1979"] == fv.ORDINAL_DATE
    assert len(by_real) == 12
    texts = {r.doc_id: r.sanitized for r in out.collect()}
    assert texts[1] == "no data"
    assert not any(real in texts[0] for real in by_real)
    pay = float(re.search(r"Pay: \$([\d,]+)", texts[0])[1].replace(",", ""))
    assert 0.88 * 98250 - 1 <= pay <= 1.12 * 98250


def test_pools_wrap_and_dates_collide(docs):
    names = "\n".join(f"Name: Ann {chr(65 + i)}oe" for i in range(9))
    maps, _ = ordinal(docs(names, HEALTH))
    rows = maps.collect()
    assert len({r.synthetic for r in rows if r.doc_id == 0}) == 8
    seen = vault.collisions(maps.select(
        F.col("doc_id").cast("string").alias("session_id"), "real", "synthetic"))
    assert {(r.session_id, r.n_reals) for r in seen.collect()} == {("0", 2), ("1", 2)}


@pytest.mark.parametrize("pii_type, real, shape", [
    ("SSN", "612-45-9083", r"[1-8]\d\d-\d\d-\d{4}"),
    ("INCOME_AMOUNT", "$50k", r"\[REDACTED-[0-9a-f]{8}\]"),
    ("INCOME_AMOUNT", "$ 1,000,000", r"\$(8[89]|9\d|1,0\d|1,1[012])\d?,?\d{0,3},?\d{3}"),
    ("INCOME_AMOUNT", "$" + ",".join(["999"] * 12), r"\[REDACTED-[0-9a-f]{8}\]"),
    ("DATE_OF_BIRTH", "02/31/2001", r"\d\d/\d\d/19[3-9]\d"),
    ("DATE_OF_BIRTH", "June 1, 2026", r"\d\d/\d\d/20(2[1-9]|3[01])"),
    ("DATE_OF_BIRTH", "soon", r"\d\d/\d\d/19[3-9]\d"),
    ("ACCOUNT_NUMBER", "1234567890123", r"[1-9]\d{12}"),
    ("ACCOUNT_NUMBER", "MED-12", r"[1-9]\d{7}"),
    ("PERSON_NAME", "Ann Lee", r"[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+ [A-Z][a-z]+"),
    ("PHONE", "x", r"\(\d{3}\) 555-\d{4}"),
    ("EMAIL", "x", r"user\.[0-9a-f]{12}@placeholder\.com"),
])
def test_keyed_values(spark, pii_type, real, shape):
    value = keyed_value("salt", F.lit("s"), F.lit(pii_type), F.lit(real))
    other = keyed_value("pepper", F.lit("s"), F.lit(pii_type), F.lit(real))
    row = spark.range(1).select(value.alias("a"), value.alias("b"), other.alias("c")).first()
    assert re.fullmatch(shape, row.a) and row.a == row.b and row.a != row.c


def test_keyed_redaction_and_back(docs):
    df = redact.with_mappings(redact.redact_keyed(resolved(docs(WAGES, HEALTH, LEASE, "", "none"))))
    back = restore.restore(df, text_col="sanitized")
    for r in back.collect():
        assert r.restored == r.text
        assert not any(m.real in r.sanitized for m in r.mappings)
    trip = restore.round_trip(back).collect()
    assert all(r.is_equal and r.has_all_reals for r in trip)


def test_join_and_projection_redact_alike(docs):
    df = docs(WAGES, HEALTH, LEASE, "none")
    spans = explode_spans(resolved(df), ("doc_id", "session_id"))
    joined = redact.redact(df, spans, redact.assign_synthetic(spans), on=("session_id", "pii_type"))
    narrow = redact.redact_keyed(resolved(df))
    assert sorted(joined.select("doc_id", "sanitized").collect()) == sorted(
        narrow.select("doc_id", "sanitized").collect())


def chain(spark, text, *pairs):
    df = spark.createDataFrame([(text, [(i, "X", r, s) for i, (r, s) in enumerate(pairs)])],
                               "response string, mappings array<struct<ord:int,pii_type:string,"
                               "real:string,synthetic:string>>")
    return restore.restore(df).first().restored


def test_restore_chain(spark):
    assert chain(spark, "Marcus Chen and Marcus's dog", ("Ann Lee", "Marcus Chen")) \
        == "Ann Lee and Ann's dog"
    # The longer value goes first; what it brings in may be replaced again.
    assert chain(spark, "AB A", ("x", "A"), ("A", "AB")) == "x x"
    assert chain(spark, "Jo's Al's", ("Ann", "Jo B"), ("Bo", "Ali")) == "Jo's Al's"
    assert chain(spark, "tab's", ("r q", "tab\tx")) == "r's"
    assert chain(spark, "nothing") == "nothing"


def mappings(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                                 "session_id string, pii_type string, real string, synthetic string, "
                                 "first_seen_ts int").withColumn(
        "first_seen_ts", F.col("first_seen_ts").cast("timestamp"))


def test_first_mapping_stays(spark):
    old = mappings(spark, [("s", "SSN", "r1", "a")])
    new = mappings(spark, [("s", "SSN", "r1", "b"), ("s", "SSN", "r2", "c"), ("s", "SSN", "r2", "d"),
                           ("t", "SSN", "r1", "e")])
    out = vault.vault_upsert(old, new, vault.BY_REAL, injective=False)
    assert sorted((r.session_id, r.real, r.synthetic) for r in out.collect()) == [
        ("s", "r1", "a"), ("s", "r2", "c"), ("t", "r1", "e")]


def test_renaming_makes_the_vault_injective(spark):
    first = vault.vault_upsert(mappings(spark, []), mappings(spark, [
        ("s", "X", f"r{i}", "same") for i in range(5)]))
    second = vault.vault_upsert(first, mappings(spark, [
        ("s", "X", f"q{i}", "same") for i in range(3)] + [("t", "X", "r0", "same")]))
    rows = second.collect()
    assert len(rows) == 9 and vault.collisions(second).count() == 0
    kept = {r.real: r.synthetic for r in first.collect()}
    assert all(kept[r.real] == r.synthetic for r in rows if r.real in kept and r.session_id == "s")
    assert {r.synthetic for r in rows if r.session_id == "t"} == {"same"}


def test_vault_table(spark, tmp_path):
    path = str(tmp_path / "vault")
    rows = mappings(spark, [("s", "SSN", "r1", "a"), ("t", "SSN", "r1", "b"), ("t", "SSN", "r2", "c")])
    vault_table.write_vault(rows.limit(1), path)
    vault_table.write_vault(rows.filter("session_id = 't'"), path)
    assert vault_table.read_vault(spark, path).count() == 3
    assert vault_table.read_session(spark, path, "t").count() == 2
    vault_table.delete_session(spark, path, "t")  # its bucket is empty now
    assert [r.session_id for r in vault_table.read_vault(spark, path).collect()] == ["s"]
    vault_table.delete_session(spark, path, "s")
    vault_table.delete_session(spark, path, "unknown")
    assert vault_table.read_vault(spark, path).count() == 0
    vault_table.write_vault(rows, path)
    assert vault_table.read_vault(spark, path).count() == 3


def test_restore_by_lookup_in_a_large_session(spark):
    texts = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("one").alias("session_id"),
        F.concat(F.lit("Patient: Ann M. "), F.expr("'Q' || translate(id, '0123456789', 'abcdefghij')"),
                 F.lit("\nSSN: 123-45-"), F.lpad(F.col("id").cast("string"), 4, "0"),
                 F.lit("\nBorn 02/03/"), (F.col("id") % 60 + 1930).cast("string")).alias("text"))
    spans = explode_spans(resolved(texts), ("doc_id", "session_id"))
    table = vault.vault_upsert(mappings(spark, []), redact.assign_synthetic(spans).withColumn(
        "first_seen_ts", F.lit("2024-01-01").cast("timestamp")))
    out = redact.redact(texts, spans, table, on=("session_id", "pii_type")).withColumnRenamed(
        "sanitized", "response").drop("text")
    back = restore.restore_keyed(out, table).join(texts.select("doc_id", "text"), "doc_id")
    assert back.filter("restored <> text").count() == 0 and back.count() == 400
    assert out.filter("response like '%123-45-%'").count() == 0


def test_texts_get_the_names_of_the_vault(spark, docs):
    from veilspan.operators.detect import with_regex_spans, with_resolved_spans
    from veilspan.operators.redact import redact_keyed, redact_with_vault
    from veilspan.operators.vault import VAULT_SCHEMA
    found = with_resolved_spans(with_regex_spans(docs("SSN 612-45-9083, 612-45-9083", "SSN 777-45-9083", "none")))
    plain = {r.doc_id: r.sanitized for r in redact_keyed(found).collect()}
    vault = spark.createDataFrame([("s", "SSN", "612-45-9083", "900-00-0000~1", None),
                                   ("t", "SSN", "777-45-9083", "900-00-0000~2", None)], VAULT_SCHEMA)
    out = {r.doc_id: r.sanitized for r in redact_with_vault(found, vault).collect()}
    assert out == {0: "SSN 900-00-0000~1, 900-00-0000~1", 1: plain[1], 2: "none"}
    assert {r.doc_id: r.sanitized for r in redact_with_vault(found, vault.limit(0)).collect()} == plain


def test_a_salt_must_be_given(spark, docs):
    df = resolved(docs("SSN 612-45-9083"))
    spark.conf.unset("veilspan.salt")
    try:
        for call in (lambda: redact.redact_keyed(df), lambda: redact.redact_ordinal(df),
                     lambda: redact.redact_keyed(df, "")):
            with pytest.raises(ValueError, match="salt"):
                call()
        one, two = (redact.redact_keyed(df, salt).first().sanitized for salt in ("a", "b"))
    finally:
        spark.conf.set("veilspan.salt", "change-me")
    assert one != two
