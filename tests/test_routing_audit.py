import pytest
from pyspark.sql import functions as F

from samples import WAGES
from veilspan.operators import audit, redact, routing
from veilspan.operators.detect import explode_spans, with_regex_spans, with_resolved_spans
from veilspan.sources.tables import build_query, dims, doc_sizes

FALLBACK = ("general", "high", "complex", "cloud")


@pytest.mark.parametrize("response, want", [
    ('{"agent":"admin","pii_risk":"low","complexity":"simple","route":"local"}',
     ("admin", "low", "simple", "local")),
    ('Sure!\n```{"agent":"research","pii_risk":"medium","complexity":"moderate",\n"route":"cloud"}``` ok',
     ("research", "medium", "moderate", "cloud")),
    ('{"agent":"admin"}', ("admin", "high", "complex", "cloud")),
    ('{"agent":"wizard","pii_risk":"low","complexity":3,"route":null}', ("general", "low", "complex", "cloud")),
    ('{"agent":"admin"} or {"agent":"general"}', FALLBACK),
    ('{"agent":"admin"}, {"agent":"general"}', FALLBACK),
    ('{"agent":"admin"} and }', FALLBACK),
    ("{'agent':'admin'}", FALLBACK), ("} {", FALLBACK), ("none", FALLBACK), ("", FALLBACK),
    ("[API not set]", FALLBACK), (None, FALLBACK),
])
def test_router_responses(spark, response, want):
    df = spark.createDataFrame([("q", response)], "text string, response string")
    row = routing.route(df).first()
    assert (row.agent, row.pii_risk, row.complexity, row.route) == want


@pytest.mark.parametrize("query, want", [
    ("What's 18% tip on a $85 dinner?", ("general", "low", "simple", "local")),
    ("Compare the best 3 kettles under $350.", ("research", "low", "complex", "cloud")),
    ("My SSN is 612-45-9083. Is my tax done?", ("admin", "high", "simple", "cloud")),
    ("Write to ann@mail.example.org", ("general", "medium", "simple", "cloud")),
    ("word " * 60, ("general", "low", "moderate", "cloud")),
    ("word " * 101, ("general", "low", "complex", "cloud")),
])
def test_rules(spark, query, want):
    df = spark.createDataFrame([(query, None)], "text string, response string")
    for mode in ("rules", "model_then_rules"):
        row = routing.route(df, mode=mode).first()
        assert (row.agent, row.pii_risk, row.complexity, row.route) == want


def test_previews_and_queries(spark):
    long = "a\n" * 40
    df = spark.createDataFrame([("short\nline",), (long,)], "text string")
    got = [r.preview for r in routing.query_previews(df).collect()]
    assert got == ["short\nline", "a " * 35 + "..."]
    row = build_query(df, "Do it.", head_chars=5).first()
    assert row.query == "Do it.\n\nshort"
    sized = doc_sizes(df.withColumn("doc_id", F.lit(1)).withColumn("text", F.lit("x" * 1234))).first()
    assert (sized.n_chars, sized.n_chars_shown) == (1234, "1,234")


def test_session_summary(spark):
    df = spark.createDataFrame([("s", "local"), ("s", "cloud"), ("s", "cloud"), ("t", "local")],
                               "session_id string, route string")
    rows = {r.session_id: r for r in audit.session_summary(df).collect()}
    assert (rows["s"].total, rows["s"].local, rows["s"].cloud, rows["s"].on_device_pct) == (3, 1, 2, 33)
    assert rows["t"].on_device_pct == 100


def test_a_planted_leak_is_caught(docs):
    df = redact.with_mappings(redact.redact_keyed(with_resolved_spans(with_regex_spans(docs(WAGES)))))
    vault = df.select("session_id", F.explode("mappings").alias("m")).select(
        "session_id", "m.pii_type", "m.real", "m.synthetic")
    out = df.withColumn("clean", F.col("sanitized")).withColumn(
        "leaky", F.concat("sanitized", F.lit("\nSSN again: 612-45-9083")))
    found = audit.leak_check(out, vault, ["clean", "leaky"]).collect()
    assert [(r.outbound, r.pii_type, r.value, r.n_texts) for r in found] == [
        ("leaky", "SSN", "612-45-9083", 1)]
    own = audit.own_leaks(out, ["clean", "leaky", "text"]).first()
    assert (own.clean_leaks, own.leaky_leaks, own.text_leaks) == (0, 1, 12)


def test_leaks_of_values_that_only_the_model_knew(spark):
    vault = spark.createDataFrame([("PERSON_NAME", "Ann  O'Neil"), ("EMPLOYER", "Acme"), ("X", "--"),
                                   ("SSN", "612-45-9083")], "pii_type string, real string")
    out = spark.createDataFrame([("met ann o'neil, twice: Ann O'Neil", "fine"), ("acmes", None), ("Joann O'Neil", "acme")],
                                "a string, b string")
    found = {(r.outbound, r.value, r.n_texts) for r in audit.value_leaks(out, vault, ["a", "b"]).collect()}
    assert found == {("a", "Ann  O'Neil", 1), ("b", "Acme", 1)}
    assert audit.value_leaks(out, vault.limit(0), ["a"]).count() == 0
    plan = audit.value_leaks(out, vault, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_counts_and_density(docs):
    found = with_regex_spans(docs(WAGES, WAGES))
    exact = audit.item_counts(explode_spans(found, ("session_id",)), ["session_id"]).first()
    assert (exact.n_items, exact.n_distinct) == (26, 12)
    about = audit.item_counts(explode_spans(found, ("session_id",)), ["session_id"], exact=False).first()
    assert about.n_items == 26 and 11 <= about.n_distinct <= 13
    totals = audit.density(found, "doc_id").filter("level = 3").first()
    assert totals.n_items == 26


def test_reports(spark, docs):
    types = dims(spark)["pii_type"]
    spans = explode_spans(with_regex_spans(docs("Name: Ann Lee")))
    assert audit.render_spans(spans, types).first().line == \
        "🟡 Name       'Ann Lee' (conf=1.00) [regex]"
    vault = spark.createDataFrame([("s", "SSN", "r" * 40, "x")],
                                  "session_id string, pii_type string, real string, synthetic string")
    row = audit.mapping_report(vault, types).first()
    assert (row.label, row.real_shown) == ("SSN", "r" * 30)
    metrics = spark.createDataFrame([("a", "route", 1.5), ("a", "pii", 2.0), ("a", "pii", 0.5)],
                                    "run_id string, stage string, seconds double")
    got = audit.stage_metrics(metrics).first()
    assert (got.route, got.pii, got.cloud, got.total) == (1.5, 2.5, None, 4.0)
    views = spark.createDataFrame([(1, None, None), (2, "x" * 700, "")],
                                  "doc_id int, restored string, response string")
    rows = {r.doc_id: r for r in audit.side_by_side(views).collect()}
    assert rows[1].user_sees == rows[2].cloud_saw == audit.NO_RESPONSE
    assert len(rows[2].user_sees) == 600
