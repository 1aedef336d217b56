"""What is kept between runs: requests, sketches, and what redaction leaves open."""

from pyspark.sql import functions as F

from veilspan.operators import exposure, sketches
from veilspan.operators.detect import with_regex_spans
from veilspan.sources import request_table


def test_a_request_is_sent_once(spark, docs, tmp_path):
    path = str(tmp_path / "requests")
    first = request_table.send_new(docs("alpha", "beta", "alpha"), path, 1)
    assert sorted((r.prompt.count("alpha"), r.n_docs) for r in first.collect()) == [(0, 1), (1, 2)]
    more = docs("beta", "gamma", "gamma", None)
    second = request_table.send_new(more, path, 2)
    assert [r.n_docs for r in second.collect()] == [2] and "gamma" in second.first().prompt
    assert request_table.send_new(more, path, 3).count() == 0
    # A run that is repeated sends what it sent, not nothing.
    assert request_table.send_new(more, path, 2).count() == 1
    assert spark.read.parquet(path).count() == 3
    # Kinds are apart, and so is a model that asks for something else.
    assert request_table.send_new(more, path, 4, "router", lambda t: F.concat(F.lit("route "), t)).count() == 2


def test_ids_that_repeat_and_plans_without_texts(spark, docs, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b")], "doc_id bigint, text string")
    sent = request_table.send_new(rows, str(tmp_path / "r"), 1).collect()
    assert sorted(r.n_docs for r in sent) == [2, 2]
    plan = request_table.request_keys(docs("x"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "first(text" not in plan


def test_the_first_response_counts(spark):
    rows = [("a", "ner", "late", 5), ("a", "ner", "early", 1), ("a", "router", "r", 9), ("b", "ner", "y", 2), ("b", "ner", "x", 2)]
    got = request_table.first_responses(spark.createDataFrame(
        rows, "text_sha string, kind string, response string, ts long"))
    assert sorted(map(tuple, got.collect())) == [("a", "ner", "early"), ("a", "router", "r"), ("b", "ner", "x")]


def test_sketches_add_up_without_the_texts(spark, tmp_path):
    n = 30_000
    texts = spark.range(n).select(
        (F.col("id") % 7).alias("day"), (F.col("id") % 50).cast("string").alias("session_id"),
        F.concat(F.lit("mail user"), F.col("id") % 9000, F.lit("@mail.example.org")).alias("text"))
    made = sketches.item_sketches(with_regex_spans(texts))
    made.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 350
    total = sketches.rolled_up(stored, ["pii_type"]).first()
    assert total.n_items == n and abs(total.n_distinct_about - 9000) < 4 * sketches.ERROR * 9000
    for r in sketches.rolled_up(stored, ["day"]).collect():
        exact = len({i % 9000 for i in range(n) if i % 7 == r.day})
        assert abs(r.n_distinct_about - exact) <= 4 * sketches.ERROR * exact
    assert sketches.rolled_up(stored.limit(0), ["pii_type"]).count() == 0
    two = with_regex_spans(spark.createDataFrame([(1, "s", "a@x.org A@X.ORG b@x.org")], "day int, session_id string, text string"))
    one = sketches.rolled_up(sketches.item_sketches(two), ["pii_type"]).first()
    assert (one.n_items, one.n_distinct_about) == (3, 2)


def test_a_synthetic_value_that_is_somebodys(spark):
    rows = [("s", "PHONE", "1", "2"), ("s", "PHONE", "2", "3"), ("t", "PHONE", " 3 ", "9"), ("u", "SSN", "9", "1"),
            ("v", "SSN", "7", "7")]
    vault = spark.createDataFrame(rows, "session_id string, pii_type string, real string, synthetic string")
    got = sorted(map(tuple, exposure.synthetic_reals(vault).select(
        "pii_type", "value", "n_given", "n_real", "same_session").collect()))
    assert got == [("PHONE", "2", 1, 1, 1), ("PHONE", "3", 1, 1, 0), ("SSN", "7", 1, 1, 1)]


def test_texts_of_small_groups(docs):
    found = with_regex_spans(docs(*["SSN 612-45-9083"] * 5, "a@x.org 612-45-9083", "none", "x@y.org 612-45-9083 b@x.org"))
    got = exposure.small_groups(found)
    assert [(r.kinds, r.n_texts) for r in got.collect()] == [("EMAIL+SSN", 2)]
    assert exposure.small_groups(found, k=2).count() == 0
