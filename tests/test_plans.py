"""The plans are what they should be at scale."""

import re

from pyspark.sql import functions as F

from veilspan.functions.patterns import DEFAULT_PATTERNS
from veilspan.operators import audit, merge, redact
from veilspan.sources import tables
from veilspan.operators.detect import detect_regex_spans, with_regex_spans, with_resolved_spans
from veilspan.operators.skew import HOT_SHARE, hot_keys, spread_join

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return tables.documents(spark, SF).withColumn(
        "session_id", F.col("doc_id").cast("string"))


def test_redaction_is_one_narrow_projection(spark):
    text = plan(redact.redact_keyed(with_resolved_spans(with_regex_spans(documents(spark))))
                .select("doc_id", "sanitized"))
    assert "Exchange" not in text and "Python" not in text
    # Each pattern is matched once, so no step computes the spans again.
    assert [text.count(p.java) for p in DEFAULT_PATTERNS] == [1] * len(DEFAULT_PATTERNS)
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", text)[1]
    assert schema == "struct<doc_id:bigint,text:string>"


def test_ordinal_redaction_is_one_narrow_projection(spark):
    text = plan(redact.redact_ordinal(with_resolved_spans(with_regex_spans(documents(spark))))
                .select("doc_id", "sanitized"))
    assert "Exchange" not in text and "Python" not in text
    assert [text.count(p.java) for p in DEFAULT_PATTERNS] == [1] * len(DEFAULT_PATTERNS)


def test_exploded_spans_are_computed_once(spark):
    text = plan(detect_regex_spans(documents(spark)).filter("pii_type = 'SSN'"))
    assert [text.count(p.java) for p in DEFAULT_PATTERNS] == [1] * len(DEFAULT_PATTERNS)


def test_counts_shuffle_partial_sums_only(spark):
    text = plan(audit.density(with_regex_spans(documents(spark)), "lang"))
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_overlap_join_has_an_equality_key(spark):
    spans = detect_regex_spans(documents(spark))
    for same in (False, True):
        text = plan(merge.without_overlaps(spans, spans, same_values=same))
        assert "NestedLoop" not in text and "Cartesian" not in text and "LeftAnti" in text


def test_hot_keys_are_few_and_spread(spark):
    left = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(left, ["k"])
    assert [r.k for r in hot.collect()] == [0] and hot.count() < HOT_SHARE
    right = left.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = spread_join(left, right, ["k"], hot, "id")
    assert out.count() == 9000 and out.filter("v = k * 2").count() == 9000
