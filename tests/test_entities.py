import json

import pytest
from pyspark.sql import functions as F

from veilspan.functions import ner
from veilspan.operators.entities import join_responses, ner_requests, parse_ner, with_ner_spans
from veilspan.operators.detect import with_regex_spans
from veilspan.operators.merge import final_order, merge_spans, with_merged_spans
from veilspan.operators.detect import explode_spans


def parsed(spark, text, response):
    df = spark.createDataFrame([(text, response)], "text string, response string")
    row = with_ner_spans(df).first()
    return [(s.pii_type, s.value, s.start, s.confidence) for s in row.ner_spans]


ITEM = {"entity": "Ann Lee", "type": "name", "confidence": 0.95}


@pytest.mark.parametrize("response, want", [
    ('"Ann Lee" -> `person_name` (0.9)', [("PERSON_NAME", "Ann Lee", 3, 0.9)]),
    ('* "Ann Lee" → full_name\n* "x" -> nonsense', [("PERSON_NAME", "Ann Lee", 3, 0.9)]),
    ('"Name: Ann Lee" >> name', [("PERSON_NAME", "Ann Lee", 3, 0.9)]),
    ('"Ann Lee" -> name (510)', [("PERSON_NAME", "Ann Lee", 3, 0.9)]),
    ('"Ann Lee" -> name (0.5)', []),
    ('"..." -> name\n"<entity>" -> name\n" " -> name', []),
    ('"Bo Li" -> name', [("PERSON_NAME", "Bo Li", None, 0.9)]),
    (json.dumps([ITEM]), [("PERSON_NAME", "Ann Lee", 3, 0.95)]),
    ("<think>[1]\n</think>\n```json\n" + json.dumps([ITEM]) + "\n```", [("PERSON_NAME", "Ann Lee", 3, 0.95)]),
    ("Here: " + json.dumps([ITEM]) + " done [x", [("PERSON_NAME", "Ann Lee", 3, 0.95)]),
    (json.dumps([{**ITEM, "confidence": None}]), [("PERSON_NAME", "Ann Lee", 3, 0.9)]),
    (json.dumps([{**ITEM, "confidence": "0.85"}]), [("PERSON_NAME", "Ann Lee", 3, 0.85)]),
    (json.dumps([{**ITEM, "confidence": "high"}]), [("PERSON_NAME", "Ann Lee", 3, 0.9)]),
    (json.dumps([{"entity": "Ann Lee"}]), []),
    ("[{'entity': 'Ann Lee', 'type': 'name'}]", []),
    ("[not json", []), ("nothing", []), ("", []), ("[API key not set]", []), (None, []),
])
def test_responses(spark, response, want):
    assert parsed(spark, "It Ann Lee".replace("It", "Hi"), response) == want


def test_bullets_win_over_json(spark):
    both = '"Ann Lee" -> name\n' + json.dumps([{"entity": "Hi", "type": "company"}])
    assert parsed(spark, "Hi Ann Lee", both) == [("PERSON_NAME", "Ann Lee", 3, 0.9)]


def test_equal_prefixes_are_different_requests(docs, spark):
    head = "x" * 600
    df = docs(head + " Ann Lee", head + " Bo Li", head + " Ann Lee")
    requests = ner_requests(df)
    assert sorted(r.n_docs for r in requests.collect()) == [1, 2]
    answers = df.dropDuplicates(["text"]).select(
        F.sha2("text", 256).alias("text_sha"), F.lit("ner").alias("kind"),
        F.concat(F.lit('"'), F.expr("substring(text, 602)"), F.lit('" -> name')).alias("response"))
    rows = parse_ner(df, answers, requests=requests).collect()
    assert sorted((r.doc_id, r.value, r.start) for r in rows) == [
        (0, "Ann Lee", 601), (1, "Bo Li", 601), (2, "Ann Lee", 601)]


def test_a_hot_text_is_spread_and_stays_whole(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("session_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    answers = df.select("text").distinct().select(
        F.sha2("text", 256).alias("text_sha"), F.lit("ner").alias("kind"), F.col("text").alias("response"))
    out = join_responses(df, answers)
    assert out.count() == 3000 and out.filter("response = text").count() == 3000
    assert "_salt" not in out.columns


def span_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, start int, end int, ord int, pii_type string, "
                                       "value string, confidence double, source string")


def test_parity_merge_is_greedy_in_response_order(spark):
    regex = span_rows(spark, [(1, 0, 5, 0, "SSN", "abcde", 1.0, "regex")])
    entities = span_rows(spark, [
        (1, 3, 8, 1000, "PHONE", "defgh", .9, "ner"),      # overlaps the hit
        (1, None, None, 1001, "SSN", " ABCDE ", .9, "ner"),  # same value and type
        (1, 10, 20, 1002, "PHONE", "first", .9, "ner"),
        (1, 15, 30, 1003, "PHONE", "second", .9, "ner"),   # overlaps a kept entity
        (1, 20, 30, 1004, "PHONE", "third", .9, "ner"),
        (1, None, None, 1005, "EMAIL", "lost", .9, "ner"),
        (2, 3, 8, 1000, "PHONE", "other", .9, "ner")])
    merged = merge_spans(regex, entities, "parity")
    assert sorted((r.doc_id, r.value) for r in merged.collect()) == [
        (1, "abcde"), (1, "first"), (1, "lost"), (1, "third"), (2, "other")]
    order = final_order(merged).filter("doc_id = 1").orderBy("rank").collect()
    assert [r.value for r in order] == ["abcde", "first", "third", "lost"]


def test_safe_merge_redacts_every_place(spark):
    text = "Name: Ann Lee\nAnn Lee met Bo Li. Bo Li left."
    df = spark.createDataFrame([(0, text, '"Bo Li" -> name\n"Ann Lee" -> name\n"Zoe" -> name')],
                               "doc_id bigint, text string, response string")
    both = with_regex_spans(with_ner_spans(df))
    safe = with_merged_spans(both, "safe").first().merged
    assert [(s.value, s.start) for s in safe] == [
        ("Ann Lee", 6), ("Ann Lee", 14), ("Bo Li", 26), ("Bo Li", 33), ("Zoe", None)]
    parity = explode_spans(with_merged_spans(both, "parity"), spans_col="merged").collect()
    assert [(s.value, s.start) for s in parity] == [("Ann Lee", 6), ("Bo Li", 26), ("Zoe", None)]


def test_prompt_holds_the_whole_text(spark):
    row = spark.range(1).select(ner.prompt(F.lit("t" * 9000)).alias("p")).first()
    assert "t" * 9000 in row.p
