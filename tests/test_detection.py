import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from samples import HEALTH, LEASE, WAGES, brute_spans
from veilspan.functions.spans import MARK, propagate_values, splice
from veilspan.operators.detect import (detect_regex_spans, explode_spans, external_spans,
                                       with_regex_spans, with_resolved_spans)


def spans_of(df, col="spans"):
    return {r.doc_id: [(s.start, s.end, s.pii_type, s.value) for s in r[col] or []]
            for r in df.collect()}


def test_counts_of_the_three_documents(docs):
    rows = detect_regex_spans(docs(WAGES, HEALTH, LEASE)).collect()
    found = {i: Counter(r.pii_type for r in rows if r.doc_id == i) for i in range(3)}
    assert found[0] == {"PERSON_NAME": 1, "SSN": 1, "ADDRESS": 2, "DATE_OF_BIRTH": 1, "EMPLOYER": 1,
                        "INCOME_AMOUNT": 3, "PHONE": 1, "EMAIL": 1, "ACCOUNT_NUMBER": 2}
    assert len({r.value for r in rows if r.doc_id == 0}) == 12
    assert found[1] == {"PERSON_NAME": 1, "DATE_OF_BIRTH": 2, "PHONE": 1}
    assert found[2] == {"PERSON_NAME": 2, "DATE_OF_BIRTH": 2, "SSN": 1, "INCOME_AMOUNT": 2,
                        "PHONE": 1, "EMAIL": 1}


@pytest.mark.parametrize("text", ["Best kettle under $350? Compare 3.", "Tip of 18% on $85?", "", None])
def test_nothing_to_find(docs, text):
    assert detect_regex_spans(docs(text)).count() == 0


CASES = [
    "Employer: Emp\nEmployer: Desk (212) 555-0100 West\nemployer : A  \nEmployer:\n Next Line Co",
    "😀😀 call (510)\t882-4471 or 510-882-4471x, 5108824471, 1510-882-4471",
    "Name: Ann Lee\r\nname: bob ray\n  CO-TENANT : Jo K. Van Berg \nName: Solo\nTenant: A B",
    "a.b@x.example.com.y@z.org @x.com a@b a@b.c %+-@q.io" + "a" * 50 + "@",
    "Jan. 5, 2020 jan 5 2020 MAY 31,2020 May 32, 2020 JUNE  07,  1999x 12/31/1999 13/01/2000 1/1/20000",
    "$1,000 $ 2,500.50 $85 $1,00 $12,345,678.9 $1,000x $999,999",
    "Account No: 12345678 acct#123456789012345678 routing 1234567 ROUTING NUMBER ::# 87654321",
    "Address: 1 Elm Road, Salem, or 97301-1234\naddress: 12\nOak Lane, Bend, OR 97701 ",
    "é123-45-6789 123-45-6789é _123-45-6789 ١٢٣-٤٥-٦٧٨٩ 1123-45-6789 123-45-67890",
    f"x{MARK} SSN 123-45-6789 {MARK} Employer: Q{MARK}uill Co\nEmployer: Q{MARK}uill Co",
]


def test_equal_to_brute_force_on_hard_cases(docs):
    got = spans_of(with_regex_spans(docs(*CASES)))
    for i, text in enumerate(CASES):
        assert got[i] == brute_spans(text), text


def test_equal_to_brute_force_on_random_texts(docs):
    rng = random.Random(7)
    parts = CASES + WAGES.split("\n") + ["\n", " ", ":", "-", "@", "$", "1", "Name: ", "😀", "\r\n"]
    texts = ["".join(rng.choice(parts)[rng.randrange(3):] + rng.choice(["", "\n", " "])
                     for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    got = spans_of(with_regex_spans(docs(*texts)))
    for i, text in enumerate(texts):
        assert got[i] == brute_spans(text)


def test_many_spans_in_a_long_text(docs):
    text = "".join(f"é line {i} SSN {100 + i % 800}-{10 + i % 89}-{i:04d} end\n" for i in range(1200))
    df = with_resolved_spans(with_regex_spans(docs(text, text[:4096], text[:4097])))
    out = df.withColumn("out", splice(F.col("text"), F.col("spans"), lambda s: F.lit("#"))).collect()
    for r in sorted(out, key=lambda r: r.doc_id):
        want, at = [], 0
        for s, e, _, _ in brute_spans(r.text):
            want += [r.text[at:s], "#"]
            at = e
        assert r.out == "".join(want) + r.text[at:]
    assert len(out[0].spans) == 1200


def test_overlaps_keep_earliest_then_longest(docs):
    text = "Employer: Desk (212) 555-0100 West\nEmployer: (212) 555-0100"
    got = spans_of(with_resolved_spans(with_regex_spans(docs(text))))[0]
    assert [(t, v) for _, _, t, v in got] == [
        ("EMPLOYER", "Desk (212) 555-0100 West"), ("PHONE", "(212) 555-0100")]


def test_values_are_spread_to_whole_words_only(docs):
    text = "Employer: Emp\nEmp pays. Employed by Emp, not Empire.\nName: Ann Lee\nAnn Lee, Ann Leeds"
    df = with_regex_spans(docs(text)).withColumn(
        "spans", propagate_values(F.col("text"), F.col("spans")))
    got = spans_of(df)[0]
    assert sorted(s for s, _, t, _ in got if t == "EMPLOYER") == [10, 14, 36]
    assert len([1 for *_, t, _ in got if t == "PERSON_NAME"]) == 2


def test_odd_values_are_found_literally(spark):
    from veilspan.functions.spans import occurrences
    value = r"a\Eb.*(c"
    df = spark.createDataFrame([(f"{value} x {value}", value), ("aXbzzzc", "a.b"), ("xx", "")],
                               "text string, value string")
    assert [r.o for r in df.select(occurrences(F.col("text"), F.col("value")).alias("o")).collect()] \
        == [[0, 11], [], []]


def test_spans_of_a_sites_own_model(docs):
    def shouting(batch):
        hits = batch[batch.text.str.isupper()]
        return hits.assign(start=0, end=hits.text.str.len(), ord=0, pii_type="EMPLOYER",
                           value=hits.text, confidence=1.0, source="site").drop(columns="text")
    rows = external_spans(docs("ACME", "quiet"), shouting).collect()
    assert [(r.doc_id, r.value, r.end) for r in rows] == [(0, "ACME", 4)]


def test_the_same_under_another_partitioning(docs):
    df = docs(*CASES, WAGES, LEASE)
    one = explode_spans(with_regex_spans(df.coalesce(1))).collect()
    many = explode_spans(with_regex_spans(df.repartition(7, "doc_id"))).collect()
    assert sorted(one) == sorted(many)
