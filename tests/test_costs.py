"""What a form costs: work done for every character, value or pair of spans."""

import random
import re
import unicodedata
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilspan.functions import ner, synth
from veilspan.functions.patterns import PATTERN_BY_NAME
from veilspan.functions.spans import MARK, same_value
from veilspan.functions.text import strip
from veilspan.operators.redact import with_mappings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strip_takes_what_python_takes_without_a_regex(spark):
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    others = [chr(i) for i in range(1, 0x3100) if unicodedata.category(chr(i)) in ("Cf", "Po")]
    values = ["", "a", " a b ", "\u3000", "\U0001f600 ", *[f"{s}{s}x{s}y{s}" for s in spaces],
              "".join(spaces), *[f"{o} x {o}" for o in others]]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", strip(F.col("v")).alias("s"))
    assert [r for r in df.collect() if r.s != r.v.strip()] == []
    assert "regexp" not in plan(df)


def test_values_of_span_pairs_are_compared_without_a_regex(spark):
    span = "struct<pii_type:string,value:string>"
    df = spark.createDataFrame([(("SSN", " A\u00a0"), ("SSN", "a")), (("SSN", "a"), ("EMAIL", "a"))],
                               f"a {span}, b {span}").select(same_value(F.col("a"), F.col("b")).alias("same"))
    assert [r.same for r in df.collect()] == [True, False]
    assert "regexp" not in plan(df)


def test_bullets_are_found_in_one_pass(spark):
    replies = [None, "", "none", '- "A B" -> `name` (0.9)\n"c" → dob\n"d"=>`x` then (1)',
               '"no" arrow', f'{MARK} "a{MARK}" -> b (2)', '"q" -> r']
    df = spark.createDataFrame([(r,) for r in replies], "r string").select(
        "r", ner.bullet_items(F.col("r")).alias("items"))
    rows = [None if r.items is None else [tuple(i) for i in r.items] for r in df.collect()]
    assert rows == [None, [], [], [("A B", "name", "0.9"), ("c", "dob", None)], [],
                    [(f"a{MARK}", "b", "2")], [("q", "r", None)]]
    assert plan(df).count("regexp_replace(") == 1


@pytest.mark.parametrize("name", ["ssn", "phone_dash", "date_slash", "date_month"])
def test_first_characters_are_looked_at_before_the_word_edge(spark, name):
    spec = PATTERN_BY_NAME[name]
    # More than one character, for most of a text's are letters or digits.
    ahead = re.match(r"\(\?dm\)(?:\(\?i\))?\(\?=(.*?)\)\(\?<!", spec.java)
    assert ahead and not re.fullmatch(r"\[[^\]]*\]", ahead[1])
    rng = random.Random(7)
    parts = ["612-45-9083", "510-882-4471", "1/2/1999", "12/31/2000", "13/01/2000", "0/1/2000", "\u0666\u0661\u0662-45-9083",
             "\U0001d7da12-45-9083", "jan 5 2020", "MAY 31, 2020", "Sept 3 2001", "\u017fep 3 2001", "dismay 3, 2021", *(
                 f"{m} 9, 2019" for m in "feb March apr june July aug SEP oct november dec".split()),
             "-", "/", " ", "\n", "_", "a", "\u00e9", "7", "\U0001f600", "\U0001d400", "\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(2000)]
    plain = replace(spec, java_template=None)
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(*[
        F.regexp_extract_all("t", F.lit(s.java), F.lit(0)).alias(n) for n, s in (("now", spec), ("plain", plain))])
    assert found.filter("now != plain").count() == 0 and found.filter("size(now) > 0").count() > 20


def test_mappings_without_repeats_are_not_cut_from_strings(spark):
    span = "struct<pii_type:string,value:string,synthetic:string>"
    sep = "\u0000"
    rows = [None, [], [("SSN", "a", "x"), ("EMAIL", "a", "x"), ("SSN", f"b{sep}{sep}c", "y")],
            [("SSN", "a", "x"), ("SSN", "a", "x"), ("SSN", "b", "x"), ("SSN", f"b{sep}c", "x")]]
    df = with_mappings(spark.createDataFrame([(r,) for r in rows], f"named array<{span}>"))
    out = [None if r.mappings is None else [tuple(m) for m in r.mappings] for r in df.collect()]
    assert out == [None, [], [(0, "SSN", "a", "x"), (1, "EMAIL", "a", "x"), (2, "SSN", f"b{sep}{sep}c", "y")],
                   [(0, "SSN", "a", "x"), (1, "SSN", "b", "x"), (2, "SSN", f"b{sep}c", "x")]]
    # A mapping's three parts come from one cut.
    assert plan(df.select("mappings")).count("split(") == 1


def test_a_date_is_parsed_once(spark):
    values = ["11/02/1979", "1/2/1979", "02/30/1979", "1/2", "May 3, 2024", "sept 31 2024", "x", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(synth._parsed_date(F.col("v")).alias("d"))
    assert [r.d and str(r.d) for r in df.collect()] == [
        "1979-11-02", "1979-01-02", None, None, "2024-05-03", None, None, None, None]
    assert plan(df).count("split(") == 1 and plan(df).count("regexp_extract(") == 2
