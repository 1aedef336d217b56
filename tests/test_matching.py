"""One-pass search for a text's own values, and span sweeps, against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilspan.functions.matching import restored_text, value_places
from veilspan.functions.spans import SPAN_TYPE, beside
from veilspan.operators import redact, restore
from veilspan.operators.detect import explode_spans, with_regex_spans, with_resolved_spans
from veilspan.operators.entities import with_ner_spans
from veilspan.operators.merge import overlapping, with_merged_spans, without_overlaps
from veilspan.sources import forms as derived

SF = "/root/testdata/sf0.001"
SPANS = ("doc_id bigint, start int, end int, ord int, pii_type string, value string, confidence double, "
         "source string")


def chain(text, pairs):
    """The replacements, one after the other."""
    for old, new in pairs:
        if old:
            text = text.replace(old, new)
        head, own = (old.split(None, 1) or [""])[0], (new.split(None, 1) or [""])[0]
        if len(head) > 2:
            text = text.replace(head + "'s", own + "'s")
    return text


def cases(n):
    rng = random.Random(7)
    for _ in range(n):
        letters = rng.choice(["ab", "abc '", "abcdefgh 's1", "Jo An's", "é😀 x"])

        def word(least):
            return "".join(rng.choice(letters) for _ in range(rng.randrange(least, 6)))
        olds = [word(0) for _ in range(rng.randrange(6))]
        if rng.random() < .2:
            olds += olds[:1]
        olds.sort(key=lambda o: -len(o))
        text = "".join(rng.choice([word(0), *olds]) for _ in range(rng.randrange(8)))
        yield text, [(o, word(0)) for o in olds]


def test_one_pass_restores_what_the_chain_does(spark):
    rows = list(cases(4000))
    df = spark.createDataFrame(
        [(i, t, [(o, n) for o, n in p]) for i, (t, p) in enumerate(rows)],
        "id int, text string, m array<struct<synthetic:string,real:string>>")
    got = {r.id: r.out for r in df.select("id", restored_text(F.col("text"), F.col("m")).alias("out")).collect()}
    assert [got[i] for i in range(len(rows))] == [chain(t, p) for t, p in rows]


def test_restoring_nulls_and_nothing(spark):
    df = spark.createDataFrame([(0, None, [("a", "b")]), (1, "", [("a", "b")]), (2, "a", []), (3, "a", [("a", None)]),
                                (4, "a", None)], "id int, text string, m array<struct<synthetic:string,real:string>>")
    got = {r.id: r.out for r in df.select("id", restored_text(F.col("text"), F.col("m")).alias("out")).collect()}
    assert got == {0: None, 1: "", 2: "a", 3: None, 4: None}


def test_value_places(spark):
    text = "Ann Ann. Annex é1 $5 x$5 -- ann"
    values = [("N", "Ann"), ("E", "Ann"), ("N", "Ann"), ("M", "$5"), ("M", "--"), ("M", "é1"), ("M", ""), ("M", "Bo")]
    df = spark.createDataFrame([(0, text, values), (1, None, values), (2, text, None), (3, "", values)],
                               "id int, text string, s array<struct<pii_type:string,value:string>>")
    got = {r.id: [(p >> 32, p & 0xFFFFFFFF) for p in r.p]
           for r in df.select("id", value_places(F.col("text"), F.col("s")).alias("p")).collect()}
    assert sorted(got[0]) == [(0, 0), (0, 4), (1, 0), (1, 4), (3, 18), (3, 22), (4, 25), (5, 15)]
    assert got[1] == got[2] == got[3] == []


def spans(rng, n, size, reach):
    out = []
    for i in range(n):
        start = rng.randrange(size)
        out.append((start, start + 1 + rng.randrange(reach), i, "T", f"v{i}", 1.0, "x"))
    return out


def overlap(a, b):
    return a[0] is not None and a[0] < b[1] and b[0] < a[1]


def test_sweep_keeps_what_overlaps_nothing(spark):
    rng = random.Random(3)
    rows = [(i, spans(rng, rng.randrange(8), 30, 6) + [(None, None, 99, "T", "lost", 1.0, "x")][:rng.randrange(2)],
             spans(rng, rng.randrange(6), 30, 6)) for i in range(300)]
    df = spark.createDataFrame(rows, f"id int, a array<{SPAN_TYPE}>, b array<{SPAN_TYPE}>")
    got = {r.id: sorted(s.ord for s in r.k) for r in df.select("id", beside(F.col("a"), F.col("b")).alias("k")).collect()}
    assert got == {i: sorted(x[2] for x in a if not any(overlap(x, y) for y in b)) for i, a, b in rows}


def test_interval_join(spark):
    rng = random.Random(4)
    a = [(i % 3, *s) for i, s in enumerate(spans(rng, 200, 400, 200))] + [(1, None, None, 5, "T", "V7 ", 1.0, "x")]
    b = [(i % 4, *s) for i, s in enumerate(spans(rng, 150, 400, 90))]
    x, y = (spark.createDataFrame(rows, SPANS) for rows in (a, b))
    pairs = sorted((r.a.doc_id, r.a.ord, r.b.ord) for r in overlapping(x, y).collect())
    assert pairs == sorted((p[0], p[3], q[3]) for p in a for q in b if p[0] == q[0] and overlap(p[1:], q[1:]))
    for same in (False, True):
        kept = sorted((r.doc_id, r.ord) for r in without_overlaps(x, y, same_values=same).collect())
        assert kept == sorted((p[0], p[3]) for p in a if not any(
            p[0] == q[0] and (overlap(p[1:], q[1:]) or same and p[5].strip().lower() == q[5].lower()) for q in b))


def test_very_many_spans_of_one_text(spark):
    n = 10_000  # of each detector
    rows = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
            (i * 7).cast("int").alias("start"), (i * 7 + 5).cast("int").alias("end"), i.cast("int").alias("ord"),
            F.lit("T").alias("pii_type"), i.cast("string").alias("value"), F.lit(1.0).alias("confidence"),
            F.lit("x").alias("source"))).alias("a"))
    both = rows.withColumn("b", F.transform("a", lambda s: s.withField("start", s["start"] + 6).withField(
        "end", s["end"] + 2 - (s["ord"] % 2)))).checkpoint()
    kept = both.select(F.size(beside(F.col("a"), F.col("b"))).alias("n"))
    best = 1e9
    for _ in range(3):
        start = time.perf_counter()
        assert kept.first().n == n
        best = min(best, time.perf_counter() - start)
    assert best < 2


def one_text(spark, n_forms):
    """Forms in one row, with the model's answers."""
    rows = F.array_sort(F.collect_list(F.struct("form_id", "text", "response")))
    return (derived.answered_forms(spark, SF).filter(F.col("form_id") <= n_forms).agg(rows.alias("r"))
            .select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("session_id"),
                    *[F.array_join(F.transform("r", lambda x: x[c]), "\n").alias(c) for c in ("text", "response")])
            .checkpoint())


@pytest.mark.parametrize("step", ["merge", "restore"])
def test_cost_grows_with_the_text(spark, step):
    """Twice the text takes about twice as long (the plan's own time is in both)."""
    def work(n):
        df = with_ner_spans(with_regex_spans(one_text(spark, n)))
        if step == "merge":
            df = with_merged_spans(df.checkpoint()).select(F.size("merged"))
        else:
            red = redact.redact_ordinal(with_resolved_spans(df)).checkpoint()
            maps = redact.assign_synthetic(explode_spans(red.select("doc_id", "spans")), "ordinal").checkpoint()
            df = restore.restore(red, maps, text_col="sanitized").select(F.length("restored"))
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            df.collect()
            best = min(best, time.perf_counter() - start)
        return best
    assert work(140) * 2.8 + .5 > work(280)
