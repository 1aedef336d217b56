"""The whole way of a query, and the counts taken on it."""

import pytest
from pyspark.sql import functions as F

from samples import WAGES
from veilspan.functions.text import content_hash
from veilspan.operators import flow
from veilspan.operators.metrics import Stages
from veilspan.sources.tables import dims

PLAIN = "Compare two pumps."
MET = "Bo Li and Ann Lee met. Mail ann@mail.example.org"
ENTITIES = '"Bo Li" -> person_name\n"Ann Lee" -> name'


def router(risk, route):
    return f'{{"agent": "admin", "pii_risk": "{risk}", "complexity": "simple", "route": "{route}"}}'


@pytest.fixture(scope="module")
def done(spark):
    texts = [(0, PLAIN), (1, MET), (2, MET + " again"), (3, WAGES), (4, "nothing, no reply"), (5, "Hi"), (6, PLAIN)]
    queries = spark.createDataFrame([(i, "s", t) for i, t in texts], "doc_id bigint, session_id string, text string")
    by_text = {PLAIN: router("low", "cloud"), MET: router("high", "cloud"), MET + " again": router("low", "cloud"),
               "Hi": router("low", "local"), WAGES: "no idea"}
    rows = [(t, "router", r) for t, r in by_text.items()] + [(MET, "ner", ENTITIES), (MET + " again", "ner", ENTITIES),
                                                             (WAGES, "ner", ""), ("Hi", "ner", ENTITIES)]
    responses = spark.createDataFrame(rows, "text string, kind string, response string").select(
        content_hash(F.col("text")).alias("text_sha"), "kind", "response")
    stages = Stages("test")
    sent = flow.prepare(queries, responses, dims(spark)["agent"], stages=stages).checkpoint()
    replies = flow.cloud_requests(sent).filter("text not like '%no reply'").select(
        "text_sha", F.lit("cloud").alias("kind"), F.concat(F.lit("You wrote: "), "text").alias("response"))
    out = flow.complete(sent, responses.unionByName(replies))
    return {r.doc_id: r for r in out.collect()}, stages.table(spark).collect(), flow.cloud_requests(sent).count()


def test_routes_decide_what_leaves(done):
    rows, _, n_requests = done
    assert [rows[i].route for i in range(7)] == ["cloud"] * 5 + ["local", "cloud"]
    assert rows[5].outbound is None and rows[5].restored is None
    # Copies of a text are sent once.
    assert n_requests == 5 and rows[0].outbound == rows[6].outbound == PLAIN
    assert rows[3].pii_risk == "high" and rows[4].pii_risk == "high"  # no usable record: the fallback


def test_low_risk_is_not_shown_to_the_model(done):
    rows, *_ = done
    assert (rows[1].n_ner, rows[2].n_ner, rows[5].n_ner) == (2, 0, 0)
    assert "Bo Li" not in rows[1].outbound and "Bo Li" in rows[2].outbound
    assert "ann@mail" not in rows[2].outbound  # the patterns count whatever the risk


def test_replies_come_back_with_real_values(done):
    rows, *_ = done
    assert rows[1].restored == "You wrote: " + MET and rows[3].restored == "You wrote: " + WAGES
    assert rows[4].response is None and rows[4].restored is None
    assert all(r.n_leaks == 0 for r in rows.values())
    assert rows[0].system_prompt.startswith("Analyse") and rows[4].system_prompt.startswith("Answer")


def test_stages_are_counted_on_the_way(done):
    rows, stages, _ = done
    got = {r.stage: (r.n_rows, r.n_items) for r in stages}
    sent = sum(len(r.outbound or "") for r in rows.values())
    assert got == {"route": (7, 1), "pii": (7, sum(r.n_unique for r in rows.values())), "cloud": (7, sent)}


def test_a_stage_is_watched_once(spark):
    stages = Stages()
    df = stages.watch(spark.range(3), "a", F.sum("id"))
    with pytest.raises(ValueError):
        stages.watch(df, "a", F.sum("id"))
    stages.watch(df.filter("id > 9"), "b", F.sum("id")).collect()
    assert sorted((r.stage, r.n_rows, r.n_items) for r in stages.table(spark).collect()) == [("a", 3, 3), ("b", 0, 0)]
