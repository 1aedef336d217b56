"""The pipeline's stages and the registered queries."""

import collections

import __spark_entry__ as entry
import corpus_pipeline
from veilspan.llm import pii, simhash
from veilspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) == set(QUERIES) and "pipeline" in entry.queries()


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = stage(spark, docs, SF).cache()
        if name != "packing":
            assert kept[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = kept[name]
    rows = {n: df.collect() for n, df in kept.items()}
    assert 0 < len(rows["quality"]) < 200
    prints = [simhash.fingerprint(r.text) for r in rows["near_copies"]]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    before = {r.doc_id: r.text for r in rows["near_copies"]}
    assert {r.doc_id: r.text for r in rows["pii"]} == {
        d: pii.pseudonymise(t, corpus_pipeline.KEY)[0] for d, t in before.items()}
    taken = collections.Counter(r.doc_id for r in rows["mixing"])
    assert taken and max(taken.values()) <= 3 and set(taken) <= set(before)
    ends = collections.Counter()
    for r in rows["packing"]:
        ends[r.doc_id] += r.start + r.length == r.doc_tokens
    assert ends == taken
    result = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, rows["packing"]))


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_a_deployment_has_its_own_key():
    own = dict(corpus_pipeline.stages(b"a secret of the site"))
    assert list(own) == [name for name, _ in corpus_pipeline.STAGES]
    assert pii.pseudonymise("4111 1111 1111 1111", b"a secret of the site") != pii.pseudonymise(
        "4111 1111 1111 1111", corpus_pipeline.KEY)
