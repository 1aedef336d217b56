"""From raw documents to packed sequences: five stages, each on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import mixing, packing, pii, quality, simhash
from veilspan.llm.common import Stored, free_name, read_table, ship

# Of the registered query alone, so that its reruns agree; a deployment passes its own secret to ``run``.
KEY = b"key of the registered pipeline"
TOKENIZER = "byte_bpe_50k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores as good."""
    ship(spark)
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    made = free_name(docs, "_score")
    scored = quality.score(docs, model, out=made)
    return scored.filter(F.col(made) >= quality.THRESHOLD).drop(made)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    ship(spark)
    return simhash.one_of_each(docs)


def pseudonymised(key: bytes) -> Stage:
    """Texts with pseudonyms under a key, and their length."""
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return pii.with_pseudonyms(docs, key).withColumn(
            "n_chars", F.length("text").cast("long")).select(*docs.columns)
    return stage


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


def stages(key: bytes) -> list[tuple[str, Stage]]:
    return [
        ("quality", good_quality),
        ("near_copies", without_near_copies),
        ("pii", pseudonymised(key)),
        ("mixing", mixed),
        ("packing", packed),
    ]


STAGES = stages(KEY)

# Dictionaries, fingerprints and permutations are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """Apply the stages to documents, each stored for the next; without a key, those registered."""
    steps = STAGES if key is None else stages(key)
    store = Stored(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in steps[:-1]:
        kept = store.put(stage(spark, docs, sf_dir))
        store.drop(docs)
        docs = kept
    return steps[-1][1](spark, docs, sf_dir)
