"""Inputs shared by the registered queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.arrays import unnest
from veilspan.operators.detect import with_regex_spans, with_resolved_spans
from veilspan.operators.entities import with_ner_spans
from veilspan.operators.merge import with_merged_spans
from veilspan.operators.redact import redact_keyed, with_keyed_spans, with_mappings
from veilspan.session import shared_dir
from veilspan.sources import forms as derived
from veilspan.sources import tables


# Of the registered queries alone, so that reruns and their oracles agree.
QUERY_SALT = "change-me"


def forms(spark: SparkSession, d: str) -> DataFrame:
    return derived.forms(spark, d).withColumnRenamed("form_id", "doc_id")


def answered(spark: SparkSession, d: str) -> DataFrame:
    """Forms with the response on the row."""
    return derived.answered_forms(spark, d).withColumnRenamed("form_id", "doc_id")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.documents(spark, d).select(
        "doc_id", F.col("doc_id").cast("string").alias("session_id"), "text", "lang", "source")


def detected(spark: SparkSession, d: str) -> DataFrame:
    """Forms with both detectors' spans as arrays."""
    return with_ner_spans(with_regex_spans(answered(spark, d)))


def merged(spark: SparkSession, d: str, mode: str = "safe") -> DataFrame:
    return with_merged_spans(detected(spark, d), mode)


def resolved(docs: DataFrame) -> DataFrame:
    return with_resolved_spans(with_regex_spans(docs))


def redacted(docs: DataFrame) -> DataFrame:
    """Texts with spans, keyed names and the redacted text."""
    return redact_keyed(resolved(docs), QUERY_SALT)


def keyed_vault(spark: SparkSession, d: str, pii_type: str | None = None) -> DataFrame:
    """One vault row per keyed mapping of the forms, of all types or of one.

    A value's name does not depend on those of other types, so these aren't made for one type alone.
    """
    found = resolved(forms(spark, d))
    if pii_type is not None:
        found = found.withColumn("spans", F.filter("spans", lambda s: s["pii_type"] == pii_type))
    named = with_keyed_spans(found, QUERY_SALT)
    rows = unnest(with_mappings(named), "mappings", "m", "session_id").select(
        "session_id", "m.pii_type", "m.real", "m.synthetic").distinct()
    return rows.withColumn("first_seen_ts", F.lit("2024-01-01").cast("timestamp"))


def fresh_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"veilspan-{name}-{uuid.uuid4().hex}")
