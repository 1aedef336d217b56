"""Assigning synthetic values and rewriting texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import redact
from veilspan.operators.detect import explode_spans
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.oracle_parts import (SRC_DOCUMENTS, SRC_FORMS, keyed_cte, ordinal_ctes,
                                         resolved_ctes, span_ctes, spliced_cte, strip, with_)
from veilspan.plans.sources import VAULT_CTES

RESOLVED = [SRC_FORMS, *span_ctes(), *resolved_ctes()]
ORDINAL = [*RESOLVED, *ordinal_ctes()]
ORDINAL_TEXT = [*ORDINAL, "named as (select r.*, o.synthetic from resolved r join ordinal o "
                "on o.doc_id = r.doc_id and o.real = r.value)", spliced_cte()]
KEYED_TEXT = [*RESOLVED, keyed_cte(), spliced_cte()]
KEYED_DOCUMENTS = [SRC_DOCUMENTS, *span_ctes(), *resolved_ctes(), keyed_cte(), spliced_cte()]

GENERATORS = {"PERSON_NAME": "names", "ADDRESS": "addresses", "SSN": "ssns", "PHONE": "phones",
              "EMAIL": "emails", "EMPLOYER": "employers", "INCOME_AMOUNT": "incomes",
              "DATE_OF_BIRTH": "dates", "ACCOUNT_NUMBER": "accounts"}


def spans(spark: SparkSession, d: str) -> DataFrame:
    return explode_spans(common.resolved(common.forms(spark, d)), ("doc_id", "session_id"))


def ordinal(spark: SparkSession, d: str) -> DataFrame:
    return redact.assign_synthetic(spans(spark, d), "ordinal", common.QUERY_SALT)


def ordinal_of(pii_type: str):
    return lambda s, d: ordinal(s, d).filter(F.col("pii_type") == pii_type).select(
        "doc_id", F.col("n").cast("bigint").alias("n"), "real", "synthetic")


def keyed_of(pii_type: str):
    return lambda s, d: common.keyed_vault(s, d, pii_type).select(
        "session_id", "real", "synthetic")


def ordinal_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact.redact_ordinal(common.resolved(common.forms(spark, d)), common.QUERY_SALT).select(
        "doc_id", "sanitized")


def ordinal_joined(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal redaction from the mapping table."""
    return redact.redact(common.forms(spark, d), spans(spark, d), ordinal(spark, d)).select(
        "doc_id", "sanitized")


def keyed_joined(spark: SparkSession, d: str) -> DataFrame:
    """Keyed redaction by joining a mapping table, as with renamed vault values."""
    found = spans(spark, d)
    return redact.redact(common.forms(spark, d), found, redact.assign_synthetic(found, salt=common.QUERY_SALT),
                         on=("session_id", "pii_type")).select("doc_id", "sanitized")


def located_counts(spark: SparkSession, d: str) -> DataFrame:
    merged = explode_spans(common.merged(spark, d, "parity"), spans_col="merged")
    return merged.filter(F.col("start").isNotNull()).select("doc_id", "start", "value")


def passed_through(spark: SparkSession, d: str) -> DataFrame:
    """Texts without personal data leave unchanged; all others are rewritten."""
    out = common.redacted(common.documents(spark, d))
    return out.select("doc_id", (F.size("spans") == 0).alias("passes_through"),
                      (F.col("sanitized") == F.col("text")).alias("is_unchanged"))


def register(c: Catalog) -> None:
    from veilspan.plans.entities import BOTH
    from veilspan.plans.oracle_parts import PARITY_CTES
    c.add("located_spans", located_counts, with_(
        [*BOTH, *PARITY_CTES], "select doc_id, start, value from parity where start is not null"))
    c.add("first_values_from_right", lambda s, d: redact.first_from_right(spans(s, d)), with_(
        ORDINAL, "select doc_id, value, pii_type, start, ord from ordinal_first"))
    c.add("value_ordinals", lambda s, d: redact.with_ordinals(
        redact.first_from_right(spans(s, d))).select(
        "doc_id", "value", F.col("seq").cast("bigint").alias("seq"),
        F.col("n").cast("bigint").alias("n")),
        with_(ORDINAL, "select doc_id, value, seq, n from ordinal_numbered"))
    for pii_type, name in GENERATORS.items():
        c.add(f"ordinal_{name}", ordinal_of(pii_type), with_(
            ORDINAL, f"select doc_id, n, real, synthetic from ordinal where pii_type = '{pii_type}'"))
        c.add(f"keyed_{name}", keyed_of(pii_type), with_(
            VAULT_CTES, f"select session_id, real, synthetic from vault where pii_type = '{pii_type}'"))
    c.add("ordinal_mappings", lambda s, d: ordinal(s, d).select(
        "doc_id", F.col("ord").cast("bigint").alias("ord"), "pii_type", "real", "synthetic"),
        with_(ORDINAL, "select doc_id, ord, pii_type, real, synthetic from ordinal"))
    c.add("ordinal_redacted_forms", ordinal_redacted,
          with_(ORDINAL_TEXT, "select doc_id, sanitized from sanitized"))
    c.add("ordinal_redacted_forms_by_join", ordinal_joined,
          with_(ORDINAL_TEXT, "select doc_id, sanitized from sanitized"))
    c.add("keyed_redacted_forms", lambda s, d: common.redacted(common.forms(s, d)).select(
        "doc_id", "sanitized"), with_(KEYED_TEXT, "select doc_id, sanitized from sanitized"))
    c.add("keyed_redacted_forms_by_join", keyed_joined,
          with_(KEYED_TEXT, "select doc_id, sanitized from sanitized"))
    c.add("keyed_redacted_documents", lambda s, d: common.redacted(common.documents(s, d)).select(
        "doc_id", F.sha2("sanitized", 256).alias("sanitized_sha")),
        with_(KEYED_DOCUMENTS, "select doc_id, sha256(sanitized) as sanitized_sha from sanitized"))
    c.add("session_mappings", lambda s, d: redact.assign_synthetic(spans(s, d), salt=common.QUERY_SALT),
          with_(VAULT_CTES, "select * from vault"))
    c.add("passed_through_documents", passed_through, with_(
        KEYED_DOCUMENTS, "select doc_id, doc_id not in (select doc_id from resolved) as passes_through, "
        "sanitized = text as is_unchanged from sanitized"))
    c.add("redacted_previews", lambda s, d: redact.previews(common.redacted(common.forms(s, d))),
          with_(KEYED_TEXT, "select doc_id, substr(sanitized, 1, 300) as preview, "
                f"{strip('substr(sanitized, 1, 120)')} as short_preview from sanitized"))
