"""Pattern detection and overlap resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.patterns import DEFAULT_PATTERNS, PATTERN_BY_NAME
from veilspan.operators.detect import detect_regex_spans, explode_spans, with_regex_spans
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.oracle_parts import (SRC_DOCUMENTS, SRC_FORMS, resolved_ctes, span_ctes, with_)
from veilspan.sources import tables

COLUMNS = ("doc_id", "start", "end", "ord", "pii_type", "value", "confidence", "source")
ALL = 'select doc_id, start, "end", ord, pii_type, value, confidence, source from '
PLACES = 'select doc_id, start, "end", pii_type, value from '
SRC_PAGES = "src as (select page_id as doc_id, html as text from pages)"
SRC_TURNS = ("src as (select conv_id || '/' || turn as doc_id, text from conversations)")


def one_pattern(name: str, docs):
    spec = PATTERN_BY_NAME[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return detect_regex_spans(docs(spark, d), [spec]).select(
            "doc_id", "start", "end", "pii_type", "value")
    return run


def pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")


def labelled_fields(spark: SparkSession, d: str) -> DataFrame:
    specs = [p for p in DEFAULT_PATTERNS if p.labelled]
    return detect_regex_spans(common.forms(spark, d), specs).select(
        "doc_id", "start", "end", "pii_type", "value")


def ordered(spark: SparkSession, d: str) -> DataFrame:
    found = with_regex_spans(common.forms(spark, d))
    return found.select("doc_id", F.posexplode_outer("spans").alias("rank", "s")).filter(
        "rank is not null").select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), "s.start", "s.pii_type", "s.value")


def density(docs):
    """Hits by type and language: the smallest useful report."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        return (detect_regex_spans(docs(spark, d), id_cols=("doc_id", "lang"))
                .groupBy("lang", "pii_type").agg(F.count(F.lit(1)).alias("n_spans")))
    return run


def register(c: Catalog) -> None:
    for spec in DEFAULT_PATTERNS:
        c.add(f"{spec.name}_spans", one_pattern(spec.name, common.forms),
              with_([SRC_FORMS, *span_ctes([spec])], PLACES + "spans"))
    for name in ("email", "phone_paren"):
        c.add(f"{name}_spans_in_documents", one_pattern(name, common.documents),
              with_([SRC_DOCUMENTS, *span_ctes([PATTERN_BY_NAME[name]])], PLACES + "spans"))
    every = [("forms", common.forms, SRC_FORMS), ("documents", common.documents, SRC_DOCUMENTS),
             ("pages", pages, SRC_PAGES), ("conversations", turns, SRC_TURNS)]
    for name, docs, src in every:
        c.add(f"all_spans_in_{name}",
              lambda s, d, docs=docs: detect_regex_spans(docs(s, d)).select(*COLUMNS),
              with_([src, *span_ctes()], ALL + "spans"))
    labelled = [p for p in DEFAULT_PATTERNS if p.labelled]
    c.add("labelled_field_spans", labelled_fields,
          with_([SRC_FORMS, *span_ctes(labelled)], PLACES + "spans"))
    c.add("nonempty_span_counts", lambda s, d: detect_regex_spans(common.forms(s, d)).groupBy(
        "pii_type").agg(F.count_if(F.col("value") != "").alias("n_nonempty"),
                        F.count(F.lit(1)).alias("n_spans")),
        with_([SRC_FORMS, *span_ctes()], "select pii_type, count(*) filter (value <> '') "
              "as n_nonempty, count(*) as n_spans from spans group by 1"))
    c.add("ordered_spans", ordered, with_(
        [SRC_FORMS, *span_ctes()], "select doc_id, row_number() over (partition by doc_id "
        "order by start, ord) - 1 as rank, start, pii_type, value from spans"))
    c.add("resolved_spans", lambda s, d: explode_spans(
        common.resolved(common.forms(s, d))).select(*COLUMNS),
        with_([SRC_FORMS, *span_ctes(), *resolved_ctes()], ALL + "resolved"))
    c.add("span_density_by_language", density(common.documents), with_(
        [SRC_DOCUMENTS, *span_ctes()], "select d.lang, s.pii_type, count(*) as n_spans "
        "from spans s join documents d using (doc_id) group by all"))
