"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions.arrays import unnest
from veilspan.operators.detect import detect_regex_spans
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.oracle_parts import (ITEM_CTES, SRC_ANSWERED, SRC_FORMS, keyed_cte, q,
                                         resolved_ctes, span_ctes, with_)
from veilspan.sources import forms as derived
from veilspan.sources import tables, vault_table
from veilspan.functions import ner

INSTRUCTION = "Please sum up this form."


def type_dimension(spark: SparkSession, d: str) -> DataFrame:
    """The type dimension with the number of hits in the forms."""
    counts = detect_regex_spans(common.forms(spark, d)).groupBy("pii_type").agg(
        F.count(F.lit(1)).alias("n"))
    types = tables.dims(spark)["pii_type"]
    return types.join(counts, types["code"] == counts["pii_type"], "left").select(
        "code", "label", "icon", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_spans"))


def alias_dimension(spark: SparkSession, d: str) -> DataFrame:
    """The alias dimension with how often the model used each alias."""
    used = (unnest(common.answered(spark, d), ner.items(F.col("response")), "i")
            .groupBy(F.lower("i.type").alias("alias")).agg(F.count(F.lit(1)).alias("n")))
    return tables.dims(spark)["ner_alias"].join(used, "alias", "left").select(
        "alias", "pii_type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"))


def pool_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Each pool entry with the number of hits of its type."""
    counts = detect_regex_spans(common.forms(spark, d)).groupBy("pii_type").agg(
        F.count(F.lit(1)).alias("n_spans"))
    return tables.dims(spark)["pool"].join(counts, "pii_type").select(
        "pii_type", F.col("n").cast("bigint").alias("n"), "synthetic", "n_spans")


def response_source(fmt: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = common.fresh_dir(spark, "responses") + ("" if fmt == "parquet" else ".jsonl")
        derived.form_responses(spark, d).write.format(fmt).save(path)
        return tables.responses(spark, path)
    return run


def written_vault(spark: SparkSession, d: str) -> DataFrame:
    """Vault rows written to the table and read back."""
    path = common.fresh_dir(spark, "vault")
    vault_table.write_vault(common.keyed_vault(spark, d), path)
    return vault_table.read_vault(spark, path).select("session_id", "pii_type", "real", "synthetic")


def vault_after_delete(spark: SparkSession, d: str) -> DataFrame:
    path = common.fresh_dir(spark, "vault")
    vault_table.write_vault(common.keyed_vault(spark, d), path)
    vault_table.delete_session(spark, path, "7")
    return vault_table.read_vault(spark, path).select("session_id", "pii_type", "real", "synthetic")


VAULT_CTES = [SRC_FORMS, *span_ctes(), *resolved_ctes(), keyed_cte(),
              "vault as (select distinct session_id, pii_type, value as real, synthetic from named)"]


def register(c: Catalog) -> None:
    c.add("document_source",
          lambda s, d: tables.with_text_sha(tables.documents(s, d)).select(
              "doc_id", "lang", "source", "n_chars", "text_sha"),
          "select doc_id, lang, source, n_chars, sha256(text) as text_sha from documents")
    c.add("query_log", tables.queries,
          "select cast(conv_id as varchar) as session_id, turn as query_id, text "
          "from conversations where role = 'user'")
    c.add("document_sizes", lambda s, d: tables.doc_sizes(tables.documents(s, d)),
          "select doc_id, length(text) as n_chars, format('{:,}', length(text)) as n_chars_shown "
          "from documents")
    types = ", ".join(f"({q(k)}, {q(label)}, {q(icon)})" for k, (label, icon) in fv.PII_TYPES.items())
    c.add("type_dimension", type_dimension, with_(
        [SRC_FORMS, *span_ctes(), f"types(code, label, icon) as (values {types})"],
        "select code, label, icon, count(pii_type) as n_spans from types "
        "left join spans on code = pii_type group by all"))
    aliases = ", ".join(f"({q(a)}, {q(t)})" for a, t in fv.NER_ALIASES.items())
    c.add("alias_dimension", alias_dimension, with_(
        [SRC_ANSWERED, *ITEM_CTES, f"aliases(alias, pii_type) as (values {aliases})"],
        "select alias, pii_type, count(type) as n_items from aliases "
        "left join items on alias = lower(type) group by all"))
    pools = ", ".join(f"({q(t)}, {i}, {q(v)})" for t, pool in fv.ORDINAL_POOLS.items()
                      for i, v in enumerate(pool))
    c.add("pool_dimension", pool_dimension, with_(
        [SRC_FORMS, *span_ctes(), f"pools(pii_type, n, synthetic) as (values {pools})"],
        "select pii_type, cast(n as bigint) as n, synthetic, count(*) as n_spans "
        "from pools join spans using (pii_type) group by all"))
    responses_sql = ("select sha256(text) as text_sha, 'ner' as kind, response "
                     f"from ({derived.ANSWERED_FORMS_SQL}) f")
    c.add("response_source_parquet", response_source("parquet"), responses_sql)
    c.add("response_source_json", response_source("json"), responses_sql)
    c.add("written_vault", written_vault, with_(VAULT_CTES, "select * from vault"))
    c.add("vault_after_delete", vault_after_delete, with_(
        VAULT_CTES, "select * from vault where session_id <> '7'"))
    c.add("form_queries", lambda s, d: tables.build_query(tables.build_query(
        common.forms(s, d), INSTRUCTION), INSTRUCTION, head_chars=tables.HEAD_CHARS,
        out_col="head_query").select("doc_id", "query", "head_query"),
        with_([SRC_FORMS], f"select doc_id, {q(INSTRUCTION)} || chr(10) || chr(10) || text as query, "
              f"{q(INSTRUCTION)} || chr(10) || chr(10) || substr(text, 1, 200) as head_query from src"))
