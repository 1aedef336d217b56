"""Entity-model requests, responses, and merging with pattern hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions import ner
from veilspan.functions.spans import propagate_values
from veilspan.functions.text import strip
from veilspan.operators import entities, merge
from veilspan.operators.detect import explode_spans, with_regex_spans
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.detection import ALL, COLUMNS
from veilspan.plans.oracle_parts import (ENTITY_CTES, IS_ANSWERED, ITEM_CTES, OVERLAP,
                                         PARITY_CTES, SAFE_CTES, SAME, SRC_ANSWERED,
                                         SRC_DOCUMENTS, SRC_FORMS, propagated_ctes, q, span_ctes,
                                         with_)
from veilspan.sources import forms as derived
from veilspan.sources import tables

PROMPT_SQL = f"{q(ner.PROMPT_HEAD)} || text || {q(ner.PROMPT_TAIL)}"
BOTH = [SRC_ANSWERED, *span_ctes(), *ENTITY_CTES]


def written_requests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The request table, as it is written for the model to work through."""
    path = common.fresh_dir(spark, "requests")
    entities.ner_requests(docs).write.parquet(path)
    return spark.read.schema("text_sha string, prompt string, n_docs bigint").parquet(path)


def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the documents answered once per text, then given to every copy."""
    docs = common.documents(spark, d)
    requests = written_requests(spark, docs)
    answers = requests.select("text_sha", F.lit("ner").alias("kind"), F.concat(
        F.lit("copies: "), F.col("n_docs").cast("string")).alias("response"))
    return entities.join_responses(docs, answers, requests=requests).select("doc_id", "response")


def item_rows(make):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = common.answered(spark, d)
        return (df.filter(ner.answered(F.col("response")))
                .select("doc_id", F.posexplode_outer(make(F.col("response"))).alias("pos", "i"))
                .filter("pos is not null")
                .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "i.entity", "i.type",
                        "i.confidence"))
    return run


def typed_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with their type code: a join with the alias dimension, which has fixed size."""
    aliases = F.broadcast(tables.dims(spark)["ner_alias"])
    items = item_rows(ner.items)(spark, d)
    return items.join(aliases, F.lower("type") == F.col("alias")).select(
        "doc_id", "pos", "entity", "pii_type")


def real_items(spark: SparkSession, d: str) -> DataFrame:
    return typed_items(spark, d).withColumn("entity", strip(F.col("entity"))).filter(
        ~F.col("entity").isin("", "...", "<entity>"))


def unlabelled_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with their text, to cut label prefixes; the texts are unique by id."""
    found = common.answered(spark, d).select(
        "doc_id", "text", F.posexplode_outer(ner.items(F.col("response"))).alias("pos", "i"))
    known = F.try_element_at(ner.alias_map(), F.lower("i.type")).isNotNull()
    real = ~strip(F.col("i.entity")).isin("", "...", "<entity>")
    return found.filter(known & real).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"),
        ner.clean_value(F.col("i.entity"), F.col("text")).alias("value"))


def clamped(spark: SparkSession, d: str) -> DataFrame:
    return item_rows(ner.items)(spark, d).select(
        "doc_id", "pos", ner.clean_confidence(F.col("confidence")).alias("score"))


def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: request key, response table, parsing, filters, location."""
    docs = common.forms(spark, d)
    return entities.parse_ner(docs, derived.form_responses(spark, d),
                              requests=written_requests(spark, docs)).select(*COLUMNS)


def detector_union(spark: SparkSession, d: str) -> DataFrame:
    """Both detectors' spans; a text is read once and its spans exploded once."""
    both = common.detected(spark, d).select("doc_id", F.concat("spans", "ner_spans").alias("spans"))
    return explode_spans(both).select(*COLUMNS)


def long_both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities and pattern hits from one written table, so that no text is read twice."""
    path = common.fresh_dir(spark, "spans")
    both = detector_union(spark, d)
    both.write.parquet(path)
    found = spark.read.schema(both.schema).parquet(path)
    is_regex = F.col("source") == fv.REGEX_SOURCE
    return found.filter(~is_regex), found.filter(is_regex)


def long_ner(spark: SparkSession, d: str) -> DataFrame:
    return explode_spans(entities.with_ner_spans(common.answered(spark, d)),
                         spans_col="ner_spans")


def merged_rows(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return explode_spans(common.merged(spark, d, mode), spans_col="merged").select(*COLUMNS)
    return run


def long_parity(spark: SparkSession, d: str) -> DataFrame:
    found, regex = long_both(spark, d)
    return merge.merge_spans(regex, found, "parity").select(*COLUMNS)


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Entity and pattern hit of the same text that share characters."""
    return merge.overlapping(*long_both(spark, d)).select(
        "a.doc_id", F.col("a.ord").alias("ner_ord"), F.col("b.ord").alias("regex_ord"),
        F.col("b.start").alias("regex_start"))


def without_overlaps(same_values: bool):
    return lambda s, d: merge.without_overlaps(
        *long_both(s, d), same_values=same_values).select(*COLUMNS)


def final_order(spark: SparkSession, d: str) -> DataFrame:
    return merge.final_order(detector_union(spark, d)).select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), "start", "ord", "value")


def gated(spark: SparkSession, d: str) -> DataFrame:
    """Every third form counts as low risk: its response is not even parsed."""
    risk = F.when(F.col("doc_id") % 3 == 0, "low").otherwise("high")
    df = merge.gate_responses(common.answered(spark, d).withColumn("pii_risk", risk))
    both = with_regex_spans(entities.with_ner_spans(df))
    return merge.merge_summary(merge.with_merged_spans(both, "parity"))


def propagated(spark: SparkSession, d: str) -> DataFrame:
    df = with_regex_spans(common.forms(spark, d)).withColumn(
        "spans", propagate_values(F.col("text"), F.col("spans")))
    return explode_spans(df).select(*COLUMNS)


def register(c: Catalog) -> None:
    c.add("entity_prompts", lambda s, d: common.documents(s, d).select(
        "doc_id", F.sha2(ner.prompt(F.col("text")), 256).alias("prompt_sha"),
        F.length(ner.prompt(F.col("text"))).cast("bigint").alias("n_chars")),
        with_([SRC_DOCUMENTS], f"select doc_id, sha256({PROMPT_SQL}) as prompt_sha, "
              f"length({PROMPT_SQL}) as n_chars from src"))
    c.add("entity_requests", lambda s, d: entities.ner_requests(common.documents(s, d)).select(
        "text_sha", F.sha2("prompt", 256).alias("prompt_sha"), "n_docs"),
        with_([SRC_DOCUMENTS], f"select sha256(text) as text_sha, sha256({PROMPT_SQL}) as prompt_sha, "
              "count(*) as n_docs from src group by all"))
    c.add("response_fan_out", fan_out, with_(
        [SRC_DOCUMENTS], "select doc_id, 'copies: ' || cast(count(*) over (partition by text) "
        "as varchar) as response from src"))
    c.add("unanswered_forms", lambda s, d: common.answered(s, d).filter(
        ~ner.answered(F.col("response"))).select(
        "doc_id", F.size(ner.items(F.col("response"))).cast("bigint").alias("n_items")),
        with_([SRC_ANSWERED], f"select doc_id, 0::bigint as n_items from src where not ({IS_ANSWERED})"))
    items_sql = "select doc_id, pos, entity, type, confidence from "
    c.add("bullet_items", item_rows(ner.bullet_items),
          with_([SRC_ANSWERED, *ITEM_CTES], items_sql + "bullets"))
    c.add("json_items", item_rows(ner.json_items),
          with_([SRC_ANSWERED, *ITEM_CTES], items_sql + "json_rows"))
    c.add("response_items", item_rows(ner.items),
          with_([SRC_ANSWERED, *ITEM_CTES], items_sql + "items"))
    c.add("typed_items", typed_items,
          with_([SRC_ANSWERED, *ENTITY_CTES], "select doc_id, pos, entity, pii_type from typed"))
    c.add("real_items", real_items, with_(
        [SRC_ANSWERED, *ENTITY_CTES], "select doc_id, pos, stripped as entity, pii_type from real_items"))
    c.add("unlabelled_items", unlabelled_items,
          with_([SRC_ANSWERED, *ENTITY_CTES], "select doc_id, pos, value from unlabelled"))
    c.add("located_entities", lambda s, d: long_ner(s, d).select("doc_id", "ord", "start", "end"),
          with_([SRC_ANSWERED, *ENTITY_CTES], 'select doc_id, ord, start, "end" from ner'))
    c.add("propagated_spans", propagated, with_(
        [SRC_FORMS, *span_ctes(), *propagated_ctes("spans")], ALL + "propagated"))
    c.add("clamped_confidence", clamped, with_(
        [SRC_ANSWERED, *ITEM_CTES], "select doc_id, pos, case when try_cast(confidence as double) "
        "between 0 and 1 then try_cast(confidence as double) else 0.9::double end as score from items"))
    c.add("confident_entities", entity_spans, with_([SRC_ANSWERED, *ENTITY_CTES], ALL + "ner"))
    c.add("response_previews", lambda s, d: entities.response_previews(
        derived.form_responses(s, d)),
        with_([SRC_ANSWERED], "select sha256(text) as text_sha, length(response) as n_chars, "
              "substr(response, 1, 500) as preview from src"))
    c.add("overlap_pairs", overlap_pairs, with_(
        BOTH, "select a.doc_id, a.ord as ner_ord, b.ord as regex_ord, b.start as regex_start "
        f"from ner a join spans b on a.doc_id = b.doc_id and {OVERLAP}"))
    anti = "select a.* from ner a where not exists (select 1 from spans b where b.doc_id = a.doc_id and "
    c.add("entities_without_overlap", without_overlaps(False), with_(BOTH, f"{anti}{OVERLAP})"))
    c.add("entities_without_clash", without_overlaps(True), with_(BOTH, f"{anti}({OVERLAP} or {SAME}))"))
    parity_sql = with_([*BOTH, *PARITY_CTES], ALL + "parity")
    c.add("merged_spans_parity", merged_rows("parity"), parity_sql)
    c.add("merged_spans_parity_long", long_parity, parity_sql)
    c.add("merged_spans_safe", merged_rows("safe"), with_([*BOTH, *SAFE_CTES], ALL + "safe"))
    c.add("detector_union", detector_union,
          with_(BOTH, ALL + "spans union all " + ALL + "ner"))
    c.add("final_order", final_order, with_(
        [*BOTH, "u as (select * from spans union all select * from ner)"],
        "select doc_id, row_number() over (partition by doc_id order by start nulls last, ord) - 1 "
        "as rank, start, ord, value from u"))
    counts = ("(select count(*) from spans x where x.doc_id = s.doc_id) as n_regex, "
              "(select count(*) from ner x where x.doc_id = s.doc_id) as n_ner, "
              "(select count(*) from parity x where x.doc_id = s.doc_id) as n_unique")
    c.add("merge_summary", lambda s, d: merge.merge_summary(common.merged(s, d, "parity")),
          with_([*BOTH, *PARITY_CTES], f"select doc_id, {counts} from src s"))
    # Low-risk forms: pattern hits only.
    c.add("gated_merge_summary", gated, with_(
        [*BOTH, *PARITY_CTES], "select doc_id, n_regex, case when doc_id % 3 = 0 then 0 else n_ner end "
        "as n_ner, case when doc_id % 3 = 0 then n_regex else n_unique end as n_unique "
        f"from (select doc_id, {counts} from src s) c"))
