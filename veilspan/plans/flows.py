"""The whole flow over the forms, with replies of all three kinds from one response table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.text import content_hash
from veilspan.operators import flow
from veilspan.operators.metrics import Stages
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.oracle_parts import (ENTITY_CTES, SAFE_CTES, keyed_cte, restored_ctes, span_ctes,
                                         spliced_cte, with_)
from veilspan.plans.restoration import REPLY_SQL, reply_to
from veilspan.plans.routes import PARSED
from veilspan.sources import forms as derived
from veilspan.sources import tables

RESULT = ("doc_id", "route", "pii_risk", *flow.COUNTS, "sanitized", "restored")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """How many forms share a text, from one written table: it tells hot keys without reading texts again."""
    path = common.fresh_dir(spark, "requests")
    common.forms(spark, d).groupBy(content_hash(F.col("text")).alias("text_sha")).agg(
        F.count("*").alias("n_docs")).write.parquet(path)
    return spark.read.schema("text_sha string, n_docs bigint").parquet(path)


def prepared(spark: SparkSession, d: str, stages: Stages | None = None) -> DataFrame:
    """The table at the boundary, written once."""
    path = common.fresh_dir(spark, "outbound")
    table = flow.prepare(common.forms(spark, d), derived.model_responses(spark, d), tables.dims(spark)["agent"],
                         common.QUERY_SALT, requests=requests(spark, d), stages=stages)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def cloud_replies(sent: DataFrame) -> DataFrame:
    """What the outside model answers: the text again, and a possessive."""
    return reply_to(flow.cloud_requests(sent).withColumnRenamed("text", "sanitized")).select(
        "text_sha", F.lit("cloud").alias("kind"), "response")


def whole_flow(spark: SparkSession, d: str) -> DataFrame:
    sent = prepared(spark, d)
    path = common.fresh_dir(spark, "responses")
    replies = derived.model_responses(spark, d).unionByName(cloud_replies(sent))
    replies.write.parquet(path)
    done = flow.complete(sent, tables.responses(spark, path))
    return done.withColumnRenamed("outbound", "sanitized").select(*RESULT)


def gated_by_route(spark: SparkSession, d: str) -> DataFrame:
    """What the detectors found and the merge kept, by route and risk."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in flow.COUNTS[:3]]
    return prepared(spark, d).groupBy("route", "pii_risk").agg(F.count("*").alias("n_queries"), *sums)


def measured_stages(spark: SparkSession, d: str) -> DataFrame:
    """Rows and items of each stage, counted while the boundary table was written."""
    stages = Stages("forms")
    prepared(spark, d, stages)
    return stages.table(spark)


FLOW = [
    f"answers as (select form_id as doc_id, session_id, text, response from ({derived.ANSWERED_FORMS_SQL}) f)",
    f"log as (select doc_id as query_id, session_id, text, {derived.ROUTER_RESPONSE_SQL} as response from "
    "(select *, doc_id as n from answers) r)",
    *PARSED[1:],
    "src as (select a.doc_id, a.session_id, a.text, r.route, r.pii_risk, case when r.pii_risk = 'low' then '' "
    "else a.response end as response from answers a join routed r on r.query_id = a.doc_id)",
    *span_ctes(), *ENTITY_CTES, *SAFE_CTES, keyed_cte("safe_placed"), spliced_cte()]
COUNTED = [
    "counted as (select s.doc_id, s.route, s.pii_risk, (select count(*) from spans x where x.doc_id = s.doc_id) "
    "as n_regex, (select count(*) from ner x where x.doc_id = s.doc_id) as n_ner, (select count(*) from safe x "
    "where x.doc_id = s.doc_id) as n_unique, (select count(*) from safe_placed x where x.doc_id = s.doc_id) as "
    "n_replaced from src s)"]

# Mappings come in the order of their first places; it decides between synthetic values of one length.
MAPS = ("maps as (select doc_id, min(start) as ord, value as real, synthetic from named "
        "group by doc_id, pii_type, value, synthetic)")


def register(c: Catalog) -> None:
    c.add("whole_flow", whole_flow, with_(
        [*FLOW, *COUNTED, REPLY_SQL, MAPS, *restored_ctes("replies", "maps")],
        "select c.*, case when route = 'cloud' then z.sanitized end as sanitized, case when route = 'cloud' then "
        "r.restored end as restored, case when route = 'cloud' then (select count(*) from maps m where m.doc_id = "
        "c.doc_id and contains(z.sanitized, m.real)) else 0 end as n_leaks from counted c join sanitized z using "
        "(doc_id) join restored r using (doc_id)"))
    c.add("gated_by_route", gated_by_route, with_(
        [*FLOW, *COUNTED], "select route, pii_risk, count(*) as n_queries, cast(sum(n_regex) as bigint) as n_regex, "
        "cast(sum(n_ner) as bigint) as n_ner, cast(sum(n_unique) as bigint) as n_unique from counted group by 1, 2"))
    c.add("measured_stages", measured_stages, with_(
        [*FLOW, *COUNTED], "select 'forms' as run_id, stage, n_rows, n_items from (select 'route' as stage, count(*) as "
        "n_rows, count(*) filter (route = 'local') as n_items from counted union all select 'pii', count(*), "
        "cast(sum(n_unique) as bigint) from counted union all select 'cloud', count(*), cast(sum(length(z.sanitized)) "
        "filter (route = 'cloud') as bigint) from counted c join sanitized z using (doc_id)) u"))
