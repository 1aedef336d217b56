"""Routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import routing as rules
from veilspan.operators import routing
from veilspan.operators.detect import with_regex_spans
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.oracle_parts import SRC_FORMS, q, span_ctes, with_
from veilspan.plans.sources import INSTRUCTION
from veilspan.sources import forms as derived
from veilspan.sources import tables

ROUTED = f"log as ({derived.ROUTED_QUERIES_SQL})"
FIELDS = ("agent", "pii_risk", "complexity", "route")

_BODY = "regexp_extract(response, '(?s)\\{.*\\}')"


def _field(name: str, allowed: str, default: str) -> str:
    value = f"json_extract_string(body, '$.{name}')"
    return f"case when {value} in ({allowed}) then {value} else '{default}' end as {name}"


PARSED = [
    ROUTED,
    f"bodies as (select *, case when json_valid({_BODY}) then {_BODY} else '{{}}' end as body from log)",
    "routed as (select session_id, query_id, text, "
    + ", ".join((_field("agent", "'research','admin','general'", "general"),
                 _field("pii_risk", "'low','medium','high'", "high"),
                 _field("complexity", "'simple','moderate','complex'", "complex"),
                 _field("route", "'local','cloud'", "cloud"))) + " from bodies)"]

# The rules over forms and over the query log, as CASE expressions.
_RISK = ("case when doc_id in (select doc_id from spans where pii_type in ('PERSON_NAME', 'ADDRESS', "
         "'SSN', 'ACCOUNT_NUMBER', 'INCOME_AMOUNT')) then 'high' when doc_id in (select doc_id from "
         "spans) then 'medium' else 'low' end as pii_risk")
RULES = [
    "features as (select *, case when regexp_matches(lower(text), "
    f"{q(rules.ADMIN_WORDS)}) then 'admin' when regexp_matches(lower(text), {q(rules.RESEARCH_WORDS)}) "
    f"then 'research' else 'general' end as agent, {_RISK}, case when "
    "len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) > 100 or regexp_matches(lower(text), "
    f"{q(rules.COMPLEX_WORDS)}) then 'complex' when len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) "
    "<= 25 then 'simple' else 'moderate' end as complexity from src)",
    "ruled as (select *, case when complexity = 'simple' and pii_risk = 'low' then 'local' "
    "else 'cloud' end as route from features)"]
SRC_LOG = (f"src as (select session_id || '/' || query_id as doc_id, session_id, "
           f"query_id, text from ({derived.ROUTED_QUERIES_SQL}) l)")
SRC_FORM_QUERIES = ("src as (select doc_id, session_id, " + q(INSTRUCTION)
                    + " || chr(10) || chr(10) || text as text from form_rows)")
FORM_QUERY_CTES = [SRC_FORMS.replace("src as", "form_rows as", 1), SRC_FORM_QUERIES, *span_ctes()]
MESSAGE_CTES = [f"src as (select event_id as doc_id, session_id, text from ({derived.MESSAGES_SQL}) m)",
                *span_ctes()]


def by_model(spark: SparkSession, d: str) -> DataFrame:
    return routing.route(derived.routed_queries(spark, d))


def form_queries(spark: SparkSession, d: str) -> DataFrame:
    return tables.build_query(common.forms(spark, d), INSTRUCTION, out_col="text")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return derived.messages(spark, d).withColumnRenamed("event_id", "doc_id")


def by_rules(source):
    return lambda s, d: routing.route(with_regex_spans(source(s, d)), spans_col="spans",
                                      response_col=None, mode="rules").select("doc_id", *FIELDS)


def rule_then_prompt(spark: SparkSession, d: str) -> DataFrame:
    return routing.with_agent_prompt(by_model(spark, d), tables.dims(spark)["agent"]).select(
        "session_id", "query_id", "agent", "system_prompt")


def mixed(spark: SparkSession, d: str) -> DataFrame:
    return routing.route(derived.routed_queries(spark, d), mode="model_then_rules").select(
        "session_id", "query_id", *FIELDS)


def rule_check(spark: SparkSession, d: str) -> DataFrame:
    """The rule applied to the model's own classes, beside the route it gave."""
    return by_model(spark, d).select("session_id", "query_id", "route", rules.route_rule(
        F.col("complexity"), F.col("pii_risk")).alias("rule_route"))


def register(c: Catalog) -> None:
    c.add("router_prompts", lambda s, d: routing.router_requests(tables.queries(s, d)).select(
        "session_id", "query_id", "router_prompt"),
        "select cast(conv_id as varchar) as session_id, turn as query_id, "
        f"{q(rules.ROUTER_PROMPT)} || text as router_prompt from conversations where role = 'user'")
    fields = ", ".join(FIELDS)
    c.add("routes_by_model", lambda s, d: by_model(s, d).select("session_id", "query_id", *FIELDS),
          with_(PARSED, f"select session_id, query_id, {fields} from routed"))
    c.add("fallback_routes", lambda s, d: by_model(s, d).filter(
        "agent = 'general' and pii_risk = 'high' and complexity = 'complex' and route = 'cloud'")
        .select("session_id", "query_id"),
        with_([ROUTED], "select session_id, query_id from log where response = '' or "
              "starts_with(response, '[API') or not contains(response, '{') "
              "or ends_with(response, ' and }')"))
    c.add("route_rule_check", rule_check, with_(
        PARSED, "select session_id, query_id, route, case when complexity = 'simple' and "
        "pii_risk = 'low' then 'local' else 'cloud' end as rule_route from routed"))
    c.add("routes_by_rules_of_forms", by_rules(form_queries), with_(
        [*FORM_QUERY_CTES, *RULES], f"select doc_id, {fields} from ruled"))
    c.add("routes_by_rules_of_messages", by_rules(messages), with_(
        [*MESSAGE_CTES, *RULES], f"select doc_id, {fields} from ruled"))
    c.add("routes_by_rules_of_documents", by_rules(common.documents), with_(
        ["src as (select doc_id, text from documents)", *span_ctes(), *RULES],
        f"select doc_id, {fields} from ruled"))
    mixed_fields = ", ".join(f"case when log.response <> '' and not starts_with(log.response, '[API') "
                             f"then m.{f} else r.{f} end as {f}" for f in FIELDS)
    c.add("routes_by_model_then_rules", mixed, with_(
        [*PARSED, SRC_LOG, *span_ctes(), *RULES],
        f"select session_id, query_id, {mixed_fields} from log join routed m using (session_id, "
        "query_id) join ruled r using (session_id, query_id)"))
    prompts = ", ".join(f"({q(a)}, {q(p)})" for a, p in rules.AGENT_PROMPTS.items())
    c.add("agent_prompts", rule_then_prompt, with_(
        [*PARSED, f"agents(agent, system_prompt) as (values {prompts})"],
        "select session_id, query_id, agent, system_prompt from routed left join agents using (agent)"))
    c.add("query_previews", lambda s, d: routing.query_previews(tables.queries(s, d)).select(
        "session_id", "query_id", "preview"),
        "select cast(conv_id as varchar) as session_id, turn as query_id, case when length(text) > 70 "
        "then replace(substr(text, 1, 70), chr(10), ' ') || '...' else text end as preview "
        "from conversations where role = 'user'")
