"""Privacy audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions.arrays import unnest
from veilspan.functions import ner, routing
from veilspan.operators import audit, redact, restore
from veilspan.operators.detect import explode_spans, with_regex_spans
from veilspan.operators.routing import route
from veilspan.plans import common, routes
from veilspan.plans.catalog import Catalog
from veilspan.plans.entities import BOTH
from veilspan.plans.oracle_parts import (SAFE_CTES, SRC_DOCUMENTS, SRC_FORMS, keyed_cte, q,
                                         resolved_ctes, restored_ctes, span_ctes, spliced_cte,
                                         with_)
from veilspan.plans.redaction import KEYED_TEXT, RESOLVED
from veilspan.plans.restoration import KEYED_MAPS, REPLY_SQL, keyed_replies
from veilspan.plans.sources import VAULT_CTES
from veilspan.sources import tables

_TYPES = ", ".join(f"({q(k)}, {q(label)}, {q(icon)})" for k, (label, icon) in fv.PII_TYPES.items())
TYPES_CTE = f"types(pii_type, label, icon) as (values {_TYPES})"


def message_summary(spark: SparkSession, d: str) -> DataFrame:
    routed = route(routes.messages(spark, d), response_col=None, mode="rules")
    return audit.session_summary(routed)


def outbound(spark: SparkSession, d: str) -> DataFrame:
    """All that would leave for each form: two raw prompts and the redacted query."""
    df = redact.with_mappings(common.redacted(common.forms(spark, d)))
    return df.withColumns({
        "router_prompt": routing.router_prompt(F.col("text")),
        "ner_prompt": ner.prompt(F.col("text")),
        "cloud_prompt": F.col("sanitized")})


OUTBOUND = ("router_prompt", "ner_prompt", "cloud_prompt")


def safe_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Forms redacted from both detectors' merged spans."""
    merged = common.merged(spark, d).withColumn(
        "placed", F.filter("merged", lambda s: s["start"].isNotNull()))
    return redact.redact_keyed(merged, common.QUERY_SALT, spans_col="placed")


def seeded_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Redacted forms of which every tenth leaves as it is, against all values of both detectors."""
    out = safe_redacted(spark, d).select(
        F.when(F.col("doc_id") % 10 == 0, F.col("text")).otherwise(F.col("sanitized")).alias("cloud_prompt"),
        F.transform("named", lambda s: F.struct(s["pii_type"].alias("pii_type"), s["value"].alias("real")))
        .alias("reals"))
    # Written, since the values are read twice and the texts once more.
    path = common.fresh_dir(spark, "sent")
    out.write.parquet(path)
    sent = spark.read.schema(out.schema).parquet(path)
    values = unnest(sent, "reals", "s").select("s.pii_type", "s.real")
    return audit.value_leaks(sent, values, ["cloud_prompt"])


def stage_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stage timings as a table; each event stands for one timed stage."""
    return tables.table(spark, d, "events").selectExpr(
        "cast(user_id as string) as run_id",
        "case event_id % 3 when 0 then 'route' when 1 then 'pii' else 'cloud' end as stage",
        "cast(event_id % 1000 as double) / 8 as seconds")


def register(c: Catalog) -> None:
    c.add("session_summary", message_summary, with_(
        [*routes.MESSAGE_CTES, *routes.RULES],
        "select session_id, count(*) as total, count(*) filter (route = 'local') as local, "
        "count(*) filter (route = 'cloud') as cloud, "
        "100 * count(*) filter (route = 'local') // count(*) as on_device_pct from ruled group by 1"))
    c.add("session_summary_of_queries", lambda s, d: audit.session_summary(routes.by_model(s, d)),
          with_(routes.PARSED, "select session_id, count(*) as total, count(*) filter (route = 'local') "
                "as local, count(*) filter (route = 'cloud') as cloud, "
                "100 * count(*) filter (route = 'local') // count(*) as on_device_pct "
                "from routed group by 1"))
    c.add("item_counts", lambda s, d: audit.item_counts(explode_spans(
        common.resolved(common.forms(s, d)), ("session_id",)), ["session_id"]),
        with_(RESOLVED, "select session_id, count(*) as n_items, count(distinct value) as n_distinct "
              "from resolved join src using (doc_id) group by 1"))
    leak = ("(select count(distinct m.real) from maps m where m.doc_id = s.doc_id and "
            "contains({}, m.real))")
    prompts = {"router_prompt": f"{q(routing.ROUTER_PROMPT)} || s.text",
               "ner_prompt": f"{q(ner.PROMPT_HEAD)} || s.text || {q(ner.PROMPT_TAIL)}",
               "cloud_prompt": "z.sanitized"}
    c.add("own_leaks", lambda s, d: audit.own_leaks(outbound(s, d), OUTBOUND), with_(
        [*KEYED_TEXT, KEYED_MAPS], "select s.doc_id, " + ", ".join(
            f"{leak.format('(' + x + ')')} as {n}_leaks" for n, x in prompts.items())
        + " from src s join sanitized z using (doc_id)"))
    # Detection runs again over every outbound text.
    texts = " union all ".join(
        f"select '{n}' as outbound, s.doc_id as id, {x} as text from src s join sanitized z using (doc_id)"
        for n, x in prompts.items())
    out_src = (f"out_src as (select row_number() over () as doc_id, outbound, text from ({texts}) t)")
    c.add("leak_check", lambda s, d: audit.leak_check(
        outbound(s, d), common.keyed_vault(s, d), OUTBOUND), with_(
        [*KEYED_TEXT, out_src, *span_ctes(src="out_src", out="out_spans")],
        "select outbound, pii_type, value, count(distinct doc_id) as n_texts from out_spans "
        "join out_src using (doc_id) where value in (select value from named) group by all"))
    c.add("reconciliation", lambda s, d: audit.reconcile(safe_redacted(s, d)), with_(
        [*BOTH, *SAFE_CTES], "select s.doc_id, count(x.value) as n_detected, count(x.start) as n_located, "
        "count(x.start) as n_replaced from src s left join safe x using (doc_id) group by 1"))
    c.add("safe_redacted_forms", lambda s, d: safe_redacted(s, d).select("doc_id", "sanitized"),
          with_([*BOTH, *SAFE_CTES, keyed_cte("safe_placed"), spliced_cte()],
                "select doc_id, sanitized from sanitized"))
    bare = "' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    c.add("value_leaks", seeded_leaks, with_(
        [*BOTH, *SAFE_CTES, keyed_cte("safe_placed"), spliced_cte(),
         f"vals as (select distinct pii_type, value, {bare.format('value')} as v from named)",
         f"sent as (select doc_id, {bare.format('case when doc_id % 10 = 0 then text else sanitized end')} "
         "as t from sanitized)"],
        "select 'cloud_prompt' as outbound, pii_type, value, count(*) as n_texts from vals join sent "
        "on contains(t, v) where v <> '  ' group by all"))
    c.add("mapping_report", lambda s, d: audit.mapping_report(
        common.keyed_vault(s, d), tables.dims(s)["pii_type"]), with_(
        [*VAULT_CTES, TYPES_CTE], "select session_id, icon, label, rpad(substr(real, 1, 30), 30, ' ') "
        "as real_shown, synthetic from vault join types using (pii_type)"))
    c.add("side_by_side", lambda s, d: audit.side_by_side(restore.restore(
        keyed_replies(s, d).withColumn("response", F.when(F.col("doc_id") % 10 != 0, F.col("response"))))),
        with_([*KEYED_TEXT, REPLY_SQL, KEYED_MAPS, *restored_ctes("replies", "maps")],
              "select doc_id, case when doc_id % 10 = 0 then '(no cloud response)' else "
              "substr(restored, 1, 600) end as user_sees, case when doc_id % 10 = 0 then "
              "'(no cloud response)' else substr(response, 1, 600) end as cloud_saw "
              "from replies join restored using (doc_id)"))
    c.add("stage_metrics", lambda s, d: audit.stage_metrics(stage_rows(s, d)),
          "select cast(user_id as varchar) as run_id, "
          "sum((event_id % 1000)::double / 8) filter (event_id % 3 = 0) as route, "
          "sum((event_id % 1000)::double / 8) filter (event_id % 3 = 1) as pii, "
          "sum((event_id % 1000)::double / 8) filter (event_id % 3 = 2) as cloud, "
          "sum((event_id % 1000)::double / 8) as total from events group by 1")
    c.add("rendered_spans", lambda s, d: audit.render_spans(explode_spans(
        common.merged(s, d), spans_col="merged"), tables.dims(s)["pii_type"]), with_(
        [*BOTH, *SAFE_CTES, TYPES_CTE], "select doc_id, start, icon || ' ' || rpad(label, 10, ' ') || "
        "' ''' || substr(value, 1, 45) || ''' (conf=' || format('{:.2f}', confidence) || ') [' || source "
        "|| ']' as line from safe join types using (pii_type)"))
    c.add("density_with_totals", lambda s, d: audit.density(
        with_regex_spans(common.documents(s, d)), "lang", "source"),
        with_([SRC_DOCUMENTS, *span_ctes()], "select s.pii_type, d.lang, d.source, count(*) as n_items, "
              "grouping(s.pii_type, d.lang, d.source) as level from spans s join documents d "
              "using (doc_id) group by rollup (s.pii_type, d.lang, d.source)"))
