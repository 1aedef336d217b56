"""What is kept between runs: requests by content, distinct counts as sketches, and the exposure audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.arrays import unnest
from veilspan.functions.text import strip
from veilspan.operators import exposure, sketches
from veilspan.operators.detect import with_regex_spans
from veilspan.operators.entities import join_responses
from veilspan.plans import common
from veilspan.plans.catalog import Catalog
from veilspan.plans.oracle_parts import SRC_DOCUMENTS, SRC_MESSAGES, span_ctes, strip as sql_strip, with_
from veilspan.plans.sources import VAULT_CTES
from veilspan.sources import forms as derived
from veilspan.sources import request_table

# The first run sees the documents of this language alone, the second all.
FIRST_LANG = "en"


def two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = common.documents(spark, d)
    path = common.fresh_dir(spark, "requests")
    first = request_table.send_new(docs.filter(F.col("lang") == FIRST_LANG), path, 1)
    return docs, first, request_table.send_new(docs, path, 2)


def sent_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Requests of two runs, and of a third over the same documents, which sends none."""
    docs, first, second = two_runs(spark, d)
    runs = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    path = common.fresh_dir(spark, "requests")
    request_table.send_new(docs, path, 1)
    third = request_table.send_new(docs, path, 2).withColumn("run", F.lit(3))
    return runs.unionByName(third).select("run", "text_sha", F.sha2("prompt", 256).alias("prompt_sha"), "n_docs")


def first_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every document gets the first response to its text, whenever it was sent."""
    docs, first, second = two_runs(spark, d)
    sent = first.unionByName(second)

    def answers(word: str, day: str) -> DataFrame:
        return sent.select("text_sha", F.lit("ner").alias("kind"), F.concat(F.lit(word), F.left("text_sha", F.lit(6)))
                           .alias("response"), F.lit(day).cast("timestamp").alias("ts"))
    replies = request_table.first_responses(answers("a late ", "2024-01-02").unionByName(answers("early ", "2024-01-01")))
    return join_responses(docs, replies, requests=sent).select("doc_id", "response")


def daily(messages: DataFrame) -> DataFrame:
    return with_regex_spans(messages.withColumn("day", F.to_date("ts")))


def rolled_up_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of all days and sessions from stored sketches, and whether their distinct count is close."""
    found = daily(derived.messages(spark, d))
    made = sketches.item_sketches(found)
    path = common.fresh_dir(spark, "sketches")
    made.write.parquet(path)
    total = sketches.rolled_up(spark.read.schema(made.schema).parquet(path), ["pii_type"])
    exact = unnest(found, "spans", "s").select(
        F.col("s.pii_type").alias("pii_type"), F.lower(strip(F.col("s.value"))).alias("value")).distinct().groupBy(
        "pii_type").agg(F.count("*").alias("n_distinct"))
    return total.join(exact, "pii_type").select(
        "pii_type", "n_items", "n_distinct",
        sketches.within(F.col("n_distinct_about"), F.col("n_distinct")).alias("is_close"))


def register(c: Catalog) -> None:
    from veilspan.plans.entities import PROMPT_SQL
    sent = (f"select text, sha256(text) as text_sha, sha256({PROMPT_SQL}) as prompt_sha, count(*) as n_docs, "
            "count(*) filter (lang = '" + FIRST_LANG + "') as n_first from documents where text is not null group by text")
    c.add("requests_by_run", sent_by_run, (
        f"with sent as ({sent}) select 1 as run, text_sha, prompt_sha, n_first as n_docs from sent where n_first > 0 "
        "union all select 2, text_sha, prompt_sha, n_docs from sent where n_first = 0"))
    c.add("first_responses", first_answers,
          "select doc_id, 'early ' || substr(sha256(text), 1, 6) as response from documents")
    c.add("rolled_up_items", rolled_up_items, with_(
        [SRC_MESSAGES, *span_ctes()], "select pii_type, count(*) as n_items, count(distinct "
        f"{sql_strip('lower(value)')}) as n_distinct, true as is_close from spans group by 1"))
    plain = {side: sql_strip(f"lower({side})") for side in ("synthetic", "real")}
    c.add("synthetic_reals", lambda s, d: exposure.synthetic_reals(common.keyed_vault(s, d)), with_(
        [*VAULT_CTES, f"given as (select distinct pii_type, session_id, {plain['synthetic']} as value from vault)",
         f"reals as (select distinct pii_type, session_id, {plain['real']} as value from vault)"],
        "select g.pii_type, g.value, count(distinct g.session_id) as n_given, count(distinct r.session_id) as n_real, "
        "count(distinct case when g.session_id = r.session_id then g.session_id end) as same_session "
        "from given g join reals r on r.pii_type = g.pii_type and r.value = g.value group by 1, 2"))
    c.add("small_groups", lambda s, d: exposure.small_groups(
        with_regex_spans(common.documents(s, d)), ["lang", "source"]), with_(
        [SRC_DOCUMENTS, *span_ctes(), "held as (select doc_id, string_agg(distinct pii_type, '+' order by pii_type) "
         "as kinds from spans group by 1)"],
        "select kinds, lang, source, count(*) as n_texts from held join documents using (doc_id) group by all "
        f"having count(*) < {exposure.SMALL_GROUP}"))
