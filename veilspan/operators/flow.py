"""The whole way of a query: route, detection as the risk asks for, redaction, reply, restoration.

There is one boundary, where texts leave for the outside model: ``prepare`` gives the table that is written
there, ``complete`` continues from it with the replies. Model replies of every kind are rows of one response
table, keyed by the hash of the text that was submitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import content_hash
from veilspan.operators.detect import with_regex_spans
from veilspan.operators.entities import join_responses, with_ner_spans
from veilspan.operators.merge import gate_responses, with_merged_spans
from veilspan.operators.metrics import Stages
from veilspan.operators.redact import redact_keyed, with_mappings
from veilspan.operators.restore import restore
from veilspan.operators.routing import route, with_agent_prompt
from veilspan.sources.tables import with_text_sha

COUNTS = ("n_regex", "n_ner", "n_unique", "n_replaced", "n_leaks")
ROUTING = ("agent", "pii_risk", "complexity", "route")


def _no_key(id_col: str) -> Column:
    """A key that no response has; one for each row, for null keys would all meet in one task."""
    return F.concat(F.lit("-"), F.col(id_col).cast("string"))


def _answered(queries: DataFrame, responses: DataFrame, kind: str, requests: DataFrame | None,
              id_col: str) -> DataFrame:
    return join_responses(queries, responses, kind, requests, id_col=id_col)


def routed_queries(queries: DataFrame, responses: DataFrame, requests: DataFrame | None = None,
                   id_col: str = "doc_id") -> DataFrame:
    """Queries with the router model's record; where there is none, its conservative fallback."""
    return route(_answered(with_text_sha(queries), responses, "router", requests, id_col)).drop("response")


def gated_spans(routed: DataFrame, responses: DataFrame, requests: DataFrame | None = None,
                id_col: str = "doc_id") -> DataFrame:
    """Both detectors' spans and their safe merge; where the risk is low, the model is not asked.

    The response of a low-risk query is neither joined nor parsed.
    """
    gate = F.when(F.col("pii_risk") != "low", F.col("text_sha")).otherwise(_no_key(id_col))
    asked = _answered(routed.withColumn("text_sha", gate), responses, "ner", requests, id_col)
    both = with_ner_spans(with_regex_spans(gate_responses(asked)))
    return with_merged_spans(both).drop("response", "text_sha")


def prepare(queries: DataFrame, responses: DataFrame, agents: DataFrame, salt: str | None = None,
            requests: DataFrame | None = None, stages: Stages | None = None,
            id_col: str = "doc_id") -> DataFrame:
    """All that happens before a text leaves: one row for each query (id, session_id, text).

    ``outbound`` is the redacted text with the agent's instructions beside it, null where the route is local:
    nothing leaves then. Texts without personal data pass as they are. ``n_leaks`` counts the query's
    own real values that still stand in what leaves. ``requests`` (text_sha, n_docs) tells hot texts.
    """
    stages = stages or Stages()
    routed = stages.watch(routed_queries(queries, responses, requests, id_col), "route",
                          n_items=F.count_if(F.col("route") == "local"))
    found = gated_spans(routed, responses, requests, id_col).withColumn(
        "placed", F.filter("merged", lambda s: s["start"].isNotNull()))
    found = stages.watch(found, "pii", n_items=F.sum(F.size("merged")))
    redacted = with_mappings(redact_keyed(found, salt, spans_col="placed"))
    leaves = F.when(F.col("route") == "cloud", F.col("sanitized"))
    leaked = F.coalesce(F.size(F.filter("mappings", lambda m: F.contains(leaves, m["real"]))), F.lit(0))
    sizes = {"n_regex": F.size("spans"), "n_ner": F.size("ner_spans"), "n_unique": F.size("merged"),
             "n_replaced": F.size("placed"), "n_leaks": leaked}
    out = with_agent_prompt(redacted, agents).select(
        id_col, "session_id", *ROUTING, "system_prompt", leaves.alias("outbound"), "mappings",
        *[sizes[c].cast("bigint").alias(c) for c in COUNTS])
    return stages.watch(out, "cloud", n_items=F.sum(F.length("outbound")))


def cloud_requests(prepared: DataFrame) -> DataFrame:
    """What goes to the outside model: one row for each distinct request."""
    return prepared.filter(F.col("outbound").isNotNull()).select(
        content_hash(F.col("outbound")).alias("text_sha"), "system_prompt", F.col("outbound").alias("text")).distinct()


def complete(prepared: DataFrame, responses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Replies joined to what was sent, with the real values put back: adds ``response``, ``restored``.

    Both are null for local queries and where no reply came.
    """
    sent = prepared.withColumn("text_sha", F.coalesce(content_hash(F.col("outbound")), _no_key(id_col)))
    replied = join_responses(sent, responses, "cloud", text_col="outbound", id_col=id_col)
    return restore(replied, id_col=id_col).drop("text_sha")
