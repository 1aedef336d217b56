"""Routing queries, and what depends on the route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import ner
from veilspan.functions.routing import (FIELDS, fallback, parse_routing, preview, router_prompt,
                                        rule_features)
from veilspan.operators.detect import with_regex_spans


def router_requests(queries: DataFrame, text_col: str = "text") -> DataFrame:
    return queries.withColumn("router_prompt", router_prompt(F.col(text_col)))


def route(queries: DataFrame, text_col: str = "text", response_col: str | None = "response",
          spans_col: str | None = None, mode: str = "model") -> DataFrame:
    """Add agent, pii_risk, complexity and route (no shuffle).

    ``model``: the record of the router's response, or the conservative fallback.
    ``rules``: keywords, size and the personal data found in the query.
    ``model_then_rules``: rules decide where there is no response at all.
    """
    if mode not in ("model", "rules", "model_then_rules"):
        raise ValueError(f"unknown routing mode: {mode}")
    source, spans = queries, spans_col or "_spans"
    if mode != "model" and spans_col is None:
        source = with_regex_spans(queries, text_col=text_col, out_col=spans)
    otherwise = fallback() if mode == "model" else rule_features(F.col(text_col), F.col(spans))
    record = otherwise
    if mode != "rules":
        response = F.col(response_col)
        record = F.when(ner.answered(response), parse_routing(response)).otherwise(otherwise)
    return (source.withColumn("routing", record)
            .withColumns({f: F.col("routing")[f] for f in FIELDS}).drop("routing", "_spans"))


def with_agent_prompt(routed: DataFrame, agents: DataFrame) -> DataFrame:
    """Add the agent's instructions; the dimension has one row per agent, three in all."""
    return routed.join(F.broadcast(agents), "agent", "left")


def query_previews(queries: DataFrame, text_col: str = "text") -> DataFrame:
    return queries.withColumn("preview", preview(F.col(text_col)))
