"""Query routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions.arrays import let
from veilspan.functions.ner import answered

ROUTER_PROMPT = (
    "Classify the user query and answer with one JSON object only, with the keys agent "
    "(research, admin or general), pii_risk (low, medium or high), complexity (simple, moderate "
    "or complex) and route (local or cloud). research: products, comparisons, look-ups, "
    "analysis. admin: personal documents, bills, tax, legal or health papers. general: "
    "greetings, quick facts, arithmetic. pii_risk is high if names, addresses, identity, "
    "financial or health data occur. route is local if simple and low risk, else cloud.\n\n"
    "User query: ")
AGENT_PROMPTS = {
    "research": "Research the question thoroughly; use headings, lists and comparison tables.",
    "admin": "Analyse the document; stress dates and amounts, list what to do and what is urgent.",
    "general": "Answer the question directly and in few words.",
}
FIELDS = tuple(fv.ROUTING_VALUES)
ROUTING_TYPE = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"

ADMIN_WORDS = "tax|bill|legal|lease|health|invoice|document"
RESEARCH_WORDS = "compare|best|recommend|analy|versus"
COMPLEX_WORDS = "compare|summari|analy"
HIGH_RISK_TYPES = ("PERSON_NAME", "ADDRESS", "SSN", "ACCOUNT_NUMBER", "INCOME_AMOUNT")
PREVIEW_CHARS = 70


def router_prompt(query: Column) -> Column:
    return F.concat(F.lit(ROUTER_PROMPT), query)


def routing_record(**fields: Column) -> Column:
    return F.struct(*[fields[f].alias(f) for f in FIELDS])


def fallback() -> Column:
    return routing_record(**{f: F.lit(v) for f, v in fv.ROUTING_FALLBACK.items()})


def parse_routing(response: Column) -> Column:
    """Record of a router response, from first { to last }.

    Anything that is not one valid JSON object gives the fallback record; a
    missing or unknown field gives the fallback of that field. The object is
    parsed inside an array: text after it makes the array invalid, while
    ``from_json`` on the object alone would accept it.
    """
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{ROUTING_TYPE}>",
                         {"allowSingleQuotes": "false"})

    def checked(records: Column) -> Column:
        one = F.when(answered(response) & (F.size(records) == 1), F.get(records, F.lit(0)))
        return routing_record(**{
            f: F.when(one[f].isin(*fv.ROUTING_VALUES[f]), one[f])
            .otherwise(F.lit(fv.ROUTING_FALLBACK[f])) for f in FIELDS})

    return let(parsed, checked)


def route_rule(complexity: Column, pii_risk: Column) -> Column:
    """Local only if simple and without risk; everything else goes to the cloud."""
    return F.when((complexity == "simple") & (pii_risk == "low"), F.lit("local")).otherwise("cloud")


def rule_features(query: Column, spans: Column) -> Column:
    """Routing record from keywords, size and the spans found in the query."""
    low = F.lower(query)
    agent = (F.when(F.rlike(low, F.lit(ADMIN_WORDS)), "admin")
             .when(F.rlike(low, F.lit(RESEARCH_WORDS)), "research").otherwise("general"))
    risk = (F.when(F.exists(spans, lambda s: s["pii_type"].isin(*HIGH_RISK_TYPES)), "high")
            .when(F.size(spans) > 0, "medium").otherwise("low"))
    words = F.regexp_count(query, F.lit("[^ \\t\\n\\r]+"))
    size = (F.when((words > 100) | F.rlike(low, F.lit(COMPLEX_WORDS)), "complex")
            .when(words <= 25, "simple").otherwise("moderate"))
    return let(F.struct(agent.alias("agent"), risk.alias("pii_risk"), size.alias("complexity")),
               lambda r: routing_record(
                   agent=r["agent"], pii_risk=r["pii_risk"], complexity=r["complexity"],
                   route=route_rule(r["complexity"], r["pii_risk"])))


def preview(query: Column) -> Column:
    """Queries longer than 70 characters: one line, cut, with an ellipsis."""
    cut = F.concat(F.replace(F.left(query, F.lit(PREVIEW_CHARS)), F.lit("\n"), F.lit(" ")),
                   F.lit("..."))
    return F.when(F.length(query) > PREVIEW_CHARS, cut).otherwise(query)
