"""Labelled forms, model responses and a message stream derived from the given tables.

The given texts hold few kinds of personal data, so each customer row becomes
one form with all of them, and each event one short message. Every expression
is plain SQL that Spark and DuckDB read alike; the checks use the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.sources.tables import dealt, table

_K = "c_custkey"


def _pick(options: str, number: str) -> str:
    size = options.count(",") + 1
    return f"split_part('{options}', ',', cast({number} % {size} as int) + 1)"


def _pad(number: str, width: int) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


# Pairs of customers share one SSN whenever the key ends in 1.
_S = f"({_K} - case when {_K} % 10 = 1 then 1 else 0 end)"

FIELDS_SQL = {
    "f_name": f"{_pick('Anna,Bela,Cyril,Dora,Emil,Frida,Gustav', _K)} || ' ' || "
              f"{_pick('Moreau,Novak,Olsen,Petit,Quast,Rossi,Silva,Toth,Urban,Vogel,Weiss', _K)}",
    "f_ssn": f"{_pad(f'{_S} % 700 + 100', 3)} || '-' || {_pad(f'{_S} % 89 + 10', 2)} || '-' || "
             f"{_pad(f'{_S} * 7 % 10000', 4)}",
    "f_address": f"cast({_K} % 900 + 11 as string) || ' ' || {_pick('Mill,Lake,Hill', _K)} "
                 f"|| ' Road, ' || {_pick('Salem,Dover,Fargo,Provo', _K)} || ', ' || "
                 f"{_pick('OR,DE,nd,UT', _K)} || ' ' || {_pad(f'{_K} % 89999 + 10000', 5)}",
    # A phone inside the employer line gives overlapping spans.
    "f_employer": f"case when {_K} % 9 = 0 then 'Desk (212) 555-' || {_pad(f'{_K} % 10000', 4)} "
                  f"|| ' ' || c_mktsegment else c_mktsegment || ' Works Ltd' end",
    "f_born": f"{_pad(f'{_K} % 12 + 1', 2)} || '/' || {_pad(f'{_K} % 28 + 1', 2)} || '/' || "
              f"cast(1940 + {_K} % 65 as string)",
    "f_start": f"{_pick('June,Jan,march,OCTOBER', _K)} || ' ' || cast({_K} % 28 + 1 as string) "
               f"|| case when {_K} % 2 = 0 then ', ' else ' ' end || cast(2000 + {_K} % 25 as string)",
    "f_wages": f"'$' || cast({_K} % 900 + 1 as string) || ',' || {_pad(f'{_K} * 37 % 1000', 3)} "
               f"|| case when {_K} % 3 = 0 then '' else '.' || {_pad(f'{_K} % 100', 2)} end",
    "f_phone": f"'(' || {_pad(f'{_K} % 800 + 200', 3)} || ')' || case when {_K} % 4 = 0 then '' "
               f"else ' ' end || '555-' || {_pad(f'{_K} % 10000', 4)}",
    "f_fax": f"{_pad(f'{_K} % 700 + 201', 3)} || '-555-' || {_pad(f'{_K} * 3 % 10000', 4)}",
    "f_email": f"'user' || cast({_K} as string) || '@mail.example.com'",
    "f_account": f"cast(100000000 + {_K} as string)",
}

_LINES = (
    "'Form ' || cast(form_id as string) || ' 😀 é'",
    f"{_pick('Name,Patient,tenant,  Co-Tenant,CLIENT', 'form_id')} || ': ' || f_name",
    "'SSN: ' || f_ssn",
    "'Address: ' || f_address",
    "case when form_id % 5 = 0 then 'employer : ' else 'Employer: ' end || f_employer",
    "'Born ' || f_born",
    "'Start: ' || f_start || ' (90 days)'",
    "'Wages: ' || f_wages || ', rent $85'",
    "case when form_id % 6 = 0 then 'Bonus: ' || f_wages else 'Bonus: none' end",
    "'Phone: ' || f_phone",
    "'Fax: ' || f_fax",
    "'Email: ' || f_email",
    f"{_pick('Bank Account,acct no,ROUTING #', 'form_id')} || ': ' || f_account",
    # The name again, unlabelled, and the account in free text.
    "case when form_id % 3 = 0 then 'Signed by ' || f_name || ' for ' || f_account "
    "else 'Not signed' end",
)

FORM_FIELDS_SQL = ("select c_custkey as form_id, cast(c_nationkey as string) as session_id, "
                   + ", ".join(f"{sql} as {name}" for name, sql in FIELDS_SQL.items())
                   + " from customer")
TEXT_SQL = "concat_ws(chr(10), " + ", ".join(_LINES) + ")"
FORMS_SQL = (f"select form_id, session_id, {TEXT_SQL} as text from ({FORM_FIELDS_SQL}) fields")

_Q = "chr(34)"


def _bullet(value: str, token: str, note: str = "''") -> str:
    return f"'- ' || {_Q} || {value} || {_Q} || ' -> `{token}`' || {note}"


def _item(value: str, token: str, confidence: str = "'0.95'") -> str:
    return (f"'{{' || {_Q} || 'entity' || {_Q} || ': ' || {_Q} || {value} || {_Q} || ', ' || {_Q} "
            f"|| 'type' || {_Q} || ': ' || {_Q} || '{token}' || {_Q} || ', ' || {_Q} || "
            f"'confidence' || {_Q} || ': ' || {confidence} || '}}'")


_LOW = "case when form_id % 5 = 0 then '0.5' else '0.85' end"
_BULLETS = (
    _bullet("f_name", "person_name"),
    _bullet("'Name: ' || f_name", "full_name"),
    _bullet("f_employer", "company", "' (0.97)'"),
    _bullet("'Not signed'", "location", f"' (' || {_LOW} || ')'"),
    _bullet("f_phone", "telephone", "case when form_id % 5 = 0 then ' call (510)' else '' end"),
    _bullet("'rent $85'", "income"),
    _bullet("case when form_id % 7 = 0 then 'Nobody Here' else '90 days' end", "dob"),
    _bullet("'...'", "person_name"),
    _bullet("f_account", "member_id"),
    _bullet("'Bonus'", "species"),
)
_JSON = ("'[' || " + " || ', ' || ".join((
    _item("f_name", "NAME"),
    _item("'Bonus: none'", "salary", _LOW),
    _item("'SSN: ' || f_ssn", "social_security"),
    _item("case when form_id % 7 = 0 then 'Nobody Here' else 'Not signed' end", "person_name",
          "case when form_id % 3 = 0 then 'null' else '1.5' end"),
    _item("'<entity>'", "address"),
    _item("'Form ' || cast(form_id as string)", "patient_id", "'0.8'"),
    _item("'rent $85'", "unheard_of"),
)) + " || ']'")

# Answers keep the question's line structure; some forms get none at all.
NER_RESPONSE_SQL = (
    "case when form_id % 11 = 0 then '' when form_id % 13 = 0 then '[API not set]' "
    f"when form_id % 2 = 0 then 'Found:' || chr(10) || concat_ws(chr(10), {', '.join(_BULLETS)}) "
    f"when form_id % 4 = 1 then '<think>' || chr(10) || 'some [thoughts]' || chr(10) || '</think>' "
    f"|| chr(10) || '```json' || chr(10) || {_JSON} || chr(10) || '```' "
    f"when form_id % 10 = 3 then 'no entities here' "
    f"else 'Result: ' || {_JSON} || ' and that is all' end")
ANSWERED_FORMS_SQL = (
    f"select form_id, session_id, {TEXT_SQL} as text, {NER_RESPONSE_SQL} as response "
    f"from ({FORM_FIELDS_SQL}) fields")


def _field(name: str, value: str) -> str:
    return f"{_Q} || '{name}' || {_Q} || ': ' || {_Q} || '{value}' || {_Q}"


def _object(agent: str, risk: str, complexity: str, route: str) -> str:
    parts = [_field(n, v) for n, v in (("agent", agent), ("pii_risk", risk),
                                       ("complexity", complexity), ("route", route)) if v]
    return "'{' || " + " || ', ' || ".join(parts) + " || '}'"


# n is a number of the query.
ROUTER_RESPONSE_SQL = (
    f"case when n % 9 = 0 then {_object('admin', 'high', 'complex', 'cloud')} "
    f"when n % 9 = 1 then 'Sure: ' || {_object('research', 'low', 'moderate', 'cloud')} || ' ok' "
    f"when n % 9 = 2 then {_object('general', 'low', 'simple', '')} "
    f"when n % 9 = 3 then {_object('wizard', 'low', 'simple', 'local')} "
    f"when n % 9 = 4 then 'I cannot say' when n % 9 = 5 then '' "
    f"when n % 9 = 6 then {_object('admin', 'low', 'simple', 'local')} || ' and }}' "
    f"when n % 9 = 7 then '[API not set]' "
    f"else {_object('general', 'low', 'simple', 'local')} end")
ROUTED_QUERIES_SQL = (
    "select session_id, query_id, text, "
    f"{ROUTER_RESPONSE_SQL} as response from (select cast(conv_id as string) as session_id, "
    "turn as query_id, text, conv_id * 3 + turn as n from conversations "
    "where role = 'user') user_turns")

# One message per event; about two in five carry personal data.
MESSAGE_TEXT_SQL = (
    "case when event_type = 'click' then 'Write to user' || cast(user_id as string) || "
    "'@mail.example.com or call (212) 555-' || lpad(cast(user_id % 10000 as string), 4, '0') "
    "when event_type = 'purchase' then 'Paid $1,' || lpad(cast(event_id % 1000 as string), 3, '0') "
    "|| '.00 from account ' || cast(100000000 + user_id as string) "
    "else 'Nothing to report, ' || event_type end")
MESSAGES_SQL = ("select event_id, ts, cast(user_id as string) as session_id, "
                f"{MESSAGE_TEXT_SQL} as text from events")


def _form_fields(spark: SparkSession, directory: str) -> DataFrame:
    customers = table(spark, directory, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return dealt(customers).selectExpr(
        "c_custkey", "c_custkey as form_id", "cast(c_nationkey as string) as session_id",
        *[f"{sql} as {name}" for name, sql in FIELDS_SQL.items()])


def forms(spark: SparkSession, directory: str) -> DataFrame:
    """form_id, session_id, text."""
    return _form_fields(spark, directory).selectExpr("form_id", "session_id", f"{TEXT_SQL} as text")


def answered_forms(spark: SparkSession, directory: str) -> DataFrame:
    """Forms with the entity model's response: form_id, session_id, text, response."""
    return _form_fields(spark, directory).selectExpr(
        "form_id", "session_id", f"{TEXT_SQL} as text", f"{NER_RESPONSE_SQL} as response")


def form_responses(spark: SparkSession, directory: str) -> DataFrame:
    """The responses as a table of their own: text_sha, kind, response."""
    return answered_forms(spark, directory).select(
        F.sha2("text", 256).alias("text_sha"), F.lit("ner").alias("kind"), "response")


def model_responses(spark: SparkSession, directory: str) -> DataFrame:
    """Replies of the router and of the entity model to the forms, in one table."""
    answers = answered_forms(spark, directory).selectExpr("text", "response as ner", "form_id as n").selectExpr(
        "text", "ner", f"{ROUTER_RESPONSE_SQL} as router")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("response")) for k in ("router", "ner")])
    return answers.select(F.sha2("text", 256).alias("text_sha"), F.explode(kinds).alias("r")).select(
        "text_sha", "r.kind", "r.response")


def routed_queries(spark: SparkSession, directory: str) -> DataFrame:
    """Query log with the router model's response."""
    turns = table(spark, directory, "conversations").filter("role = 'user'")
    return turns.selectExpr(
        "cast(conv_id as string) as session_id", "turn as query_id", "text",
        "conv_id * 3 + turn as n").selectExpr(
        "session_id", "query_id", "text", f"{ROUTER_RESPONSE_SQL} as response")


def messages(spark: SparkSession, directory: str) -> DataFrame:
    """event_id, ts, session_id, text."""
    return as_messages(table(spark, directory, "events"))


def as_messages(events: DataFrame) -> DataFrame:
    """Event rows, batch or stream, as messages."""
    return events.selectExpr("event_id", "cast(ts as timestamp) as ts",
                             "cast(user_id as string) as session_id", f"{MESSAGE_TEXT_SQL} as text")
