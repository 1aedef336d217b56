"""Pieces of DuckDB SQL that the query oracles are made of.

They compute the same results by other means: relational unnesting, window
functions and recursive queries instead of array expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from veilspan.functions import fixed_values as fv
from veilspan.functions import ner, synth
from veilspan.functions.patterns import DEFAULT_PATTERNS, NOT_WS, WS, PatternSpec
from veilspan.plans.common import QUERY_SALT
from veilspan.sources import forms


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(ctes: Sequence[str], final: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + final


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+' + chr(92) + 'z')}, '', 'g')"


def first_token(x: str) -> str:
    return f"regexp_extract({x}, {q(NOT_WS + '+')})"


SRC_FORMS = f"src as (select form_id as doc_id, session_id, text from ({forms.FORMS_SQL}) f)"
SRC_DOCUMENTS = "src as (select doc_id, cast(doc_id as varchar) as session_id, text from documents)"
SRC_MESSAGES = f"src as (select event_id as doc_id, session_id, ts, text from ({forms.MESSAGES_SQL}) m)"
SRC_ANSWERED = ("src as (select form_id as doc_id, session_id, text, response "
                f"from ({forms.ANSWERED_FORMS_SQL}) f)")


def span_ctes(specs: Sequence[PatternSpec] = DEFAULT_PATTERNS, src: str = "src",
              out: str = "spans") -> list[str]:
    """One row per pattern hit: offsets are sums of gap and match lengths."""
    parts, names = [], []
    for spec in specs:
        pattern, name = q(spec.re2), f"{out}_{spec.name}"
        groups = (f", regexp_extract_all(text, {pattern}, 1) as p, "
                  f"regexp_extract_all(text, {pattern}, 2) as v" if spec.labelled else "")
        head = ("list_sum(list_transform(g[1:i], lambda x: length(x))) + "
                "coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)")
        start = f"{head} + length(p[i])" if spec.labelled else head
        value = strip("v[i]") if spec.labelled else strip("m[i]")
        ord_ = DEFAULT_PATTERNS.index(spec) if spec in DEFAULT_PATTERNS else specs.index(spec)
        parts.append(
            f"{name} as (select doc_id, cast({start} as integer) as start, {value} as value, "
            f"{ord_} as ord, {q(spec.pii_type)} as pii_type from (select *, "
            f"unnest(range(1, len(m) + 1)) as i from (select doc_id, "
            f"regexp_extract_all(text, {pattern}) as m, string_split_regex(text, {pattern}) as g"
            f"{groups} from {src}) a) b)")
        names.append(name)
    union = " union all ".join(f"select * from {n}" for n in names)
    parts.append(
        f"{out} as (select doc_id, start, cast(start + length(value) as integer) as \"end\", ord, "
        f"pii_type, value, cast(1.0 as double) as confidence, {q(fv.REGEX_SOURCE)} as source "
        f"from ({union}) u where value <> '')")
    return parts


def resolved_ctes(spans: str = "spans", out: str = "resolved") -> list[str]:
    """Greedy walk over each text's spans, one step per recursion."""
    return [
        f"{out}_ordered as (select *, row_number() over (partition by doc_id "
        f"order by start, \"end\" desc, ord) as rn from {spans} where start is not null)",
        f"{out}_walk as (select *, true as kept, \"end\" as reached from {out}_ordered "
        f"where rn = 1 union all select o.*, o.start >= w.reached, "
        f"case when o.start >= w.reached then o.\"end\" else w.reached end "
        f"from {out}_walk w join {out}_ordered o on o.doc_id = w.doc_id and o.rn = w.rn + 1)",
        f"{out} as (select doc_id, start, \"end\", ord, pii_type, value, confidence, source "
        f"from {out}_walk where kept)"]


def spliced_cte(named: str = "named", src: str = "src", out: str = "sanitized") -> str:
    """Redacted texts from spans with a ``synthetic`` column."""
    return (
        f"{out} as (select s.doc_id, any_value(s.text) as text, case when count(n.start) = 0 then "
        f"any_value(s.text) else string_agg(substr(s.text, prev + 1, start - prev) || synthetic, "
        f"'' order by start) || substr(any_value(s.text), max(\"end\") + 1) end as sanitized "
        f"from {src} s left join (select *, coalesce(lag(\"end\") over (partition by doc_id "
        f"order by start), 0) as prev from {named}) n on n.doc_id = s.doc_id group by s.doc_id)")


def _slot(i: int) -> str:
    return f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint)"


def _pick(pool, n: str) -> str:
    return "[" + ", ".join(q(p) for p in pool) + f"][({n}) % {len(pool)} + 1]"


def _pad(n: str, width: int) -> str:
    return f"lpad(cast({n} as varchar), {width}, '0')"


_AMOUNT = f"try_cast(regexp_replace(value, {q('[,$]|' + WS)}, '', 'g') as decimal(18, 2))"
_CENTS = f"cast({_AMOUNT} * 100 as hugeint)"
INCOME = f"'$' || format('{{:,}}', cast({_CENTS} * ({_slot(0)} % 240001 + 880000) // 100000000 as bigint))"
SSN = (f"{_pad(f'{_slot(0)} % 800 + 100', 3)} || '-' || {_pad(f'{_slot(1)} % 90 + 10', 2)} || '-' "
       f"|| {_pad(f'{_slot(2)} % 9000 + 1000', 4)}")
_SLASHED = ("split_part(value, '/', 3) || '-' || lpad(split_part(value, '/', 1), 2, '0') || '-' || "
            "lpad(split_part(value, '/', 2), 2, '0')")
_WORDED = ("regexp_extract(value, '([0-9]{4})$', 1) || '-' || lpad(cast((instr("
           "'janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(value, 1, 3))) + 2) // 3 as varchar)"
           f", 2, '0') || '-' || lpad(regexp_extract(value, {q(WS + '([0-9]+)')}, 1), 2, '0')")
_DATE = f"try_cast(case when contains(value, '/') then {_SLASHED} else {_WORDED} end as date)"
_DAYS = (f"cast(({_slot(0)} % 1825 + 1) * case when {_slot(1)} % 2 = 0 then 1 else -1 end as integer)")


def hash_of(salt: str, scope: str) -> str:
    return f"sha256({q(salt + '|')} || {scope} || '|' || pii_type || '|' || value)"


KEYED_SQL = (
    "case pii_type "
    f"when 'PERSON_NAME' then {_pick(synth.FIRST, _slot(0))} || ' ' || chr(cast(65 + {_slot(1)} % 26 "
    f"as integer)) || '. ' || {_pick(synth.LAST, _slot(2))} || ' ' || {_pick(synth.LAST, _slot(3))} "
    f"when 'ADDRESS' then cast({_slot(0)} % 9900 + 100 as varchar) || ' ' || "
    f"{_pick(synth.STREET, _slot(1))} || ' ' || {_pick(synth.STREET_KIND, _slot(2))} || ', ' || "
    f"{_pick(synth.CITY, _slot(3))} || ', ' || {_pick(synth.STATE, _slot(4))} || ' ' || "
    f"cast({_slot(5)} % 90000 + 10000 as varchar) "
    f"when 'PHONE' then '(' || cast({_slot(0)} % 800 + 200 as varchar) || ') 555-' || "
    f"{_pad(f'{_slot(1)} % 10000', 4)} "
    "when 'EMAIL' then 'user.' || substr(h, 1, 12) || '@placeholder.com' "
    f"when 'SSN' then {SSN} "
    f"when 'DATE_OF_BIRTH' then coalesce(strftime({_DATE} + {_DAYS}, '%m/%d/%Y'), "
    f"strftime(date '1930-01-01' + cast({_slot(0)} % 25000 as integer), '%m/%d/%Y')) "
    f"when 'ACCOUNT_NUMBER' then substr(cast({_slot(0)} % 9 + 1 as varchar) || "
    f"{_pad(f'{_slot(1)} % 100000000', 8)} || {_pad(f'{_slot(2)} % 100000000', 8)}, 1, "
    "case when regexp_matches(value, '^[0-9]{8,17}$') then length(value) else 8 end) "
    f"when 'EMPLOYER' then {_pick(synth.LAST, _slot(0))} || ' and ' || {_pick(synth.LAST, _slot(1))} "
    f"|| ' ' || {_pick(synth.STREET, _slot(2))} || ' ' || {_pick(synth.FIELD, _slot(3))} || ' ' || "
    f"{_pick(synth.COMPANY_KIND, _slot(4))} "
    f"when 'INCOME_AMOUNT' then coalesce({INCOME}, '[REDACTED-' || substr(h, 1, 8) || ']') end")


def keyed_cte(spans: str = "resolved", src: str = "src", out: str = "named",
              scope: str = "session_id", salt: str = QUERY_SALT) -> str:
    return (f"{out} as (select * exclude (h), {KEYED_SQL} as synthetic from (select p.*, s.{scope}, "
            f"{hash_of(salt, 's.' + scope)} as h from {spans} p join {src} s using (doc_id)) x)")


ORDINAL_SQL = (
    "case pii_type " + " ".join(f"when {q(t)} then {_pick(pool, 'n')}"
                                for t, pool in fv.ORDINAL_POOLS.items())
    + f" when 'EMAIL' then 'synthetic.user' || cast(n + 1 as varchar) || '@placeholder.com'"
    f" when 'SSN' then {SSN} when 'INCOME_AMOUNT' then coalesce({INCOME}, '[REDACTED]')"
    f" when 'DATE_OF_BIRTH' then {q(fv.ORDINAL_DATE)} when 'ACCOUNT_NUMBER' then "
    "cast(cast('0x' || substr(h, 1, 12) as bigint) % 90000000 + 10000000 as varchar) end")


def ordinal_ctes(spans: str = "resolved", out: str = "ordinal",
                 salt: str = QUERY_SALT) -> list[str]:
    return [
        f"{out}_first as (select * from (select *, row_number() over (partition by doc_id, value "
        f"order by start desc, ord) as pick from {spans}) x where pick = 1)",
        f"{out}_numbered as (select doc_id, value, pii_type, start, ord, "
        "row_number() over (partition by doc_id order by start desc, ord) - 1 as seq, "
        "row_number() over (partition by doc_id, pii_type order by start desc, ord) - 1 as n, "
        f"{hash_of(salt, 'cast(doc_id as varchar)')} as h from {out}_first)",
        f"{out} as (select doc_id, seq as ord, pii_type, value as real, {ORDINAL_SQL} as synthetic, "
        f"n from {out}_numbered)"]


def restored_ctes(texts: str, mappings: str, text_col: str = "response",
                  out: str = "restored") -> list[str]:
    """Chained replacement, one mapping per recursion step.

    ``mappings`` has doc_id, ord, real, synthetic; ``texts`` doc_id and the text.
    """
    head, real_head = first_token("m.synthetic"), first_token("m.real")
    step = f"replace(w.done, m.synthetic, m.real)"
    return [
        f"{out}_chain as (select *, row_number() over (partition by doc_id "
        f"order by length(synthetic) desc, ord) as rn from {mappings})",
        f"{out}_walk as (select doc_id, cast(0 as bigint) as rn, {text_col} as done from {texts} "
        f"union all select w.doc_id, m.rn, case when length({head}) > 2 then replace({step}, "
        f"{head} || '''s', {real_head} || '''s') else {step} end "
        f"from {out}_walk w join {out}_chain m on m.doc_id = w.doc_id and m.rn = w.rn + 1)",
        f"{out} as (select doc_id, arg_max(done, rn) as restored from {out}_walk group by doc_id)"]


_BULLET = q(ner.BULLET)
_CLEAN = strip(f"regexp_replace({strip('response')}, '(?s)<think>.*?</think>', '', 'g')")
for _fence in ("^```json", "^```", "```" + chr(92) + "z"):
    _CLEAN = f"regexp_replace({_CLEAN}, {q(_fence)}, '')"
IS_ANSWERED = f"response <> '' and not starts_with(response, {q(fv.NO_RESPONSE_PREFIX)})"

ITEM_CTES = [
    f"bullets as (select doc_id, i - 1 as pos, e[i] as entity, t[i] as type, nullif(c[i], '') as "
    f"confidence from (select *, unnest(range(1, len(e) + 1)) as i from (select doc_id, "
    f"regexp_extract_all(response, {_BULLET}, 1) as e, regexp_extract_all(response, {_BULLET}, 2) "
    f"as t, regexp_extract_all(response, {_BULLET}, 3) as c from src where {IS_ANSWERED}) a) b)",
    f"arrays as (select doc_id, case when json_valid(a) then a else '[]' end as a from (select "
    f"doc_id, regexp_extract({_CLEAN}, '(?s)\\[.*\\]') as a from src where {IS_ANSWERED}) x)",
    "json_rows as (select doc_id, i - 1 as pos, json_extract_string(x[i], '$.entity') as entity, "
    "json_extract_string(x[i], '$.type') as type, json_extract_string(x[i], '$.confidence') as "
    "confidence from (select *, unnest(range(1, len(x) + 1)) as i from (select doc_id, "
    "json_extract(a, '$[*]') as x from arrays) y) z)",
    "items as (select * from bullets union all select * from json_rows where doc_id not in "
    "(select doc_id from bullets))"]

_ALIASES = ", ".join(f"({q(a)}, {q(t)})" for a, t in fv.NER_ALIASES.items())
ENTITY_CTES = [
    *ITEM_CTES,
    f"aliases(alias, pii_type) as (values {_ALIASES})",
    "typed as (select i.*, a.pii_type from items i join aliases a on a.alias = lower(i.type))",
    f"real_items as (select *, {strip('entity')} as stripped from typed "
    f"where {strip('entity')} not in ('', '...', '<entity>'))",
    f"tails as (select r.*, s.text, case when contains(stripped, ': ') then "
    f"{strip('substr(stripped, instr(stripped, chr(58) || chr(32)) + 2)')} end as tail "
    "from real_items r join src s using (doc_id))",
    "unlabelled as (select * exclude (tail), case when tail <> '' and contains(text, tail) "
    "then tail else stripped end as value from tails)",
    "scored as (select *, case when try_cast(confidence as double) between 0 and 1 "
    "then try_cast(confidence as double) else 0.9 end as score from unlabelled)",
    "ner as (select doc_id, cast(nullif(instr(text, value), 0) - 1 as integer) as start, "
    "cast(nullif(instr(text, value), 0) - 1 + length(value) as integer) as \"end\", "
    f"cast(1000 + pos as integer) as ord, pii_type, value, cast(score as double) as confidence, "
    f"{q(fv.NER_SOURCE)} as source from scored where score >= 0.8)"]

OVERLAP = "coalesce(a.start < b.\"end\" and b.start < a.\"end\", false)"
SAME = f"({strip('lower(a.value)')} = {strip('lower(b.value)')} and a.pii_type = b.pii_type)"

# Long form of the parity merge: anti join, then a walk over the survivors in
# response order that carries the kept ones.
PARITY_CTES = [
    f"survivors as (select a.*, row_number() over (partition by a.doc_id order by a.ord) as rn "
    f"from ner a where not exists (select 1 from spans b where b.doc_id = a.doc_id and "
    f"({OVERLAP} or {SAME})))",
    "greedy as (select doc_id, rn, [rn] as kept from survivors where rn = 1 union all "
    "select g.doc_id, a.rn, case when exists (select 1 from survivors b where "
    f"b.doc_id = a.doc_id and list_contains(g.kept, b.rn) and ({OVERLAP} or {SAME})) "
    "then g.kept else list_append(g.kept, a.rn) end from greedy g join survivors a "
    "on a.doc_id = g.doc_id and a.rn = g.rn + 1)",
    "kept_rows as (select doc_id, arg_max(kept, rn) as kept from greedy group by doc_id)",
    "parity as (select * from spans union all select s.* exclude (rn) from survivors s "
    "join kept_rows k on k.doc_id = s.doc_id and list_contains(k.kept, s.rn))"]

# The safe merge: no overlap with pattern hits, values spread to all whole-word
# occurrences, overlaps resolved.
_GLUED = ("(regexp_matches(value, '^[\\p{L}\\p{N}]') and regexp_matches(g[i], '[\\p{L}\\p{N}]\\z')) or "
          "(regexp_matches(value, '[\\p{L}\\p{N}]\\z') and regexp_matches(g[i + 1], '^[\\p{L}\\p{N}]'))")


def propagated_ctes(own: str, out: str = "propagated") -> list[str]:
    return [
        f"{out}_seeds as (select * from (select *, row_number() over (partition by doc_id, pii_type, "
        f"value order by source desc, start, ord) as pick from {own}) x where pick = 1)",
        f"{out} as (select doc_id, start, cast(start + length(value) as integer) as \"end\", ord, "
        f"pii_type, value, confidence, source from (select *, cast(list_sum(list_transform(g[1:i], "
        f"lambda x: length(x))) + (i - 1) * length(value) as integer) as start from (select *, "
        f"unnest(range(1, len(g))) as i from (select p.doc_id, p.ord, p.pii_type, p.value, "
        f"p.confidence, p.source, string_split(s.text, p.value) as g from {out}_seeds p join src s "
        f"using (doc_id)) a) b where not ({_GLUED})) c)"]


SAFE_CTES = [
    f"own as (select * from spans union all select a.* from ner a where not exists (select 1 from "
    f"spans b where b.doc_id = a.doc_id and {OVERLAP}))",
    *propagated_ctes("own"),
    f"candidates as (select * from own union all select a.* from propagated a where not exists ("
    f"select 1 from own b where b.doc_id = a.doc_id and {OVERLAP}))",
    *resolved_ctes("candidates", "safe_placed"),
    "safe as (select * from safe_placed union all select * from ner where start is null)"]
