"""Entity-model requests and responses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions.arrays import empty, let
from veilspan.functions.patterns import WS
from veilspan.functions.spans import MARK, make_span
from veilspan.functions.text import strip, tail_from

PROMPT_HEAD = (
    "List all personal data in the text that follows as a JSON array of objects with the keys "
    "entity (copied exactly), type and confidence (0 to 1). Types: "
    "person_name, address, phone, email, ssn, date_of_birth, account_number (also tax, patient, "
    "member and routing numbers), employer (also insurers and providers), income_amount (also "
    "rent and deposits). List doubtful items too, with a lower confidence.\n\nText:\n")
PROMPT_TAIL = "\n\nJSON array:"

# Grammar of a bullet line, "value" -> `type` ... (confidence).
BULLET = (rf'"([^"]+)"{WS}*[-→>]+{WS}*`?([a-z_]+)`?'
          r"(?:[^)\n]*\((\p{Nd}+(?:\.\p{Nd}+)?)\))?")
ITEM_TYPE = "struct<entity:string,type:string,confidence:string>"
PREVIEW_CHARS = 500
FIRST_ORD = 1000


def prompt(text: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), text, F.lit(PROMPT_TAIL))


def answered(response: Column) -> Column:
    """False for a missing, empty or not-configured response."""
    return F.coalesce((response != "") & ~F.startswith(response, F.lit(fv.NO_RESPONSE_PREFIX)),
                      F.lit(False))


def bullet_items(response: Column) -> Column:
    """Items of bullet lines; an unmatched confidence is null.

    One pass marks the three groups of every match; between them the marked response is cut.
    """
    def group(i: int) -> Column:
        return F.regexp_extract_all(response, F.lit(BULLET), F.lit(i))

    def item(entity: Column, kind: Column, confidence: Column) -> Column:
        return F.struct(entity.alias("entity"), kind.alias("type"),
                        F.nullif(confidence, F.lit("")).alias("confidence"))

    def cut(pieces: Column) -> Column:
        # Gap, entity, type and confidence in turn, and a last gap.
        return F.when(F.size(pieces) == 1, empty(ITEM_TYPE)).when(F.size(pieces) > 1, F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 4, F.lit(4)),
            lambda i: item(*[F.get(pieces, i + k) for k in range(3)])))

    marked = F.regexp_replace(response, BULLET, MARK.join(("", "$1", "$2", "$3", "")))
    zipped = F.arrays_zip(group(1).alias("entity"), group(2).alias("type"),
                          group(3).alias("confidence"))
    # A response that has the mark itself is searched once for each group.
    return F.when(F.contains(response, F.lit(MARK)), F.transform(
        zipped, lambda z: item(z["entity"], z["type"], z["confidence"]))).otherwise(
        let(F.split(marked, MARK, -1), cut))


def json_items(response: Column) -> Column:
    """Items of the first JSON array; null if there is none or it does not parse."""
    def spoken(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("<think>")), strip(F.regexp_replace(
            text, "(?s)<think>.*?</think>", ""))).otherwise(text)

    def unfenced(text: Column) -> Column:
        bare = text
        for fence in ("^```json", "^```", r"```\z"):
            bare = F.regexp_replace(bare, fence, "")
        return F.when(F.contains(text, F.lit("```")), bare).otherwise(text)

    def parsed(text: Column) -> Column:
        start = F.instr(text, "[")
        return F.when(start > 0, F.from_json(tail_from(text, start), f"array<{ITEM_TYPE}>",
                                             {"allowSingleQuotes": "false"}))

    return let(strip(response), lambda r: let(spoken(r), lambda t: let(unfenced(t), parsed)))


def items(response: Column) -> Column:
    """Bullet lines if there are any, else JSON, else nothing."""
    nothing = F.array().cast(f"array<{ITEM_TYPE}>")
    found = let(bullet_items(response), lambda b: F.when(F.size(b) > 0, b).otherwise(
        F.coalesce(json_items(response), nothing)))
    return F.when(answered(response), found).otherwise(nothing)


def alias_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in fv.NER_ALIASES.items() for x in kv])


def clean_value(entity: Column, text: Column) -> Column:
    """Strip; and drop a ``Label: `` prefix if what follows occurs in the text."""
    def unlabelled(v: Column) -> Column:
        tail = F.when(F.contains(v, F.lit(": ")), strip(tail_from(v, F.instr(v, ": ") + 2)))
        return let(tail, lambda t: F.when((t != "") & F.contains(text, t), t).otherwise(v))
    return let(strip(F.coalesce(entity, F.lit(""))), unlabelled)


def clean_confidence(raw: Column) -> Column:
    number = raw.try_cast("double")
    return let(number, lambda c: F.when((c >= 0) & (c <= 1), c)
               .otherwise(F.lit(fv.DEFAULT_CONFIDENCE)))


def item_spans(text: Column, found: Column, min_confidence: float = fv.MIN_CONFIDENCE) -> Column:
    """Spans of parsed items: known type, real value, confident enough."""
    def candidate(item: Column, i: Column) -> Column:
        pii_type = F.try_element_at(alias_map(), F.lower(F.coalesce(item["type"], F.lit(""))))
        placeholder = strip(F.coalesce(item["entity"], F.lit(""))).isin("", *fv.PLACEHOLDER_VALUES)

        def span(t: Column, c: Column, v: Column) -> Column:
            return let(F.nullif(F.instr(text, v), F.lit(0)) - 1, lambda start: make_span(
                start, start + F.length(v), F.lit(FIRST_ORD) + i, t, v, c, F.lit(fv.NER_SOURCE)))

        def sure(t: Column) -> Column:
            return let(clean_confidence(item["confidence"]), lambda c: F.when(
                c >= min_confidence, let(clean_value(item["entity"], text), lambda v: span(t, c, v))))

        return let(pii_type, lambda t: F.when(t.isNotNull() & ~placeholder, sure(t)))

    return F.filter(F.transform(found, candidate), lambda s: s.isNotNull())


def ner_spans(text: Column, response: Column,
              min_confidence: float = fv.MIN_CONFIDENCE) -> Column:
    """Response of the entity model, as spans in response order."""
    return let(items(response), lambda found: item_spans(text, found, min_confidence))


def preview(response: Column) -> Column:
    return F.left(response, F.lit(PREVIEW_CHARS))
