"""Span expressions: detection, overlap resolution, propagation and splicing.

All of them work on one text and an ARRAY<STRUCT> of spans next to it, so the
whole path from text to redacted text is a narrow projection: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions.arrays import chunk_slice, empty, fold_emit, let, offsets, text_chunks
from veilspan.functions.matching import PLACE_BITS, value_places
from veilspan.functions.patterns import DEFAULT_PATTERNS, PatternSpec
from veilspan.functions.text import strip

SPAN_TYPE = ("struct<start:int,end:int,ord:int,pii_type:string,value:string,"
             "confidence:double,source:string>")
SPAN_FIELDS = ("start", "end", "ord", "pii_type", "value", "confidence", "source")

# Noncharacters: not used in interchanged text. A text that has one anyway is
# matched with MARK swapped for STAND_IN, which the patterns treat alike.
MARK = "\ufdd0"
STAND_IN = "\ufdd1"


def make_span(start, end, ord_, pii_type, value, confidence, source) -> Column:
    parts = (start, end, ord_, pii_type, value, confidence, source)
    return F.struct(*[p.alias(n) for p, n in zip(parts, SPAN_FIELDS)]).cast(SPAN_TYPE)


def _guard(text: Column, spec: PatternSpec) -> Column:
    """Cheap tests that every match implies; they spare most texts the regex."""
    cond = F.lit(True)
    for literal in spec.needs:
        cond = cond & F.contains(text, F.lit(literal))
    return cond


def _marked(text: Column, spec: PatternSpec) -> Column:
    """The text with a mark on both sides of every value; the text itself without a hit."""
    around = f"$1{MARK}$2{MARK}$3" if spec.labelled else f"{MARK}$0{MARK}"
    return F.when(_guard(text, spec), F.regexp_replace(text, spec.java, around))


def regex_spans(text: Column, patterns: Sequence[PatternSpec] = DEFAULT_PATTERNS) -> Column:
    """All pattern hits of a text as spans, ordered by start, then pattern.

    Each pattern marks its values in one pass; cutting the marked text at the
    marks gives gaps and values in turn, and their lengths give the offsets.
    """
    has_mark = F.contains(text, F.lit(MARK))
    source = F.struct(
        F.when(has_mark, F.translate(text, MARK, STAND_IN)).otherwise(text).alias("clean"),
        F.when(has_mark, text_chunks(text)).alias("original"))

    def hits(src: Column) -> Column:
        return F.filter(F.array(*[
            F.struct(_marked(src["clean"], p).alias("marked"), F.lit(i).alias("ord"),
                     F.lit(p.pii_type).alias("pii_type"), F.lit(p.labelled).alias("labelled"))
            for i, p in enumerate(patterns)]), lambda h: F.contains(h["marked"], F.lit(MARK)))

    def cut(src: Column, hit: Column, pieces: Column, starts: Column) -> Column:
        def span(i: Column) -> Column:
            return let(F.get(starts, i), lambda begin: span_at(src, hit, F.get(pieces, i), begin))
        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), span)

    def span_at(src: Column, hit: Column, piece: Column, begin: Column) -> Column:
        raw = F.when(src["original"].isNull(), piece).otherwise(
            chunk_slice(src["original"], begin, begin + F.length(piece)))
        # Only a labelled value can end in whitespace.
        value = F.when(hit["labelled"], strip(raw)).otherwise(raw)
        return let(value, lambda v: make_span(
            begin, begin + F.length(v), hit["ord"], hit["pii_type"], v, F.lit(1.0), F.lit(fv.REGEX_SOURCE)))

    def spans_of(src: Column, hit: Column) -> Column:
        # Most patterns hit once: gap, value, gap.
        return let(F.split(hit["marked"], MARK, -1), lambda p: F.when(
            F.size(p) == 3, F.array(span_at(src, hit, F.get(p, F.lit(1)), F.length(F.get(p, F.lit(0))))))
            .otherwise(let(offsets(F.transform(p, F.length)), lambda o: cut(src, hit, p, o))))

    found = let(source, lambda src: F.flatten(
        F.transform(hits(src), lambda hit: spans_of(src, hit))))
    return sort_spans(F.filter(found, lambda s: s["value"] != ""))


def _sorted_by(spans: Column, key) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(*key(s), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def sort_spans(spans: Column) -> Column:
    """Order by start (spans without a place last), then detector order."""
    return _sorted_by(spans, lambda s: (
        s["start"].isNull().alias("k0"), s["start"].alias("k1"), s["ord"].alias("k2")))


def overlaps(a: Column, b: Column) -> Column:
    """True if two located spans share a character; false if one has no place."""
    return F.coalesce((a["start"] < b["end"]) & (b["start"] < a["end"]), F.lit(False))


def same_value(a: Column, b: Column) -> Column:
    """Equal value up to case and outer whitespace, and equal type."""
    return ((a["pii_type"] == b["pii_type"])
            & (F.lower(strip(a["value"])) == F.lower(strip(b["value"]))))


def resolve_overlaps(spans: Column) -> Column:
    """Keep located, non-overlapping spans: earliest, then longest, then detector order."""
    located = F.filter(spans, lambda s: s["start"].isNotNull())
    ordered = _sorted_by(located, lambda s: (
        s["start"].alias("k0"), (-s["end"]).alias("k1"), s["ord"].alias("k2")))
    return fold_emit(
        ordered, F.lit(0), SPAN_TYPE,
        step=lambda reached, s: F.when(s["start"] >= reached, s["end"]).otherwise(reached),
        emit=lambda reached, s: F.when(s["start"] >= reached, F.array(s))
                                 .otherwise(empty(SPAN_TYPE)))


def occurrences(text: Column, value: Column) -> Column:
    """Starts of every whole-word occurrence of a literal value in a text."""
    literal = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                       F.lit("\\E"))
    glued_before = "[\\p{L}\\p{N}]\\z"
    glued_after = "^[\\p{L}\\p{N}]"

    def starts(gaps: Column) -> Column:
        begin = offsets(F.transform(gaps, lambda g: F.length(g) + F.length(value)))
        # Gap i+1 begins right after occurrence i.
        return let(begin, lambda b: F.filter(
            F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), lambda i: F.when(
                ~((F.rlike(value, F.lit(glued_after))
                   & F.rlike(F.get(gaps, i - 1), F.lit(glued_before)))
                  | (F.rlike(value, F.lit(glued_before))
                     & F.rlike(F.get(gaps, i), F.lit(glued_after)))),
                F.get(b, i) - F.length(value))),
            lambda p: p.isNotNull()))

    return F.when((value != "") & F.contains(text, value),
                  let(F.split(text, literal, F.lit(-1)), starts)).otherwise(empty("int"))


def spans_at(spans: Column, places: Column) -> Column:
    """The spans that ``value_places`` found, each like the one its value came from."""
    def span(place: Column) -> Column:
        start = place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        return let(F.get(spans, F.shiftright(place, PLACE_BITS).cast("int")), lambda s: let(
            start, lambda p: make_span(p, p + F.length(s["value"]), s["ord"], s["pii_type"], s["value"],
                                       s["confidence"], s["source"])))

    return F.transform(places, span)


def propagate_values(text: Column, spans: Column) -> Column:
    """Spans for every occurrence of every value already found in the text."""
    return spans_at(spans, value_places(text, spans))


def ordinal_named(spans: Column, name) -> Column:
    """Give each span of a text the name of its value: ``name(pii_type, value, n)``.

    Values are numbered from the right within their type, which is that of the right-most
    place. ``spans`` must be located, ordered and free of overlaps.
    """
    seen = F.array_sort(F.transform(F.reverse(spans), lambda s, i: F.struct(
        s["value"].alias("value"), i.alias("i"), s.alias("span"))))

    def group(state: Column, x: Column) -> Column:
        return F.when(state["value"] == x["value"], state["g"]).otherwise(state["g"] + 1)

    grouped = fold_emit(
        seen, F.struct(F.lit(None).cast("string").alias("value"), F.lit(-1).alias("g")),
        f"struct<g:int,is_new:boolean,i:int,span:{SPAN_TYPE}>",
        step=lambda state, x: F.struct(x["value"].alias("value"), group(state, x).alias("g")),
        emit=lambda state, x: F.array(F.struct(
            group(state, x).alias("g"), (group(state, x) > state["g"]).alias("is_new"),
            x["i"].alias("i"), x["span"].alias("span"))))

    def names(found: Column) -> Column:
        def number(state: Column, x: Column) -> Column:
            return F.when(state["type"] == x["type"], state["n"] + 1).otherwise(0)

        by_type = F.array_sort(F.transform(
            F.filter(found, lambda x: x["is_new"]), lambda x: F.struct(
                x["span"]["pii_type"].alias("type"), x["i"].alias("i"), x["g"].alias("g"),
                x["span"]["value"].alias("value"))))
        counted = fold_emit(
            by_type, F.struct(F.lit(None).cast("string").alias("type"), F.lit(-1).alias("n")),
            "struct<g:int,n:int,pii_type:string,value:string>",
            step=lambda state, x: F.struct(x["type"].alias("type"), number(state, x).alias("n")),
            emit=lambda state, x: F.array(F.struct(
                x["g"].alias("g"), number(state, x).alias("n"), x["type"].alias("pii_type"),
                x["value"].alias("value"))))
        return F.transform(F.array_sort(counted),
                           lambda c: name(c["pii_type"], c["value"], c["n"]))

    def named(found: Column, known: Column) -> Column:
        from_left = F.array_sort(F.transform(found, lambda x: F.struct(
            (-x["i"]).alias("k"), x["g"].alias("g"), x["span"].alias("span"))))
        return F.transform(from_left, lambda x: F.struct(
            *[x["span"][f].alias(f) for f in SPAN_FIELDS],
            F.get(known, x["g"]).alias("synthetic")))

    return let(grouped, lambda found: let(names(found), lambda known: named(found, known)))


def greedy_distinct(spans: Column) -> Column:
    """In given order, keep a span unless it clashes with one kept before."""
    return F.aggregate(
        spans, empty(SPAN_TYPE),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: overlaps(s, k) | same_value(s, k)), kept)
        .otherwise(F.array_append(kept, s)))


def beside(extra: Column, base: Column) -> Column:
    """Those of ``extra`` that overlap no span of ``base``; a span without a place overlaps none.

    One sweep over all starts from the left knows how far the spans of ``base`` reach, one from the right
    where the next of them begins. Overlapping spans in either array do no harm.
    """
    event = "struct<start:int,extra:int,end:int,at:int>"

    def events(spans: Column, side: int) -> Column:
        return F.transform(spans, lambda s, i: F.struct(
            s["start"].alias("start"), F.lit(side).alias("extra"), s["end"].alias("end"), i.alias("at")))

    def swept(found: Column) -> Column:
        from_left = fold_emit(
            found, F.lit(-1), event,
            step=lambda reach, e: F.when(e["extra"] == 0, F.greatest(reach, e["end"])).otherwise(reach),
            emit=lambda reach, e: F.when((e["extra"] == 0) | (e["start"] >= reach), F.array(e))
                                   .otherwise(empty(event)))
        free = fold_emit(
            F.reverse(from_left), F.lit(2147483647), "int",
            step=lambda following, e: F.when(e["extra"] == 0, e["start"]).otherwise(following),
            emit=lambda following, e: F.when((e["extra"] == 1) & (e["end"] <= following), F.array(e["at"]))
                                       .otherwise(empty("int")))
        return F.array_sort(free)

    def kept(more: Column) -> Column:
        located = F.array_sort(F.filter(F.concat(events(base, 0), events(more, 1)),
                                        lambda e: e["start"].isNotNull()))
        return F.concat(F.transform(swept(located), lambda i: F.get(more, i)),
                        F.filter(more, lambda s: s["start"].isNull()))

    return let(extra, lambda more: F.when(F.size(more) == 0, more).otherwise(kept(more)))


def merge_parity(regex: Column, ner: Column) -> Column:
    """Pattern hits, and the model entities that clash with none of them nor with each other.

    A model entity is dropped if it overlaps, or equals in value and type, a pattern hit or an
    entity kept before. Nothing is propagated.
    """
    return let(regex, lambda r: let(
        F.filter(ner, lambda g: ~F.exists(r, lambda k: overlaps(g, k) | same_value(g, k))),
        lambda rest: sort_spans(F.concat(r, greedy_distinct(rest)))))


def own_spans(regex: Column, ner: Column) -> Column:
    """Safe merge, first step: pattern hits, and the entities that overlap none."""
    return let(regex, lambda r: let(ner, lambda n: F.concat(r, beside(n, r))))


def merge_safe(own: Column, places: Column) -> Column:
    """Safe merge, last step: all values at all their places, free of overlaps.

    ``own`` comes from ``own_spans``, ``places`` is where ``value_places`` found its values. Values
    spread give way to spans found where they stand. Entities without a place are kept at the end,
    for reporting.
    """
    return let(own, lambda o: let(
        resolve_overlaps(F.concat(o, beside(spans_at(o, places), o))),
        lambda placed: F.concat(placed, F.filter(o, lambda s: s["start"].isNull()))))


def splice(text: Column, spans: Column, replacement) -> Column:
    """Rewrite a text, putting ``replacement(span)`` in place of each span.

    ``spans`` must be located, ordered and free of overlaps.
    """

    def build(c: Column, s: Column) -> Column:
        def end_of(i: Column) -> Column:
            return F.coalesce(F.get(s, i)["end"], F.lit(0))
        pieces = F.transform(s, lambda x, i: F.concat(
            chunk_slice(c, end_of(i - 1), x["start"]), replacement(x)))
        rest = chunk_slice(c, end_of(F.size(s) - 1), F.length(text))
        return F.array_join(F.array_append(pieces, rest), "")

    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(
        let(text_chunks(text), lambda c: build(c, s))))
