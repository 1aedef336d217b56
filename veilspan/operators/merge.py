"""Merging the outputs of several detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.matching import value_places
from veilspan.functions.spans import (SPAN_FIELDS, greedy_distinct, merge_parity, merge_safe, overlaps,
                                      own_spans)
from veilspan.functions.text import strip
from veilspan.operators.detect import explode_spans
from veilspan.session import built_once

BIN = 64  # characters; longer than most spans
SCORES = ("n_regex", "n_ner", "n_unique")


@built_once
def _parity(regex_col: str, ner_col: str) -> Column:
    return merge_parity(F.col(regex_col), F.col(ner_col))


@built_once
def _own(regex_col: str, ner_col: str) -> Column:
    return own_spans(F.col(regex_col), F.col(ner_col))


@built_once
def _safe() -> Column:
    return merge_safe(F.col("_own"), F.col("_places"))


def _binned(spans: DataFrame, id_col: str, name: str) -> DataFrame:
    """Located spans, once for every bin of BIN characters that they reach into."""
    first = F.floor(F.col("start") / BIN)
    last = F.floor(F.greatest(F.col("end") - 1, F.col("start")) / BIN)
    return spans.filter(F.col("start").isNotNull()).select(
        F.col(id_col).alias("_id"), F.explode(F.sequence(first, last)).alias("_bin"),
        F.struct(*spans.columns).alias(name))


def overlapping(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Interval join: pairs of located spans of one text that share characters, as structs a and b.

    Spans meet by text and bin of positions, so a text with very many spans is spread over its bins and
    a span is compared with its surroundings alone. A pair counts in the bin where the later
    of its two starts lies: once.
    """
    x, y = F.col("a"), F.col("b")
    later = F.floor(F.greatest(x["start"], y["start"]) / BIN)
    return _binned(a, id_col, "a").join(_binned(b, id_col, "b"), ["_id", "_bin"]).filter(
        overlaps(x, y) & (F.col("_bin") == later)).select("a", "b")


def without_overlaps(ner: DataFrame, regex: DataFrame, id_col: str = "doc_id",
                     same_values: bool = False) -> DataFrame:
    """Anti joins: entities that clash with no pattern hit of the same text.

    Whether a span overlaps depends on its text and place, whether it is known on its text, type and
    value; so both tests are equality joins with the distinct clashes.
    """
    place = [id_col, "start", "end"]
    met = overlapping(ner.select(*place), regex.select(*place), id_col).select("a.*").distinct()
    rest = ner.join(met, place, "left_anti")
    if not same_values:
        return rest
    value = F.lower(strip(F.col("value")))
    known = regex.select(id_col, "pii_type", value.alias("_value")).distinct()
    return rest.withColumn("_value", value).join(
        known, [id_col, "pii_type", "_value"], "left_anti").select(*ner.columns)


def merge_spans(regex: DataFrame, ner: DataFrame, mode: str = "parity",
                id_col: str = "doc_id") -> DataFrame:
    """Long-form merge: pattern hits, then the entities that clash with none.

    ``parity`` also drops equal values and, among entities, later clashes in
    response order; the entities of a text are bounded by one model response.
    ``safe`` drops overlaps only; values must have been propagated before.
    """
    rest = without_overlaps(ner, regex, id_col, same_values=mode == "parity")
    if mode == "parity":
        packed = rest.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
            F.col("ord").alias("k"), F.struct(*SPAN_FIELDS).alias("span")))).alias("_k"))
        kept = packed.withColumn("spans", greedy_distinct(
            F.transform("_k", lambda k: k["span"])))
        rest = explode_spans(kept, [id_col])
    return regex.unionByName(rest)


def with_merged_spans(df: DataFrame, mode: str = "safe", text_col: str = "text",
                      regex_col: str = "spans", ner_col: str = "ner_spans",
                      out_col: str = "merged") -> DataFrame:
    """Merge two span arrays of the same row (no shuffle); pattern hits win over model entities.

    ``parity``: an entity is dropped if it overlaps or equals a span kept before. ``safe``: every value
    found is first spread to all its whole-word occurrences, which one pass over the text finds;
    then only overlap counts, and the result has none.
    """
    if mode == "parity":
        return df.withColumn(out_col, _parity(regex_col, ner_col))
    if mode != "safe":
        raise ValueError(f"unknown merge mode: {mode}")
    own = df.withColumn("_own", _own(regex_col, ner_col))
    return own.withColumn("_places", value_places(F.col(text_col), F.col("_own"))).withColumn(
        out_col, _safe()).drop("_own", "_places")


def gate_responses(df: DataFrame, risk_col: str = "pii_risk") -> DataFrame:
    """Drop the model's response where the risk is low: pattern detection only."""
    return df.withColumn("response", F.when(F.col(risk_col) != "low", F.col("response")))


def final_order(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add each span's place in its text's report; spans without a place come last."""
    # Dense numbering from the packed form keeps this free of a global sort.
    key = F.struct(F.col("start").isNull().alias("k0"), F.col("start").alias("k1"),
                   F.col("ord").alias("k2"), F.struct(*SPAN_FIELDS).alias("span"))
    packed = spans.groupBy(id_col).agg(F.array_sort(F.collect_list(key)).alias("_k"))
    return packed.select(id_col, F.posexplode("_k").alias("rank", "_k")).select(
        id_col, "rank", *[F.col("_k.span")[f].alias(f) for f in SPAN_FIELDS])


def merge_summary(merged: DataFrame, id_col: str = "doc_id", regex_col: str = "spans",
                  ner_col: str = "ner_spans", merged_col: str = "merged") -> DataFrame:
    """Counts per text: pattern hits, model entities, unique after the merge."""
    return merged.select(id_col, *[F.size(c).cast("bigint").alias(n) for n, c in
                                   zip(SCORES, (regex_col, ner_col, merged_col))])
