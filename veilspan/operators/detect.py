"""Pattern detection over tables of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import unnest
from veilspan.functions.patterns import DEFAULT_PATTERNS, PatternSpec
from veilspan.functions.spans import SPAN_FIELDS, regex_spans, resolve_overlaps
from veilspan.session import built_once

SPANS = "spans"


@built_once
def _found(text_col: str, patterns: tuple[PatternSpec, ...]) -> Column:
    return regex_spans(F.col(text_col), patterns)


@built_once
def _resolved(spans_col: str) -> Column:
    return resolve_overlaps(F.col(spans_col))


def with_regex_spans(docs: DataFrame, patterns: Sequence[PatternSpec] = DEFAULT_PATTERNS,
                     text_col: str = "text", out_col: str = SPANS) -> DataFrame:
    """Add the pattern hits of each text as an array of spans (no shuffle)."""
    return docs.withColumn(out_col, _found(text_col, tuple(patterns)))


def explode_spans(df: DataFrame, id_cols: Sequence[str] = ("doc_id",),
                  spans_col: str = SPANS) -> DataFrame:
    """One row per span. Texts without spans vanish."""
    return unnest(df, spans_col, "_s", *id_cols).select(
        *id_cols, *[F.col("_s")[f].alias(f) for f in SPAN_FIELDS])


def detect_regex_spans(docs: DataFrame, patterns: Sequence[PatternSpec] = DEFAULT_PATTERNS,
                       text_col: str = "text", id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Pattern hits, one row per span."""
    found = with_regex_spans(docs.select(*id_cols, text_col), patterns, text_col)
    return explode_spans(found, id_cols)


def with_resolved_spans(df: DataFrame, spans_col: str = SPANS,
                        out_col: str = SPANS) -> DataFrame:
    """Replace spans by their located, non-overlapping subset."""
    return df.withColumn(out_col, _resolved(spans_col))


def external_spans(docs: DataFrame, detector: Callable[[pd.DataFrame], pd.DataFrame],
                   id_type: str = "bigint", text_col: str = "text",
                   id_col: str = "doc_id") -> DataFrame:
    """Spans from a site's own model.

    ``detector`` gets batches of (id, text) and returns span rows; it runs once
    per Arrow batch in the executors.
    """
    schema = (f"{id_col} {id_type}, start int, end int, ord int, pii_type string, "
              "value string, confidence double, source string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield detector(batch)

    return docs.select(id_col, text_col).mapInPandas(run, schema)
