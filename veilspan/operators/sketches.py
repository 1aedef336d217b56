"""Distinct counts that add up: sketches of found values, stored by day, type and session, merged on read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import unnest
from veilspan.functions.text import strip

LG_K = 12  # 4,096 cells and at most some 2.5 KB a sketch
ERROR = 1.04 / 2 ** (LG_K / 2)  # relative standard error of an estimate, 1.6 %


def item_sketches(found: DataFrame, by: Sequence[str] = ("day", "session_id"),
                  spans_col: str = "spans") -> DataFrame:
    """Items and a sketch of their distinct values, for each type and group of ``by``.

    Only sketches are shuffled, partly merged by each task. Values count up to case and outer white
    space. Stored, these rows answer for any union of their groups without the texts.
    """
    items = unnest(found, spans_col, "s", *by).select(
        *by, F.col("s.pii_type").alias("pii_type"), F.lower(strip(F.col("s.value"))).alias("value"))
    return items.groupBy(*by, "pii_type").agg(
        F.count(F.lit(1)).alias("n_items"), F.hll_sketch_agg("value", LG_K).alias("sketch"))


def rolled_up(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Items and the estimate of distinct values for coarser groups of stored sketches."""
    return sketches.groupBy(*by).agg(
        F.sum("n_items").alias("n_items"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct_about"))


def within(estimate: Column, exact: Column, errors: float = 4) -> Column:
    """Is an estimate within some standard errors of the exact count? Small counts are exact but for rounding."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), errors * ERROR * exact)
