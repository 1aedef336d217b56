"""Re-identification audit: could a redacted text point to a person after all?

Two ways are looked at. A synthetic value may happen to be a real value of somebody else, in the same session or
another; and a text may hold a combination of kinds of values that few other texts have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import strip

SMALL_GROUP = 5


def _plain(name: str):
    return F.lower(strip(F.col(name)))


def synthetic_reals(vault: DataFrame) -> DataFrame:
    """Synthetic values that are also real values, whoever's: pii_type, value, n_given, n_real, same_session.

    Values of a type collapse to one row each before they meet, by equality, so one that very many sessions share
    is no hot key. ``n_given`` sessions were given it as a synthetic value, ``n_real`` have it as a real one, and
    in ``same_session`` of them both hold: there a reply cannot be restored rightly. Compared up to
    case and outer white space; a value that is its own synthetic one counts too.
    """
    both = vault.select("session_id", "pii_type", F.explode(F.array(
        F.struct(_plain("synthetic").alias("value"), F.lit(1).alias("given"), F.lit(0).alias("real")),
        F.struct(_plain("real").alias("value"), F.lit(0).alias("given"), F.lit(1).alias("real")))).alias("v"))
    sides = both.groupBy("pii_type", "v.value", "session_id").agg(
        F.max("v.given").alias("given"), F.max("v.real").alias("real"))
    met = sides.groupBy("pii_type", "value").agg(
        F.sum("given").alias("n_given"), F.sum("real").alias("n_real"),
        F.sum(F.col("given") * F.col("real")).alias("same_session"))
    return met.filter((F.col("n_given") > 0) & (F.col("n_real") > 0))


def small_groups(found: DataFrame, by: Sequence[str] = (), k: int = SMALL_GROUP, id_col: str = "doc_id",
                 spans_col: str = "spans") -> DataFrame:
    """Combinations of kinds (and further columns of the texts) that fewer than ``k`` texts share.

    Columns kinds, by, n_texts. Redaction hides the values of a text, not which kinds it has; who knows
    that about a person may single out a text of a small group. Texts without values are left out.
    """
    kinds = F.array_sort(F.array_distinct(F.transform(spans_col, lambda s: s["pii_type"])))
    groups = found.select(F.array_join(kinds, "+").alias("kinds"), *by).filter("kinds <> ''")
    return groups.groupBy("kinds", *by).agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") < k)
