"""The mapping table (vault): session_id, pii_type, real, synthetic, first_seen_ts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

VAULT_COLUMNS = ("session_id", "pii_type", "real", "synthetic", "first_seen_ts")
VAULT_SCHEMA = ("session_id string, pii_type string, real string, synthetic string, "
                "first_seen_ts timestamp")
BY_REAL = ("session_id", "real")
BY_TYPE = ("session_id", "pii_type", "real")


def first_per_key(mappings: DataFrame, keys: Sequence[str] = BY_TYPE,
                  order: Sequence[str] = ("first_seen_ts",)) -> DataFrame:
    """The first mapping of each key. Repeats collapse before the shuffle."""
    rest = [c for c in VAULT_COLUMNS if c not in keys]
    ties = [c for c in ("pii_type", "synthetic") if c in rest]
    first = F.min_by(F.struct(*rest), F.struct(*order, *ties))
    return (mappings.groupBy(*keys).agg(first.alias("_f"))
            .select(*keys, *[F.col("_f")[c].alias(c) for c in rest]).select(*VAULT_COLUMNS))


def new_mappings(vault: DataFrame, mappings: DataFrame, keys: Sequence[str] = BY_TYPE,
                 order: Sequence[str] = ("first_seen_ts",)) -> DataFrame:
    """Mappings whose key the vault does not have yet."""
    return first_per_key(mappings, keys, order).join(vault.select(*keys), list(keys), "left_anti")


def base_of(synthetic: str = "synthetic") -> Column:
    """A synthetic value without the number that tells it from others with the same base."""
    return F.regexp_replace(synthetic, "~[0-9]+$", "")


def rename_collisions(vault: DataFrame, new: DataFrame) -> DataFrame:
    """Make new mappings injective: one synthetic value per real value and session.

    Real values that hash to the same synthetic value are numbered; the first
    keeps it, the others get "~1", "~2" and so on, which no base value contains.
    Known mappings keep what they have; of these only the rows that share a session and base with
    a new one are ordered. Keyed values spread over large ranges, so the numbered groups stay
    small even in a very large session.
    """
    new = new.select(*VAULT_COLUMNS, F.lit(1).alias("_new")).withColumn("_base", base_of())
    known = vault.select(*VAULT_COLUMNS, F.lit(0).alias("_new")).withColumn("_base", base_of()).join(
        new.select("session_id", "_base").distinct(), ["session_id", "_base"], "left_semi")
    # Known rows come first, so that new ones are numbered after them.
    place = W.partitionBy("session_id", "_base").orderBy(
        "_new", F.sha2(F.concat_ws("|", "pii_type", "real"), 256))
    n = F.row_number().over(place) - 1
    return (known.unionByName(new).withColumn("_n", n).filter("_new = 1")
            .withColumn("synthetic", F.when(F.col("_n") > 0, F.concat_ws("~", "_base", "_n"))
                        .otherwise(F.col("_base")))
            .select(*VAULT_COLUMNS))


def vault_upsert(vault: DataFrame, mappings: DataFrame, keys: Sequence[str] = BY_TYPE,
                 injective: bool = True, order: Sequence[str] = ("first_seen_ts",)) -> DataFrame:
    """The vault with the unknown mappings added; the first one of a key stays."""
    new = new_mappings(vault, mappings, keys, order)
    if injective:
        new = rename_collisions(vault, new)
    return vault.select(*VAULT_COLUMNS).unionByName(new)


def overrides(vault: DataFrame, keyed_col: str) -> DataFrame:
    """Vault rows that differ from the value their key would give."""
    return vault.filter(F.col("synthetic") != F.col(keyed_col))


def audit_trail(vault: DataFrame) -> DataFrame:
    return vault.select("session_id", "pii_type", "real", "synthetic")


def clear_session(vault: DataFrame, session_id: str) -> DataFrame:
    return vault.filter(F.col("session_id") != F.lit(session_id))


def collisions(vault: DataFrame) -> DataFrame:
    """Synthetic values that stand for more than one real value of a session."""
    pairs = vault.select("session_id", "synthetic", "real").distinct()
    return (pairs.groupBy("session_id", "synthetic").agg(F.count(F.lit(1)).alias("n_reals"))
            .filter("n_reals > 1"))


def first_of_type(mappings: DataFrame, pii_type: str, default: str,
                  id_col: str = "doc_id") -> DataFrame:
    """Each text's first mapping of a type, or the default."""
    # Rows of other types get a null order, which min_by ignores.
    order = F.when(F.col("pii_type") == pii_type, F.col("ord"))
    return mappings.groupBy(id_col).agg(*[
        F.coalesce(F.min_by(c, order), F.lit(default)).alias(c) for c in ("real", "synthetic")])
