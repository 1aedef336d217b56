"""Assigning synthetic values and rewriting texts.

Synthetic values depend on a secret salt: the one given, or the session's ``veilspan.salt``. There is
no default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilspan.functions.arrays import let, unnest
from veilspan.functions.spans import SPAN_FIELDS, ordinal_named, splice
from veilspan.functions.synth import keyed_value, ordinal_value, salt_of
from veilspan.functions.text import strip
from veilspan.operators.skew import hot_keys, spread_join
from veilspan.operators.vault import overrides
from veilspan.session import built_once, shared_dir

_SEP = "\u0000"


def first_from_right(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Distinct values of each text; the right-most place decides a value's type.

    One row per (text, value): pii_type, start, ord. An aggregate, not a window:
    repeats of a value collapse before the shuffle.
    """
    placed = spans.filter(F.col("start").isNotNull())
    first = F.max_by(F.struct("pii_type", "start", "ord"),
                     F.struct(F.col("start"), -F.col("ord")))
    return (placed.groupBy(id_col, "value").agg(first.alias("f"))
            .select(id_col, "value", "f.pii_type", "f.start", "f.ord"))


def with_ordinals(distinct_values: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number the values of a text from the right: ``n`` per type, ``seq`` over all."""
    right_first = (F.col("start").desc(), F.col("ord"))
    return (distinct_values
            .withColumn("seq", F.row_number().over(
                W.partitionBy(id_col).orderBy(*right_first)) - 1)
            .withColumn("n", F.row_number().over(
                W.partitionBy(id_col, "pii_type").orderBy(*right_first)) - 1))


@built_once
def _keyed(salt: str, scope_col: str, type_col: str, value_col: str) -> Column:
    return keyed_value(salt, F.col(scope_col), F.col(type_col), F.col(value_col))


@built_once
def _ordinal(salt: str, scope_col: str, type_col: str, value_col: str, n_col: str) -> Column:
    return ordinal_value(salt, *map(F.col, (scope_col, type_col, value_col, n_col)))


def assign_synthetic(spans: DataFrame, mode: str = "keyed", salt: str | None = None,
                     scope_col: str = "session_id", id_col: str = "doc_id") -> DataFrame:
    """Mappings from real to synthetic values.

    ``keyed``: one row per (scope, type, value), the same in every text of a scope.
    ``ordinal``: one row per (text, value), numbered from the right of each text;
    ``ord`` is the order in which the mappings were made.
    """
    if mode == "keyed":
        distinct = (spans.filter(F.col("start").isNotNull())
                    .select(F.col(scope_col), "pii_type", F.col("value").alias("real")).distinct())
        return distinct.withColumn("synthetic", _keyed(salt_of(salt), scope_col, "pii_type", "real"))
    if mode != "ordinal":
        raise ValueError(f"unknown assignment mode: {mode}")
    numbered = with_ordinals(first_from_right(spans, id_col), id_col)
    return numbered.select(
        id_col, F.col("seq").alias("ord"), "pii_type", F.col("value").alias("real"),
        _ordinal(salt_of(salt), id_col, "pii_type", "value", "n").alias("synthetic"), "n")


def redact(docs: DataFrame, spans: DataFrame, mappings: DataFrame, id_col: str = "doc_id",
           text_col: str = "text", on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rewrite texts from long-form spans and a mapping table; adds ``sanitized``.

    ``on`` names the mapping scope: the text id for ordinal mappings, or for
    example ("session_id", "pii_type") for keyed ones, with one mapping per
    scope and real value. Spans must be free of overlaps. Texts without spans
    pass through unchanged. No side is broadcast: what Spark expects of its size
    leaves out that a text has many spans.

    In a wider scope one value may stand in a large share of all texts. The spans
    are then written to the checkpoint folder, counted, and hot values spread.
    """
    placed = spans.filter(F.col("start").isNotNull())
    known = mappings.select(*on, F.col("real").alias("value"), "synthetic")
    keys = [*on, "value"]
    if id_col in on:
        named = placed.join(known.hint("merge"), keys)
    else:
        shared_dir(docs.sparkSession)
        placed = placed.select(id_col, *keys, "start", "end").checkpoint()
        named = spread_join(placed, known, keys, hot_keys(placed, keys), id_col, "inner")
    # Spans of one text, so the list is bounded by the text.
    packed = named.groupBy(id_col).agg(F.array_sort(F.collect_list(
        F.struct("start", "end", "synthetic"))).alias("_s"))
    nothing = F.array().cast("array<struct<start:int,end:int,synthetic:string>>")
    joined = docs.join(packed.hint("merge"), id_col, "left").withColumn("_s", F.coalesce("_s", nothing))
    return joined.withColumn("sanitized", _spliced(text_col, "_s", "synthetic")).drop("_s")


@built_once
def _named(salt: str, scope_col: str, spans_col: str) -> Column:
    return F.transform(spans_col, lambda s: F.struct(
        *[s[f].alias(f) for f in SPAN_FIELDS],
        keyed_value(salt, F.col(scope_col), s["pii_type"], s["value"]).alias("synthetic")))


@built_once
def _spliced(text_col: str, spans_col: str, field: str) -> Column:
    return splice(F.col(text_col), F.col(spans_col), lambda s: s[field])


def with_keyed_spans(df: DataFrame, salt: str | None = None, scope_col: str = "session_id",
                     spans_col: str = "spans", out_col: str = "named") -> DataFrame:
    """Give each span its keyed synthetic value (no shuffle, works on streams)."""
    return df.withColumn(out_col, _named(salt_of(salt), scope_col, spans_col))


def redact_keyed(df: DataFrame, salt: str | None = None, scope_col: str = "session_id",
                 text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Text to redacted text in one narrow projection; adds ``named`` and ``sanitized``.

    This is the path for very large tables and for streams: nothing is shuffled.
    """
    named = with_keyed_spans(df, salt, scope_col, spans_col)
    return named.withColumn("sanitized", _spliced(text_col, "named", "synthetic"))


@built_once
def _ordinal_named(salt: str, id_col: str, spans_col: str) -> Column:
    return ordinal_named(F.col(spans_col), lambda pii_type, value, n: ordinal_value(
        salt, F.col(id_col), pii_type, value, n))


def redact_ordinal(df: DataFrame, salt: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Ordinal redaction in one narrow projection; adds ``named`` and ``sanitized``.

    The numbers are those of one text, so its spans are all that is needed: no shuffle,
    and it works on streams. Spans must be resolved.
    """
    named = df.withColumn("named", _ordinal_named(salt_of(salt), id_col, spans_col))
    return named.withColumn("sanitized", _spliced(text_col, "named", "synthetic"))


def redact_with_vault(df: DataFrame, vault: DataFrame, salt: str | None = None,
                      scope_col: str = "session_id", id_col: str = "doc_id",
                      text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Like ``redact_keyed``, with the value the vault has where it differs from the keyed one.

    A vault without collisions has renamed a few values. Those are looked up by (session,
    type, value), and the texts that hold some, which are few, get them as a map no larger than
    the text. ``id_col`` must be unique. On streams the vault is the static side.
    """
    named = with_keyed_spans(df, salt, scope_col, spans_col)
    renamed = overrides(vault.withColumn(
        "_keyed", _keyed(salt_of(salt), "session_id", "pii_type", "real")), "_keyed").select(
        F.col("session_id").alias(scope_col), "pii_type", F.col("real").alias("value"),
        F.col("synthetic").alias("_name"))
    values = unnest(named, "named", "s", id_col, scope_col).select(
        id_col, scope_col, "s.pii_type", "s.value").distinct()
    hits = (values.join(renamed, [scope_col, "pii_type", "value"]).groupBy(id_col)
            .agg(F.map_from_entries(F.collect_list(F.struct(
                F.concat_ws(_SEP, "pii_type", "value"), "_name"))).alias("_names")))

    def own(s: Column) -> Column:
        name = F.col("_names")[F.concat_ws(_SEP, s["pii_type"], s["value"])]
        return s.withField("synthetic", F.coalesce(name, s["synthetic"]))

    fitted = named.join(hits, id_col, "left").withColumn("named", F.transform("named", own))
    return fitted.withColumn("sanitized", _spliced(text_col, "named", "synthetic")).drop("_names")


def with_mappings(redacted: DataFrame, named_col: str = "named",
                  out_col: str = "mappings") -> DataFrame:
    """The distinct mappings of each text, as an array on its row.

    Repeats are told by strings since Spark compares structs pairwise in ``array_distinct``; only a
    text that has some gets its mappings by cutting these strings.
    """
    def key(s: Column) -> Column:
        return F.concat_ws(_SEP, s["pii_type"], s["synthetic"], s["value"])

    def parsed(x: Column, i: Column) -> Column:
        return let(F.split(x, _SEP, 3), lambda parts: F.struct(
            i.alias("ord"), F.get(parts, F.lit(0)).alias("pii_type"), F.get(parts, F.lit(2)).alias("real"),
            F.get(parts, F.lit(1)).alias("synthetic")))

    def mapping(s: Column, i: Column) -> Column:
        return F.struct(i.alias("ord"), s["pii_type"].alias("pii_type"), s["value"].alias("real"),
                        s["synthetic"].alias("synthetic"))

    def has_null(s: Column) -> Column:
        return s["pii_type"].isNull() | s["synthetic"].isNull() | s["value"].isNull()

    # Each array is named once, so that its expression stays once in the plan.
    return redacted.withColumn(out_col, let(F.col(named_col), lambda named: let(
        F.array_distinct(F.transform(named, key)), lambda keys: F.when(
            (F.size(keys) == F.size(named)) & ~F.exists(named, has_null), F.transform(named, mapping))
        .otherwise(F.transform(keys, parsed)))))


def previews(redacted: DataFrame, id_col: str = "doc_id", text_col: str = "sanitized",
             lengths: tuple[int, int] = (300, 120)) -> DataFrame:
    """First characters of each redacted text: as it is, and trimmed."""
    long, short = lengths
    return redacted.select(id_col, F.left(F.col(text_col), F.lit(long)).alias("preview"),
                           strip(F.left(F.col(text_col), F.lit(short))).alias("short_preview"))
