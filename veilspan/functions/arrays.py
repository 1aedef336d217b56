"""Small building blocks over array columns.

Spark's ``aggregate`` copies its accumulator on every append, so a plain fold
over n elements moves n**2/2 references. The folds here work in blocks and
keep even texts with very many spans near linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
FEW = 9
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, array: str | Column, alias: str, *keep: str | Column) -> DataFrame:
    """One row per array element, as ``alias`` beside the kept columns.

    An inner explode makes Spark infer a filter on the array's size and push it
    below the projection that computes the array, which is then computed twice
    (and once per element where it is used in a lambda). An outer explode with
    a filter on the elements gives the same rows and leaves the plan alone.
    """
    return (df.select(*keep, F.explode_outer(array).alias(alias))
            .filter(F.col(alias).isNotNull()))


def empty(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def in_blocks(items: Column) -> Column:
    """Cut an array into an array of arrays of at most BLOCK elements."""
    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last),
                       lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def fold_emit(items: Column, zero: Column, out_type: str,
              step: Callable[[Column, Column], Column],
              emit: Callable[[Column, Column], Column]) -> Column:
    """Fold with a state; ``emit(state, x)`` gives the array to output for x."""

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"),
                        F.concat(acc["out"], emit(acc["state"], x)).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(
            xs, F.struct(acc["state"].alias("state"), empty(out_type).alias("out")), one)
        return let(inner, lambda r: F.struct(
            r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    def blocked(xs: Column) -> Column:
        start = F.struct(zero.alias("state"), empty(f"array<{out_type}>").alias("out"))
        return F.aggregate(in_blocks(xs), start, block, lambda acc: F.flatten(acc["out"]))

    def plain(xs: Column) -> Column:
        start = F.struct(zero.alias("state"), empty(out_type).alias("out"))
        return F.aggregate(xs, start, one, lambda acc: acc["out"])

    return let(items, lambda xs: F.when(F.size(xs) <= BLOCK, plain(xs)).otherwise(blocked(xs)))


def matches(wanted: Column, keys: Column) -> Column:
    """Places of strings that stand in both arrays, by sorting them together.

    One struct for each element of ``wanted`` that is among ``keys``: ``at``, its place, and
    ``to``, the places there in rising order. A map would be searched from its head
    for every element.
    """
    def tagged(items: Column, side: int) -> Column:
        return F.transform(items, lambda x, i: F.struct(
            x.alias("key"), F.lit(side).alias("side"), i.alias("at")))

    def step(state: Column, x: Column) -> Column:
        places = F.when(state["key"] == x["key"], F.array_append(state["to"], x["at"])).otherwise(
            F.array(x["at"]))
        return F.when(x["side"] == 1, state).otherwise(
            F.struct(x["key"].alias("key"), places.alias("to")))

    out = "struct<at:int,to:array<int>>"
    return fold_emit(
        F.array_sort(F.concat(tagged(keys, 0), tagged(wanted, 1))),
        F.struct(F.lit(None).cast("string").alias("key"), empty("int").alias("to")), out,
        step=step,
        emit=lambda state, x: F.when((x["side"] == 1) & (state["key"] == x["key"]), F.array(
            F.struct(x["at"].alias("at"), state["to"].alias("to")))).otherwise(empty(out)))


def offsets(lengths: Column) -> Column:
    """Sum of the elements before each element."""
    def few(xs: Column) -> Column:
        return F.transform(xs, lambda _, i: F.aggregate(
            F.slice(xs, F.lit(1), i), F.lit(0), lambda a, x: a + x))

    def many(xs: Column) -> Column:
        return fold_emit(xs, F.lit(0), "int",
                         step=lambda s, x: s + x, emit=lambda s, x: F.array(s))

    return let(lengths, lambda xs: F.when(F.size(xs) <= FEW, few(xs)).otherwise(many(xs)))


def text_chunks(text: Column) -> Column:
    """Cut a text into chunks of CHUNK characters, in one pass."""
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)))


def chunk_slice(chunks: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a chunked text, without scanning from its head."""

    def within(first: Column, last: Column) -> Column:
        head = F.substring(F.get(chunks, first), start - first * CHUNK + 1, end - start)
        whole = F.array_join(F.slice(chunks, first + 2, last - first - 1), "")
        tail = F.substring(F.get(chunks, last), F.lit(1), end - last * CHUNK)
        return F.when(first == last, head).otherwise(F.concat(head, whole, tail))

    one_chunk = F.substring(F.get(chunks, F.lit(0)), start + 1, end - start)
    return F.when(end <= start, F.lit("")).when(F.size(chunks) == 1, one_chunk).otherwise(
        let(F.shiftright(start, CHUNK_BITS),
            lambda a: let(F.shiftright(end - 1, CHUNK_BITS), lambda b: within(a, b))))
