"""Putting real values back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.arrays import let, matches
from veilspan.functions.spans import splice
from veilspan.functions.text import first_token

MAPPING_TYPE = "struct<ord:int,pii_type:string,real:string,synthetic:string>"
MIN_FIRST_TOKEN = 2


def in_chain_order(mappings: Column) -> Column:
    """Mappings as a chain of replacements takes them: longest synthetic value first, then by ``ord``."""
    keyed = F.transform(mappings, lambda m: F.struct(
        (-F.length(m["synthetic"])).alias("k0"), m["ord"].alias("k1"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda k: k["m"])


def restore_found(text: Column, hits: Column, mappings: Column) -> Column:
    """Put real values in the place of found synthetic ones, in one pass over the text.

    ``hits`` are spans of what looks like a keyed value or the possessive of its first word,
    ordered and free of overlaps. Where several values share that word the longest decides.
    """
    def surface(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    def surfaces(ordered: Column) -> Column:
        owned = F.filter(F.transform(ordered, lambda m: surface(
            first_token(m["synthetic"]), first_token(m["real"]))),
            lambda s: F.length(s["key"]) > MIN_FIRST_TOKEN)
        return F.concat(
            F.transform(ordered, lambda m: surface(m["synthetic"], m["real"])),
            F.transform(owned, lambda s: surface(F.concat(s["key"], F.lit("'s")),
                                                 F.concat(s["value"], F.lit("'s")))))

    def replaced(known: Column, found: Column) -> Column:
        met = matches(F.transform(found, lambda h: h["value"]),
                      F.transform(known, lambda s: s["key"]))
        spans = F.array_sort(F.transform(met, lambda m: F.struct(
            F.get(found, m["at"])["start"].alias("start"), F.get(found, m["at"])["end"].alias("end"),
            F.get(known, F.get(m["to"], F.lit(0)))["value"].alias("real"))))
        return splice(text, spans, lambda s: s["real"])

    return let(in_chain_order(mappings), lambda o: let(surfaces(o), lambda known: let(
        hits, lambda found: replaced(known, found))))
