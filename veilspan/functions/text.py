"""Text helpers whose whitespace rules equal Python's ``str`` methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.patterns import NOT_WS

# The characters of patterns.WS.
WS_CHARS = "".join(map(chr, (*range(0x9, 0xe), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                             0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace (``trim`` alone takes only spaces). A regex would search the whole text."""
    return F.btrim(text, F.lit(WS_CHARS))


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, f"{NOT_WS}+", 0)


def tail_from(text: Column, start: Column) -> Column:
    """Characters from a 1-based position to the end."""
    return F.substring(text, start, F.length(text))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hex_number(digest: Column, start: int, width: int) -> Column:
    """A slice of a hex digest as a number; at most 12 hex digits."""
    return F.conv(F.substring(digest, start, width), 16, 10).cast("bigint")
