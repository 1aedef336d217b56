"""Synthetic values.

``ordinal``: the n-th distinct value of a type in a text takes the n-th pool
entry, modulo pool size. Values that are not taken from a pool come from a
hash, never from a random generator, so a retried task writes the same text.

``keyed``: the value is a pure function of (salt, session, type, real value).
It needs no state, so redaction stays a narrow projection and works on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fixed_values as fv
from veilspan.functions.arrays import let
from veilspan.functions.patterns import WS, PatternSpec
from veilspan.functions.text import hex_number

SALT_SETTING = "veilspan.salt"

FIRST = ("Adele Bruno Carla Denis Elena Felix Greta Hanno Irene Jonas Karin Lukas Marta Nils "
         "Olga Pavel Quinn Rhea Stefan Tilda Ulrik Vera Wanda Xenia Yannick Zelda Amara Boris "
         "Celia Dario Edith Fiona").split()
LAST = ("Abbot Barlow Calder Dunmore Ellery Farrow Garland Hollis Ingram Jarvis Keaton Lomax "
        "Marlow Norwood Oakley Penrose Quimby Radley Selwyn Thorne Upton Vance Wexley Yardley "
        "Zeller Ashby Bexley Corwin Darrow Esmond Fenwick Granger").split()
STREET = ("Alder Birch Cypress Dogwood Elm Fir Gum Hazel Ivy Juniper Kauri Larch Myrtle Nutmeg "
          "Olive Poplar Quince Rowan Spruce Teak Umber Viburnum Willow Yew Zinnia Aspen Beech "
          "Clover Dahlia Fern Heather Laurel").split()
STREET_KIND = ("Street", "Avenue", "Lane", "Court")
CITY = ("Ashford", "Brookdale", "Clearview", "Dunwick", "Eastmere", "Fairhaven", "Glenrock",
        "Highfield")
STATE = ("AL", "CO", "GA", "ID", "KS", "ME", "NV", "OR")
FIELD = ("Logistics", "Textiles", "Robotics", "Catering", "Surveying", "Printing", "Ceramics",
         "Forestry")
COMPANY_KIND = ("Ltd", "Group", "Partners", "Company")

DATE_SHIFT_DAYS = 1825
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def salt_of(salt: str | None) -> str:
    """The salt given, or the session's own; there is none that everybody would know."""
    if salt is None:
        session = SparkSession.getActiveSession()
        salt = session.conf.get(SALT_SETTING, None) if session is not None else None
    if not salt:
        raise ValueError(f"give a secret salt, or set {SALT_SETTING} in the session")
    return salt


def digest(salt: str, scope: Column, pii_type: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit("|"), F.coalesce(scope.cast("string"), F.lit("")),
                           F.lit("|"), pii_type, F.lit("|"), value), 256)


def _slot(h: Column, i: int) -> Column:
    """The i-th of eight 32-bit numbers of a digest."""
    return hex_number(h, 8 * i + 1, 8)


def _pick(pool, n: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in pool]), (n % len(pool)).cast("int"))


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _ssn(h: Column) -> Column:
    return F.concat_ws("-", _padded(_slot(h, 0) % 800 + 100, 3),
                       _padded(_slot(h, 1) % 90 + 10, 2), _padded(_slot(h, 2) % 9000 + 1000, 4))


def _income(h: Column, value: Column) -> Column:
    """Shift by up to 12 percent, cut to whole dollars; null if it is no number."""
    amount = F.regexp_replace(value, f"[,$]|{WS}", "").try_cast("decimal(18,2)")
    factor = _slot(h, 0) % 240001 + 880000

    def shifted(cents: Column) -> Column:
        # cents * factor / 10**8 without leaving 64 bits
        return (_div(cents, 10**8) * factor
                + _div(cents % 10**8 * factor, 10**8))

    return let((amount * 100).cast("bigint"),
               lambda c: F.concat(F.lit("$"), F.format_number(shifted(c), 0)))


def _parsed_date(value: Column) -> Column:
    def from_slashes(parts: Column) -> Column:
        return F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(0)), 2, "0"),
                           F.lpad(F.get(parts, F.lit(1)), 2, "0"))

    month = F.floor((F.instr(F.lit(_MONTHS), F.lower(F.substring(value, 1, 3))) + 2) / 3)
    text = F.when(F.contains(value, F.lit("/")), let(F.split(value, "/"), from_slashes)).otherwise(F.concat_ws(
        "-", F.regexp_extract(value, "([0-9]{4})$", 1), _padded(month, 2),
        F.lpad(F.regexp_extract(value, f"{WS}([0-9]+)", 1), 2, "0")))
    return let(text, lambda t: F.when(
        F.rlike(t, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), t).try_cast("date"))


def _shifted_date(h: Column, value: Column) -> Column:
    days = (_slot(h, 0) % DATE_SHIFT_DAYS + 1).cast("int")
    days = F.when(_slot(h, 1) % 2 == 0, days).otherwise(-days)
    return let(_parsed_date(value),
               lambda d: F.date_format(F.date_add(d, days), "MM/dd/yyyy"))


def _any_date(h: Column) -> Column:
    """For dates that cannot be read: spread out, so that no single value gets them all."""
    day = F.date_add(F.lit("1930-01-01").cast("date"), (_slot(h, 0) % 25000).cast("int"))
    return F.date_format(day, "MM/dd/yyyy")


def _token(h: Column) -> Column:
    return F.concat(F.lit("[REDACTED-"), F.substring(h, 1, 8), F.lit("]"))


def _same_length_account(h: Column, value: Column) -> Column:
    digits = F.concat((_slot(h, 0) % 9 + 1).cast("string"), _padded(_slot(h, 1) % 10**8, 8),
                      _padded(_slot(h, 2) % 10**8, 8))
    width = F.when(F.rlike(value, F.lit("^[0-9]{8,17}$")), F.length(value)).otherwise(8)
    return F.substring(digits, F.lit(1), width)


def keyed_value(salt: str, scope: Column, pii_type: Column, value: Column) -> Column:
    """Synthetic value as a pure function of salt, scope, type and real value."""

    def by_type(h: Column) -> Column:
        name = F.concat_ws(" ", _pick(FIRST, _slot(h, 0)), F.concat(
            F.substring(F.lit(_LETTERS), (_slot(h, 1) % 26 + 1).cast("int"), F.lit(1)),
            F.lit(".")), _pick(LAST, _slot(h, 2)), _pick(LAST, _slot(h, 3)))
        address = F.concat_ws(" ", (_slot(h, 0) % 9900 + 100).cast("string"),
                              _pick(STREET, _slot(h, 1)), F.concat(
            _pick(STREET_KIND, _slot(h, 2)), F.lit(", "), _pick(CITY, _slot(h, 3)), F.lit(",")),
            _pick(STATE, _slot(h, 4)), (_slot(h, 5) % 90000 + 10000).cast("string"))
        phone = F.concat(F.lit("("), (_slot(h, 0) % 800 + 200).cast("string"), F.lit(") 555-"),
                         _padded(_slot(h, 1) % 10000, 4))
        email = F.concat(F.lit("user."), F.substring(h, 1, 12), F.lit("@placeholder.com"))
        employer = F.concat_ws(" ", _pick(LAST, _slot(h, 0)), F.lit("and"),
                               _pick(LAST, _slot(h, 1)), _pick(STREET, _slot(h, 2)),
                               _pick(FIELD, _slot(h, 3)), _pick(COMPANY_KIND, _slot(h, 4)))
        return (F.when(pii_type == "PERSON_NAME", name)
                .when(pii_type == "ADDRESS", address)
                .when(pii_type == "PHONE", phone)
                .when(pii_type == "EMAIL", email)
                .when(pii_type == "SSN", _ssn(h))
                .when(pii_type == "DATE_OF_BIRTH",
                      F.coalesce(_shifted_date(h, value), _any_date(h)))
                .when(pii_type == "ACCOUNT_NUMBER", _same_length_account(h, value))
                .when(pii_type == "EMPLOYER", employer)
                .when(pii_type == "INCOME_AMOUNT", F.coalesce(_income(h, value), _token(h)))
                .otherwise(_token(h)))

    return let(digest(salt, scope, pii_type, value), by_type)


# What keyed values look like, for finding them again in returned texts. "~n"
# marks a value that was renamed because another real value had it already.
_RENAMED = "(?:~[0-9]+)?"


def _any(pool) -> str:
    return "(?:" + "|".join(pool) + ")"


KEYED_PATTERNS: tuple[PatternSpec, ...] = tuple(
    PatternSpec("keyed_" + code.lower(), code, body, needs=needs) for code, body, needs in (
        ("PERSON_NAME", rf"{_any(FIRST)} [A-Z]\. {_any(LAST)} {_any(LAST)}{_RENAMED}", (". ",)),
        ("ADDRESS", rf"[0-9]{{3,4}} {_any(STREET)} {_any(STREET_KIND)}, {_any(CITY)}, "
                    rf"{_any(STATE)} [0-9]{{5}}{_RENAMED}", (", ",)),
        ("PHONE", rf"\([0-9]{{3}}\) 555-[0-9]{{4}}{_RENAMED}", (") 555-",)),
        ("EMAIL", rf"user\.[0-9a-f]{{12}}@placeholder\.com{_RENAMED}", ("@placeholder.com",)),
        ("SSN", rf"\<[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\>{_RENAMED}", ("-",)),
        ("DATE_OF_BIRTH", rf"\<[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\>{_RENAMED}", ("/",)),
        ("ACCOUNT_NUMBER", rf"\<[0-9]{{8,17}}\>{_RENAMED}", ()),
        ("EMPLOYER", rf"{_any(LAST)} and {_any(LAST)} {_any(STREET)} {_any(FIELD)} "
                     rf"{_any(COMPANY_KIND)}{_RENAMED}", (" and ",)),
        ("INCOME_AMOUNT", rf"\$[0-9]{{1,3}}(?:,[0-9]{{3}})*{_RENAMED}", ("$",)),
        ("OTHER", rf"\[REDACTED-[0-9a-f]{{8}}\]{_RENAMED}", ("[REDACTED-",)),
    ))
POSSESSIVE_PATTERN = PatternSpec("keyed_possessive", "PERSON_NAME",
                                 rf"\<{_any(FIRST + LAST)}'s", needs=("'s",))


def ordinal_value(salt: str, scope: Column, pii_type: Column, value: Column,
                  n: Column) -> Column:
    """Synthetic value of the n-th (0-based) distinct value of a type in a text."""

    def by_type(h: Column) -> Column:
        out = F.when(pii_type == "SSN", _ssn(h))
        for code, pool in fv.ORDINAL_POOLS.items():
            out = out.when(pii_type == code, _pick(pool, n))
        email = F.format_string(fv.ORDINAL_EMAIL_FORMAT, (n + 1).cast("bigint"))
        return (out.when(pii_type == "EMAIL", email)
                .when(pii_type == "INCOME_AMOUNT",
                      F.coalesce(_income(h, value), F.lit(fv.REDACTED)))
                .when(pii_type == "DATE_OF_BIRTH", F.lit(fv.ORDINAL_DATE))
                .when(pii_type == "ACCOUNT_NUMBER",
                      (hex_number(h, 1, 12) % 90000000 + 10000000).cast("string"))
                .otherwise(F.lit(fv.REDACTED)))

    return let(digest(salt, scope, pii_type, value), by_type)
