"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import column, free_name

ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "key", "secret", "date")
# Month names of the four languages of the tables: fixed values, in calendar order.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
_MONTH_NUMBER = {name.lower(): i for names in MONTHS.values()
                 for i, name in enumerate(names.split(), 1)}
_MONTH_NAMES = "|".join(sorted({n for names in MONTHS.values() for n in names.split()},
                               key=lambda n: (-len(n), n)))

# Each pattern starts only where a run of its characters starts, so a scan stays linear.
PATTERNS: dict[str, re.Pattern] = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
        r"(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.-])[3-6]\d{3}(?:[ -]?\d){9,15}(?![\w-]|\.\d)"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)"
        r"|(?<![\w+)-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
        r"|(?<![\w.+-])[2-9]\d{2}[.-][2-9]\d{2}[.-]\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"),
    "key": re.compile(r"(?<!\w)A[KS]IA[0-9A-Z]{16}(?!\w)"),
    "secret": re.compile(
        r"(?i)(?<![a-z0-9])(?:passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
        r"\"?'?\s{0,3}[=:]\s{0,3}(?P<quote>[\"']?)(?P<value>[A-Za-z0-9+/_-]{8,})"),
    "date": re.compile(
        r"(?<![\w./-])(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})(?![\w/-]|\.\d)"
        r"|(?<![\w./-])(?P<a>\d{1,2})(?P<t>[-/.])(?P<b>\d{1,2})(?P=t)(?P<y2>\d{4})(?![\w/-]|\.\d)"
        rf"|(?<!\w)(?P<mn>{_MONTH_NAMES}) (?P<d3>\d{{1,2}})(?P<c>,? )(?P<y3>\d{{4}})(?!\w)"
        rf"|(?<![\w.])(?P<d4>\d{{1,2}})(?P<o>\.? (?:de )?)(?P<mn4>{_MONTH_NAMES})(?P<o2>,? (?:de )?)"
        r"(?P<y4>\d{4})(?!\w)", re.IGNORECASE),
}


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of 0 .. size-1.

    The value is written as two digits of radices a and b with a x b at least the size. Rounds add
    a keyed hash of one to the other in turn, each round a permutation; values outside
    the size are walked on until one falls inside, which keeps it one.
    """
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        high, low = divmod(value, b)
        for i in range(ROUNDS):
            if i % 2:
                low = (low + _noise(key, tweak, i, high)) % b
            else:
                high = (high + _noise(key, tweak, i, low)) % a
        value = high * b + low
        if value < size:
            return value


def _noise(key: bytes, tweak: str, turn: int, value: int) -> int:
    digest = hashlib.blake2b(f"{tweak}/{turn}/{value:x}".encode(), key=key[:64],
                             digest_size=32).digest()
    return int.from_bytes(digest, "big")


def permute_characters(text: str, key: bytes, tweak: str) -> str:
    """Permute digits among digits and letters among letters of their case; the rest stays.

    Hexadecimal strings stay hexadecimal.
    """
    hexadecimal = bool(re.fullmatch("[0-9a-f]+", text))
    runs = []
    for c in text:
        if hexadecimal:
            runs.append("0123456789abcdef")
        elif "0" <= c <= "9":
            runs.append("0123456789")
        elif "a" <= c <= "z":
            runs.append("abcdefghijklmnopqrstuvwxyz")
        elif "A" <= c <= "Z":
            runs.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        else:
            runs.append("")
    value, size = 0, 1
    for c, run in zip(text, runs):
        if run:
            value, size = value * len(run) + run.index(c), size * len(run)
    value = permute(value, size, key, f"{tweak}/{size:x}")
    out = []
    for c, run in zip(reversed(text), reversed(runs)):
        if run:
            value, digit = divmod(value, len(run))
            c = run[digit]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Sum of the Luhn check, modulo 10: 0 for valid numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_rest(text: str) -> int:
    """Remainder by 97 of an IBAN without blanks: 1 for valid numbers."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _into(shape: str, characters: str) -> str:
    """Put characters into the places of the letters and digits of a shape."""
    rest = iter(characters)
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in shape)


def _card(match: re.Match, key: bytes) -> str | None:
    """Pseudonym of the longest part from the start that is a valid number.

    A number that follows a card after a blank is not part of it.
    """
    shape = match[0]
    while True:
        digits = re.sub("[ -]", "", shape)
        if len(digits) < 13:
            return None
        if not luhn(digits):
            break
        shape = shape[:max(shape.rfind(" "), shape.rfind("-"), 0)]
    inner = digits[1:-1]
    new = permute(int(inner), 10 ** len(inner), key, f"card/{len(digits)}")
    body = digits[0] + str(new).zfill(len(inner))
    check = (10 - luhn(body + "0")) % 10
    return _into(shape, body + str(check))


def _iban(match: re.Match, key: bytes) -> str | None:
    text = match[0].replace(" ", "")
    if not 15 <= len(text) <= 34 or iban_rest(text) != 1:
        return None
    body = permute_characters(text[4:], key, "iban/" + text[:2])
    check = 98 - iban_rest(text[:2] + "00" + body)
    return _into(match[0], f"{text[:2]}{check:02d}{body}")


def _ssn(match: re.Match, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in match[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value = permute(value, len(areas) * 99 * 9999, key, "ssn")
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(match: re.Match, key: bytes) -> str | None:
    text = match[0]
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    country = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
    head = country[1] if country else digits[:1] if text.startswith("+") else ""
    body = digits[len(head):]
    if len(body) == 10 and body[0] >= "2" and body[3] >= "2":
        # Area and exchange of a North American number begin with 2 to 9.
        value = (((int(body[0]) - 2) * 100 + int(body[1:3])) * 8 + int(body[3]) - 2
                 ) * 1_000_000 + int(body[4:])
        value = permute(value, 8 * 100 * 8 * 1_000_000, key, "phone/na")
        rest, low = divmod(value, 1_000_000)
        rest, exchange = divmod(rest, 8)
        area, tens = divmod(rest, 100)
        new = f"{area + 2}{tens:02d}{exchange + 2}{low:06d}"
    else:
        new = str(permute(int(body), 10 ** len(body), key, f"phone/{len(body)}")).zfill(len(body))
    return _into(text, head + new)


def _ip(match: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in match[0].split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def _email(match: re.Match, key: bytes) -> str | None:
    local, _, domain = match[0].rpartition("@")
    return permute_characters(local, key, "email") + "@" + domain


def _key(match: re.Match, key: bytes) -> str | None:
    return match[0][:4] + permute_characters(match[0][4:], key, "key")


def _secret(match: re.Match, key: bytes) -> str | None:
    value = match["value"]
    if not any(c.isdigit() for c in value):  # a word of prose after a colon
        return None
    return match[0][:match.start("value") - match.start()] + permute_characters(value, key, "secret")


def _date(match: re.Match, key: bytes) -> str | None:
    g = match.groupdict()
    try:
        if g["y"]:
            day = datetime.date(int(g["y"]), int(g["m"]), int(g["d"]))
        elif g["y2"]:
            a, b = int(g["a"]), int(g["b"])
            day_first = g["t"] == "." or a > 12
            day = datetime.date(int(g["y2"]), b if day_first else a, a if day_first else b)
        elif g["y3"]:
            day = datetime.date(int(g["y3"]), _MONTH_NUMBER[g["mn"].lower()], int(g["d3"]))
        else:
            day = datetime.date(int(g["y4"]), _MONTH_NUMBER[g["mn4"].lower()], int(g["d4"]))
    except ValueError:
        return None
    place = day.toordinal() - FIRST_DAY
    if not 0 <= place < DAYS:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + permute(place, DAYS, key, "date"))
    if g["y"]:
        return (f"{new.year}{g['s']}{new.month:0{len(g['m'])}d}{g['s']}"
                f"{new.day:0{len(g['d'])}d}")
    if g["y2"]:
        a, b = (new.day, new.month) if day_first else (new.month, new.day)
        return f"{a:0{len(g['a'])}d}{g['t']}{b:0{len(g['b'])}d}{g['t']}{new.year}"
    name = g["mn"] or g["mn4"]
    names = next(n.split() for n in MONTHS.values() if name.lower() in n.lower().split())
    month = names[new.month - 1]
    month = month.upper() if name.isupper() else month.capitalize() if name[0].isupper() \
        else month.lower()
    if g["y3"]:
        return f"{month} {new.day}{g['c']}{new.year}"
    return f"{new.day}{g['o']}{month}{g['o2']}{new.year}"


_REPLACE = {"email": _email, "card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip,
            "key": _key, "secret": _secret, "date": _date}
_DIGIT = re.compile("[0-9]")


def findings(text: str, key: bytes) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym of what is found, in order and without overlaps.

    Of overlapping findings the kind that stands first in KINDS wins.
    """
    found: list[tuple[int, int, str, str]] = []
    digit = _DIGIT.search(text) is not None
    for kind in KINDS:
        if not (("@" in text) if kind == "email" else digit):
            continue
        before, at, fresh = 0, 0, []
        while (match := PATTERNS[kind].search(text, at)) is not None:
            start, at = match.span()
            new = _REPLACE[kind](match, key)
            if new is None:
                continue
            if kind == "card":  # it may be followed by another number
                at = start + len(new)
            # Findings of the kinds before stand in order, so one walk along them is enough.
            while before < len(found) and found[before][1] <= start:
                before += 1
            if before == len(found) or found[before][0] >= at:
                fresh.append((start, at, kind, new))
        found = sorted(found + fresh)
    return iter(found)


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[int]]:
    """The text with pseudonyms, and how many there are of each of KINDS."""
    counts = [0] * len(KINDS)
    if not text:
        return text, counts
    parts, at = [], 0
    for start, end, kind, new in findings(text, key):
        parts += text[at:start], new
        at = end
        counts[KINDS.index(kind)] += 1
    return ("".join([*parts, text[at:]]) if parts else text), counts


def with_pseudonyms(df: DataFrame, key: bytes, text_col: str = "text",
                    counts_col: str | None = None) -> DataFrame:
    """Replace personal data in a text column; nothing else of the text changes.

    Cards (Luhn), IBANs (modulo 97), social security numbers, phones, IPv4 addresses and calendar
    dates are validated and permuted within their format, check digits and all; local parts of
    e-mail addresses, access keys and secret values are permuted character class by class. Equal
    values get equal pseudonyms in all documents under one key, and different ones of a
    format different ones. Numbers that fail their check stay.

    Null stays null, empty stays empty, whole texts are read, rows and other columns stay. With
    ``counts_col`` a map of kind to number of findings is added.
    """
    if not key:
        raise ValueError("a secret key is needed")

    @F.pandas_udf("text string, counts array<int>")
    def replaced(texts: pd.Series) -> pd.DataFrame:
        rows = [pseudonymise(t, key) for t in texts]
        return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object),
                             "counts": pd.Series([r[1] for r in rows], dtype=object)})

    made = free_name(df, "_replaced")
    result = df.withColumn(made, replaced(F.col(text_col)))
    columns = [F.col(made)["text"].alias(c) if c == text_col else column(c)
               for c in df.columns]
    if counts_col:
        kinds = F.array(*[F.lit(k) for k in KINDS])
        columns.append(F.map_from_arrays(kinds, F.col(made)["counts"]).alias(counts_col))
    return result.select(*columns)
