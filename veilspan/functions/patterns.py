"""Pattern specs for the detectors.

One spec renders for two regex dialects: Java (Spark) and RE2 (the DuckDB
oracle). Templates use these tokens:

  \\<  \\>   word edge before / after a digit or letter run (Unicode)
  {{WS}}   one whitespace character, as Python's ``str`` sees it
  {{SEP}}  a whitespace character, "#" or ":"
  {{IWS}}  the same as WS without CR and LF (inside a line)
  {{ND}}   one decimal digit of any script

Double braces are no regex, so a pattern holds a token only on purpose.

A labelled spec is written as (prefix)(value)(suffix): the value's offset is
the match start plus the prefix length, so nothing has to be searched for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

WS_RANGES = (r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
             r"\x{202f}\x{205f}\x{3000}")
WS = r"[\t-\r\x{1c}-\x{20}" + WS_RANGES + "]"
NOT_WS = r"[^\t-\r\x{1c}-\x{20}" + WS_RANGES + "]"
IWS = r"[\t\x{0b}\x{0c}\x{1c}-\x{20}" + WS_RANGES + "]"
SEP = r"[#:\t-\r\x{1c}-\x{20}" + WS_RANGES + "]"
ND = r"\p{Nd}"
_WORD = r"[\p{L}\p{N}_]"


def _groups(template: str) -> int:
    """Capturing groups of a template."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", template)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", bare))


def _own(template: str) -> str:
    """A template of this module, in which the tokens stand without braces."""
    return re.sub("SEP|IWS|WS|ND", r"{{\g<0>}}", template)


@dataclass(frozen=True)
class PatternSpec:
    """A detector: a regex template, its type and how the value is captured.

    ``needs`` lists literals every match contains; texts without them skip the
    regex altogether. ``labelled`` templates have exactly three groups.
    """

    name: str
    pii_type: str
    template: str
    labelled: bool = False
    needs: tuple[str, ...] = ()
    java_template: str | None = None

    def __post_init__(self) -> None:
        for template in (self.template, self.java_template):
            if self.labelled and template is not None and _groups(template) != 3:
                raise ValueError(f"pattern {self.name}: a labelled template has three groups")

    def _fill(self, template: str) -> str:
        for token, chars in (("SEP", SEP), ("IWS", IWS), ("WS", WS), ("ND", ND)):
            template = template.replace("{{" + token + "}}", chars)
        return template

    @property
    def java(self) -> str:
        body = self._fill(self.java_template or self.template)
        body = body.replace(r"\<", f"(?<!{_WORD})").replace(r"\>", f"(?!{_WORD})")
        return "(?dm)" + body

    @property
    def re2(self) -> str:
        body = self._fill(self.template)
        return "(?m)" + body.replace(r"\<", r"\b").replace(r"\>", r"\b")


_DAY = "(?:0?[1-9]|[12]ND|3[01])"
_MONTHS = ("(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?"
           "|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
_SSN = r"\<ND{3}-ND{2}-ND{4}\>"
_PHONE_DASH = r"\<ND{3}-ND{3}-ND{4}\>"
_DATE_SLASH = rf"\<(?:0?[1-9]|1[0-2])/{_DAY}/ND{{4}}\>"
_LOCAL = "[a-zA-Z0-9._%+-]"
_DOMAIN = r"@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_ACCOUNT = (r"((?:account|acct|routing)WS*(?:number|no|num|#)?SEP*)"
            r"(ND{8,17})(\>)")

# The detectors' grammars, in priority order.
_GRAMMARS: tuple[PatternSpec, ...] = (
    # A word edge looks back at every character; in Java a match's first characters are looked at before.
    PatternSpec("ssn", "SSN", _SSN, needs=("-",), java_template="(?=ND{3}-)" + _SSN),
    # In Java the local part is possessive and only tried where a run of its
    # characters begins (or the previous match ended): same matches, linear time.
    PatternSpec("email", "EMAIL", _LOCAL + "+" + _DOMAIN, needs=("@",),
                java_template=rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++{_DOMAIN}"),
    PatternSpec("phone_paren", "PHONE", r"\(ND{3}\)WS?ND{3}-ND{4}", needs=("(", "-")),
    PatternSpec("phone_dash", "PHONE", _PHONE_DASH, needs=("-",), java_template="(?=ND{3}-)" + _PHONE_DASH),
    PatternSpec("date_slash", "DATE_OF_BIRTH", _DATE_SLASH, needs=("/",),
                java_template="(?=[0-9]{1,2}/)" + _DATE_SLASH),
    # The two specs without a required literal look at the first letters before
    # anything else; it halves the cost of texts without a hit.
    PatternSpec("date_month", "DATE_OF_BIRTH",
                rf"(?i)\<{_MONTHS}WS+{_DAY},?WS+ND{{4}}\>",
                java_template=rf"(?i)(?=[jfmasond][aepuco][nbrylgptvc])\<{_MONTHS}WS+{_DAY},?WS+ND{{4}}\>"),
    PatternSpec("income", "INCOME_AMOUNT",
                r"\$WS*ND{1,3}(?:,ND{3})+(?:\.ND{2})?\>", needs=("$", ",")),
    PatternSpec("account", "ACCOUNT_NUMBER", "(?i)" + _ACCOUNT, labelled=True,
                java_template="(?i)(?=[ar])" + _ACCOUNT),
    PatternSpec("person_name", "PERSON_NAME",
                r"(?i)(^IWS*(?:name|patient|employee|tenant|co-?tenant|client)WS*:WS*)"
                r"([A-Z][a-z]+(?: [A-Z][a-z.]+){1,3})(WS*$)", labelled=True, needs=(":",)),
    PatternSpec("address", "ADDRESS",
                r"(?i)(^IWS*addressWS*:WS*)"
                r"(ND+WS+[^\r\n,]{4,},WS*[^\r\n,]{3,},WS*[A-Z]{2}WS+ND{5}(?:-ND{4})?)(WS*$)",
                labelled=True, needs=(":", ",")),
    PatternSpec("employer", "EMPLOYER",
                r"(?i)(^IWS*employerWS*:WS*)([A-Z][^\r\n]{2,60}?)(WS*$)",
                labelled=True, needs=(":",)),
)

DEFAULT_PATTERNS = tuple(replace(
    p, template=_own(p.template), java_template=p.java_template and _own(p.java_template))
    for p in _GRAMMARS)
PATTERN_BY_NAME = {p.name: p for p in DEFAULT_PATTERNS}
