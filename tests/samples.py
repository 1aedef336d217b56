"""Look-alike texts with invented values, and a brute-force detector to compare with."""

import re

from veilspan.functions.patterns import DEFAULT_PATTERNS

WAGES = """YEARLY WAGE PAPER

Person:
Name: Ada Brandt
SSN: 612-45-9083
Address: 77 Quarry Path, Lindale, TX 75771
Date of Birth: 11/02/1979

Firm:
Employer: Bluefin Tools Corp.
EIN: 55-1234567
Address: 900 Harbor View Blvd, Ostend, ME 04401

Pay: $98,250.00
Tax: $17,040.00
Base: $98,250.00

Phone: (207) 314-9920
Email: ada.brandt@mail.example.org
Bank Account: 990123456
Routing Number: 011000138"""
HEALTH = """SUMMARY
Patient: Ada Brandt
Date of Birth: 11/02/1979
Patient ID: MED-001122
Insurance: Harbor Mutual, Member ID: HM-5512345
Doctor: Dr. Olaf Finn
Last Visit: May 3, 2024
Pressure 121/80, pulse 64
Emergency Contact: Piet Brandt, (207) 220-1188, Brother"""
LEASE = """LEASE
Tenant: Ada Brandt
Co-Tenant: Piet Brandt
Date of Birth (Tenant): 11/02/1979
SSN (Tenant): 612-45-9083
Property: 77 Quarry Path, Lindale, TX 75771
Landlord: Old Mill Homes LLC
Monthly Rent: $1,850.00
Deposit: $3,700.00
Start: September 1, 2024
Emergency Contact: Jo Finn, (207) 455-7781
Email: ada.brandt@mail.example.org
Bank Account for Auto-Pay: 990123456"""


def python_pattern(spec):
    body = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), spec.re2)
    body = body.replace(r"\p{Nd}", r"\d")
    flags = re.MULTILINE | (re.IGNORECASE if "(?i)" in body else 0)
    return re.compile(body.replace("(?m)", "").replace("(?i)", ""), flags)


def brute_spans(text):
    """(start, end, type, value) of every hit, ordered by start, then detector."""
    out = []
    for ord_, spec in enumerate(DEFAULT_PATTERNS):
        for m in python_pattern(spec).finditer(text):
            start = m.start(2) if spec.labelled else m.start()
            value = (m[2] if spec.labelled else m[0]).strip()
            if value:
                out.append((start, ord_, start + len(value), spec.pii_type, value))
    return [(s, e, t, v) for s, _, e, t, v in sorted(out, key=lambda x: x[:2])]
