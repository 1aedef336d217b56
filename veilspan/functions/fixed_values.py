"""Everything in this file must be exactly as stated for results
to be right. Lists keep their natural order.

The values (type table, alias table, substitution pools, formats, thresholds)
follow a publicly available work under CC-BY 4.0; see NOTICE.
"""

# Type code -> (label, icon), in display order.
PII_TYPES = {
    "PERSON_NAME": ("Name", "🟡"),
    "ADDRESS": ("Address", "🔵"),
    "PHONE": ("Phone", "🟣"),
    "EMAIL": ("Email", "🟤"),
    "SSN": ("SSN", "🔴"),
    "DATE_OF_BIRTH": ("Date", "🟠"),
    "ACCOUNT_NUMBER": ("Account", "🔴"),
    "EMPLOYER": ("Employer", "⚪"),
    "INCOME_AMOUNT": ("Income", "🟢"),
}

# Type token written by the entity model -> type code.
NER_ALIASES = {
    "person_name": "PERSON_NAME",
    "address": "ADDRESS",
    "phone": "PHONE",
    "email": "EMAIL",
    "ssn": "SSN",
    "date_of_birth": "DATE_OF_BIRTH",
    "account_number": "ACCOUNT_NUMBER",
    "employer": "EMPLOYER",
    "income_amount": "INCOME_AMOUNT",
    "name": "PERSON_NAME",
    "full_name": "PERSON_NAME",
    "street_address": "ADDRESS",
    "location": "ADDRESS",
    "phone_number": "PHONE",
    "telephone": "PHONE",
    "email_address": "EMAIL",
    "social_security_number": "SSN",
    "social_security": "SSN",
    "dob": "DATE_OF_BIRTH",
    "date": "DATE_OF_BIRTH",
    "ein": "ACCOUNT_NUMBER",
    "tax_id": "ACCOUNT_NUMBER",
    "employer_id": "ACCOUNT_NUMBER",
    "patient_id": "ACCOUNT_NUMBER",
    "member_id": "ACCOUNT_NUMBER",
    "insurance_id": "ACCOUNT_NUMBER",
    "routing_number": "ACCOUNT_NUMBER",
    "bank_account": "ACCOUNT_NUMBER",
    "company": "EMPLOYER",
    "organization": "EMPLOYER",
    "insurance_provider": "EMPLOYER",
    "provider": "EMPLOYER",
    "salary": "INCOME_AMOUNT",
    "wages": "INCOME_AMOUNT",
    "income": "INCOME_AMOUNT",
    "compensation": "INCOME_AMOUNT",
}

# Substitution pools of the ordinal mode, picked by n modulo size.
ORDINAL_POOLS = {
    "PERSON_NAME": ["Marcus Chen", "Sarah Mitchell", "David Okafor", "Emily Tanaka",
                    "James Rivera", "Priya Sharma", "Michael O'Brien", "Lisa Nakamura"],
    "ADDRESS": ["456 Pine Ave, Portland, OR 97201", "789 Maple Dr, Denver, CO 80202",
                "321 Oak Blvd, Raleigh, NC 27601", "654 Cedar Ln, Phoenix, AZ 85001"],
    "PHONE": ["(503) 555-0147", "(720) 555-0238", "(919) 555-0391", "(602) 555-0482"],
    "EMPLOYER": ["Pinnacle Solutions Inc", "Meridian Tech Group",
                 "Cascade Industries LLC", "Summit Digital Partners"],
}

# Formats, constants and thresholds.
ORDINAL_DATE = "07/22/1991"
ORDINAL_EMAIL_FORMAT = "synthetic.user%d@placeholder.com"
REDACTED = "[REDACTED]"
MIN_CONFIDENCE = 0.80
DEFAULT_CONFIDENCE = 0.9
NO_RESPONSE_PREFIX = "[API"
PLACEHOLDER_VALUES = ["...", "<entity>"]
REGEX_SOURCE = "regex"
NER_SOURCE = "ner"

# Routing vocabulary and the conservative fallback record.
ROUTING_VALUES = {
    "agent": ["research", "admin", "general"],
    "pii_risk": ["low", "medium", "high"],
    "complexity": ["simple", "moderate", "complex"],
    "route": ["local", "cloud"],
}
ROUTING_FALLBACK = {"agent": "general", "pii_risk": "high",
                    "complexity": "complex", "route": "cloud"}
