"""Category, preset and protection vocabularies (fixed values)."""

# Categories, best priority first.  The position is the rank that
# decides which of several overlapping spans survives.
CATEGORY_PRIORITY = [
    "payment_card",
    "ssn",
    "canadian_sin",
    "uk_nhs",
    "aadhaar",
    "pan_india",
    "australian_tfn",
    "cpf",
    "npi",
    "dea",
    "mbi",
    "secrets",
    "email",
    "phone",
    "dob",
    "medical_record_number",
    "member_id",
    "address",
    "custom",
    "possible_name",
]

# Every category in settings order; "custom" is off by default.
ALL_CATEGORIES = [
    "email",
    "phone",
    "ssn",
    "dob",
    "medical_record_number",
    "member_id",
    "npi",
    "dea",
    "mbi",
    "address",
    "payment_card",
    "secrets",
    "possible_name",
    "custom",
    "canadian_sin",
    "uk_nhs",
    "aadhaar",
    "pan_india",
    "australian_tfn",
    "cpf",
]
DEFAULT_CATEGORIES = [c for c in ALL_CATEGORIES if c != "custom"]

# Short label stamped over a redacted span.
PLACEHOLDER_LABELS = {
    "email": "EMAIL",
    "phone": "PHONE",
    "ssn": "SSN",
    "dob": "DOB",
    "medical_record_number": "MRN",
    "member_id": "MEMBER ID",
    "npi": "NPI",
    "dea": "DEA",
    "mbi": "MBI",
    "address": "ADDRESS",
    "payment_card": "CARD",
    "secrets": "API KEY",
    "possible_name": "NAME",
    "custom": "CUSTOM",
    "canadian_sin": "SIN",
    "uk_nhs": "NHS",
    "aadhaar": "AADHAAR",
    "pan_india": "PAN",
    "australian_tfn": "TFN",
    "cpf": "CPF",
}

# Long display names of the categories that have one.
DISPLAY_LABELS = {
    "email": "Email Address",
    "phone": "Phone Number",
    "ssn": "SSN",
    "dob": "Date of Birth",
    "medical_record_number": "Medical Record Number (MRN)",
    "member_id": "Member ID",
    "npi": "Provider NPI",
    "dea": "DEA Number",
    "mbi": "Medicare ID (MBI)",
    "address": "Street Address",
    "payment_card": "Payment Card",
    "secrets": "API Key / Secret",
    "possible_name": "Personal Name",
    "custom": "Custom Pattern",
}

# Categories switched on by each compliance preset.
PRESETS = {
    "hipaa": [
        "medical_record_number", "member_id", "npi", "dea", "mbi", "ssn", "dob",
        "address", "phone", "email", "possible_name",
    ],
    "pci": ["payment_card", "ssn", "address", "phone", "email"],
    "gdpr": [
        "email", "phone", "address", "ssn", "dob", "possible_name",
        "medical_record_number", "member_id",
    ],
    "developer": ["secrets", "email", "phone"],
    "pipeda": [
        "canadian_sin", "email", "phone", "address", "dob", "possible_name",
        "payment_card",
    ],
    "uk_gdpr": [
        "uk_nhs", "email", "phone", "address", "dob", "possible_name",
        "medical_record_number", "member_id", "payment_card",
    ],
    "india_dpdp": [
        "aadhaar", "pan_india", "email", "phone", "address", "dob",
        "possible_name", "payment_card",
    ],
    "australia_privacy": [
        "australian_tfn", "email", "phone", "address", "dob", "possible_name",
        "payment_card",
    ],
    "brazil_lgpd": [
        "cpf", "email", "phone", "address", "dob", "possible_name", "payment_card",
    ],
}

# Protection modes, narrowest first.
PROTECTION_MODES = ["off", "this-tab", "always-on"]

# Limits of the scan, rule and audit contracts.
MAX_VISIBLE_CHARS = 250_000
MAX_NODE_CHARS = 10_000
MAX_ATTRIBUTE_CHARS = 2_048
MAX_CUSTOM_TEXT_CHARS = 100_000
MAX_CUSTOM_MATCHES = 1_000
MAX_CUSTOM_RULES = 200
MAX_PACK_RULES = 500
MAX_PACK_BYTES = 512 * 1024
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_FILE_PAGES = 20
MAX_AUDIT_EVENTS = 500
MAX_MEDIA_PER_PAGE = 8
MAX_IMAGE_CANDIDATES = 12
SESSION_GAPS = {"5m": 5 * 60, "15m": 15 * 60, "30m": 30 * 60}
