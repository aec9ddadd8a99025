"""Parameters: every dimension, threshold and fixed value lives here.

Values marked FIXED must equal the behaviour being matched for results to be
right; they are stated plainly, in their natural order, and are not derived.
Operators take them as keyword defaults, so a caller can override any of them.
"""

from __future__ import annotations

import datetime as _dt

# ---------------------------------------------------------------------------
# FIXED VALUES -- adoption cutoff, detector patterns, weights, keywords,
# redaction tokens, model rates, licence costs and tier minima, levels.
# ---------------------------------------------------------------------------

# Before/After boundary of the original deployment (inclusive "After").
ADOPTION_CUTOFF = _dt.datetime(2022, 6, 21)

# Seven regex detectors, in evaluation order (order matters for redaction).
PII_PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone_us", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("api_key", r"\b(?:sk|pk|ghp|xox[baprs])-[A-Za-z0-9_\-]{10,}\b"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("url_with_cred", r"https?://[^@\s]+:[^@\s]+@[^\s]+"),
)

# Score weight per regex detector.
PII_WEIGHTS: dict[str, int] = {
    "email": 25,
    "phone_us": 20,
    "credit_card": 40,
    "ssn": 45,
    "api_key": 50,
    "ip_address": 5,
    "url_with_cred": 45,
}

# Score weight per entity label (optional entity hook).
ENTITY_WEIGHTS: dict[str, int] = {
    "PERSON": 15,
    "ORG": 10,
    "GPE": 5,
    "LOC": 5,
    "MONEY": 20,
}

KEYWORD_WEIGHT = 20
KEYWORD_CAP = 40

# 32 sensitive keywords, lower-case substring match. Kept sorted so the
# label is deterministic.
SENSITIVE_KEYWORDS: tuple[str, ...] = tuple(sorted((
    "password", "passwd", "secret", "api_key", "apikey",
    "token", "bearer", "private_key", "access_key", "secret_key",
    "credit card", "card number", "cvv", "bank account",
    "routing number", "ssn", "social security",
    "diagnosis", "prescription", "patient id", "medical record",
    "confidential", "proprietary", "attorney-client", "nda",
    "trade secret", "merger", "acquisition", "insider",
    "project phoenix", "operation", "internal only",
)))

# Redaction token per detector / entity label.
REDACTION_TOKENS: dict[str, str] = {
    "email": "[EMAIL_REDACTED]",
    "phone_us": "[PHONE_REDACTED]",
    "credit_card": "[CARD_REDACTED]",
    "ssn": "[SSN_REDACTED]",
    "api_key": "[API_KEY_REDACTED]",
    "ip_address": "[IP_REDACTED]",
    "url_with_cred": "[URL_CRED_REDACTED]",
    "PERSON": "[NAME_REDACTED]",
    "ORG": "[ORG_REDACTED]",
    "GPE": "[LOCATION_REDACTED]",
    "LOC": "[LOCATION_REDACTED]",
}

# Risk level thresholds, highest first (score >= threshold).
RISK_LEVELS: tuple[tuple[str, float], ...] = (
    ("Critical", 75.0),
    ("High", 50.0),
    ("Medium", 25.0),
)
RISK_FLAG_THRESHOLD = 25.0

# USD per 1,000 tokens by model; unknown models take DEFAULT_MODEL_RATE.
MODEL_RATES: dict[str, float] = {
    "gpt-4.1-mini": 0.004,
    "gpt-4.1": 0.020,
    "claude-sonnet-4": 0.015,
    "claude-haiku-3.5": 0.003,
    "gemini-2.5-pro": 0.008,
    "github-copilot": 0.010,
    "llama-3.3-70b": 0.002,
    "unknown": 0.003,
}
DEFAULT_MODEL_RATE = 0.003

# Monthly licence cost by tier.
LICENCE_COSTS: dict[str, float] = {"Enterprise": 30.0, "Pro": 20.0, "Free": 0.0}

# Tier minima (tokens, prompts, tickets); a user qualifies on ANY of them.
TIER_MINIMA: tuple[tuple[str, int, int, int], ...] = (
    ("Enterprise", 50_000, 50, 5),
    ("Pro", 10_000, 10, 1),
    ("Free", 0, 0, 0),
)

# Classifier percentiles.
CHAMPION_IMPROVEMENT_P = 0.70
AT_RISK_COST_P = 0.60
AT_RISK_OUTPUT_P = 0.30
UNDERUTIL_COST_P = 0.40
UNDERUTIL_OUTPUT_P = 0.40

CATEGORY_ORDER: tuple[str, ...] = ("Champion", "Healthy", "Underutilized", "At-Risk", "Zombie")

PRIORITY_ORDER: tuple[str, ...] = ("Low", "Medium", "High", "Critical")
WEEKDAY_ORDER: tuple[str, ...] = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Correlation wording.
SIGNIFICANCE_P = 0.05
STRONG_R = 0.7
MODERATE_R = 0.4

# Pull-request landing window and per-repo cap.

# Characters per call handed to the optional entity detector (whole texts are chunked).
ENTITY_TEXT_LIMIT = 5000


# Cutoff used with the driver-derived canonical tables (order dates span 1995-2001).
CANONICAL_CUTOFF = _dt.datetime(1998, 1, 1)
