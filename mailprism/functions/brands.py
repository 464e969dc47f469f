"""Brand-name cleaning and normalisation as regex chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailprism.functions.scalars import title_case

# ---------------------------------------------------------------------------
# Removal patterns, applied in this order.
# ---------------------------------------------------------------------------
NOISE_PATTERNS = [
    r"\b(newsletter|mailer|noreply|no-reply|donotreply|mail|email|emails)\b",
    r"\b(support|help|info|contact|team|official|india|global)\b",
    r"\b(notifications?|updates?|alerts?|digest)\b",
    r"\b(pvt\.?\s*ltd\.?|private\s*limited|limited|llp|inc\.?|corp\.?)\b",
    r"\b(customer\s*service|customer\s*care)\b",
    r"^(hi|hello|dear|from|the)\s+",
    r"\s+(team|crew|family|club)$",
]
SUFFIX_PATTERNS = [
    r"\s*[-–—_,]\s*a\s+tata\s+product",
    r"\s*[-–—_,]\s*a\s+tanishq\s+partnership",
    r"\s*[-–—_,]\s*a\s+godrej\s+\w+\s+brand",
    r"\s*,?\s*a\s+\w+\s+(brand|product|partnership)",
    r"\s+(sale|promotion|promotions|rewards|new arrivals|black friday|cyber monday)$",
    r"\s+at\s+\w+$",
    r"\s+by\s+\w+$",
    r"\+\s*clinic$",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_brand(name) -> Column:
    """Readable brand from a display name; null when fewer than two characters remain."""
    out = _strip(_c(name))
    for rx in NOISE_PATTERNS:
        out = F.regexp_replace(out, "(?iu)" + rx, "")
    out = _strip(F.regexp_replace(out, r"(?U)\s+", " "))
    out = F.regexp_replace(out, r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "")
    return F.when(F.length(out) >= 2, title_case(out))


def normalize_brand(name) -> Column:
    """Lower-case lookup form with partnership and promotion suffixes removed."""
    out = _strip(F.lower(F.coalesce(_c(name), F.lit(""))))
    for rx in SUFFIX_PATTERNS:
        out = _strip(F.regexp_replace(out, "(?iu)" + rx, ""))
    return out


def letters_and_digits(text) -> Column:
    """Only a-z, 0-9 and white space (the form compared by the fuzzy match)."""
    return F.regexp_replace(_c(text), r"(?U)[^a-z0-9\s]", "")
