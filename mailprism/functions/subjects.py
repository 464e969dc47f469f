"""Subject-line predicates, labels and keyword extraction as Column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Word lists, patterns and code-point ranges. They decide the
# results, so they are stated literally.
# ---------------------------------------------------------------------------

DISCOUNT_PARTS = ["off", "%", "sale", "discount", "save"]

EMOJI_RANGES = {
    "insights": [
        ("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"), ("1F1E0", "1F1FF"),
        ("2702", "27B0"), ("24C2", "1F251"), ("2600", "26FF"), ("2B05", "2B55"),
        ("FE00", "FE0F"), ("1F900", "1F9FF"), ("1FA00", "1FA6F"), ("1FA70", "1FAFF"),
        ("2194", "2199"), ("21A9", "21AA"), ("231A", "231B"), ("2328", "2328"),
        ("23CF", "23CF"), ("23E9", "23F3"), ("23F8", "23FA"),
    ],
    "analytics": [
        ("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"), ("1F1E0", "1F1FF"),
        ("2702", "27B0"), ("24C2", "1F251"),
    ],
    "scoring": [
        ("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"), ("1F1E0", "1F1FF"),
        ("2600", "26FF"), ("2700", "27BF"), ("1F900", "1F9FF"), ("1FA00", "1FAFF"),
    ],
    "plane": [("1F601", "10FFFF")],
}

# Subject formulas, first match wins.
FORMULAS = [
    ("discount_led", r"^\d+%\s*off|\bflat\s+\d+%|\bbuy\s+\d+\s+get|\bsave\s+\d+|\bfree\s+(?:shipping|delivery)|\bunder\s+[₹$]|\bunder\s+rs"),
    ("urgency", r"last chance|ends?\s+(?:tonight|today|soon|now)|hurry|final\s+(?:hours?|day)|limited\s+time|don't\s+miss|closing|expir"),
    ("number_list", r"\b\d+\b.*(?:ways|tips|looks|reasons|things|styles|ideas|steps|picks|must|best|top)"),
    ("personalization", r"^your\b|^you\b|for you|picked for|just for|waiting for you|your\s+(?:picks|style|cart|order|favorites|wishlist)"),
    ("curiosity_teaser", r"something\s+(?:big|new|special)|guess what|you won't believe|sneak peek|coming soon|just dropped|wait till you see|big reveal|surprise"),
    ("social_proof", r"everyone|bestsell|most\s+(?:loved|wanted|popular)|trending|selling fast|going fast|fan favou?rite|crowd favou?rite"),
    ("question", r"\?"),
    ("command", r"^(?:shop|get|grab|check out|discover|try|meet|explore|stock up|treat yourself|upgrade|don't|do not)\b"),
]
PERSONAL_PATTERN = r"^your\b|^you\b|for you|picked for|just for|waiting for you"

# Tactic labels: substrings of the lower-case subject, first group wins; None tests for '?'.
TACTICS = [
    ("urgency/scarcity", ["last chance", "ending", "hurry", "urgent", "final", "limited"]),
    ("personalization", ["just for you", "your ", "personalized", "picked for", "recommended"]),
    ("social proof", ["best seller", "trending", "popular", "everyone", "top rated"]),
    ("discount/promotion", ["% off", "sale", "discount", "save ", "deal"]),
    ("novelty/exclusivity", ["new", "introducing", "just dropped", "just launched", "first look"]),
    ("scarcity (restock)", ["back in stock", "restocked", "available again"]),
    ("curiosity/question", None),
    ("incentive/freebie", ["free", "gift", "bonus", "complimentary"]),
]
NO_TACTIC = "brand storytelling"

# Urgency substrings, one list per report; they differ on purpose.
URGENCY_WORDS = {
    "rates": ["limited", "hurry", "last chance", "ending", "urgent", "now", "today only", "final"],
    "archive": ["last chance", "ends today", "ends soon", "hurry"],
    "data_points": ["last chance", "hurry", "ending", "limited", "final"],
    "trend": ["last chance", "hurry", "ending", "final"],
    "spotlight": ["last chance", "ending", "hurry", "final hours"],
    "flags": ["limited", "hurry", "last chance", "ending", "expires", "final", "only", "rush",
              "midnight", "tonight", "today only"],
}
FLAG_TOKENS = ["{first_name}", "{name}", "{{name}}", "hi ,", "hey ,"]
CASUAL_PARTS = ["bestie", "babe", "hey "]
TIP_PERSONAL_PARTS = ["your ", "you ", "just for", "picked for"]

TOP_WORD_STOPS = ["the", "a", "an", "is", "are", "and", "or", "to", "for", "of", "in", "on", "at",
                  "your", "you", "we", "our", "this", "that", "it", "with"]
OVERLAP_STOPS = ["the", "and", "for", "you", "your", "are", "our", "this", "that", "with", "from",
                 "has", "have", "not", "all", "new"]
KEYWORD_STOPS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during",
    "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "not", "only", "own", "same",
    "so", "than", "too", "very", "just", "don", "now", "and", "but", "or", "if", "this", "that", "these", "those", "i", "me", "my", "you", "your",
    "he", "she", "it", "we", "they", "what", "which", "who", "whom", "its", "his", "her", "our", "their", "about", "up", "get", "got",
    "like", "make", "think", "know", "see", "want", "use", "new", "one", "two", "way", "thing", "people", "really", "much", "even", "still",
]

WORD_PATTERN = r"\b[a-zA-Z]{3,}\b"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contains_any(text, parts) -> Column:
    """True when a literal substring of ``parts`` occurs (substring, not word)."""
    text = _c(text)
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def contains_any_ci(text, parts) -> Column:
    return contains_any(F.lower(_c(text)), parts)


# --- predicates -------------------------------------------------------------


def emoji_class(profile: str = "insights") -> str:
    """Regex character class of an emoji profile (same text for Java and RE2)."""
    def span(lo, hi):
        return rf"\x{{{lo}}}" if lo == hi else rf"\x{{{lo}}}-\x{{{hi}}}"

    return "[" + "".join(span(lo, hi) for lo, hi in EMOJI_RANGES[profile]) + "]"


def has_emoji(text, profile: str = "insights") -> Column:
    text = _c(text)
    ascii_only = F.octet_length(text) == F.length(text)  # no emoji is among those
    return F.when(ascii_only, False).otherwise(F.rlike(text, F.lit(emoji_class(profile))))


def extract_emojis(text, profile: str = "analytics") -> Column:
    return F.regexp_extract_all(_c(text), F.lit(emoji_class(profile) + "+"), F.lit(0))


def is_discount(text) -> Column:
    return contains_any_ci(text, DISCOUNT_PARTS)


def is_personal(text) -> Column:
    return F.rlike(_c(text), F.lit("(?iu)" + PERSONAL_PATTERN))


def has_digit(text) -> Column:
    return F.rlike(_c(text), F.lit(r"\p{Nd}"))


def is_urgent(text, kind: str) -> Column:
    return contains_any_ci(text, URGENCY_WORDS[kind])


def mentions_off(text) -> Column:
    """' off' or 'off ' (archive statistics)."""
    return contains_any_ci(text, [" off", "off "])


def mentions_discount(text) -> Column:
    """' off', 'sale' or 'discount' (outlier and trend statistics)."""
    return contains_any_ci(text, [" off", "sale", "discount"])


def is_all_caps(text) -> Column:
    text = _c(text)
    return (text == F.upper(text)) & (F.length(text) > 3)


def words_of(text) -> Column:
    """White-space separated words."""
    trimmed = F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")
    return F.filter(F.split(trimmed, r"(?U)\s+"), lambda w: w != "")


def shouted_words(text) -> Column:
    """Number of words longer than two characters written in capitals."""
    loud = F.filter(
        words_of(text),
        lambda w: (F.length(w) > 2) & (w == F.upper(w)) & (w != F.lower(w)),
    )
    return F.size(loud)


def subject_flags(subject) -> list[Column]:
    """Columns char_count, word_count and five flags of one subject."""
    s = F.coalesce(_c(subject), F.lit(""))
    return [
        F.length(s).cast("long").alias("char_count"),
        F.size(words_of(s)).cast("long").alias("word_count"),
        has_emoji(s, "analytics").alias("has_emoji"),
        F.contains(s, F.lit("?")).alias("has_question"),
        has_digit(s).alias("has_number"),
        contains_any_ci(s, FLAG_TOKENS).alias("has_personalization"),
        is_urgent(s, "flags").alias("has_urgency"),
    ]


# --- labels -----------------------------------------------------------------


def _first_label(pairs, default) -> Column:
    out = None
    for cond, label in pairs:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def subject_formula(subject) -> Column:
    s = _c(subject)
    pairs = [(F.rlike(s, F.lit("(?iu)" + rx)), label) for label, rx in FORMULAS]
    return F.when(s.isNotNull(), _first_label(pairs, "other"))


def tactic(subject) -> Column:
    s = _c(subject)
    low = F.lower(s)
    pairs = [
        (F.contains(s, F.lit("?")) if parts is None else contains_any(low, parts), label)
        for label, parts in TACTICS
    ]
    return F.when(s.isNotNull(), _first_label(pairs, NO_TACTIC))


# --- words ------------------------------------------------------------------


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _without(words: Column, stops) -> Column:
    stop = _literals(stops)
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def subject_words(subject, stops=TOP_WORD_STOPS) -> Column:
    """Lower-case words of three letters or more, stop words removed, repeats kept."""
    found = F.regexp_extract_all(F.lower(_c(subject)), F.lit("(?U)" + WORD_PATTERN), F.lit(0))
    return _without(found, stops)


def keywords(text, n: int = 8) -> Column:
    """First ``n`` distinct content words of a text, in order."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-zA-Z]{3,}"), F.lit(0))
    return F.slice(F.array_except(found, _literals(KEYWORD_STOPS)), 1, n)  # hash-based, keeps first order


def overlap_words(subject) -> Column:
    """Distinct words of a subject without the overlap stop words."""
    found = F.regexp_extract_all(F.lower(_c(subject)), F.lit("(?U)" + WORD_PATTERN), F.lit(0))
    return F.array_except(found, _literals(OVERLAP_STOPS))
