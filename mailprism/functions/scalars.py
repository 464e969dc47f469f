"""Column functions for numbers, dates, addresses and short strings.

Everything here is a plain Catalyst expression: no Python runs per row.
Rounding is half-even (``bround``), which equals Python's ``round`` on ratios of
counts; the few statistics that came from SQL ``ROUND`` use ``F.round``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Weekday names (Monday first), send-time buckets, second-level domain labels.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TIME_BUCKETS = [
    (5, 9, "Early Morning (5-9am)"),
    (9, 12, "Morning (9am-12pm)"),
    (12, 14, "Lunch (12-2pm)"),
    (14, 17, "Afternoon (2-5pm)"),
    (17, 20, "Evening (5-8pm)"),
    (20, 23, "Night (8-11pm)"),
]
NIGHT_BUCKET = "Late Night (11pm-5am)"
SECOND_LEVEL = ["co", "com", "org", "net", "ac"]
ICON_URL = "https://www.google.com/s2/favicons?domain={domain}&sz=128"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- ratios -----------------------------------------------------------------


def ratio(num, den) -> Column:
    """num/den as double, null when den is 0 (never raises in ANSI mode)."""
    return F.try_divide(_c(num).cast("double"), _c(den))


def pct(num, den, digits: int = 1) -> Column:
    """Percentage, 0.0 on a zero denominator."""
    return F.coalesce(F.bround(ratio(num, den) * 100, digits), F.lit(0.0))


def pct_change(cur, prev, digits: int = 1) -> Column:
    """Relative change in percent; 100 (or 0) when there is no previous value."""
    cur, prev = _c(cur).cast("double"), _c(prev).cast("double")
    return F.when(prev == 0, F.when(cur > 0, 100.0).otherwise(0.0)).otherwise(
        F.bround(F.try_divide(cur - prev, prev) * 100, digits)
    )


def mean_len(total_chars, n, digits: int = 1) -> Column:
    """Average length, 0.0 for an empty group."""
    return F.coalesce(F.bround(ratio(total_chars, n), digits), F.lit(0.0))


# --- time -------------------------------------------------------------------


def floor_days(start, end) -> Column:
    """Whole elapsed days, rounded toward minus infinity (not midnights crossed)."""
    micros = F.unix_micros(_c(end)) - F.unix_micros(_c(start))
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("long")


def week_start(ts) -> Column:
    return F.date_trunc("week", _c(ts))


def week_end(ts) -> Column:
    return week_start(ts) + F.expr("INTERVAL 7 DAYS")


def week_label(ts) -> Column:
    """ISO week label such as 2026-W53 (ISO year, two-digit week)."""
    ts = _c(ts)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), ts).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
    )


def weeks_back(ts, ref) -> Column:
    """0 for the week of ``ref``, 1 for the week before it, and so on."""
    return F.floor(F.datediff(week_start(ref), week_start(ts)) / 7).cast("long")


def day_name(ts) -> Column:
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return F.get(names, F.weekday(_c(ts)))


def time_bucket(ts) -> Column:
    hour = F.hour(_c(ts))
    out = None
    for lo, hi, label in TIME_BUCKETS:
        cond = (hour >= lo) & (hour < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.when(hour.isNotNull(), out.otherwise(NIGHT_BUCKET))


def window_label(days) -> Column:
    """Words for a window that reaches ``days`` whole days back."""
    days = _c(days)
    return (
        F.when(days <= 1, "today")
        .when(days <= 7, "this week")
        .when(days <= 30, "this month")
        .when(days <= 90, "in the last 3 months")
        .otherwise("across our archive")
    )


# --- send frequency ---------------------------------------------------------


def send_frequency_label(n, first, last) -> Column:
    """``Nx/day``, ``Nx/week`` or ``Nx/month`` from a count and its date range."""
    n, first, last = _c(n), _c(first), _c(last)
    days = floor_days(first, last)
    weekly = F.bround(ratio(n, days) * 7, 1)

    def times(value, unit):
        return F.concat(F.bround(value, 0).cast("long").cast("string"), F.lit("x/" + unit))

    label = (
        F.when(weekly >= 7, times(weekly / 7, "day"))
        .when(weekly >= 1, times(weekly, "week"))
        .otherwise(times(weekly * 4, "month"))
    )
    return F.when(days > 0, label).otherwise("1x")


def per_week(n, first=None, last=None, mode: str = "span", days=None) -> Column:
    """Mails per week.

    span    observed whole days; the plain count when they are 0
    span1   observed whole days, at least 1
    window  a given number of days, at least 1
    strict  observed whole days; 0 when they are 0
    """
    n = _c(n)
    if mode == "window":
        return F.bround(ratio(n, F.greatest(_c(days), F.lit(1))) * 7, 1)
    span = floor_days(first, last)
    if mode == "span1":
        return F.coalesce(F.bround(ratio(n, F.when(span == 0, 1).otherwise(span)) * 7, 1), F.lit(0.0))
    rate = F.bround(ratio(n, span) * 7, 1)
    fallback = F.lit(0.0) if mode == "strict" else n.cast("double")
    return F.when(span > 0, rate).otherwise(fallback)


# --- addresses --------------------------------------------------------------


def registrable_domain(sender) -> Column:
    """Last two labels of the sender's domain, three below co./com./org./net./ac."""
    sender = _c(sender)
    angle = F.regexp_extract(sender, r"<([^>]+)>", 1)
    address = F.when(angle != "", angle).otherwise(sender)
    domain = F.regexp_extract(address, r"(?U)@([^@\s]+)", 1)
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    keep = F.when(F.get(labels, n - 2).isin(SECOND_LEVEL), 3).otherwise(2)
    short = F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep), ".")
    return F.when(domain != "", F.when(n > 2, short).otherwise(domain))


def icon_url(domain) -> Column:
    before, after = ICON_URL.split("{domain}")
    return F.concat(F.lit(before), _c(domain), F.lit(after))


# --- short strings ----------------------------------------------------------


def safe_filename(text) -> Column:
    """Lower-case file key: anything else becomes one '-', 60 chars, no edge '-'."""
    slug = F.left(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), F.lit(60))
    return F.regexp_replace(slug, "^-+|-+$", "")


def title_case(text) -> Column:
    """Capitalise every run of letters, also after an apostrophe, digit or hyphen."""
    runs = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), "")


def snippet(text, n: int = 60) -> Column:
    return F.left(_c(text), F.lit(n))


def ellipsize(text, limit: int = 255) -> Column:
    """Cut to ``limit`` characters, the last one an ellipsis, when longer."""
    text = _c(text)
    cut = F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def split_parts(text, mark: str = "---") -> Column:
    """Trimmed non-empty parts between ``mark`` lines, in order."""
    parts = F.transform(F.split(_c(text), mark), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def base64url_text(data) -> Column:
    """Decode url-safe base64 (padding optional) to text, dropping bytes that are not UTF-8."""
    # Spark's decoder passes over what is not base64 and asks for no padding; a look at every character by a pattern costs far more.
    raw = F.unbase64(F.translate(_c(data), "-_=", "+/"))
    # make_valid_utf8 turns each bad byte run into U+FFFD, which is then removed.
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))
