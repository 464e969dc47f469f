"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from mailprism import dims
from mailprism.functions import subjects as sub
from mailprism.functions.scalars import DAY_NAMES, TIME_BUCKETS, NIGHT_BUCKET
from mailprism.plans.fixtures import AS_OF

T = f"TIMESTAMP '{AS_OF}'"
KNOWN = "(brand IS NOT NULL AND brand <> 'Unknown')"


def q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def emoji(col: str, profile: str) -> str:
    return f"regexp_matches({col}, {q(sub.emoji_class(profile))})"


def has_any(col: str, parts, ci: bool = True) -> str:
    base = f"lower({col})" if ci else col
    return "(" + " OR ".join(f"contains({base}, {q(p)})" for p in parts) + ")"


def discount(col: str) -> str:
    return has_any(col, sub.DISCOUNT_PARTS)


def pct(num: str, den: str, digits: int = 1) -> str:
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE round_even(CAST({num} AS DOUBLE) / {den} * 100, {digits}) END)"


def pct_change(cur: str, prev: str) -> str:
    return (f"(CASE WHEN {prev} = 0 THEN CASE WHEN {cur} > 0 THEN 100.0 ELSE 0.0 END "
            f"ELSE round_even((CAST({cur} AS DOUBLE) - {prev}) / {prev} * 100, 1) END)")


def mean(total: str, n: str, digits: int = 1) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE round_even(CAST({total} AS DOUBLE) / {n}, {digits}) END)"


def days(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


def count_if(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def day_name(col: str) -> str:
    arr = ", ".join(q(d) for d in DAY_NAMES)
    return f"([{arr}])[isodow({col})]"


def bucket(col: str) -> str:
    parts = " ".join(f"WHEN hour({col}) >= {lo} AND hour({col}) < {hi} THEN {q(n)}" for lo, hi, n in TIME_BUCKETS)
    return f"(CASE {parts} ELSE {q(NIGHT_BUCKET)} END)"


def formula(col: str) -> str:
    parts = " ".join(f"WHEN regexp_matches({col}, {q('(?i)' + rx)}) THEN {q(n)}" for n, rx in sub.FORMULAS)
    return f"(CASE {parts} ELSE 'other' END)"


def tactic(col: str) -> str:
    def cond(parts):
        return f"contains({col}, '?')" if parts is None else has_any(col, parts)

    parts = " ".join(f"WHEN {cond(p)} THEN {q(n)}" for n, p in sub.TACTICS)
    return f"(CASE {parts} ELSE {q(sub.NO_TACTIC)} END)"


def words(col: str, stops) -> str:
    stop = "[" + ", ".join(q(s) for s in stops) + "]"
    return f"list_filter(regexp_extract_all(lower({col}), {q(sub.WORD_PATTERN)}), lambda w: NOT list_contains({stop}, w))"


def domain(col: str) -> str:
    addr = f"(CASE WHEN regexp_extract({col}, '<([^>]+)>', 1) <> '' THEN regexp_extract({col}, '<([^>]+)>', 1) ELSE {col} END)"
    dom = f"regexp_extract({addr}, '@([^@\\s]+)', 1)"
    lab = f"string_split({dom}, '.')"
    return (f"(CASE WHEN {dom} = '' THEN NULL WHEN len({lab}) <= 2 THEN {dom} "
            f"WHEN {lab}[-2] IN ('co','com','org','net','ac') THEN array_to_string({lab}[-3:], '.') "
            f"ELSE array_to_string({lab}[-2:], '.') END)")


def icon(expr: str) -> str:
    return f"('https://www.google.com/s2/favicons?domain=' || {expr} || '&sz=128')"


def title(col: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({col}), '(\\p{{L}}+|\\P{{L}}+)'), "
            "lambda r: upper(r[1]) || r[2:]), '')")


def keyword_cte(source: str, key: str, col: str, n: int = 8) -> str:
    """CTEs kw_all and kw(key, word, pos): the first n distinct content words per key."""
    stop = "[" + ", ".join(q(x) for x in sub.KEYWORD_STOPS) + "]"
    return (f"kw_raw AS (SELECT {key}, regexp_extract_all(lower({col}), '[a-zA-Z]{{3,}}') AS l FROM {source}), "
            f"kw_all AS (SELECT {key}, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS idx FROM kw_raw), "
            f"kw_first AS (SELECT {key}, word, min(idx) AS idx FROM kw_all WHERE NOT list_contains({stop}, word) GROUP BY {key}, word), "
            f"kw AS (SELECT {key}, word, row_number() OVER (PARTITION BY {key} ORDER BY idx) AS pos FROM kw_first QUALIFY pos <= {n})")


def window_start(preferred: int) -> str:
    """Scalar subquery: start of the active window."""
    tries = [preferred, 7, 30, 90, 365, 3650]
    cases = " ".join(f"WHEN count(*) FILTER (WHERE received_at >= {T} - INTERVAL {d} DAY) >= 10 THEN {T} - INTERVAL {d} DAY" for d in tries)
    return f"(SELECT CASE {cases} ELSE TIMESTAMP '2000-01-01 00:00:00' END FROM emails)"


def window_days(preferred: int) -> str:
    return f"greatest(1, {days(window_start(preferred), T)})"


def values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else q(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def festival_cte(festivals) -> str:
    rows = [(s, n, y, lo, hi) for s, n, _, ys in festivals for y, (lo, hi) in ys.items()]
    kws = [(s, k) for s, _, ks, _ in festivals for k in ks]
    return (f"fest(slug, name, year, lo, hi) AS (VALUES {values(rows)}), fest_kw(slug, kw) AS (VALUES {values(kws)}), "
            "fest_rows AS (SELECT e.*, f.slug, f.name, f.year, "
            "(coalesce(lower(e.type) IN ('festive','sale'), false) OR EXISTS (SELECT 1 FROM fest_kw k WHERE k.slug = f.slug "
            "AND contains(lower(coalesce(e.subject, '')), k.kw))) AS relevant "
            "FROM emails e JOIN fest f ON e.received_at >= CAST(f.lo AS TIMESTAMP) AND e.received_at <= CAST(f.hi AS TIMESTAMP))")


def top_n(source: str, by: str, order: str, n: int, rank: str = "rank") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(SELECT *, CAST(row_number() OVER ({part}ORDER BY {order}) AS INTEGER) AS {rank} FROM {source} QUALIFY {rank} <= {n})"


PLAN = (f"(CASE WHEN subscription_tier IN ('starter','pro','agency') AND (subscription_expires_at IS NULL OR subscription_expires_at > {T}) "
        f"THEN subscription_tier WHEN trial_ends_at > {T} THEN 'starter' ELSE 'free' END)")


def plan_limits_cte() -> str:
    rows = []
    for feature, vals in dims.PLAN_LIMITS.items():
        for rank, (plan, v) in enumerate(zip(dims.PLANS, vals)):
            kind = "unlimited" if v is None else "flag" if isinstance(v, bool) else "number" if isinstance(v, int) else "text"
            num = None if v is None or isinstance(v, str) else int(v)
            rows.append((plan, rank, feature, kind, num))
    return f"plan_limits(plan, rank, feature, kind, num_value) AS (VALUES {values(rows)})"
