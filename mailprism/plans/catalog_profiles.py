"""Profiles of brands, industries, types and festivals, and the joins behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailprism import dims
from mailprism.operators import profiles as pr
from mailprism.operators import ranking as rk
from mailprism.plans import sqltext as s
from mailprism.functions import subjects as sub
from mailprism.plans.catalog import TEST_FESTIVALS, query

T = s.T
FEST = s.festival_cte(TEST_FESTIVALS)
SLUGS = f"slugs(pos, slug, type) AS (VALUES {s.values([(n, a, b) for n, (a, b) in enumerate(dims.TYPE_SLUGS)])})"


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def texts(df, *cols):
    """Profile sections as text."""
    return df.withColumns({c: pr.listing(c) for c in cols})


def ids(col):
    return F.array_join(F.transform(col, lambda e: e["id"].cast("string")), "|")


def names(col, field):
    return F.array_join(F.transform(col, lambda e: e[field]), "|")


def shares(col):
    return F.array_join(F.transform(col, lambda e: F.concat(e["item"], F.lit(":"), e["pct"].cast("string"))), "|")


# SQL for one section: "item:cnt|item:cnt" per key, most common first
def section(keys: str, item: str, source: str, where: str = "true", top: int | None = None, pct_of: str | None = None) -> str:
    cut = f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, item) <= {top}" if top else ""
    shown = f"CAST(round_even(CAST(n AS DOUBLE) / {pct_of} * 100, 1) AS VARCHAR)" if pct_of else "n"
    return (f"(SELECT {keys}, string_agg(item || ':' || {shown}, '|' ORDER BY n DESC, item) AS v, count(*) AS k, arg_min(item, (-n, item)) AS best FROM "
            f"(SELECT * FROM (SELECT {keys}, {item} AS item{', max(tot) AS tot' if pct_of else ''}, count(*) AS n FROM {source} WHERE {where} GROUP BY {keys}, {item}) z "
            f"WHERE item IS NOT NULL AND item <> '' {cut}) y GROUP BY {keys})")


EMOJI = s.count_if(f"subject <> '' AND {s.emoji('subject', 'analytics')}")
SUBJ = s.count_if("subject <> ''")
AVG = s.mean("coalesce(sum(length(subject)), 0)", SUBJ)
EMO = s.pct(EMOJI, SUBJ)
RATE = f"(CASE WHEN {s.days('lo', 'hi')} > 0 THEN round_even(CAST(total AS DOUBLE) / {s.days('lo', 'hi')} * 7, 1) ELSE CAST(total AS DOUBLE) END)"


def base(keys: str, source: str) -> str:
    return (f"(SELECT {keys}, count(*) AS total, min(received_at) AS lo, max(received_at) AS hi, {AVG} AS avg_subject_length, {EMO} AS emoji_rate, "
            f"count(DISTINCT CASE WHEN {s.KNOWN} THEN brand END) AS n_brand, min(sender) AS sender FROM {source} GROUP BY {keys})")


# --- counts -----------------------------------------------------------------


@query("a01_total", "SELECT count(*) AS total FROM emails")
def _(i):
    return pr.total(i.emails)


@query("a02_category_counts", "SELECT category, count(*) AS cnt FROM emails WHERE category <> '' GROUP BY category")
def _(i):
    return pr.value_counts(i.emails, "category")


@query("a03_distinct_values", f"""
SELECT DISTINCT 'industry' AS kind, industry AS item FROM emails WHERE industry <> '' UNION ALL SELECT DISTINCT 'brand', brand FROM emails WHERE {s.KNOWN}
UNION ALL SELECT DISTINCT 'home_brand', brand FROM emails WHERE {s.KNOWN} AND industry = 'Home & Living'
UNION ALL SELECT 'no_industry', brand || ':' || count(*) FROM emails WHERE {s.KNOWN} AND industry IS NULL GROUP BY brand""")
def _(i):
    e = i.emails
    parts = [
        pr.distinct_values(e, "industry").select(F.lit("industry").alias("kind"), F.col("industry").alias("item")),
        pr.distinct_values(e, "brand", rk.known_brand()).select(F.lit("brand").alias("kind"), F.col("brand").alias("item")),
        pr.distinct_values(e, "brand", rk.known_brand() & (F.col("industry") == "Home & Living")).select(F.lit("home_brand").alias("kind"), F.col("brand").alias("item")),
        pr.brands_without_industry(e).select(F.lit("no_industry").alias("kind"), F.concat_ws(":", "brand", F.col("cnt").cast("string")).alias("item")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- brands -----------------------------------------------------------------

_W = f"round_even(CAST(n AS DOUBLE) / {s.days('lo', 'hi')} * 7, 1)"
_BRAND_STATS = f"""
WITH c AS (SELECT brand, count(*) AS n, min(received_at) AS lo, max(received_at) AS hi, min(sender) AS sender FROM emails WHERE {s.KNOWN} GROUP BY brand),
ind AS (SELECT brand, arg_min(industry, (-n, industry)) AS industry FROM (SELECT brand, industry, count(*) AS n FROM emails WHERE industry IS NOT NULL GROUP BY brand, industry) GROUP BY brand)
SELECT c.brand, n AS email_count, {s.ts('lo')} AS first_email, {s.ts('hi')} AS last_email,
 CASE WHEN {s.days('lo', 'hi')} > 0 THEN CASE WHEN {_W} >= 7 THEN CAST(CAST(round_even({_W} / 7, 0) AS BIGINT) AS VARCHAR) || 'x/day'
  WHEN {_W} >= 1 THEN CAST(CAST(round_even({_W}, 0) AS BIGINT) AS VARCHAR) || 'x/week' ELSE CAST(CAST(round_even({_W} * 4, 0) AS BIGINT) AS VARCHAR) || 'x/month' END ELSE '1x' END AS send_frequency,
 ind.industry, {s.domain('sender')} AS domain, {s.icon(s.domain('sender'))} AS icon_url
FROM c LEFT JOIN ind ON c.brand = ind.brand"""


@query("a04_brand_stats", _BRAND_STATS)
def _(i):
    return pr.brand_stats(i.emails).withColumns({"first_email": stamp("first_email"), "last_email": stamp("last_email")})


@query("j04_brand_stats_join", f"""
WITH c AS (SELECT brand, count(*) AS n, min(sender) AS sender FROM emails WHERE {s.KNOWN} GROUP BY brand),
ind AS (SELECT brand, arg_min(industry, (-n, industry)) AS industry FROM (SELECT brand, industry, count(*) AS n FROM emails WHERE industry IS NOT NULL GROUP BY brand, industry) GROUP BY brand)
SELECT c.brand, n AS cnt, ind.industry, {s.domain('sender')} AS domain FROM c LEFT JOIN ind ON c.brand = ind.brand""")
def _(i):
    from mailprism.functions.scalars import registrable_domain

    e = i.emails.where(rk.known_brand())
    out = rk.counts(e, "brand").join(rk.modal(e, "brand", "industry"), "brand", "left")
    senders = e.groupBy("brand").agg(F.min("sender").alias("sender"))
    return out.join(senders, "brand", "left").select("brand", "cnt", "industry", registrable_domain("sender").alias("domain"))


_EB = "x AS (SELECT *, lower(brand) AS k FROM emails WHERE brand IS NOT NULL)"
_WORDS = s.words("subject", sub.TOP_WORD_STOPS)


def word_section(keys, source, n=10):
    return (f"(SELECT {keys}, string_agg(item || ':' || n, '|' ORDER BY n DESC, item) AS v FROM (SELECT {keys}, item, count(*) AS n FROM "
            f"(SELECT {keys}, unnest({_WORDS}) AS item FROM {source}) u GROUP BY {keys}, item QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, item) <= {n}) y GROUP BY {keys})")


@query("a05_brand_profile", f"""
WITH {_EB}, b AS {base('k', 'x')}, ty AS {section('k', 'type', 'x')}, ind AS {section('k', 'industry', 'x')},
dy AS {section('k', s.day_name('received_at'), 'x')}, tm AS {section('k', s.bucket('received_at'), 'x')}, w AS {word_section('k', 'x')}
SELECT b.k AS brand_key, b.total, ind.best AS primary_industry, {RATE} AS emails_per_week, {s.ts('lo')} AS first_email, {s.ts('hi')} AS last_email,
 coalesce(ty.v, '') AS campaign_breakdown, dy.v AS send_days, tm.v AS send_times, coalesce(w.v, '') AS top_words, b.avg_subject_length, b.emoji_rate,
 {s.icon(s.domain('b.sender'))} AS icon_url
FROM b LEFT JOIN ty USING (k) LEFT JOIN ind USING (k) LEFT JOIN dy USING (k) LEFT JOIN tm USING (k) LEFT JOIN w USING (k)""")
def _(i):
    out = texts(pr.brand_profile(i.mails), "campaign_breakdown", "send_days", "send_times", "top_words")
    return out.withColumns({"first_email": stamp("first_email"), "last_email": stamp("last_email")})


_CMP = ["nykaa", "Gucci", "Wakefit", "No Such Brand"]


@query("a07_compare_brands", f"""
WITH asked(brand) AS (VALUES {s.values([(b,) for b in _CMP])}), {_EB}, b AS {base('k', 'x')}, ty AS {section('k', 'type', 'x')}, ind AS {section('k', 'industry', 'x')}
SELECT a.brand, coalesce(b.total, 0) AS total, ind.best AS industry, coalesce(round_even(CAST(b.total AS DOUBLE) / greatest({s.days('lo', 'hi')}, 1) * 7, 1), 0.0) AS emails_per_week,
 ty.best AS top_type, coalesce(b.avg_subject_length, 0.0) AS avg_subject_length, coalesce(b.emoji_rate, 0.0) AS emoji_rate, CASE WHEN b.total IS NULL THEN 'No emails found' END AS error
FROM asked a LEFT JOIN b ON lower(a.brand) = b.k LEFT JOIN ty USING (k) LEFT JOIN ind USING (k)""")
def _(i):
    out = pr.compare_brands(i.emails, _CMP)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("emails_per_week", "avg_subject_length", "emoji_rate")}
    return out.withColumns({"total": F.coalesce("total", F.lit(0)), **zero})


@query("a09_calendar", f"""
WITH x AS (SELECT *, lower(brand) AS k, strftime(received_at, '%Y-%m') AS month FROM emails WHERE brand IS NOT NULL AND received_at >= {T} - INTERVAL 90 DAY),
b AS (SELECT k, month, count(*) AS total FROM x GROUP BY k, month), ty AS {section('k, month', 'type', 'x')},
r AS (SELECT k, month, string_agg(strftime(received_at, '%Y-%m-%d') || ' ' || subject, '|' ORDER BY received_at DESC, id) AS v FROM {s.top_n('x', 'k, month', 'received_at DESC, id', 10)} GROUP BY k, month)
SELECT b.k AS brand_key, b.month, b.total, coalesce(ty.v, '') AS campaign_breakdown, r.v AS emails FROM b LEFT JOIN ty ON b.k = ty.k AND b.month = ty.month JOIN r ON b.k = r.k AND b.month = r.month""")
def _(i):
    out = texts(pr.calendar(i.mails, i.t), "campaign_breakdown")
    return out.withColumn("emails", F.array_join(F.transform("emails", lambda e: F.concat_ws(" ", e["date"], e["subject"])), "|"))


_PRIMARY = "prim AS (SELECT k, arg_min(industry, (-n, industry)) AS industry FROM (SELECT k, industry, count(*) AS n FROM x WHERE industry IS NOT NULL GROUP BY k, industry) GROUP BY k)"
_RELATED = f"""rel AS (SELECT k, string_agg(brand, '|' ORDER BY brand) AS v FROM (SELECT p.k, o.brand FROM prim p
 JOIN (SELECT DISTINCT lower(industry) AS li, brand FROM emails WHERE {s.KNOWN} AND industry IS NOT NULL) o ON lower(p.industry) = o.li AND lower(o.brand) <> p.k
 QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY o.brand) <= 12) GROUP BY k)"""


@query("j13_related_brands", f"WITH {_EB}, {_PRIMARY}, {_RELATED} SELECT prim.k AS brand_key, prim.industry AS primary_industry, rel.v AS related FROM prim JOIN rel USING (k)")
def _(i):
    return pr.related_brands(i.emails).withColumn("related", F.array_join("related", "|"))


@query("a10_brand_public_profile", f"""
WITH {_EB}, b AS {base('k', 'x')}, {_PRIMARY}, {_RELATED}, {FEST},
subj AS (SELECT k, string_agg(subject, '|' ORDER BY r DESC, subject) AS v FROM (SELECT k, subject, max(received_at) AS r FROM x GROUP BY k, subject QUALIFY row_number() OVER (PARTITION BY k ORDER BY r DESC, subject) <= 5) GROUP BY k),
rec AS (SELECT k, string_agg(CAST(id AS VARCHAR), '|' ORDER BY received_at DESC, id) AS v FROM {s.top_n('x', 'k', 'received_at DESC, id', 10)} GROUP BY k),
fc AS (SELECT k, string_agg(name || ':' || year || ':' || n, '|' ORDER BY name, year) AS v FROM (SELECT lower(brand) AS k, name, year, count(*) AS n FROM fest_rows WHERE relevant AND brand IS NOT NULL GROUP BY 1, 2, 3) GROUP BY k)
SELECT b.k AS brand_key, b.total, prim.industry AS primary_industry, {RATE} AS emails_per_week, b.avg_subject_length, b.emoji_rate,
 subj.v AS sample_subjects, rec.v AS recent_emails, coalesce(fc.v, '') AS festivals, coalesce(rel.v, '') AS related
FROM b LEFT JOIN prim USING (k) LEFT JOIN subj USING (k) LEFT JOIN rec USING (k) LEFT JOIN fc USING (k) LEFT JOIN rel USING (k)""")
def _(i):
    out = pr.brand_public_profile(i.mails, i.festivals)
    fest = F.transform("festivals", lambda e: F.concat_ws(":", e["name"], e["year"].cast("string"), e["cnt"].cast("string")))
    return out.select(
        "brand_key", "total", "primary_industry", "emails_per_week", "avg_subject_length", "emoji_rate",
        names("sample_subjects", "subject").alias("sample_subjects"), ids("recent_emails").alias("recent_emails"),
        F.coalesce(F.array_join(fest, "|"), F.lit("")).alias("festivals"), F.coalesce(F.array_join("related", "|"), F.lit("")).alias("related"))


def neighbours(keys, cond, where):
    return (f"SELECT a.id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY o.received_at DESC, o.id) AS INTEGER) AS pos, o.id AS other_id FROM emails a "
            f"JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY received_at DESC, id) AS r FROM emails WHERE {where} QUALIFY r <= 6) o ON {cond} AND a.id <> o.id "
            f"WHERE {where.replace('brand', 'a.brand').replace('type', 'a.type').replace('industry', 'a.industry')} QUALIFY pos <= 5")


@query("j14_similar_emails", neighbours("type, industry", "a.type = o.type AND a.industry = o.industry", "type <> '' AND industry <> ''"))
def _(i):
    return pr.similar_emails(i.emails)


@query("j15_more_from_brand", neighbours("lower(brand)", "lower(a.brand) = lower(o.brand)", "brand <> ''"))
def _(i):
    return pr.more_from_brand(i.emails)


@query("a43_email_public", f"""
WITH m AS ({neighbours("lower(brand)", "lower(a.brand) = lower(o.brand)", "brand <> ''")}),
sm AS ({neighbours("type, industry", "a.type = o.type AND a.industry = o.industry", "type <> '' AND industry <> ''")})
SELECT e.id, e.subject, e.brand, {s.ts('e.received_at')} AS received_at, CAST(length(e.subject) AS BIGINT) AS char_count,
 {s.has_any('e.subject', sub.URGENCY_WORDS['flags'])} AS has_urgency,
 coalesce((SELECT string_agg(CAST(other_id AS VARCHAR), '|' ORDER BY pos) FROM m WHERE m.id = e.id), '') AS more_from_brand,
 coalesce((SELECT string_agg(CAST(other_id AS VARCHAR), '|' ORDER BY pos) FROM sm WHERE sm.id = e.id), '') AS similar_emails FROM emails e""")
def _(i):
    out = pr.email_public(i.emails)

    def listed(c):
        return F.coalesce(F.array_join(F.transform(c, lambda e: e["other_id"].cast("string")), "|"), F.lit("")).alias(c)

    return out.select("id", "subject", "brand", stamp("received_at").alias("received_at"), "char_count", "has_urgency", listed("more_from_brand"), listed("similar_emails"))


# --- industries -------------------------------------------------------------

_EI = "x AS (SELECT *, lower(industry) AS k FROM emails WHERE industry IS NOT NULL), t AS (SELECT k, count(*) AS tot FROM x GROUP BY k), xt AS (SELECT x.*, t.tot FROM x JOIN t USING (k))"
_BR = f"CASE WHEN {s.KNOWN} THEN brand END"


@query("a06_industry_profile", f"""
WITH {_EI}, b AS {base('k', 'x')}, br AS {section('k', _BR, 'x', top=10)}, ty AS {section('k', 'type', 'xt', pct_of='tot')}, dy AS {section('k', s.day_name('received_at'), 'x')},
bm AS (SELECT k, count(*) FILTER (WHERE {s.KNOWN}) AS n FROM x GROUP BY k)
SELECT b.k AS industry_key, b.total, b.n_brand AS total_brands, coalesce(br.v, '') AS top_brands, coalesce(ty.v, '') AS type_mix, dy.v AS send_days,
 {s.mean('bm.n', 'b.n_brand')} AS avg_emails_per_brand, b.avg_subject_length
FROM b LEFT JOIN br USING (k) LEFT JOIN ty USING (k) LEFT JOIN dy USING (k) LEFT JOIN bm USING (k)""")
def _(i):
    return texts(pr.industry_profile(i.mails), "top_brands", "send_days").withColumn("type_mix", shares("type_mix"))


_STRICT = f"(CASE WHEN {s.days('lo', 'hi')} > 0 THEN round_even(CAST(n AS DOUBLE) / {s.days('lo', 'hi')} * 7, 1) ELSE 0.0 END)"


@query("a11_industry_public_profile", f"""
WITH {_EI}, b AS {base('k', 'x')}, ty AS {section('k', 'type', 'xt', pct_of='tot')}, dy AS {section('k', s.day_name('received_at'), 'x')}, tm AS {section('k', s.bucket('received_at'), 'x')},
br AS (SELECT k, string_agg(brand || ':' || CAST({_STRICT} AS VARCHAR), '|' ORDER BY n DESC, brand) AS v FROM
 (SELECT k, brand, count(*) AS n, min(received_at) AS lo, max(received_at) AS hi FROM x WHERE {s.KNOWN} GROUP BY k, brand QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, brand) <= 10) GROUP BY k),
rec AS (SELECT k, string_agg(CAST(id AS VARCHAR), '|' ORDER BY received_at DESC, id) AS v FROM {s.top_n('x', 'k', 'received_at DESC, id', 15)} GROUP BY k),
mo AS (SELECT k, string_agg(m || ':' || n, '|' ORDER BY m) AS v FROM (SELECT k, strftime(received_at, '%Y-%m') AS m, count(*) AS n FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC) <= 12) GROUP BY k)
SELECT b.k AS industry_key, b.n_brand AS total_brands, b.total, coalesce(br.v, '') AS top_brands, coalesce(ty.v, '') AS types, rec.v AS recent_emails,
 CASE WHEN {s.days('lo', 'hi')} > 0 AND b.n_brand > 0 THEN round_even(CAST(b.total AS DOUBLE) / b.n_brand / {s.days('lo', 'hi')} * 7, 1) ELSE 0.0 END AS avg_emails_per_brand_per_week,
 b.avg_subject_length, b.emoji_rate, dy.best AS peak_send_day, tm.best AS peak_send_time, mo.v AS seasonal
FROM b LEFT JOIN ty USING (k) LEFT JOIN dy USING (k) LEFT JOIN tm USING (k) LEFT JOIN br USING (k) LEFT JOIN rec USING (k) LEFT JOIN mo USING (k)""")
def _(i):
    out = pr.industry_public_profile(i.mails)
    rate = F.transform("top_brands", lambda e: F.concat_ws(":", e["item"], e["emails_per_week"].cast("string")))
    return out.withColumns({
        "top_brands": F.array_join(rate, "|"), "types": shares("types"), "recent_emails": ids("recent_emails"), "seasonal": pr.listing("seasonal")})


@query("a16_industry_block", f"""
WITH {_EI}, b AS {base('k', 'x')}, ty AS {section('k', 'type', 'x', top=5)}, br AS {section('k', 'brand', 'x', top=5)}
SELECT b.k AS industry_key, b.total, b.n_brand AS total_brands, coalesce(ty.v, '') AS top_types, br.v AS top_brands FROM b LEFT JOIN ty USING (k) LEFT JOIN br USING (k) WHERE b.n_brand > 0""")
def _(i):
    out = pr.industry_block(i.emails)
    return out.withColumns({"top_types": F.coalesce(pr.listing("top_types"), F.lit("")), "top_brands": pr.listing("top_brands")})


@query("a08_overview", f"""
SELECT 'total' AS section, 'emails' AS item, count(*) AS cnt FROM emails UNION ALL SELECT 'total', 'brands', count(DISTINCT brand) FROM emails WHERE {s.KNOWN}
UNION ALL SELECT 'industry', industry, count(*) FROM emails WHERE industry IS NOT NULL GROUP BY industry
UNION ALL SELECT 'type', type, count(*) FROM emails WHERE type IS NOT NULL GROUP BY type
UNION ALL SELECT 'top_brand', brand, cnt FROM (SELECT brand, count(*) AS cnt FROM emails WHERE {s.KNOWN} GROUP BY brand ORDER BY cnt DESC, brand LIMIT 10)""")
def _(i):
    return pr.overview(i.emails)


# --- types and festivals ----------------------------------------------------


@query("a12_type_list", f"WITH {SLUGS} SELECT e.type, s.slug, count(*) AS cnt FROM emails e JOIN slugs s ON e.type = s.type GROUP BY e.type, s.slug")
def _(i):
    return pr.type_list(i.emails, i.slugs)


@query("a13_type_profile", f"""
WITH {SLUGS}, x AS (SELECT e.*, s.slug AS k FROM emails e JOIN slugs s ON lower(e.type) = lower(s.type)), t AS (SELECT k, count(*) AS tot FROM x GROUP BY k), xt AS (SELECT x.*, t.tot FROM x JOIN t USING (k)),
b AS {base('k', 'x')}, br AS {section('k', _BR, 'x', top=10)}, ind AS {section('k', 'industry', 'xt', pct_of='tot')}, dy AS {section('k', s.day_name('received_at'), 'x')}, w AS {word_section('k', 'x')},
d1 AS {s.top_n('x', 'k, brand', 'received_at DESC, id', 2, 'r')}, ex AS (SELECT k, string_agg(CAST(id AS VARCHAR), '|' ORDER BY received_at DESC, id) AS v FROM {s.top_n('d1', 'k', 'received_at DESC, id', 15)} GROUP BY k),
subj AS (SELECT k, string_agg(subject, '|' ORDER BY r DESC, subject) AS v FROM (SELECT k, subject, max(received_at) AS r FROM x GROUP BY k, subject QUALIFY row_number() OVER (PARTITION BY k ORDER BY r DESC, subject) <= 10) GROUP BY k)
SELECT b.k AS slug, b.total, b.n_brand AS total_brands, coalesce(br.v, '') AS top_brands, coalesce(ind.v, '') AS industries, ex.v AS examples, b.avg_subject_length, b.emoji_rate,
 coalesce(w.v, '') AS top_words, subj.v AS sample_subjects, dy.best AS peak_send_day,
 (SELECT string_agg(slug, '|' ORDER BY pos) FROM (SELECT slug, pos FROM slugs WHERE slug <> b.k ORDER BY pos LIMIT 5)) AS related_types
FROM b LEFT JOIN br USING (k) LEFT JOIN ind USING (k) LEFT JOIN dy USING (k) LEFT JOIN w USING (k) LEFT JOIN ex USING (k) LEFT JOIN subj USING (k)""")
def _(i):
    out = texts(pr.type_profile(i.mails, i.slugs), "top_brands", "top_words")
    return out.withColumns({
        "industries": shares("industries"), "examples": ids("examples"), "sample_subjects": names("sample_subjects", "subject"),
        "related_types": F.array_join("related_types", "|")})


@query("p11_festival_relevance", f"WITH {FEST} SELECT slug, year, id, relevant FROM fest_rows")
def _(i):
    return pr.festival_rows(i.emails, i.festivals).select("slug", "year", "id", "relevant")


@query("j08_festival_range_join", f"WITH {FEST} SELECT slug, year, {s.ts('min(received_at)')} AS first_at, {s.ts('max(received_at)')} AS last_at, count(*) AS n FROM fest_rows GROUP BY slug, year")
def _(i):
    rows = pr.festival_rows(i.emails, i.festivals)
    return rows.groupBy("slug", "year").agg(stamp(F.min("received_at")).alias("first_at"), stamp(F.max("received_at")).alias("last_at"), F.count(F.lit(1)).alias("n"))


@query("a14_festival_list", f"WITH {FEST} SELECT slug, name, year, count(*) AS cnt FROM fest_rows GROUP BY slug, name, year HAVING count(*) >= 5")
def _(i):
    return pr.festival_list(i.emails, i.festivals)


@query("a15_festival_profile", f"""
WITH {FEST}, sel AS (SELECT *, slug || year AS k FROM (SELECT *, count(*) FILTER (WHERE relevant) OVER (PARTITION BY slug, year) AS rel FROM fest_rows) WHERE relevant OR rel < 5),
t AS (SELECT k, count(*) AS tot, any_value(slug) AS slug, any_value(year) AS year FROM sel GROUP BY k), xt AS (SELECT sel.*, t.tot FROM sel JOIN t USING (k)),
b AS {base('k', 'sel')}, br AS {section('k', _BR, 'sel', top=10)}, ind AS {section('k', 'industry', 'xt', pct_of='tot')}, ty AS {section('k', 'type', 'sel')}, dy AS {section('k', s.day_name('received_at'), 'sel')}, w AS {word_section('k', 'sel')},
d1 AS {s.top_n("(SELECT * FROM sel WHERE subject <> '')", 'k, brand', 'received_at DESC, id', 2, 'r')}, ex AS (SELECT k, string_agg(CAST(id AS VARCHAR), '|' ORDER BY received_at DESC, id) AS v FROM {s.top_n('d1', 'k', 'received_at DESC, id', 15)} GROUP BY k),
rec AS (SELECT k, string_agg(CAST(id AS VARCHAR), '|' ORDER BY received_at DESC, id) AS v FROM {s.top_n('sel', 'k', 'received_at DESC, id', 10)} GROUP BY k)
SELECT t.slug, t.year, b.total, b.n_brand AS total_brands, coalesce(ind.v, '') AS industries, coalesce(br.v, '') AS top_brands, coalesce(ty.v, '') AS campaign_types, ex.v AS best_subject_lines, rec.v AS best_emails,
 b.avg_subject_length, b.emoji_rate, dy.best AS peak_send_day, coalesce(w.v, '') AS top_words
FROM b JOIN t USING (k) LEFT JOIN br USING (k) LEFT JOIN ind USING (k) LEFT JOIN ty USING (k) LEFT JOIN dy USING (k) LEFT JOIN w USING (k) LEFT JOIN ex USING (k) LEFT JOIN rec USING (k)""")
def _(i):
    out = texts(pr.festival_profile(i.mails, i.festivals), "top_brands", "campaign_types", "top_words")
    return out.withColumns({"industries": shares("industries"), "best_subject_lines": ids("best_subject_lines"), "best_emails": ids("best_emails")})


# --- comparisons ------------------------------------------------------------


@query("j16_compare_pairs", f"""
WITH c AS (SELECT lower(industry) AS li, brand, count(*) AS n FROM emails WHERE {s.KNOWN} AND industry IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY li ORDER BY n DESC, brand) <= 5),
k AS (SELECT * FROM c WHERE n >= 20), i AS (SELECT DISTINCT industry, lower(industry) AS li FROM emails WHERE industry IS NOT NULL)
SELECT a.brand AS brand_a, b.brand AS brand_b, i.industry FROM k a JOIN k b ON a.li = b.li AND a.brand < b.brand JOIN i ON i.li = a.li""")
def _(i):
    return pr.compare_pairs(i.emails)


@query("j25_compare_summary", f"""
WITH {_EB}, b AS {base('k', 'x')}, ind AS {section('k', 'industry', 'x')}, f AS (SELECT b.k, {RATE} AS rate, b.avg_subject_length AS l, b.emoji_rate AS e, ind.best AS industry FROM b LEFT JOIN ind USING (k))
SELECT 'Gucci' AS brand_a, 'Caratlane - A Tata Product' AS brand_b, CASE WHEN a.rate >= b.rate THEN 'Gucci' ELSE 'Caratlane - A Tata Product' END AS more_active,
 CASE WHEN a.l >= b.l THEN 'Gucci' ELSE 'Caratlane - A Tata Product' END AS longer_subjects, CASE WHEN a.e >= b.e THEN 'Gucci' ELSE 'Caratlane - A Tata Product' END AS more_emoji,
 CASE WHEN lower(a.industry) = lower(b.industry) THEN a.industry END AS shared_industry FROM f a, f b WHERE a.k = 'gucci' AND b.k = 'caratlane - a tata product'""")
def _(i):
    return pr.compare_summary(i.emails, "Gucci", "Caratlane - A Tata Product")
