"""Users, plans, usage, library, payments, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailprism import dims
from mailprism.functions.scalars import safe_filename
from mailprism.operators import accounts as ac
from mailprism.operators import insights as ins
from mailprism.operators import ranking as rk
from mailprism.plans import fixtures
from mailprism.plans import sqltext as s
from mailprism.plans.catalog import query
from mailprism.session import scratch_path
from mailprism.sources import mail as ml
from mailprism.sources import store
from mailprism.sources.keyed import KeyedTable
from mailprism.streaming import jobs, payments

T = s.T
LIMITS = s.plan_limits_cte()


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# --- plans ------------------------------------------------------------------

_PAID = f"coalesce(subscription_tier IN ('starter','pro','agency') AND (subscription_expires_at IS NULL OR subscription_expires_at > {T}), false)"
_TRIAL = f"(NOT {_PAID} AND coalesce(trial_ends_at > {T}, false))"


@query("e01_effective_plan", f"SELECT id, {s.PLAN} AS plan FROM users")
def _(i):
    return ac.effective_plan(i.view("users"), i.t).select("id", "plan")


@query("e02_plan_flags", f"SELECT id, {_TRIAL} AS is_on_trial, {s.PLAN} IN ('pro', 'agency') AS is_pro FROM users")
def _(i):
    return ac.effective_plan(i.view("users"), i.t).select("id", "is_on_trial", "is_pro")


_USED = f"""u AS (SELECT id AS user_id, {s.PLAN} AS plan FROM users),
td AS (SELECT user_id, sum(html_views) AS a, sum(brand_views) AS b, sum(html_exports) AS c FROM usage_daily WHERE usage_date = DATE '2024-01-30' GROUP BY user_id),
used AS (SELECT u.user_id, plan, feature, CAST(coalesce(CASE feature WHEN 'email_views_per_day' THEN td.a WHEN 'brand_pages_per_day' THEN td.b WHEN 'html_exports_per_month' THEN td.c
  WHEN 'collections' THEN co.n WHEN 'follows' THEN fo.n ELSE bm.n END, 0) AS BIGINT) AS used FROM u JOIN (SELECT unnest(['email_views_per_day','brand_pages_per_day','html_exports_per_month','collections','follows','bookmarks']) AS feature) f ON true
 LEFT JOIN td USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM collections GROUP BY 1) co USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM follows GROUP BY 1) fo USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM bookmarks GROUP BY 1) bm USING (user_id))"""


def report(i):
    return ac.usage_report(i.view("users"), i.view("usage_daily"), i.view("collections"), i.view("follows"), i.view("bookmarks"), i.limits, i.t)


@query("j19_usage_report", f"""
WITH {LIMITS}, {_USED} SELECT user_id, used.plan, used.feature, used, CAST(coalesce(num_value, -1) AS BIGINT) AS "limit", CASE WHEN num_value IS NULL THEN -1 ELSE greatest(0, num_value - used) END AS remaining
FROM used JOIN plan_limits l ON used.plan = l.plan AND used.feature = l.feature""")
def _(i):
    out = report(i).select("user_id", "plan", "feature", "used", "limit", "remaining")
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("limit", "remaining")})


@query("e03_limit_check", f"""
WITH {LIMITS}, {_USED} SELECT user_id, used.plan, used.feature, used, CAST(coalesce(l.num_value, -1) AS BIGINT) AS "limit", (l.num_value IS NULL OR used < l.num_value) AS allowed, CASE WHEN l.num_value IS NULL THEN -1 ELSE greatest(0, l.num_value - used) END AS remaining,
 CASE WHEN l.num_value IS NOT NULL THEN (SELECT arg_min(h.plan, h.rank) FROM plan_limits h WHERE h.feature = l.feature AND h.rank > l.rank AND (h.num_value IS NULL OR h.num_value > l.num_value)) END AS upgrade_to
FROM used JOIN plan_limits l ON used.plan = l.plan AND used.feature = l.feature""")
def _(i):
    out = ac.limit_check(report(i).select("user_id", "plan", "feature", "used"), i.limits)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("limit", "remaining")}).select("user_id", "plan", "feature", "used", "limit", "allowed", "remaining", "upgrade_to")


@query("e04_plan_revenue", f"""
WITH prices(plan, monthly, annual) AS (VALUES {s.values([(p, *dims.PLAN_PRICES[p]) for p in dims.PLANS])}),
n AS (SELECT {s.PLAN} AS plan, count(*) FILTER (billing_cycle = 'annual') AS a, count(*) FILTER (billing_cycle <> 'annual') AS m FROM users GROUP BY 1)
SELECT plan, CAST(monthly AS BIGINT) AS monthly, CAST(annual AS BIGINT) AS annual, coalesce(m, 0) AS monthly_users, coalesce(a, 0) AS annual_users, round(monthly * coalesce(m, 0) + annual * coalesce(a, 0) / 12.0, 2) AS per_month
FROM prices LEFT JOIN n USING (plan)""")
def _(i):
    return ac.plan_revenue(i.view("users"), dims.plan_prices_table(i.spark), i.t)


@query("e04_min_plan", f"""
WITH {LIMITS}, mp AS (SELECT feature, coalesce(arg_min(plan, rank) FILTER (WHERE kind = 'unlimited' OR (kind <> 'text' AND num_value > 0)), 'agency') AS min_plan FROM plan_limits GROUP BY feature)
SELECT mp.feature, mp.min_plan, (SELECT count(*) FROM users u JOIN (SELECT DISTINCT plan, rank FROM plan_limits) r ON r.plan = {s.PLAN} WHERE r.rank >= (SELECT min(rank) FROM plan_limits x WHERE x.plan = mp.min_plan)) AS entitled FROM mp""")
def _(i):
    ranks = i.limits.select("plan", "rank").distinct()
    users = rk.counts(ac.effective_plan(i.view("users"), i.t), "plan", "n").join(ranks, "plan")
    need = ac.min_plan(i.limits).join(ranks.withColumnsRenamed({"plan": "min_plan", "rank": "need"}), "min_plan")
    # four plans on each side
    levels = users.agg(F.collect_list(F.struct("rank", "n")).alias("l")).scalar()
    out = need.withColumn("l", levels)
    enough = F.filter("l", lambda e: e["rank"] >= F.col("need"))
    return out.select("feature", "min_plan", F.aggregate(enough, F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("entitled"))


# --- usage ------------------------------------------------------------------


@query("e05_usage_rollup", """
SELECT user_id, CAST(usage_date AS VARCHAR) AS usage_date, CAST(html_views AS BIGINT) AS html_views, CAST(brand_views AS BIGINT) AS brand_views, CAST(html_exports AS BIGINT) AS html_exports, CAST(ai_generations AS BIGINT) AS ai_generations FROM usage_daily""")
def _(i):
    return ac.usage_rollup(i.table("events")).withColumn("usage_date", F.col("usage_date").cast("string"))


@query("a39_month_to_date", "SELECT user_id, CAST(sum(ai_generations) AS BIGINT) AS ai_generations FROM usage_daily WHERE usage_date >= DATE '2024-01-01' GROUP BY user_id")
def _(i):
    return ac.month_to_date(i.view("usage_daily"), i.t)


@query("e06_export_resets", """
SELECT user_id, CAST(date_trunc('month', usage_date) AS DATE)::VARCHAR AS month, CAST(sum(html_exports) AS BIGINT) AS html_exports, strftime(date_trunc('month', usage_date) + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS resets_at FROM usage_daily GROUP BY user_id, date_trunc('month', usage_date)""")
def _(i):
    return ac.export_resets(i.view("usage_daily")).withColumns({"month": F.col("month").cast("string"), "resets_at": stamp("resets_at")})


@query("e07_trial_status", f"SELECT id, {_TRIAL} AS is_on_trial, CASE WHEN {_TRIAL} THEN greatest(0, {s.days(T, 'trial_ends_at')}) ELSE 0 END AS days_left, {s.PLAN} AS plan FROM users")
def _(i):
    return ac.trial_status(i.view("users"), i.t).select("id", "is_on_trial", "days_left", "plan")


_DL = s.days(T, "trial_ends_at")


@query("e08_reminders", f"""
WITH x AS (SELECT id, {_DL} AS d, coalesce(trial_emails_sent, '[]') AS sent FROM users WHERE subscription_tier = 'free'),
y AS (SELECT *, CASE WHEN d > 1 AND d <= 3 AND NOT contains(sent, 'day4') THEN 'day4' WHEN d > 0 AND d <= 1 AND NOT contains(sent, 'day6') THEN 'day6' WHEN d > -3 AND d <= -1 AND NOT contains(sent, 'day8') THEN 'day8' END AS reminder FROM x)
SELECT id, reminder, d AS days_left, CASE WHEN sent = '[]' THEN '["' || reminder || '"]' ELSE replace(sent, ']', ',"' || reminder || '"]') END AS trial_emails_sent FROM y WHERE reminder IS NOT NULL""")
def _(i):
    return ac.reminder_cohort(i.view("users"), i.t).select("id", "reminder", "days_left", "trial_emails_sent")


_FOLD = """la AS (SELECT user_id, max((event_time, event_id)) AS since FROM payment_events WHERE event = 'subscription.activated' GROUP BY user_id),
cu AS (SELECT p.user_id, p.subscription_id AS cur, p.tier, p.billing_cycle, p.event_time AS act, since FROM payment_events p JOIN la ON p.user_id = la.user_id AND (p.event_time, p.event_id) = since),
ev AS (SELECT p.user_id, p.event, p.event_time, p.event_id FROM payment_events p LEFT JOIN cu ON p.user_id = cu.user_id
 WHERE p.subscription_id = coalesce(cur, concat('sub', CAST(p.user_id AS VARCHAR), '-0')) AND (since IS NULL OR (p.event_time, p.event_id) > since)),
st AS (SELECT user_id, min((event_time, event_id)) AS stop FROM ev WHERE event = 'subscription.cancelled' GROUP BY user_id),
ch AS (SELECT ev.user_id, max(event_time) AS charge FROM ev LEFT JOIN st ON ev.user_id = st.user_id WHERE event = 'subscription.charged' AND (stop IS NULL OR (event_time, event_id) < stop) GROUP BY ev.user_id),
fd AS (SELECT u.user_id, coalesce(cur, concat('sub', CAST(u.user_id AS VARCHAR), '-0')) AS subscription_id, tier, billing_cycle, act, charge, stop IS NOT NULL AS cancelled
 FROM (SELECT DISTINCT user_id FROM payment_events) u LEFT JOIN cu ON u.user_id = cu.user_id LEFT JOIN st ON u.user_id = st.user_id LEFT JOIN ch ON u.user_id = ch.user_id)"""


@query("e09_fold_payments", f"""
WITH {_FOLD} SELECT u.id, strftime(coalesce(coalesce(charge, act) + to_days(CASE WHEN coalesce(fd.billing_cycle, u.billing_cycle) = 'annual' THEN 370 ELSE 35 END), subscription_expires_at), '%Y-%m-%d %H:%M:%S') AS expires_at,
 NOT coalesce(cancelled, false) AS has_subscription, coalesce(fd.tier, subscription_tier) AS subscription_tier, coalesce(fd.billing_cycle, u.billing_cycle) AS billing_cycle,
 CASE WHEN NOT coalesce(cancelled, false) THEN coalesce(fd.subscription_id, u.subscription_id) END AS subscription_id
FROM users u LEFT JOIN fd ON u.id = fd.user_id""")
def _(i):
    out = ac.fold_payments(i.view("users"), i.view("payment_events"))
    return out.select("id", stamp("subscription_expires_at").alias("expires_at"), "has_subscription", "subscription_tier", "billing_cycle", "subscription_id")


@query("a20_admin_metrics", f"""
SELECT 'total' AS section, 'users' AS item, count(*) AS value FROM users UNION ALL SELECT 'total', 'active_trials', count(*) FROM users WHERE trial_ends_at > {T}
UNION ALL SELECT 'total', 'active_users_7d', count(DISTINCT user_id) FROM usage_daily WHERE usage_date >= DATE '2024-01-23' UNION ALL SELECT 'total', 'page_views', CAST(sum(html_views + brand_views) AS BIGINT) FROM usage_daily
UNION ALL SELECT 'total', 'page_views_7d', CAST(coalesce(sum(html_views + brand_views), 0) AS BIGINT) FROM usage_daily WHERE usage_date >= DATE '2024-01-23'
UNION ALL SELECT 'total', 'emails', count(*) FROM emails UNION ALL SELECT 'total', 'brands', count(DISTINCT brand) FROM emails UNION ALL SELECT 'total', 'subscribers', count(*) FROM supplier
UNION ALL SELECT 'plan', subscription_tier, count(*) FROM users GROUP BY subscription_tier
UNION ALL SELECT 'signups', CAST(CAST(created_at AS DATE) AS VARCHAR), count(*) FROM users WHERE created_at >= {T} - INTERVAL 30 DAY GROUP BY 2""")
def _(i):
    return ac.admin_metrics(i.view("users"), i.view("usage_daily"), i.emails, i.table("supplier"), i.t)


@query("a20_recent_users", f"SELECT id, email, coalesce(subscription_tier, 'free') AS plan, {_TRIAL} AS is_on_trial, {s.ts('created_at')} AS created_at FROM users ORDER BY users.created_at DESC, id LIMIT 10")
def _(i):
    return ac.recent_users(i.view("users"), i.t).withColumn("created_at", stamp("created_at"))


# --- library ----------------------------------------------------------------


@query("j02_bookmarks", f"SELECT b.user_id, b.email_id, {s.ts('b.created_at')} AS created_at, e.subject, e.brand FROM bookmarks b JOIN emails e ON b.email_id = e.id")
def _(i):
    out = ac.bookmarks_with_emails(i.view("bookmarks"), i.emails)
    return out.select("user_id", "email_id", stamp("created_at").alias("created_at"), "subject", "brand")


@query("j03_collections", f"""
SELECT 'counts' AS part, c.id AS collection_id, name AS label, count(ce.email_id) AS number FROM collections c LEFT JOIN collection_emails ce ON c.id = ce.collection_id GROUP BY c.id, name
UNION ALL SELECT 'contents', ce.collection_id, e.subject, ce.email_id FROM collection_emails ce JOIN emails e ON ce.email_id = e.id""")
def _(i):
    members = i.view("collection_emails")
    tally = ac.collection_counts(i.view("collections"), members).select(F.lit("counts").alias("part"), F.col("id").alias("collection_id"), F.col("name").alias("label"), F.col("email_count").alias("number"))
    rows = ac.collection_emails(members, i.emails).select(F.lit("contents").alias("part"), "collection_id", F.col("subject").alias("label"), F.col("email_id").alias("number"))
    return tally.unionByName(rows)


_CAP = "CASE plan WHEN 'free' THEN 3 WHEN 'starter' THEN 10 ELSE 1000000000 END"


@query("e10_cap_library", f"""
WITH u AS (SELECT id, {s.PLAN} AS plan FROM users), r AS (SELECT f.*, plan, row_number() OVER (PARTITION BY user_id ORDER BY f.created_at, brand_name) AS n FROM follows f JOIN u ON f.user_id = u.id)
SELECT 'kept' AS part, user_id, brand_name AS item FROM r WHERE n <= {_CAP} UNION ALL SELECT 'over', user_id, CAST(count(*) AS VARCHAR) FROM r WHERE n > {_CAP} GROUP BY user_id""")
def _(i):
    follows, users = i.view("follows"), i.view("users")
    kept = ac.cap_library(follows, users, i.t, "follows").select(F.lit("kept").alias("part"), "user_id", F.col("brand_name").alias("item"))
    return kept.unionByName(ac.over_cap(follows, users, i.t, "follows").select(F.lit("over").alias("part"), "user_id", F.col("over").cast("string").alias("item")))


def library_log(i):
    return i.table("orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("email_id"),
        F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("op"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"))


@query("e11_compact_log", """
SELECT user_id, email_id, strftime(at_, '%Y-%m-%d %H:%M:%S') AS created_at FROM (SELECT o_custkey AS user_id, o_orderkey % 50 AS email_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st, max(o_orderdate) AS at_ FROM orders GROUP BY 1, 2) WHERE st <> 'F'""")
def _(i):
    return ac.compact_log(library_log(i), ["user_id", "email_id"]).withColumn("created_at", stamp("created_at"))


# --- sources and sinks ------------------------------------------------------


@query("s01_email_table", "SELECT strftime(received_at, '%Y-%m') AS month, count(*) AS n, count(DISTINCT brand) AS brands FROM emails WHERE type = 'Sale' GROUP BY 1")
def _(i):
    path = scratch_path(i.spark, "emails")
    ml.write_emails(i.emails, path)
    rows = ml.read_emails(i.spark, path).where("type = 'Sale'")
    return rows.groupBy(F.date_format("received_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("brand").alias("brands"))


def exported(i):
    """Messages written as JSON lines and read back."""
    path = scratch_path(i.spark, "messages")
    fixtures.messages(i.spark, i.sf_dir).write.json(path)
    return ml.read_messages(i.spark, path)


_SUBJ = "CASE WHEN page_id % 7 = 0 THEN 'no-subject' ELSE concat('Offer ', page_id, '% off') END"
_FROM = "concat('Shop ', page_id % 9, ' <news@shop', page_id % 9, '.com>')"


@query("s02_read_messages", f"SELECT concat('m', page_id) AS id, {_SUBJ} AS subject, {_FROM} AS sender FROM email_html")
def _(i):
    return exported(i).select("id", "subject", "sender")


@query("s03_extract_body", "SELECT concat('m', page_id) AS id, md5(html) AS html_md5 FROM email_html WHERE page_id % 13 <> 5")
def _(i):
    return ml.extract_body(exported(i)).select("id", F.md5("html").alias("html_md5"))


@query("s04_mail_date", f"""
SELECT concat('m', page_id) AS id, strftime(CASE WHEN page_id % 5 = 0 THEN {T} ELSE TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 3607) - INTERVAL 330 MINUTE END, '%Y-%m-%d %H:%M:%S') AS received_at FROM email_html""")
def _(i):
    return exported(i).select("id", stamp(ml.parse_mail_date("date_header", i.t)).alias("received_at"))


# Files of all mails: the brand's folder, the day and the subject, and the id behind a name that an earlier mail has.
_TREE = f"""
tree AS (SELECT regexp_replace(left(regexp_replace(lower(coalesce(e.brand, 'unknown')), '[^a-z0-9]+', '-', 'g'), 60), '^-+|-+$', '', 'g') AS folder,
  regexp_replace(left(regexp_replace(lower(e.subject), '[^a-z0-9]+', '-', 'g'), 60), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN e.id % 10 <> 0 THEN strftime(e.received_at, '%Y-%m-%d') END AS day, e.id, e.received_at, h.html FROM emails e JOIN email_html h ON e.page_id = h.page_id),
named AS (SELECT folder, day, html, CASE WHEN day IS NULL AND slug = '' THEN 'untitled' ELSE slug END || CASE WHEN row_number() OVER (PARTITION BY folder, day, slug ORDER BY received_at, id) > 1 THEN '-' || id ELSE '' END AS slug FROM tree)"""


def written_tree(i):
    """All mails written as HTML files (every tenth without its day)."""
    path = scratch_path(i.spark, "tree")
    day = F.when(F.col("id") % 10 != 0, F.to_date("received_at"))
    ml.write_html_tree(i.emails, path, day, pages=i.view("email_html"))
    return path


@query("s05_html_tree", f"""
WITH {_TREE} SELECT {s.title('folder')} AS brand, coalesce(day, '0001-01-01') AS date, CASE WHEN day IS NULL THEN slug ELSE {s.title("replace(slug, '-', ' ')")} END AS subject,
 folder || '/' || coalesce(day || '_', '') || slug || '.html' AS path, md5(html) AS html_md5 FROM named""")
def _(i):
    files = ml.read_html_tree(i.spark, written_tree(i), of_html=F.md5("html").alias("html_md5"))
    return files.select("brand", F.col("date").cast("string").alias("date"), "subject", "path", "html_md5")


@query("s06_write_html_tree", f"WITH {_TREE} SELECT folder AS brand, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS chars FROM named GROUP BY 1")
def _(i):
    files = ml.read_html_tree(i.spark, written_tree(i))
    return files.groupBy(F.substring_index("path", "/", 1).alias("brand")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("html")).alias("chars"))


def keyed_mails(i):
    """A third of the mails in a keyed table, and all mails twice as the next batch."""
    table = KeyedTable(i.spark, scratch_path(i.spark, "keyed"), "gmail_id")
    rows = i.emails.select("id", "gmail_id", "received_at")
    table.append(rows.where("id % 3 = 0"))
    return table, rows.unionByName(rows)


@query("s07_append_new", """
SELECT strftime(received_at, '%Y-%m') AS month, count(*) FILTER (id % 3 <> 0) AS created, count(*) * 2 - count(*) FILTER (id % 3 <> 0) AS skipped, count(*) AS stored FROM emails GROUP BY 1""")
def _(i):
    table, batch = keyed_mails(i)
    created = rk.counts(table.append(batch), "month", "created")
    offered = rk.counts(batch, F.date_format("received_at", "yyyy-MM").alias("month"), "offered")
    stored = rk.counts(table.rows(), "month", "stored")
    return offered.join(created, "month").join(stored, "month").select("month", "created", (F.col("offered") - F.col("created")).alias("skipped"), "stored")


@query("j01_unseen", "SELECT id, gmail_id FROM emails e WHERE id % 3 <> 0")
def _(i):
    table, batch = keyed_mails(i)
    return table.fresh(batch).select("id", "gmail_id")


@query("s08_skip_listed", "SELECT gmail_id AS id, subject FROM emails WHERE id % 4 <> 0")
def _(i):
    path = scratch_path(i.spark, "ids")
    i.emails.where("id % 4 = 0").select(F.concat(F.lit(" "), "gmail_id", F.lit(" ")).alias("value")).write.text(path)
    batch = i.emails.select(F.col("gmail_id").alias("id"), "subject")
    return store.skip_listed(batch, store.read_id_list(i.spark, path))


@query("s09_insight_store", """
WITH x AS (SELECT brand, count(*) AS cnt FROM emails WHERE brand IS NOT NULL GROUP BY brand), y AS (SELECT brand, count(*) AS cnt FROM emails WHERE brand IS NOT NULL AND type = 'Sale' GROUP BY brand)
SELECT 'brand_counts' AS insight_type, '2024-W05' AS week_label, '2024-01-30 02:00:00' AS computed_at, brand, cnt FROM x
UNION ALL SELECT 'brand_counts', '2024-W04', '2024-01-23 01:00:00', brand, cnt FROM x UNION ALL SELECT 'sale_counts', '2024-W05', '2024-01-30 01:00:00', brand, cnt FROM y""")
def _(i):
    path = scratch_path(i.spark, "insights")
    mails = i.emails.where(rk.has_brand())
    tally, sales = rk.counts(mails, "brand"), rk.counts(mails.where("type = 'Sale'"), "brand")
    store.write_insight(tally, "brand_counts", "2024-01-23 00:00:00", path, "2024-01-23 01:00:00")
    store.write_insight(sales, "sale_counts", i.t, path, "2024-01-30 01:00:00")
    store.write_insight(sales, "brand_counts", i.t, path, "2024-01-30 01:00:00")
    store.write_insight(tally, "brand_counts", i.t, path, "2024-01-30 02:00:00")  # replaces these rows and no others
    return i.spark.read.parquet(path).select("insight_type", "week_label", stamp("computed_at").alias("computed_at"), F.get_json_object("data", "$.brand").alias("brand"),
                                             F.get_json_object("data", "$.cnt").cast("long").alias("cnt"))


@query("s10_latest_insight", """
WITH x AS (SELECT brand, count(*) AS cnt FROM emails WHERE brand IS NOT NULL GROUP BY brand)
SELECT 'doc' AS part, brand AS item, CAST(cnt AS VARCHAR) AS value FROM x UNION ALL SELECT 'week', 'brand_counts', '2024-W05' UNION ALL SELECT 'week', 'new_tactics', 'never'""")
def _(i):
    tally = rk.counts(i.emails.where(rk.has_brand()), "brand")
    old = store.insight_rows(tally.withColumn("cnt", F.col("cnt") * 0), "brand_counts", "2024-01-23 00:00:00", "2024-01-23 01:00:00")
    rows = old.unionByName(store.insight_rows(tally, "brand_counts", i.t, "2024-01-30 01:00:00"))
    docs = store.latest_insight(rows, "brand_counts").select(
        F.lit("doc").alias("part"), F.get_json_object("data", "$.brand").alias("item"), F.get_json_object("data", "$.cnt").alias("value"))
    weeks = store.insight_summary(rows, ["brand_counts", "new_tactics"]).select(
        F.lit("week").alias("part"), F.col("insight_type").alias("item"), F.coalesce("week", F.lit("never")).alias("value"))
    return docs.unionByName(weeks)


@query("s11_rule_tables", f"""
WITH tax(industry) AS (VALUES {s.values([(x,) for x in dims.INDUSTRIES])}), subs(industry, n) AS (VALUES {s.values([(k, len(v)) for k, v in dims.SUBCATEGORIES.items()])})
SELECT t.industry, CAST(s.n AS BIGINT) AS subcategories, (SELECT count(*) FROM emails e WHERE e.industry = t.industry) AS emails FROM tax t JOIN subs s ON t.industry = s.industry""")
def _(i):
    subs = rk.counts(dims.subcategory_table(i.spark), "industry", "subcategories")
    mails = rk.counts(i.emails, "industry", "emails")
    out = dims.taxonomy_table(i.spark).join(subs, "industry").join(mails, "industry", "left")
    return out.withColumn("emails", F.coalesce("emails", F.lit(0)))


@query("s12_insert_absent", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT lower(trim(email)) AS k FROM users EXCEPT SELECT lower(trim(email)) FROM users WHERE id % 3 = 0)) AS seeded,
 (SELECT count(*) FROM users WHERE id % 3 = 0) AS skipped""")
def _(i):
    users = i.view("users")
    existing = users.where("id % 3 = 0").select(F.concat(F.lit("  "), F.upper("email")).alias("email"))
    return store.insert_absent(existing, users.select("email"), "email")[1]


_OLD = "SELECT s_name AS brand_name, 'Pets' AS industry, 0.5 AS confidence, CASE s_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'keyword' ELSE 'ai' END AS classified_by FROM supplier WHERE s_suppkey % 2 = 0"
_FRESH = "SELECT upper(s_name) AS brand_name, 'Entertainment' AS industry, 0.9 AS confidence, CASE WHEN s_suppkey % 5 = 0 THEN 'keyword' ELSE 'ai' END AS classified_by FROM supplier"


@query("s13_merge_labels", f"""
WITH o AS ({_OLD}), n AS ({_FRESH})
SELECT coalesce(o.brand_name, n.brand_name) AS brand_name, CASE WHEN o.brand_name IS NULL OR (n.classified_by = 'ai' AND o.classified_by <> 'manual') THEN n.industry ELSE o.industry END AS industry,
 CASE WHEN o.brand_name IS NULL OR (n.classified_by = 'ai' AND o.classified_by <> 'manual') THEN n.classified_by ELSE o.classified_by END AS classified_by
FROM o FULL JOIN n ON lower(o.brand_name) = lower(n.brand_name)""")
def _(i):
    sup = i.table("supplier")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "manual").when(F.col("s_suppkey") % 3 == 1, "keyword").otherwise("ai")
    old = sup.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("brand_name"), F.lit("Pets").alias("industry"), F.lit(0.5).alias("confidence"), kind.alias("classified_by"))
    new = sup.select(F.upper("s_name").alias("brand_name"), F.lit("Entertainment").alias("industry"), F.lit(0.9).alias("confidence"), F.when(F.col("s_suppkey") % 5 == 0, "keyword").otherwise("ai").alias("classified_by"))
    return store.merge_classifications(old, new).select("brand_name", "industry", "classified_by")


@query("s14_drop_keys", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 <> 0")
def _(i):
    sup = i.table("supplier").select("s_suppkey", "s_name")
    return store.drop_keys(sup, sup.where("s_suppkey % 4 = 0").select(F.upper("s_name").alias("s_name")), "s_name")


# --- streams ----------------------------------------------------------------


def mail_stream(i):
    """The mails as a stream: static dictionaries joined to the streamed events."""
    events = jobs.read_table_stream(i.spark, i.sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"), F.md5(F.col("event_id").cast("string")).alias("gmail_id"), F.col("ts").alias("received_at"),
        F.concat(F.lit("brand "), (F.col("user_id") % 16).cast("string")).alias("brand"),
        F.concat(F.lit("Save "), F.floor("value").cast("string"), F.when(F.col("event_type") == "view", "% off?").otherwise(" today 🔥")).alias("subject"))


_STREAM = """ms AS (SELECT event_id AS id, ts AS received_at, concat('brand ', user_id % 16) AS brand, concat('Save ', CAST(floor(value) AS BIGINT), CASE WHEN event_type = 'view' THEN '% off?' ELSE ' today 🔥' END) AS subject FROM events)"""


@query("r01_incremental_ingest", f"SELECT concat('m', page_id) AS gmail_id, {_SUBJ} AS subject, {_FROM} AS sender FROM email_html WHERE page_id % 13 <> 5")
def _(i):
    src, out, mark = (scratch_path(i.spark, n) for n in ("inbox", "mails", "mark"))
    fixtures.messages(i.spark, i.sf_dir).repartition(3).write.json(src)
    jobs.start_ingest(i.spark, src, out, mark, i.t, files_per_trigger=2).awaitTermination()
    return ml.read_emails(i.spark, out).select("gmail_id", "subject", "sender")


@query("r02_dedup_stream", "SELECT md5(CAST(event_id AS VARCHAR)) AS gmail_id FROM events")
def _(i):
    path = scratch_path(i.spark, "dedup")
    twice = mail_stream(i).unionByName(mail_stream(i))
    jobs.run_available(jobs.dedup_stream(twice, delay="40 days"), path, "append")
    return i.spark.read.parquet(f"{path}/data").select("gmail_id")


@query("r03_weekly_metrics_stream", f"""
WITH {_STREAM} SELECT strftime(date_trunc('week', received_at), '%Y-%m-%d') AS week_start, {s.formula('subject')} AS formula, count(*) AS emails, CAST(sum(length(subject)) AS BIGINT) AS chars,
 {s.count_if(s.discount('subject'))} AS discounts, {s.count_if(s.emoji('subject', 'insights'))} AS emoji, {s.count_if('isodow(received_at) >= 6')} AS weekend FROM ms GROUP BY 1, 2""")
def _(i):
    path = scratch_path(i.spark, "weekly")
    jobs.run_current(jobs.weekly_metrics_stream(mail_stream(i)), path, ["week_start", "formula"], "week_start")
    return jobs.current_state(i.spark, path).withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))


@query("r04_payment_state_stream", f"WITH {_FOLD} SELECT user_id, subscription_id, tier, billing_cycle, coalesce(strftime(act, '%Y-%m-%d %H:%M:%S'), 'never') AS activated_at, coalesce(strftime(charge, '%Y-%m-%d %H:%M:%S'), 'never') AS last_charge, cancelled FROM fd")
def _(i):
    source = f"{scratch_path(i.spark, 'payment-events')}/events"
    i.view("payment_events").write.parquet(source)
    events = i.spark.readStream.schema(i.spark.read.parquet(source).schema).parquet(source)
    out = payments.payment_state(i.spark, events, scratch_path(i.spark, "payments"))
    never = lambda c: F.coalesce(stamp(c), F.lit("never")).alias(c)
    return out.select("user_id", "subscription_id", "tier", "billing_cycle", never("activated_at"), never("last_charge"), "cancelled")


@query("r05_usage_stream", """
SELECT user_id, CAST(usage_date AS VARCHAR) AS usage_date, CAST(html_views AS BIGINT) AS html_views, CAST(brand_views AS BIGINT) AS brand_views, CAST(html_exports AS BIGINT) AS html_exports, CAST(ai_generations AS BIGINT) AS ai_generations FROM usage_daily""")
def _(i):
    path = scratch_path(i.spark, "usage")
    jobs.run_current(jobs.usage_stream(jobs.read_table_stream(i.spark, i.sf_dir, "events")), path, ["user_id", "usage_date"], "usage_date")
    return jobs.current_state(i.spark, path).withColumn("usage_date", F.col("usage_date").cast("string"))


@query("r06_scheduled_insights", """
WITH w AS (SELECT date_trunc('week', received_at) AS week, count(*) AS n FROM emails WHERE subject IS NOT NULL GROUP BY 1)
SELECT strftime(a.week, '%G-W%V') AS week, CAST(a.n AS DOUBLE) AS total_this, CAST(coalesce(b.n, 0) AS DOUBLE) AS total_last, strftime(a.week + INTERVAL 7 DAY - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS computed_at
FROM w a LEFT JOIN w b ON b.week = a.week - INTERVAL 7 DAY""")
def _(i):
    source, path, mark = (scratch_path(i.spark, n) for n in ("archive", "scheduled", "scheduled-mark"))
    late = F.col("received_at") >= F.lit("2024-01-22").cast("timestamp")
    for part in (~late, late):  # the second run recomputes the weeks of the second part only
        i.emails.where(part).write.mode("append").parquet(source)
        jobs.refresh_insights(i.spark, source, i.emails.schema, path, mark, ["weekly_scoreboard"])
    rows = i.spark.read.parquet(path)
    total = lambda c: F.get_json_object("data", f"$.{c}").cast("double").alias(c)
    return rows.select(F.col("week_label").alias("week"), total("total_this"), total("total_last"), stamp("computed_at").alias("computed_at"))


@query("r07_sliding_activity", f"""
WITH {_STREAM} SELECT brand, strftime(w, '%Y-%m-%d') AS window_start, count(*) AS emails FROM (SELECT brand, unnest(list_transform(range(0, 7), lambda k: date_trunc('day', received_at) - to_days(CAST(k AS INTEGER)))) AS w FROM ms) GROUP BY 1, 2""")
def _(i):
    path = scratch_path(i.spark, "sliding")
    jobs.run_available(jobs.activity_windows(mail_stream(i), "sliding"), path)
    out = jobs.newest_state(i.spark, path, ["brand", "window_start"])
    return out.select("brand", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "emails")


@query("r07_session_activity", f"""
WITH {_STREAM}, g AS (SELECT *, CASE WHEN received_at - lag(received_at) OVER (PARTITION BY brand ORDER BY received_at) < INTERVAL 48 HOUR THEN 0 ELSE 1 END AS fresh FROM ms),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY brand ORDER BY received_at, id) AS sn FROM g)
SELECT brand, strftime(min(received_at), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(received_at) + INTERVAL 48 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS emails FROM h GROUP BY brand, sn""")
def _(i):
    path = scratch_path(i.spark, "session")
    jobs.run_available(jobs.activity_windows(mail_stream(i), "session"), path, "complete")
    out = jobs.whole_result(i.spark, path)
    return out.select("brand", stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "emails")
