"""Users, plans, usage, library and subscription state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism import dims
from mailprism.functions.scalars import floor_days
from mailprism.operators.ranking import counts, top_n_per

PAID = ["starter", "pro", "agency"]

# Days a charge extends a subscription, reminder windows (above, up to) in whole days.
CHARGE_DAYS = {"monthly": 35, "annual": 370}
REMINDERS = [("day4", 1, 3), ("day6", 0, 1), ("day8", -3, -1)]
USAGE_EVENTS = {"view": "html_views", "click": "brand_views", "purchase": "html_exports", "signup": "ai_generations"}


def _ts(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")


# --- plans ------------------------------------------------------------------


def plan_of(t, tier="subscription_tier", expires="subscription_expires_at", trial="trial_ends_at") -> Column:
    """Effective plan: a paid tier that has not run out, else starter while on trial, else free."""
    paid = F.col(tier).isin(PAID) & (F.col(expires).isNull() | (F.col(expires) > _ts(t)))
    return F.when(paid, F.col(tier)).when(F.col(trial) > _ts(t), "starter").otherwise("free")


def effective_plan(users: DataFrame, t) -> DataFrame:
    """Adds plan, is_on_trial (no active paid tier, trial running) and is_pro."""
    paid = F.col("subscription_tier").isin(PAID) & (
        F.col("subscription_expires_at").isNull() | (F.col("subscription_expires_at") > _ts(t)))
    on_trial = ~F.coalesce(paid, F.lit(False)) & F.coalesce(F.col("trial_ends_at") > _ts(t), F.lit(False))
    out = users.withColumns({"plan": plan_of(t), "is_on_trial": on_trial})
    return out.withColumn("is_pro", F.col("plan").isin("pro", "agency"))


def trial_status(users: DataFrame, t) -> DataFrame:
    """Adds days_left: whole days of a running trial, else 0."""
    days = F.greatest(F.lit(0), floor_days(_ts(t), "trial_ends_at"))
    out = effective_plan(users, t)
    return out.withColumn("days_left", F.when(F.col("is_on_trial"), days).otherwise(0).cast("long"))


def limit_check(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """(…, plan, feature, used) → allowed, limit, remaining and the next plan that gives more."""
    numeric = limits.where(F.col("kind") != "text").select("plan", "rank", "feature", F.col("num_value").alias("limit"))
    ladder = numeric.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("rank", "plan", "limit"))).alias("_ladder"))
    # one row per feature with its four plans: a fixed, tiny dimension
    out = usage.join(numeric.join(ladder, "feature"), ["plan", "feature"])
    higher = F.filter("_ladder", lambda h: (h["rank"] > F.col("rank")) & (h["limit"].isNull() | (h["limit"] > F.col("limit"))))
    unlimited = F.col("limit").isNull()
    return out.withColumns({
        "allowed": unlimited | (F.col("used") < F.col("limit")),
        "remaining": F.when(~unlimited, F.greatest(F.lit(0), F.col("limit") - F.col("used"))),
        "upgrade_to": F.when(~unlimited, F.get(higher, 0)["plan"]),
    }).drop("_ladder", "rank")


def min_plan(limits: DataFrame) -> DataFrame:
    """Lowest plan that offers each feature; a text feature counts as the highest plan."""
    offers = (F.col("kind") == "unlimited") | (F.col("kind").isin("number", "flag") & (F.col("num_value") > 0))
    first = F.min(F.when(offers, F.struct("rank", "plan")))["plan"]
    return limits.groupBy("feature").agg(F.coalesce(first, F.lit(dims.PLANS[-1])).alias("min_plan"))


# --- usage ------------------------------------------------------------------


def usage_rollup(events: DataFrame, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """Daily counters per user from raw events."""
    return events.groupBy("user_id", F.to_date(ts).alias("usage_date")).agg(
        *[F.count_if(F.col(kind) == k).alias(name) for k, name in USAGE_EVENTS.items()])


def month_to_date(usage: DataFrame, t, col: str = "ai_generations") -> DataFrame:
    """Sum of a counter per user since the first of the month."""
    rows = usage.where(F.col("usage_date") >= F.to_date(F.date_trunc("month", _ts(t))))
    return rows.groupBy("user_id").agg(F.sum(F.coalesce(col, F.lit(0))).alias(col))


def export_resets(usage: DataFrame) -> DataFrame:
    """Exports per user and month with the time the counter starts again."""
    month = F.trunc("usage_date", "month")
    out = usage.groupBy("user_id", month.alias("month")).agg(F.sum("html_exports").alias("html_exports"))
    return out.withColumn("resets_at", F.add_months("month", 1).cast("timestamp"))


def usage_report(users: DataFrame, usage: DataFrame, collections: DataFrame, follows: DataFrame, bookmarks: DataFrame,
                 limits: DataFrame, t) -> DataFrame:
    """Per user and feature: plan, used, limit, remaining (today's counters, current library)."""
    today = usage.where(F.col("usage_date") == F.to_date(_ts(t))).groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in ("html_views", "brand_views", "html_exports")])
    out = effective_plan(users, t).select(F.col("id").alias("user_id"), "plan").join(today, "user_id", "left")
    for name, lib in (("collections", collections), ("follows", follows), ("bookmarks", bookmarks)):
        out = out.join(counts(lib, "user_id", name), "user_id", "left")
    features = {
        "email_views_per_day": "html_views", "brand_pages_per_day": "brand_views", "html_exports_per_month": "html_exports",
        "collections": "collections", "follows": "follows", "bookmarks": "bookmarks"}
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("used")) for f, c in features.items()])
    out = out.select("user_id", "plan", F.inline(rows))
    lim = limits.select("plan", "feature", F.col("num_value").alias("limit"))
    out = out.join(lim, ["plan", "feature"])
    return out.withColumn("remaining", F.greatest(F.lit(0), F.col("limit") - F.col("used"))).withColumn(
        "remaining", F.when(F.col("limit").isNotNull(), F.col("remaining")))


def admin_metrics(users: DataFrame, usage: DataFrame, emails: DataFrame, subscribers: DataFrame, t) -> DataFrame:
    """Dashboard numbers in long form (section, item, value)."""
    now = _ts(t)
    week_ago = F.to_date(now - F.make_dt_interval(F.lit(7)))
    month_ago = now - F.make_dt_interval(F.lit(30))
    per_user = users.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("trial_ends_at") > now).alias("active_trials"))
    recent = F.col("usage_date") >= week_ago
    views = F.col("html_views") + F.col("brand_views")
    use = usage.agg(
        F.count_distinct(F.when(recent, F.col("user_id"))).alias("active_users_7d"),
        F.coalesce(F.sum(views), F.lit(0)).alias("page_views"),
        F.coalesce(F.sum(F.when(recent, views)), F.lit(0)).alias("page_views_7d"))
    mail = emails.agg(F.count(F.lit(1)).alias("emails"), F.count_distinct("brand").alias("brands"))
    subs = subscribers.agg(F.count(F.lit(1)).alias("subscribers"))

    def long(section, one):
        rows = [F.struct(F.lit(section).alias("section"), F.lit(c).alias("item"), F.col(c).cast("long").alias("value")) for c in one.columns]
        return one.select(F.inline(F.array(*rows)))

    out = long("total", per_user).unionByName(long("total", use)).unionByName(long("total", mail)).unionByName(long("total", subs))
    plans = counts(users, "subscription_tier", "value").select(F.lit("plan").alias("section"), F.col("subscription_tier").alias("item"), "value")
    signups = counts(users.where(F.col("created_at") >= month_ago), F.to_date("created_at").cast("string").alias("item"), "value")
    return out.unionByName(plans).unionByName(signups.select(F.lit("signups").alias("section"), "item", "value"))


def recent_users(users: DataFrame, t, n: int = 10) -> DataFrame:
    """Newest users with plan name and trial flag."""
    out = effective_plan(users, t).orderBy(F.desc("created_at"), "id").limit(n)
    return out.select("id", "email", F.coalesce("subscription_tier", F.lit("free")).alias("plan"), "is_on_trial", "created_at")


def plan_revenue(users: DataFrame, prices: DataFrame, t) -> DataFrame:
    """Per plan its prices, the users on it now by billing cycle, and what they pay in a month (annual prices by twelve)."""
    annual = F.col("billing_cycle") == "annual"
    on = effective_plan(users, t).groupBy("plan").agg(
        F.count_if(~F.coalesce(annual, F.lit(False))).alias("monthly_users"), F.count_if(annual).alias("annual_users"))
    out = prices.join(on, "plan", "left").fillna(0, ["monthly_users", "annual_users"])
    per_month = F.col("monthly") * F.col("monthly_users") + F.col("annual") * F.col("annual_users") / 12
    return out.withColumn("per_month", F.round(per_month, 2))


# --- reminders and payments -------------------------------------------------


def reminder_cohort(users: DataFrame, t) -> DataFrame:
    """Free-tier users due a trial reminder, with the list of sent ones after it.

    A missing tier is not 'free': the original IN list holds NULL, which never matches.
    """
    days = floor_days(_ts(t), "trial_ends_at")
    sent = F.coalesce(F.from_json("trial_emails_sent", "array<string>"), F.array().cast("array<string>"))
    out = users.where((F.col("subscription_tier") == "free") & F.col("trial_ends_at").isNotNull())
    out = out.withColumns({"days_left": days, "_sent": sent})
    due = None
    for key, above, upto in REMINDERS:
        cond = (F.col("days_left") > above) & (F.col("days_left") <= upto) & ~F.array_contains("_sent", key)
        due = F.when(cond, key) if due is None else due.when(cond, key)
    out = out.withColumn("reminder", due).where(F.col("reminder").isNotNull())
    return out.withColumn("trial_emails_sent", F.to_json(F.array_append("_sent", F.col("reminder")))).drop("_sent")


STATE = ["subscription_id", "tier", "billing_cycle", "activated_at", "last_charge", "cancelled"]


def fold_events(events: DataFrame, state: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """Subscription of every user after payment events: key, subscription_id, tier, billing_cycle, activated_at,
    last_charge, cancelled.

    An activation starts a new subscription with its tier and billing cycle; charges and cancellations count only
    for the subscription that is current, and charges only until it is cancelled. So a user's last activation and
    what follows it decide. ``state`` is what events before these have led to; a user without it and without an
    activation has the subscription of the first event. Only aggregations and joins by user: no user's events are
    sorted or gathered.
    """
    stamp = F.struct("event_time", "event_id")
    named = F.struct("subscription_id", "tier", "billing_cycle", "event_time", "event_id")
    started = F.col("event") == "subscription.activated"
    known = F.col("event").isin("subscription.activated", "subscription.charged", "subscription.cancelled")
    now = events.where(known).groupBy(key).agg(F.max_by(F.when(started, named), F.when(started, stamp)).alias("new"),
                                               F.min(F.struct("event_time", "event_id", "subscription_id")).alias("first"))
    if state is None:
        old = now.select(key, F.lit(None).cast("struct<subscription_id:string,tier:string,billing_cycle:string,activated_at:timestamp,"
                                               "last_charge:timestamp,cancelled:boolean>").alias("old"))
    else:
        old = state.select(key, F.struct(*STATE).alias("old"))
    base = old.join(now, key, "full_outer").select(
        key, "new", "old", F.coalesce("new.subscription_id", "old.subscription_id", "first.subscription_id").alias("current"))
    after = events.join(base.select(key, F.col("current").alias("_c"), F.struct("new.event_time", "new.event_id").alias("_since"),
                                    F.col("new").isNotNull().alias("_new")), key)
    after = after.where((F.col("subscription_id") == F.col("_c")) & (~F.col("_new") | (stamp > F.col("_since"))))
    stops = after.where(F.col("event") == "subscription.cancelled").groupBy(key).agg(F.min(stamp).alias("stop"))
    charges = after.where(F.col("event") == "subscription.charged").join(stops, key, "left").where(F.col("stop").isNull() | (stamp < F.col("stop")))
    charges = charges.groupBy(key).agg(F.max("event_time").alias("charge"))
    out = base.join(stops, key, "left").join(charges, key, "left")
    fresh = F.col("new").isNotNull()
    gone = ~fresh & F.coalesce("old.cancelled", F.lit(False))
    return out.select(
        key, F.col("current").alias("subscription_id"), F.when(fresh, F.col("new.tier")).otherwise(F.col("old.tier")).alias("tier"),
        F.when(fresh, F.col("new.billing_cycle")).otherwise(F.col("old.billing_cycle")).alias("billing_cycle"),
        F.when(fresh, F.col("new.event_time")).otherwise(F.col("old.activated_at")).alias("activated_at"),
        F.when(fresh, F.col("charge")).otherwise(F.coalesce(F.when(~gone, F.col("charge")), F.col("old.last_charge"))).alias("last_charge"),
        (gone | F.col("stop").isNotNull()).alias("cancelled"))


def fold_payments(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users with the tier, billing cycle, expiry and subscription flag their payment events lead to.

    ``users`` has the ``subscription_id`` they start with. An activation or a charge sets the expiry.
    """
    none = F.lit(None).cast("timestamp")
    start = users.select(F.col("id").alias("user_id"), "subscription_id", F.col("subscription_tier").alias("tier"), "billing_cycle",
                         none.alias("activated_at"), none.alias("last_charge"), F.lit(False).alias("cancelled"))
    state = fold_events(events, start).withColumnsRenamed({"user_id": "id", **{c: f"_{c}" for c in STATE}})
    out = users.join(state, "id", "left")
    annual = F.coalesce(F.col("_billing_cycle") == "annual", F.lit(False))
    days = F.when(annual, CHARGE_DAYS["annual"]).otherwise(CHARGE_DAYS["monthly"])
    expiry = F.coalesce("_last_charge", "_activated_at") + F.make_dt_interval(days)
    return out.withColumns({
        "subscription_expires_at": F.coalesce(expiry, "subscription_expires_at"),
        "subscription_tier": F.col("_tier"), "billing_cycle": F.col("_billing_cycle"),
        "subscription_id": F.when(~F.col("_cancelled"), F.col("_subscription_id")),
        "has_subscription": ~F.coalesce("_cancelled", F.lit(False)),
    }).drop(*(f"_{c}" for c in STATE))


# --- library ----------------------------------------------------------------


def bookmarks_with_emails(bookmarks: DataFrame, emails: DataFrame) -> DataFrame:
    """Bookmarks with their mail, newest bookmark first."""
    mail = emails.select(F.col("id").alias("email_id"), "subject", "brand", "type", "industry", "received_at")
    return bookmarks.join(mail, "email_id").orderBy(F.desc("created_at"), "user_id", "email_id")


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Every collection with its number of mails (0 kept)."""
    n = counts(members, "collection_id", "email_count").withColumnRenamed("collection_id", "id")
    return collections.join(n, "id", "left").withColumn("email_count", F.coalesce("email_count", F.lit(0)))


def collection_emails(members: DataFrame, emails: DataFrame, collection_id: int | None = None) -> DataFrame:
    """Mails of one collection (or all), newest addition first."""
    rows = members if collection_id is None else members.where(F.col("collection_id") == collection_id)
    mail = emails.select(F.col("id").alias("email_id"), "subject", "brand", "received_at")
    return rows.join(mail, "email_id").orderBy("collection_id", F.desc("added_at"), "email_id")


def cap_library(library: DataFrame, users: DataFrame, t, feature: str, owner: str = "user_id", group: str | None = None,
                order=("created_at",)) -> DataFrame:
    """The rows of a library each user's plan keeps (the first N of ``group``).

    Limited plans go through a partial group limit at the largest numeric limit, so a hot user
    ships at most that many rows per task; unlimited plans keep all rows.
    """
    limits = dict(zip(dims.PLANS, dims.PLAN_LIMITS[feature]))
    numeric = {p: v for p, v in limits.items() if v is not None}
    plans = effective_plan(users, t).select(F.col("id").alias(owner), "plan")
    rows = library.join(plans, owner)
    cut = None
    for p, v in numeric.items():
        cut = F.when(F.col("plan") == p, v) if cut is None else cut.when(F.col("plan") == p, v)
    tie = [c for c in library.columns if c not in (owner, group, *order)]
    by = [group or owner]
    head = top_n_per(rows.where(F.col("plan").isin(list(numeric))), by, [F.asc(c) for c in (*order, *tie)], max(numeric.values()), "_n")
    free = rows.where(~F.col("plan").isin(list(numeric)))
    return head.where(F.col("_n") <= cut).drop("_n").unionByName(free)


def over_cap(library: DataFrame, users: DataFrame, t, feature: str, owner: str = "user_id", group: str | None = None) -> DataFrame:
    """Per user (or ``group``) the rows beyond the plan's limit, from counts alone."""
    plans = effective_plan(users, t).select(F.col("id").alias(owner), "plan")
    keys = [owner] if group is None else [owner, group]
    tally = counts(library, keys).join(plans, owner)
    limit = None
    for p, v in zip(dims.PLANS, dims.PLAN_LIMITS[feature]):
        if v is not None:
            limit = F.when(F.col("plan") == p, v) if limit is None else limit.when(F.col("plan") == p, v)
    out = tally.withColumn("limit", limit.cast("long"))
    return out.where(F.col("cnt") > F.col("limit")).withColumn("over", F.col("cnt") - F.col("limit"))


def compact_log(log: DataFrame, key, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Current library from an add / remove log: the latest operation of each key wins."""
    keys = [key] if isinstance(key, str) else list(key)
    last = log.groupBy(*keys).agg(F.max_by(F.struct("op", F.col(ts).alias("at")), F.struct(ts, seq)).alias("_l"))
    return last.where(F.col("_l.op") == "add").select(*keys, F.col("_l.at").alias("created_at"))
