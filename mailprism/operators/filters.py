"""Projections, filters and list views over the e-mail table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions.scalars import floor_days, window_label
from mailprism.functions.subjects import has_emoji
from mailprism.operators.ranking import newest_first, counts, in_months, known_brand

LIST_COLUMNS = ["id", "gmail_id", "subject", "sender", "brand", "category", "type", "industry", "received_at", "preview"]
SEARCH_COLUMNS = ["subject", "preview", "brand", "type", "industry"]

# Windows tried in this order, rows needed, and the start used when none has them.
WINDOW_DAYS = [7, 30, 90, 365, 3650]
WINDOW_MIN_ROWS = 10
ARCHIVE_START = "2000-01-01 00:00:00"


def slim(df: DataFrame) -> DataFrame:
    """List columns only; the scan then never reads HTML."""
    return df.select(*[c for c in LIST_COLUMNS if c in df.columns])


def text_match(q: str, columns=SEARCH_COLUMNS) -> Column:
    """Case-insensitive ``%q%`` over several columns; % and _ in q stay wildcards."""
    return reduce(or_, [F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False)) for c in columns])


def list_emails(df, brand=None, type=None, industry=None, category=None, q=None,
                archive_days=None, t=None, skip=0, limit=None) -> DataFrame:
    """Faceted list, newest first, without HTML."""
    for name, value in {"brand": brand, "type": type, "industry": industry, "category": category}.items():
        if value:
            df = df.where(F.col(name) == value)
    if archive_days is not None:
        df = df.where(F.col("received_at") >= _ts(t) - F.make_dt_interval(F.lit(archive_days)))
    if q:
        df = df.where(text_match(q))
    out = slim(df).orderBy(*newest_first())
    if skip:
        out = out.offset(skip)
    return out if limit is None else out.limit(limit)


def archive_counts(df: DataFrame, depths: dict, t) -> DataFrame:
    """(plan, archive_days, visible): mails inside each plan's archive depth, in one pass.

    ``depths`` maps plan to days; None is unlimited.
    """
    def visible(days):
        if days is None:
            return F.count(F.lit(1))
        return F.count_if(F.col("received_at") >= _ts(t) - F.make_dt_interval(F.lit(days)))

    one = df.agg(*[visible(d).alias(f"_p{n}") for n, d in enumerate(depths.values())])
    rows = [
        F.struct(F.lit(plan).alias("plan"), F.lit(days).cast("long").alias("archive_days"), F.col(f"_p{n}").alias("visible"))
        for n, (plan, days) in enumerate(depths.items())
    ]
    return one.select(F.inline(F.array(*rows)))


def search_text(df: DataFrame, q: str, industry: str | None = None) -> DataFrame:
    """Substring search over subject, brand and preview joined by spaces."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("subject", "brand", "preview")]
    out = df.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(q.lower())))
    return out if industry is None else out.where(F.col("industry") == industry)


def html_for(html: DataFrame, ids: DataFrame, cap: int | None = 50, key: str = "id") -> DataFrame:
    """HTML of the first ``cap`` requested ids."""
    wanted = ids.select(key) if cap is None else ids.select(key).orderBy(key).limit(cap)
    return html.join(wanted, key, "left_semi")


def email_detail(df: DataFrame, email_id: int) -> DataFrame:
    return df.where(F.col("id") == email_id)


def subject_lines(df, brand=None, industry=None, campaign_type=None, limit=100) -> DataFrame:
    """The ``limit`` newest subjects with date, length and emoji flag."""
    for name, value in {"brand": brand, "industry": industry, "type": campaign_type}.items():
        if value:
            df = df.where(F.col(name).ilike(value))
    out = df.orderBy(*newest_first()).limit(limit)
    return out.select(
        "id", "subject", "brand", "industry", F.col("type").alias("campaign_type"),
        F.date_format("received_at", "yyyy-MM-dd").alias("date"),
        F.coalesce(F.length("subject"), F.lit(0)).cast("long").alias("length"),
        F.coalesce(has_emoji("subject", "analytics"), F.lit(False)).alias("has_emoji"),
    )


def mask(df: DataFrame, cols, entitled, sample: Column | None = None) -> DataFrame:
    """Numeric columns as text, 'xx' where the caller is not entitled (a sample row stays open)."""
    allowed = F.lit(entitled) if isinstance(entitled, bool) else entitled
    if sample is not None:
        allowed = allowed | F.coalesce(sample, F.lit(False))
    return df.withColumns({c: F.when(allowed, F.col(c).cast("string")).otherwise("xx") for c in cols})


def unknown_brands(df: DataFrame) -> DataFrame:
    return df.where(F.col("brand").isNull() | F.col("brand").isin("Unknown", "unknown"))


def unlabelled(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows without a type, by id, with the number that remain."""
    todo = df.where(F.col("type").isNull() & F.col("subject").isNotNull())
    remaining = todo.agg(F.count(F.lit(1))).scalar()
    out = todo.orderBy("id")
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.withColumn("remaining", remaining)


def active_window(df: DataFrame, t, preferred_days: int = 1) -> DataFrame:
    """One row (since, days, label): the first window that holds enough rows.

    All candidate windows are counted in one aggregation.
    """
    tries = [preferred_days, *WINDOW_DAYS]
    hits = [
        F.count_if(F.col("received_at") >= F.lit(t).cast("timestamp") - F.make_dt_interval(F.lit(d))).alias(f"_w{n}")
        for n, d in enumerate(tries)
    ]
    one = df.agg(*hits)
    choice = F.coalesce(*[F.when(F.col(f"_w{n}") >= WINDOW_MIN_ROWS, F.lit(d)) for n, d in enumerate(tries)])
    since = F.coalesce(_ts(t) - F.make_dt_interval(F.col("_d")), F.lit(ARCHIVE_START).cast("timestamp"))
    out = one.select(choice.alias("_d")).select(since.alias("since"))
    days = floor_days("since", _ts(t))
    return out.select("since", days.alias("days"), window_label(days).alias("label"))


def in_active_window(df: DataFrame, t, preferred_days: int = 1) -> DataFrame:
    """Rows of the active window (its start is a scalar subquery, no join)."""
    since = active_window(df, t, preferred_days).select("since").scalar()
    return in_months(df, since).where(F.col("received_at") >= since)


def orphan_industries(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Industry values outside the taxonomy with their counts."""
    return counts(df.where(F.col("industry").isNotNull()), "industry").join(taxonomy, "industry", "left_anti")


def queue_list(queue: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Content queue, newest first, with its character count."""
    out = queue if status is None else queue.where(F.col("status") == status)
    out = out.withColumn("char_count", F.length("content").cast("long")).orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def targets(df: DataFrame, category: str | None = None, active_only: bool = True) -> DataFrame:
    """Accounts by follower count, unknown counts last."""
    if category:
        df = df.where(F.col("category") == category)
    if active_only:
        df = df.where("is_active")
    return df.orderBy(F.desc_nulls_last("follower_count"), "handle")


def newest(df: DataFrame, skip: int = 0, limit: int | None = None, ts: str = "created_at") -> DataFrame:
    """Rows newest first, with the total."""
    total = df.agg(F.count(F.lit(1))).scalar()
    out = df.orderBy(F.desc_nulls_last(ts), "id")
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.withColumn("total", total)


def id_dates(df: DataFrame) -> DataFrame:
    return df.select("id", "received_at").orderBy(*newest_first())


def library_ids(library: DataFrame, user_id, col: str) -> DataFrame:
    return library.where(F.col("user_id") == user_id).select(col)


def brands_to_label(df: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Known brands without a cached label (with ``force``: all but manual ones) and a sample e-mail."""
    settled = cache.where(F.col("classified_by") == "manual") if force else cache
    done = settled.select(F.lower("brand_name").alias("_key")).distinct()
    sample = F.max_by(F.struct("id", "subject", "preview"), F.struct("received_at", -F.col("id")))
    brands = df.where(known_brand()).groupBy("brand").agg(sample.alias("s"))
    todo = brands.withColumn("_key", F.lower("brand")).join(done, "_key", "left_anti")
    return todo.select("brand", F.col("s.id").alias("sample_id"), F.col("s.subject").alias("subject"), F.col("s.preview").alias("preview"))


def _ts(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")
