"""Archive and window statistics (rankings, digests, trends, timing) in long form.

Brand rankings follow one pattern: one wide aggregate per brand, exploded into
(section, sort key) rows, then the first rows of every section. The mails are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism.functions.scalars import DAY_NAMES, pct, per_week, ratio, snippet
from mailprism.functions.subjects import (
    CASUAL_PARTS, TIP_PERSONAL_PARTS, contains_any_ci, has_digit, has_emoji, is_all_caps, is_urgent,
    keywords, mentions_discount, mentions_off, tactic,
)
from mailprism.operators.filters import active_window, in_active_window
from mailprism.operators.ranking import counts, has_brand, hash_sample, tally_cells, top_n_per

SUNDAY_FIRST = [DAY_NAMES[-1], *DAY_NAMES[:-1]]

# Minimum group sizes, list lengths and thresholds of the reports.
ARCHIVE_MIN = 20
OUTLIER_MIN = 10
CONTRARIAN_MIN = 5
SPOTLIGHT_MIN = 3


def _ts(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")


def _int_pct(num, den) -> Column:
    return pct(num, den, 0).cast("long")


def _sql_pct(num, den) -> Column:
    """Percentage with SQL rounding (half away from zero); null for an empty group."""
    return F.round(100.0 * ratio(num, den), 1)


def _sql_avg(total, n) -> Column:
    return F.round(ratio(total, n), 1)


def _since(df, t, days) -> Column:
    return active_window(df, t, days).select("since").scalar()


def _window_days(df, t, days) -> Column:
    """Whole days of the active window, at least 1."""
    return F.greatest(active_window(df, t, days).select("days").scalar(), F.lit(1))


def _mails(col=None) -> Column:
    return F.count(F.lit(1)) if col is None else F.count_if(col)


def _sections(df: DataFrame, sections: dict, limits: dict, key: str = "brand", carry=()) -> DataFrame:
    """Rank brand-level rows per section.

    ``sections`` maps a name to (condition, sort value ascending, number, second number);
    ``limits`` gives the rows kept, None for all of them. ``carry`` names further columns
    of the aggregate: referencing them in every branch keeps the branches' aggregates equal,
    so Spark runs the aggregate once and reuses its exchange.
    """
    def entry(name, spec):
        cond, order, number, extra = spec
        row = F.struct(
            F.lit(name).alias("section"), F.col(key).alias("item"), order.cast("double").alias("sort_key"),
            number.cast("double").alias("value"), extra.cast("double").alias("extra"), *carry)
        return F.when(cond, row)

    rows = df.select(F.inline(F.array_compact(F.array(*[entry(n, s) for n, s in sections.items()]))))
    order = [F.asc("sort_key"), F.asc_nulls_first("item")]
    capped = [n for n in sections if limits.get(n) is not None]
    most = max(limits[n] for n in capped)
    cut = None
    for n in capped:
        cut = F.when(F.col("section") == n, limits[n]) if cut is None else cut.when(F.col("section") == n, limits[n])
    ranked = top_n_per(rows.where(F.col("section").isin(capped)), "section", order, most).where(F.col("rank") <= cut)
    out = ranked.select("section", "rank", "item", "value", "extra")
    free = [n for n in sections if limits.get(n) is None]
    if free:
        whole = rows.where(F.col("section").isin(free))
        out = out.unionByName(whole.select("section", F.lit(None).cast("int").alias("rank"), "item", "value", "extra"))
    return out


def _long(one: DataFrame, section: str, cols) -> DataFrame:
    """One-row frame as (section, rank, item, value, extra) rows, one per column."""
    rows = [
        F.struct(F.lit(section).alias("section"), F.lit(n + 1).alias("rank"), F.lit(c).alias("item"),
                 F.col(c).cast("double").alias("value"), F.lit(None).cast("double").alias("extra"))
        for n, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


# --- totals and digests -----------------------------------------------------


def totals(df: DataFrame, t=None, days: int | None = None) -> DataFrame:
    """Mails and distinct brands, all time or in the active window."""
    rows = df if t is None else in_active_window(df, t, days or 7)
    return rows.agg(_mails().alias("emails"), F.count_distinct("brand").alias("brands"))


def top_brand_subjects(df: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent brands with their newest subject (60 characters)."""
    newest = F.max_by("subject", F.struct("received_at", -F.col("id")))
    rows = df.where(has_brand()).groupBy("brand").agg(_mails().alias("cnt"), snippet(newest).alias("snippet"))
    return top_n_per(rows, None, [F.desc("cnt"), F.asc("brand")], n)


def daily_digest(df: DataFrame, t, n: int = 5) -> DataFrame:
    label = active_window(df, t, 1).select("label").scalar()
    return top_brand_subjects(in_active_window(df, t, 1), n).withColumn("window", label)


def weekly_digest(df: DataFrame, t) -> DataFrame:
    """One row: window, totals, top brand, trending type."""
    rows = in_active_window(df, t, 7)
    cells = rows.groupBy("brand", "type").agg(_mails().alias("cnt"))

    def best(col):
        rows = tally_cells(cells, col)
        return rows.agg(F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("item").alias("v")))["v"].alias("v")).scalar()

    one = cells.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("emails"), F.count_distinct("brand").alias("brands"))
    return one.select(
        active_window(df, t, 7).select("label").scalar().alias("window"), "emails", "brands",
        F.coalesce(best("brand"), F.lit("N/A")).alias("top_brand"),
        F.coalesce(best("type"), F.lit("Newsletter")).alias("trending_type"))


def weekly_digest_samples(df: DataFrame, t, n: int = 5, seed: str = "0") -> DataFrame:
    rows = in_active_window(df, t, 7).where(F.col("subject").isNotNull())
    return hash_sample(rows, n, seed).select("sample_no", "brand", snippet("subject").alias("subject"))


def brand_spotlight(df: DataFrame, t, brand: str | None = None) -> DataFrame:
    """Brands with at least three mails in the window: favourite weekday, average subject length."""
    rows = in_active_window(df, t, 7).where(has_brand())
    if brand is not None:
        rows = rows.where(F.col("brand") == brand)
    cells = rows.groupBy("brand", F.weekday("received_at").alias("day")).agg(
        _mails().alias("cnt"), F.sum(F.coalesce(F.length("subject"), F.lit(0))).alias("chars"))
    out = cells.groupBy("brand").agg(
        F.sum("cnt").alias("emails"), F.sum("chars").alias("chars"),
        F.min(F.struct((-F.col("cnt")).alias("neg"), "day"))["day"].alias("day"))
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return out.where(F.col("emails") >= SPOTLIGHT_MIN).select(
        "brand", "emails", F.get(names, F.col("day")).alias("favourite_day"),
        F.bround(ratio("chars", "emails"), 0).cast("long").alias("avg_subject_length"))


def spotlight_samples(df: DataFrame, n: int = 8, seed: str = "0") -> DataFrame:
    rows = df.where(has_brand() & F.col("subject").isNotNull())
    return hash_sample(rows, n, seed, by="brand").select("brand", "sample_no", F.left("subject", F.lit(70)).alias("subject"))


def subject_rates(df: DataFrame, t) -> DataFrame:
    """One row: share of questions, emoji, digits and urgency words in whole percent."""
    rows = in_active_window(df, t, 7).where(F.col("subject").isNotNull())
    hits = {
        "questions": F.contains("subject", F.lit("?")),
        "with_emoji": has_emoji("subject", "plane"),
        "with_numbers": has_digit("subject"),
        "with_urgency": is_urgent("subject", "rates"),
    }
    one = rows.agg(_mails().alias("total"), *[_mails(c).alias(n) for n, c in hits.items()])
    return one.select("total", *hits, *[_int_pct(n, "total").alias(f"{n}_pct") for n in hits])


# --- archive statistics -----------------------------------------------------


def archive_stats(df: DataFrame) -> DataFrame:
    """The archive report in long form (section, rank, item, value, extra)."""
    rows = df.where(F.col("subject").isNotNull())
    per_brand = rows.groupBy("brand").agg(
        _mails().alias("cnt"),
        F.sum(F.length("subject")).alias("chars"),
        _mails(F.contains("subject", F.lit("!"))).alias("exclaimed"),
        _mails(F.contains("subject", F.lit("?"))).alias("asked"),
        _mails(mentions_off("subject")).alias("discounted"),
        _mails(is_urgent("subject", "archive")).alias("urgent"),
        _mails(is_all_caps("subject")).alias("capped"),
        _mails(contains_any_ci("subject", CASUAL_PARTS)).alias("casual"))
    cnt, avg_len = F.col("cnt"), _sql_avg("chars", "cnt")
    excl_pct, caps_pct = _sql_pct("exclaimed", "cnt"), _sql_pct("capped", "cnt")
    branded = F.col("brand").isNotNull()
    big = branded & (cnt >= ARCHIVE_MIN)
    none = F.lit(None)
    ranked = _sections(
        per_brand,
        {
            "top_brands": (branded, -cnt, cnt, avg_len),
            "zero_exclamation": (big & (F.col("exclaimed") == 0), -cnt, cnt, none),
            "most_exclamation": (big, -excl_pct, excl_pct, cnt),
            "shortest_subjects": (big, avg_len, avg_len, cnt),
            "longest_subjects": (big, -avg_len, avg_len, cnt),
            "all_caps": (big, -caps_pct, caps_pct, cnt),
            "casual": (F.col("casual") > 0, -F.col("casual"), F.col("casual"), none),
        },
        {"top_brands": 10, "zero_exclamation": None, "most_exclamation": 5, "shortest_subjects": 5,
         "longest_subjects": 5, "all_caps": 5, "casual": 5},
        carry=("asked", "discounted", "urgent"),
    )
    sums = ("cnt", "chars", "exclaimed", "asked", "discounted", "urgent", "capped", "casual")
    whole = per_brand.agg(*[F.sum(c).alias(c) for c in sums], F.count("brand").alias("brands")).where("cnt + capped + casual >= 0")
    whole = whole.select(
        F.col("cnt").alias("emails"), _sql_avg("chars", "cnt").alias("avg_subject_length"), "brands",
        _sql_pct("discounted", "cnt").alias("discount_pct"), _sql_pct("exclaimed", "cnt").alias("exclamation_pct"),
        _sql_pct("asked", "cnt").alias("question_pct"), _sql_pct("urgent", "cnt").alias("urgency_pct"))
    return ranked.unionByName(_long(whole, "totals", whole.columns))


def short_subjects(df: DataFrame, n: int = 25, low: int = 3, high: int = 20) -> DataFrame:
    """The shortest subjects between ``low`` and ``high`` characters."""
    size = F.length("subject")
    rows = df.where(size.between(low, high))
    return top_n_per(rows, None, [size.asc(), F.asc("id")], n).select("rank", "id", "brand", "subject")


def brand_subject_samples(df: DataFrame, brands: list[str], n: int = 10, seed: str = "0") -> DataFrame:
    rows = df.where(F.col("brand").isin(brands) & F.col("subject").isNotNull())
    return hash_sample(rows, n, seed, by="brand").select("brand", "sample_no", "id", "subject")


# --- brand strategy ---------------------------------------------------------


def brand_strategy(df: DataFrame, t, brand: str | None = None) -> DataFrame:
    """Type mix in the window, industry, rate and average subject length of all brands.

    A named brand needs five mails in the window, others ten.
    """
    inside = F.col("received_at") >= _since(df, t, 30)
    rows = df.where(has_brand())
    if brand is not None:
        rows = rows.where(F.col("brand") == brand)
    # number buffers only on the mails (hash aggregation); the text minimum is taken on cells
    cells = rows.groupBy("brand", "type", "industry").agg(
        _mails(inside).alias("cnt"), F.sum(F.length("subject")).alias("chars"), F.count("subject").alias("subjects"))
    cells = cells.groupBy("brand", "type").agg(*[F.sum(c).alias(c) for c in ("cnt", "chars", "subjects")], F.min("industry").alias("industry"))
    kind = F.when(F.col("type").isNotNull() & (F.col("cnt") > 0),
                  F.struct((-F.col("cnt")).alias("neg"), F.col("type").alias("item"), "cnt"))
    out = cells.groupBy("brand").agg(
        F.sum("cnt").alias("total"), F.sum("chars").alias("chars"), F.sum("subjects").alias("subjects"),
        F.coalesce(F.min("industry"), F.lit("DTC/Ecommerce")).alias("industry"),
        F.array_sort(F.collect_list(kind)).alias("types"))
    need = 10 if brand is None else 5
    return out.where(F.col("total") >= need).select(
        "brand", "industry", "total", per_week("total", mode="window", days=_window_days(df, t, 30)).alias("emails_per_week"),
        F.coalesce(F.bround(ratio("chars", "subjects"), 0), F.lit(0.0)).cast("long").alias("avg_subject_length"),
        F.coalesce(F.get("types", 0)["item"], F.lit("Newsletter")).alias("top_type"), "types")


def brand_difference(df: DataFrame, t, a: str, b: str) -> DataFrame:
    """First difference that holds between two brands: rate, length of all their subjects or type."""
    rows = df.where(F.col("brand").isin(a, b))
    cells = rows.groupBy("brand", "type", "industry").agg(
        _mails(F.col("received_at") >= _since(df, t, 30)).alias("recent"), _mails().alias("cnt"),
        F.sum(F.length("subject")).alias("chars"), F.count("subject").alias("subjects"))
    cells = cells.groupBy("brand", "type").agg(*[F.sum(c).alias(c) for c in ("recent", "cnt", "chars", "subjects")], F.min("industry").alias("industry"))
    vote = F.when(F.col("type").isNotNull(), F.struct((-F.col("cnt")).alias("neg"), F.col("type").alias("v")))
    out = cells.groupBy("brand").agg(
        F.sum("recent").alias("total"), F.sum("chars").alias("chars"), F.sum("subjects").alias("subjects"),
        F.coalesce(F.min(vote)["v"], F.lit("Unknown")).alias("top_type"),
        F.coalesce(F.min("industry"), F.lit("DTC/Ecommerce")).alias("industry"))
    facts = out.select(
        "brand", F.struct(
            per_week("total", mode="window", days=_window_days(df, t, 30)).alias("rate"),
            F.coalesce(F.bround(ratio("chars", "subjects"), 0), F.lit(0.0)).cast("long").alias("length"),
            "top_type", "industry").alias("f"))
    one = facts.agg(F.max(F.when(F.col("brand") == a, F.col("f"))).alias("a"), F.max(F.when(F.col("brand") == b, F.col("f"))).alias("b"))
    one = one.where("a IS NOT NULL AND b IS NOT NULL")
    diff = (
        F.when(F.abs(F.col("a.rate") - F.col("b.rate")) > 1, "send frequency")
        .when(F.abs(F.col("a.length") - F.col("b.length")) > 10, "subject line length")
        .when(F.col("a.top_type") != F.col("b.top_type"), "email types")
        .otherwise("overall email strategy approach"))
    return one.select(
        F.lit(a).alias("brand_a"), F.lit(b).alias("brand_b"), diff.alias("difference"),
        F.col("a.rate").alias("rate_a"), F.col("b.rate").alias("rate_b"),
        F.col("a.length").alias("length_a"), F.col("b.length").alias("length_b"),
        F.col("a.top_type").alias("type_a"), F.col("b.top_type").alias("type_b"),
        F.col("a.industry").alias("industry"))


def teardown(df: DataFrame, t) -> DataFrame:
    """Per brand with three mails in the window: newest mail, its type and tactic, rate."""
    newest = F.max_by(F.struct("id", "subject", "type"), F.struct("received_at", -F.col("id")))
    rows = in_active_window(df, t, 7).where(has_brand())
    out = rows.groupBy("brand").agg(_mails().alias("cnt"), newest.alias("m")).where(F.col("cnt") >= SPOTLIGHT_MIN)
    return out.select(
        "brand", F.coalesce("m.type", F.lit("Promotional")).alias("type"), F.col("m.subject").alias("subject"),
        tactic("m.subject").alias("tactic"),
        per_week("cnt", mode="window", days=_window_days(df, t, 7)).alias("emails_per_week"))


def sample_per_brand(df: DataFrame) -> DataFrame:
    """Newest mail of every brand, as a sample for a labeller."""
    newest = F.max_by(F.struct("id", "subject", "preview"), F.struct("received_at", -F.col("id")))
    out = df.where(has_brand()).groupBy("brand").agg(newest.alias("m"))
    return out.select("brand", F.col("m.id").alias("id"), F.col("m.subject").alias("subject"), F.col("m.preview").alias("preview"))


# --- trends -----------------------------------------------------------------


def type_changes(df: DataFrame, t) -> DataFrame:
    """Types of the last seven days whose count changed by at least 10 % on the seven before."""
    now, week = _ts(t), F.make_dt_interval(F.lit(7))
    ts = F.col("received_at")
    rows = df.where((ts >= now - week - week) & (ts < now) & F.col("type").isNotNull())
    out = rows.groupBy("type").agg(_mails(ts >= now - week).alias("this_count"), _mails(ts < now - week).alias("last_count"))
    change = F.bround(F.try_divide((F.col("this_count") - F.col("last_count")).cast("double"), F.col("last_count")) * 100, 0)
    out = out.where((F.col("this_count") > 0) & (F.col("last_count") > 0)).withColumn("change_pct", change.cast("long"))
    return out.where(F.abs("change_pct") >= 10)


def weekly_roundup(df: DataFrame, t, n: int = 3) -> DataFrame:
    """Biggest type change of the rolling week and its top brands (no change: top brands overall)."""
    now, week = _ts(t), F.make_dt_interval(F.lit(7))
    best = type_changes(df, t).agg(F.max_by(F.struct("type", "change_pct"), F.struct(F.abs("change_pct"), "this_count")).alias("b"))
    kind = best.select("b.type").scalar()
    rows = df.where((F.col("received_at") >= now - week) & has_brand())
    rows = rows.where(kind.isNull() | (F.col("type") == kind))
    top = top_n_per(counts(rows, "brand"), None, [F.desc("cnt"), F.asc("brand")], n)
    change = best.select("b.change_pct").scalar()
    return top.select(
        kind.alias("type"), change.alias("change_pct"),
        F.when(change > 0, "more").when(change < 0, "fewer").alias("direction"), "rank", "brand", "cnt")


def month_trends(df: DataFrame, t) -> DataFrame:
    """This month against last month: volume (from 5 %) and three subject rates (from 2 points)."""
    month = F.date_trunc("month", _ts(t))
    before = month - F.make_ym_interval(F.lit(0), F.lit(1))
    ts = F.col("received_at")
    rows = df.where(ts >= before).withColumn("_now", ts >= month)
    low_hits = {
        "urgency language": is_urgent("subject", "trend"),
        "discount mentions": mentions_discount("subject"),
        "question marks in subjects": F.contains("subject", F.lit("?")),
    }
    aggs = []
    for side, cond in (("this", F.col("_now")), ("last", ~F.col("_now"))):
        aggs += [_mails(cond).alias(f"n_{side}"), _mails(cond & F.col("subject").isNotNull()).alias(f"s_{side}")]
        aggs += [_mails(cond & hit).alias(f"h{k}_{side}") for k, hit in enumerate(low_hits.values())]
    one = rows.agg(*aggs)
    volume = F.bround(F.try_divide((F.col("n_this") - F.col("n_last")).cast("double"), F.col("n_last")) * 100, 0)
    lines = [F.when((F.col("n_this") > 0) & (F.col("n_last") > 0) & (F.abs(volume) >= 5), F.struct(
        F.lit(1).alias("pos"), F.lit("volume").alias("metric"), F.when(volume > 0, "up").otherwise("down").alias("direction"),
        F.col("n_this").cast("double").alias("this_month"), F.col("n_last").cast("double").alias("last_month"), F.abs(volume).alias("change")))]
    for k, name in enumerate(low_hits):
        this, last = _sql_pct(f"h{k}_this", "s_this"), _sql_pct(f"h{k}_last", "s_last")
        diff = F.round(this - last, 1)
        keep = (this != 0) & (last != 0) & (F.abs(diff) >= 2)
        lines.append(F.when(keep, F.struct(
            F.lit(k + 2).alias("pos"), F.lit(name).alias("metric"), F.when(diff > 0, "up").otherwise("down").alias("direction"),
            this.alias("this_month"), last.alias("last_month"), F.abs(diff).alias("change"))))
    return one.select(F.inline(F.array_compact(F.array(*lines))))


def outlier_brands(df: DataFrame, t) -> DataFrame:
    """Brands off the norm in the window, in long form (section, rank, item, value, extra)."""
    rows = in_active_window(df, t, 30).where(has_brand())
    per_brand = rows.groupBy("brand").agg(
        _mails().alias("mails"), F.count("subject").alias("cnt"), F.sum(F.length("subject")).alias("chars"),
        _mails(F.contains("subject", F.lit("!"))).alias("exclaimed"), _mails(mentions_discount("subject")).alias("discounted"))
    cnt, none = F.col("cnt"), F.lit(None)
    big = cnt >= OUTLIER_MIN
    avg_len = _sql_avg("chars", "cnt")
    rate = per_week("mails", mode="window", days=F.col("_days"))
    return _sections(
        per_brand.withColumn("_days", _window_days(df, t, 30)),
        {
            "zero_exclamation": (big & (F.col("exclaimed") == 0), -cnt, cnt, none),
            "shortest_subjects": (big, avg_len, avg_len, none),
            "most_frequent": (F.col("mails") > 0, -F.col("mails"), F.col("mails"), rate),
            "never_discount": (big & (F.col("discounted") == 0), -cnt, cnt, none),
        },
        {"zero_exclamation": 5, "shortest_subjects": 3, "most_frequent": 3, "never_discount": 3})


def contrarian_points(df: DataFrame, t) -> DataFrame:
    """Shortest subjects, never-discount and never-exclaim brands (five mails in the window)."""
    rows = in_active_window(df, t, 30).where(has_brand() & F.col("subject").isNotNull())
    per_brand = rows.groupBy("brand").agg(
        _mails().alias("cnt"), F.sum(F.length("subject")).alias("chars"),
        _mails(F.contains("subject", F.lit("!"))).alias("exclaimed"), _mails(mentions_discount("subject")).alias("discounted"))
    cnt, none = F.col("cnt"), F.lit(None)
    big = cnt >= CONTRARIAN_MIN
    avg_len = _sql_avg("chars", "cnt")
    return _sections(
        per_brand,
        {
            "shortest_subjects": (big, avg_len, avg_len, none),
            "never_discount": (big & (F.col("discounted") == 0), -cnt, cnt, none),
            "zero_exclamation": (big & (F.col("exclaimed") == 0), -cnt, cnt, none),
        },
        {"shortest_subjects": 5, "never_discount": 5, "zero_exclamation": 5})


def data_points(df: DataFrame, t, n: int = 5) -> DataFrame:
    """Counts, subject rates, top types and top brands of the window in long form."""
    rows = in_active_window(df, t, 30)
    subject = F.col("subject").isNotNull()
    cells = rows.groupBy("brand", "type").agg(
        _mails().alias("mails"), _mails(subject).alias("cnt"), F.sum(F.length("subject")).alias("chars"),
        _mails(F.contains("subject", F.lit("?"))).alias("asked"), _mails(F.contains("subject", F.lit("!"))).alias("exclaimed"),
        _mails(is_urgent("subject", "data_points")).alias("urgent"))
    one = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("mails", "cnt", "chars", "asked", "exclaimed", "urgent")],
                    F.count_distinct("brand").alias("brands"))
    one = one.select(
        F.col("mails").alias("emails"), "brands",
        F.coalesce(F.bround(ratio("chars", "cnt"), 1), F.lit(0.0)).alias("avg_subject_length"),
        pct("asked", "cnt").alias("question_pct"), pct("exclaimed", "cnt").alias("exclamation_pct"), pct("urgent", "cnt").alias("urgency_pct"))

    def top(col, section):
        ranked = top_n_per(tally_cells(cells, col, weight="mails"), None, [F.desc("cnt"), F.asc("item")], n)
        return ranked.select(F.lit(section).alias("section"), "rank", "item", F.col("cnt").cast("double").alias("value"),
                             F.lit(None).cast("double").alias("extra"))

    return _long(one, "totals", one.columns).unionByName(top("type", "top_types")).unionByName(top("brand", "top_brands"))


def tip_points(df: DataFrame, t) -> DataFrame:
    """One row: brands, mails, average subject length, personalised share in the window."""
    rows = in_active_window(df, t, 30)
    one = rows.agg(
        F.count_distinct("brand").alias("brands"), _mails().alias("emails"), F.count("subject").alias("n"),
        F.sum(F.length("subject")).alias("chars"), _mails(contains_any_ci("subject", TIP_PERSONAL_PARTS)).alias("personal"))
    return one.select(
        "brands", "emails", F.coalesce(F.bround(ratio("chars", "n"), 0), F.lit(0.0)).cast("long").alias("avg_subject_length"),
        pct("personal", "n").alias("personalized_pct"))


def timing_patterns(df: DataFrame, t, n: int = 3) -> DataFrame:
    """Peak and lowest weekday with whole-percent share, and the busiest weekend senders."""
    rows = in_active_window(df, t, 30)
    dow = F.dayofweek("received_at") - 1
    cells = rows.groupBy("brand", dow.alias("dow")).agg(_mails().alias("cnt"))
    days = cells.groupBy("dow").agg(F.sum("cnt").alias("cnt"))
    one = days.agg(
        F.sum("cnt").alias("total"),
        F.min(F.struct((-F.col("cnt")).alias("neg"), "dow")).alias("hi"),
        F.max(F.struct((-F.col("cnt")).alias("neg"), "dow")).alias("lo"))
    names = F.array(*[F.lit(d) for d in SUNDAY_FIRST])

    def line(section, pick):
        return F.struct(F.lit(section).alias("section"), F.lit(1).alias("rank"), F.get(names, F.col(f"{pick}.dow")).alias("item"),
                        pct(-F.col(f"{pick}.neg"), "total", 0).alias("value"), F.lit(None).cast("double").alias("extra"))

    heads = one.where("total IS NOT NULL").select(F.inline(F.array(line("peak_day", "hi"), line("lowest_day", "lo"))))
    rest = cells.withColumn("weekend", F.when(F.col("dow").isin(0, 6), F.col("cnt")).otherwise(0))
    weekend = tally_cells(rest, "brand", weight="weekend").where(F.col("cnt") >= 3)
    weekend = top_n_per(weekend, None, [F.desc("cnt"), F.asc("item")], n)
    return heads.unionByName(weekend.select(
        F.lit("weekend_senders").alias("section"), "rank", "item",
        F.col("cnt").cast("double").alias("value"), F.lit(None).cast("double").alias("extra")))


def burst_days(df: DataFrame, t, min_count: int = 3, top: int = 5) -> DataFrame:
    """(brand, day) with at least ``min_count`` mails in the window, the largest first."""
    rows = in_active_window(df, t, 14).where(has_brand())
    tally = counts(rows, ["brand", F.to_date("received_at").alias("day")])
    return top_n_per(tally.where(F.col("cnt") >= min_count), None, [F.desc("cnt"), F.asc("brand"), F.asc("day")], top)


def burst_subjects(df: DataFrame, t, n: int = 3, min_count: int = 3, top: int = 5) -> DataFrame:
    """The first ``n`` subjects (50 characters) of each burst day."""
    bursts = burst_days(df, t, min_count, top).select("brand", "day", "cnt", F.col("rank").alias("burst_rank"))
    rows = df.where(F.col("subject").isNotNull()).withColumn("day", F.to_date("received_at")).join(bursts, ["brand", "day"])
    first = top_n_per(rows, ["brand", "day"], [F.asc("received_at"), F.asc("id")], n)
    return first.select("brand", "day", "cnt", "burst_rank", "rank", snippet("subject", 50).alias("subject"))


# --- candidate pools and topics ---------------------------------------------


def spotlight_candidates(df: DataFrame, t, seed: str = "0") -> DataFrame:
    """Pools of standout subjects (ten short, ten questions, the urgent ones of a sample of 30);
    any five when all pools are empty. A mail may appear in several pools.

    One pass: every mail is listed under the pools it fits, and each pool keeps its first mails
    in hash order.
    """
    rows = in_active_window(df, t, 7).where(F.col("subject").isNotNull())
    fits = {"short": F.length("subject").between(5, 30), "question": F.contains("subject", F.lit("?")), "sample": F.lit(True)}
    listed = rows.select("id", "brand", "type", "subject", F.explode(
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fits.items()]))).alias("pool"))
    drawn = hash_sample(listed, 30, seed, by="pool")
    drawn = drawn.where((F.col("pool") == "sample") | (F.col("sample_no") <= 10))
    urgent = is_urgent("subject", "spotlight")
    pools = F.when(F.col("pool") != "sample", F.array("pool")).otherwise(F.array_compact(F.array(
        F.when(urgent, F.lit("urgency")), F.when(F.col("sample_no") <= 5, F.lit("any")))))
    named = drawn.withColumn("_pools", pools).drop("pool").withColumn("pool", F.explode("_pools")).drop("_pools")
    found = F.count_if(F.col("pool") != "any").over(Window.partitionBy())  # at most 55 rows
    out = named.withColumn("_found", found).where((F.col("pool") != "any") | (F.col("_found") == 0))
    return out.select(
        "pool", "sample_no", "id", F.coalesce("brand", F.lit("Unknown")).alias("brand"), "subject",
        F.coalesce("type", F.lit("Promotional")).alias("type"), tactic("subject").alias("tactic"))


def topic_match(df: DataFrame, texts: DataFrame, t, limit: int = 10, per_keyword: int = 5, n_keywords: int = 5,
                seed: str = "0") -> DataFrame:
    """For every (text_id, text) mails whose subject contains one of its first keywords.

    The substring test is an equi join: a keyword has letters only, so it can only occur inside
    a run of letters. The first ``per_keyword`` mails of a keyword (hash order) are among the first
    ones of the runs that contain it, so every run is cut to that many mails before any join;
    the distinct runs are then expanded to substrings and matched with the distinct keywords.
    """
    asked = texts.select("text_id", F.posexplode(F.slice(keywords("text"), 1, n_keywords)).alias("kw_pos", "keyword"))
    wanted = asked.select("keyword").distinct()
    longest = wanted.agg(F.max(F.length("keyword"))).scalar()
    rows = in_active_window(df, t, 30).where(F.col("subject").isNotNull() & has_brand())
    runs = F.array_distinct(F.regexp_extract_all(F.lower("subject"), F.lit("[a-z]{3,}"), F.lit(0)))
    columns = ["id", "brand", "subject", "type", "preview", "received_at"]
    by_run = hash_sample(rows.select(*columns, F.explode(runs).alias("run")), per_keyword, seed, by="run").drop("sample_no")

    def parts(run):
        starts = F.sequence(F.lit(1), F.length(run) - 2)
        return F.flatten(F.transform(starts, lambda i: F.transform(
            F.sequence(F.lit(3), F.length(run) - i + 1), lambda n: F.substr(run, i, n))))

    vocabulary = by_run.select("run").distinct().withColumn("_longest", longest)
    subs = F.filter(F.array_distinct(parts(F.col("run"))), lambda s: F.length(s) <= F.col("_longest"))
    pairs = vocabulary.select("run", F.explode(subs).alias("keyword")).join(wanted, "keyword")
    hits = hash_sample(by_run.join(pairs, "run").dropDuplicates(["keyword", "id"]), per_keyword, seed, by="keyword")
    found = asked.join(hits, "keyword")
    by_subject = top_n_per(found, ["text_id", "subject"], [F.asc("kw_pos"), F.asc("sample_no")], 1, "_r").drop("_r")
    out = top_n_per(by_subject, "text_id", [F.asc("kw_pos"), F.asc("sample_no")], limit)
    return out.select(
        "text_id", "rank", "keyword", "id", "brand", "subject", F.coalesce("type", F.lit("Promotional")).alias("type"),
        snippet(F.coalesce("preview", F.lit("")), 120).alias("preview"), F.date_format("received_at", "EEEE").alias("day"))


# --- cube -------------------------------------------------------------------


def summary_cube(df: DataFrame, dims=("industry", "brand", "type", "month")) -> DataFrame:
    """Counts and subject characters for every combination of the dimensions.

    Mails are reduced to base cells first; the cube then expands cells, not mails.
    """
    rows = df.withColumn("month", F.date_format("received_at", "yyyy-MM"))
    cells = rows.groupBy(*dims).agg(_mails().alias("_n"), F.sum(F.length("subject")).alias("_c"))
    return cells.cube(*dims).agg(
        F.grouping_id().alias("level"), F.sum("_n").alias("emails"), F.sum("_c").alias("chars"))


def distribution(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Counts (null included) with their share of all rows."""
    everything = df.agg(_mails()).scalar()
    out = counts(df, col).withColumn("pct", F.bround(ratio("cnt", everything) * 100, 1))
    return out if top is None else out.orderBy(F.desc("cnt"), F.asc_nulls_first(col)).limit(top)


def brand_industries(df: DataFrame) -> DataFrame:
    """Per brand its industries and total mails."""
    cells = counts(df.where(has_brand()), ["brand", "industry"])
    out = cells.groupBy("brand").agg(F.array_sort(F.collect_set("industry")).alias("industries"), F.sum("cnt").alias("cnt"))
    return out.orderBy(F.desc("cnt"), "brand")


# --- packs ------------------------------------------------------------------


def _trend_lines(df, t):
    return month_trends(df, t).select(
        F.lit("trends").alias("section"), F.col("pos").alias("rank"),
        F.concat_ws(" ", "metric", "direction", F.col("last_month").cast("string"), F.lit("->"), F.col("this_month").cast("string")).alias("line"))


def _ranked_lines(rows, section):
    return rows.select(
        F.lit(section).alias("section"), F.col("rank"),
        F.concat_ws(" ", "section", "item", F.col("value").cast("string")).alias("line"))


def _sample_lines(df, t, n, section):
    rows = in_active_window(df, t, 30).where(has_brand() & F.col("subject").isNotNull())
    return hash_sample(rows, n).select(
        F.lit(section).alias("section"), F.col("sample_no").alias("rank"),
        F.concat_ws(" | ", "brand", F.coalesce("type", F.lit("Promo")), snippet("subject", 80)).alias("line"))


def _burst_lines(df, t):
    return burst_days(df, t).where("rank <= 3").select(
        F.lit("bursts").alias("section"), "rank", F.concat_ws(" ", "brand", F.col("day").cast("string"), F.col("cnt").cast("string")).alias("line"))


def _topic_lines(df, t, text):
    texts = df.sparkSession.range(1).select(F.col("id").alias("text_id"), F.lit(text).alias("text"))
    return topic_match(df, texts, t).select(
        F.lit("topic").alias("section"), "rank", F.concat_ws(" | ", "brand", "type", "subject").alias("line"))


SECTIONS = {
    "trends": lambda df, t, text: _trend_lines(df, t),
    "outliers": lambda df, t, text: _ranked_lines(outlier_brands(df, t), "outliers"),
    "timing": lambda df, t, text: _ranked_lines(timing_patterns(df, t), "timing"),
    "bursts": lambda df, t, text: _burst_lines(df, t),
    "topic": lambda df, t, text: _topic_lines(df, t, text),
    "examples": lambda df, t, text: _sample_lines(df, t, EXAMPLES, "examples"),
}
EXAMPLES = 8
# Sections of each pack, with the most ranks that it shows (None: all).
PACKS = {
    "counter": {"trends": None, "outliers": None, "timing": None},
    "proof": {"topic": None, "examples": EXAMPLES},
    "playbook": {"trends": None, "bursts": None, "outliers": None, "timing": None},
    "builder": {"outliers": None, "trends": None, "examples": 5},
}


def stat_packs(df: DataFrame, t, styles=tuple(PACKS), text: str | None = None) -> DataFrame:
    """Lines of several statistics for each style: (pack, section, rank, line). A section is computed once, whatever
    number of packs show it."""
    unknown = [x for x in styles if x not in PACKS]
    if unknown:
        raise ValueError(f"unknown pack {unknown[0]!r}; one of {sorted(PACKS)}")
    if "proof" in styles and not text:
        raise ValueError("the proof pack needs a text")
    parts = []
    for section, lines in SECTIONS.items():
        shown = [(style, PACKS[style][section]) for style in styles if section in PACKS[style]]
        if shown:
            packs = F.array(*[F.struct(F.lit(style).alias("pack"), F.lit(most).cast("int").alias("most")) for style, most in shown])
            parts.append(lines(df, t, text).select(F.inline(packs), "section", "rank", "line"))
    return reduce(DataFrame.unionByName, parts).where("most IS NULL OR rank <= most").drop("most")


def stat_pack(df: DataFrame, t, style: str, text: str | None = None) -> DataFrame:
    """The lines of one style."""
    return stat_packs(df, t, (style,), text)
