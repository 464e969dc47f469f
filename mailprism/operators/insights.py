"""Week-over-week insights: scoreboard, send sequences, subject formulas, new tactics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism.functions.scalars import (
    DAY_NAMES, MICROS_PER_DAY, floor_days, mean_len, pct, pct_change, ratio, week_label, week_start,
)
from mailprism.functions.subjects import (
    has_emoji, is_discount, is_personal, overlap_words, subject_formula,
)
from mailprism.operators.ranking import counts, in_months, known_brand, present, top_n_per

TREND_STEP = 20.0  # percent change that counts as rising or falling


def _ts(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")


def weeks_slice(df: DataFrame, t, back: int, known: bool = False) -> DataFrame:
    """Rows of the week of ``t`` and ``back`` weeks before, with ``week_no`` (0 = this week)."""
    start = week_start(_ts(t))
    ts = F.col("received_at")
    low, high = start - F.make_dt_interval(F.lit(7 * back)), start + F.make_dt_interval(F.lit(7))
    rows = in_months(df, low, high).where(
        (ts >= low)
        & (ts < high)
        & F.col("subject").isNotNull()
    )
    if known:
        rows = rows.where(known_brand())
    week_no = F.ceil((F.unix_micros(start) - F.unix_micros(ts)) / F.lit(7.0 * MICROS_PER_DAY))
    return rows.withColumn("week_no", F.greatest(week_no, F.lit(0)).cast("long"))


def trailing(df: DataFrame, t, n: int = 4) -> DataFrame:
    """Rows of the ``n`` weeks before the week of ``t``."""
    return weeks_slice(df, t, n).where(F.col("week_no") > 0)


def weekly_trailing_counts(df: DataFrame, n: int = 4) -> DataFrame:
    """For every week: its mails and the mails of the ``n`` weeks before it."""
    weekly = df.groupBy(week_start("received_at").alias("week")).agg(F.count(F.lit(1)).alias("cnt"))
    weekly = weekly.withColumn("week_no", F.floor(F.datediff("week", F.lit("1970-01-05").cast("date")) / 7).cast("long"))
    frame = Window.orderBy("week_no").rangeBetween(-n, -1)  # one row per calendar week
    return weekly.select(
        week_label("week").alias("week_label"), "cnt",
        F.coalesce(F.sum("cnt").over(frame), F.lit(0)).alias("trailing"))


# --- scoreboard -------------------------------------------------------------


def _week_pair(df: DataFrame, t) -> DataFrame:
    return weeks_slice(df, t, 1)


def week_metrics(df: DataFrame, t) -> DataFrame:
    """One row per week (0 this, 1 last): total, averages, rates, busiest day."""
    day = F.weekday("received_at")
    per_day = _week_pair(df, t).groupBy("week_no", day.alias("day")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum(F.length("subject")).alias("chars"),
        F.count_if(is_discount("subject")).alias("discounts"),
        F.count_if(has_emoji("subject", "insights")).alias("emoji"),
    )
    out = per_day.groupBy("week_no").agg(
        F.sum("cnt").alias("total"), F.sum("chars").alias("chars"), F.sum("discounts").alias("discounts"),
        F.sum("emoji").alias("emoji"), F.sum(F.when(F.col("day") >= 5, F.col("cnt")).otherwise(0)).alias("weekend"),
        F.min(F.struct((-F.col("cnt")).alias("neg"), "day"))["day"].alias("day"))
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return out.select(
        "week_no", "total", mean_len("chars", "total").alias("avg_subject_length"),
        pct("discounts", "total").alias("discount_pct"), pct("emoji", "total").alias("emoji_pct"),
        pct("weekend", "total").alias("weekend_pct"), F.get(names, F.col("day")).alias("busiest_day"))


SCORES = ["total", "avg_subject_length", "discount_pct", "emoji_pct", "weekend_pct"]


def weekly_scoreboard(df: DataFrame, t) -> DataFrame:
    """One row: every metric this week, last week and its change, plus the biggest mover."""
    weeks = week_metrics(df, t)

    def of(week, col):
        return F.max(F.when(F.col("week_no") == week, F.col(col)))

    picks = [of(w, c).alias(f"{c}_{w}") for c in SCORES + ["busiest_day"] for w in (0, 1)]
    one = weeks.agg(*picks)
    cols = [week_label(_ts(t)).alias("week")]
    for c in SCORES:
        this, last = (F.coalesce(F.col(f"{c}_{w}"), F.lit(0)).cast("double") for w in (0, 1))
        cols += [this.alias(f"{c}_this"), last.alias(f"{c}_last"), pct_change(this, last).alias(f"{c}_change")]
    cols += [F.col("busiest_day_0").alias("busiest_day_this"), F.col("busiest_day_1").alias("busiest_day_last")]
    parts = ("brand", "change_pct", "this_count", "last_count")
    mover = biggest_mover(df, t).select(F.struct(*parts).alias("m")).scalar()
    out = one.withColumn("_m", mover)  # one subquery for all four fields
    return out.select(*cols, *[F.col(f"_m.{p}").alias(f"mover_{p}") for p in parts])


def brand_weeks(df: DataFrame, t) -> DataFrame:
    """Mails per known brand this week and last week."""
    return weeks_slice(df, t, 1, known=True).where(present("brand").isNotNull()).groupBy("brand").agg(
        F.count_if(F.col("week_no") == 0).alias("this_count"), F.count_if(F.col("week_no") == 1).alias("last_count"))


def biggest_mover(df: DataFrame, t, min_emails: int = 3) -> DataFrame:
    """Brand with the largest strictly positive rise; ties by name."""
    moved = brand_weeks(df, t).withColumn("change_pct", pct_change("this_count", "last_count"))
    moved = moved.where((F.col("this_count") >= min_emails) & (F.col("change_pct") > 0))
    return moved.orderBy(F.desc("change_pct"), "brand").limit(1)


# --- sequences --------------------------------------------------------------


def longest_runs(df: DataFrame, max_days: int = 7, min_count: int = 3, bucket_minutes: int = 1) -> DataFrame:
    """Per brand the anchor mail time with the most mails in [t, t + max_days + 1 days).

    (brand, anchor, run_count); the earliest anchor wins ties. The count of an anchor is
    rank(t + span) - rank(t), where rank(x) = mails of the brand strictly before x. Ranks are
    taken inside (brand, time bucket) windows and shifted by a running sum over the brand's
    buckets, so a hot brand is split over as many tasks as it has buckets.
    """
    span = F.lit((max_days + 1) * MICROS_PER_DAY)
    width = F.lit(bucket_minutes * 60_000_000)
    micros = F.unix_micros("received_at")
    ticks = df.groupBy("brand", micros.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # n = mails at x; each tick is also a probe at x and one at x + span, both carrying n = 0
    probes = ticks.select("brand", F.inline(F.array(
        F.struct(F.col("x").alias("x"), F.col("n").alias("n"), F.col("x").alias("anchor"), F.lit(-1).alias("sign")),
        F.struct((F.col("x") + span).alias("x"), F.lit(0).cast("long").alias("n"), F.col("x").alias("anchor"), F.lit(1).alias("sign")),
    ))).withColumn("bucket", F.floor(F.col("x") / width).cast("long"))
    per_bucket = probes.groupBy("brand", "bucket").agg(F.sum("n").alias("in_bucket"))
    before = Window.partitionBy("brand").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_bucket.select("brand", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("brand", "bucket").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
    ranked = probes.withColumn("r", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranked = ranked.join(shift, ["brand", "bucket"])
    runs = ranked.groupBy("brand", "anchor").agg(
        F.sum(F.col("sign") * (F.col("r") + F.col("shift"))).alias("run_count"))
    best = F.min(F.struct((-F.col("run_count")).alias("neg"), "anchor"))
    out = runs.groupBy("brand").agg(best.alias("b")).select(
        "brand", F.timestamp_micros(F.col("b.anchor")).alias("anchor"), (-F.col("b.neg")).alias("run_count"))
    return out.where(F.col("run_count") >= min_count)


def sequence_window(df: DataFrame, t) -> DataFrame:
    """Known-brand mails from the start of last week to the end of this week."""
    return weeks_slice(df, t, 1, known=True)


def run_members(df: DataFrame, t, max_days: int = 7, min_count: int = 3, top: int = 20) -> DataFrame:
    """Mails of the ``top`` longest sequences (one per brand) with the sequence's size."""
    rows = sequence_window(df, t)
    runs = longest_runs(rows, max_days, min_count).orderBy(F.desc("run_count"), "brand").limit(top)
    inside = (F.col("received_at") >= F.col("anchor")) & (
        F.unix_micros("received_at") < F.unix_micros("anchor") + F.lit((max_days + 1) * MICROS_PER_DAY))
    return rows.join(runs, "brand").where(inside)  # at most ``top`` rows on the right


def sequence_members(df: DataFrame, t, max_days: int = 7, min_count: int = 3, top: int = 20) -> DataFrame:
    """Mails of the longest sequences with the gap to the previous mail in hours."""
    inside = previous_time(run_members(df, t, max_days, min_count, top), "brand")
    gap = F.bround((F.unix_micros("received_at") - F.unix_micros("prev_at")) / F.lit(3.6e9), 1)
    return inside.withColumn("gap_hours", gap)


def previous_time(df: DataFrame, key: str, bucket: str = "minute") -> DataFrame:
    """Adds ``prev_at``, the time of the previous row of the key (ties by id).

    ``lag`` runs inside (key, minute); the first row of a minute takes the last time of the
    key's previous non-empty minute, so no task sees a whole hot key.
    """
    rows = df.withColumn("_b", F.date_trunc(bucket, "received_at"))
    hours = rows.groupBy(key, "_b").agg(F.max("received_at").alias("_last"))
    across = Window.partitionBy(key).orderBy("_b")
    hours = hours.select(key, "_b", F.lag("_last").over(across).alias("_carry"))
    inside = Window.partitionBy(key, "_b").orderBy("received_at", "id")
    rows = rows.withColumn("_lag", F.lag("received_at").over(inside))
    return rows.join(hours, [key, "_b"]).withColumn("prev_at", F.coalesce("_lag", "_carry")).drop("_b", "_lag", "_carry")


def brand_sequences(df: DataFrame, t, max_days: int = 7, min_count: int = 3, top: int = 20) -> DataFrame:
    """One row per sequence: brand, mails, span in whole days, words shared by all subjects."""
    members = run_members(df, t, max_days, min_count, top)
    spans = members.groupBy("brand").agg(
        F.max("run_count").alias("email_count"),
        floor_days(F.min("received_at"), F.max("received_at")).alias("span_days"))
    words = shared_words(members, "brand", "run_count").groupBy("brand").agg(
        F.array_sort(F.collect_list("word")).alias("w")).select("brand", F.col("w").alias("keyword_overlap"))
    empty = F.array().cast("array<string>")
    return spans.join(words, "brand", "left").withColumn("keyword_overlap", F.coalesce("keyword_overlap", empty))


def shared_words(df: DataFrame, key: str, size: str, n: int = 5) -> DataFrame:
    """Words that occur in every subject of a group, first ``n`` by name.

    Counted as (key, word) over distinct words per mail, so no subject list is collected.
    """
    seen = df.select(key, size, F.explode(overlap_words("subject")).alias("word")).groupBy(key, "word").agg(
        F.count(F.lit(1)).alias("mails"), F.max(size).alias("_size"))
    return top_n_per(seen.where(F.col("mails") == F.col("_size")), key, [F.asc("word")], n)


# --- subject formulas -------------------------------------------------------


def formula_weeks(df: DataFrame, t, n: int = 4) -> DataFrame:
    """(formula, week_no, cnt) for this week and ``n`` before."""
    return counts(weeks_slice(df, t, n).withColumn("formula", subject_formula("subject")), ["formula", "week_no"])


def subject_formulas(df: DataFrame, t, n: int = 4) -> DataFrame:
    """Formula shares this week against the average of the non-empty trailing weeks."""
    tally = formula_weeks(df, t, n)
    is_this = F.col("week_no") == 0
    now = F.coalesce(F.sum(F.when(is_this, F.col("cnt"))), F.lit(0))
    past = F.coalesce(F.sum(F.when(~is_this, F.col("cnt"))), F.lit(0))
    weeks = F.greatest(F.count_distinct(F.when(~is_this, F.col("week_no"))), F.lit(1))
    totals = tally.agg(F.struct(now.alias("now"), past.alias("past"), weeks.alias("weeks")).alias("t")).scalar()
    out = tally.groupBy("formula").agg(now.alias("this_week_count"), past.alias("_past")).withColumn("_t", totals)
    this_pct = pct("this_week_count", F.col("_t.now"))
    avg_pct = pct(ratio("_past", F.col("_t.weeks")), ratio("_t.past", F.col("_t.weeks")))
    out = out.select("formula", "this_week_count", this_pct.alias("this_week_pct"), avg_pct.alias("trailing_avg_pct"))
    out = out.withColumn("change_pct", pct_change("this_week_pct", "trailing_avg_pct"))
    trend = (
        F.when(F.col("change_pct") >= TREND_STEP, "rising")
        .when(F.col("change_pct") <= -TREND_STEP, "falling").otherwise("stable"))
    return out.withColumn("trend", trend)


def formula_examples(df: DataFrame, t, n: int = 3) -> DataFrame:
    """First ``n`` subjects of the week per formula (by time, then id)."""
    rows = weeks_slice(df, t, 0).withColumn("formula", subject_formula("subject"))
    return top_n_per(rows, "formula", [F.asc("received_at"), F.asc("id")], n).select("formula", "rank", "id", "subject")


# --- new tactics ------------------------------------------------------------

SIGNALS = ["emoji_rate", "discount_rate", "question_rate", "personalization_rate", "avg_subject_length"]


def brand_signals(df: DataFrame, t, n: int = 4, min_this: int = 3, min_trailing: int = 5) -> DataFrame:
    """Per brand five signals this week and over the trailing weeks (both with enough mails)."""
    rows = weeks_slice(df, t, n, known=True).withColumn("_now", F.col("week_no") == 0)
    hits = {
        "emoji_rate": has_emoji("subject", "insights"),
        "discount_rate": is_discount("subject"),
        "question_rate": F.contains("subject", F.lit("?")),
        "personalization_rate": is_personal("subject"),
    }
    aggs = []
    for side, cond in (("this", F.col("_now")), ("past", ~F.col("_now"))):
        aggs.append(F.count_if(cond).alias(f"n_{side}"))
        aggs += [F.count_if(cond & hit).alias(f"{name}_{side}") for name, hit in hits.items()]
        aggs.append(F.sum(F.when(cond, F.length("subject")).otherwise(0)).alias(f"chars_{side}"))
    out = rows.groupBy("brand").agg(*aggs).where((F.col("n_this") >= min_this) & (F.col("n_past") >= min_trailing))
    cols = ["brand", "n_this", "n_past"]
    for side in ("this", "past"):
        cols += [pct(f"{name}_{side}", f"n_{side}").alias(f"{name}_{side}") for name in hits]
        cols.append(mean_len(f"chars_{side}", f"n_{side}").alias(f"avg_subject_length_{side}"))
    return out.select(*cols)


def new_tactics(df: DataFrame, t, min_this: int = 3, min_trailing: int = 5, threshold: float = 50, top: int = 30) -> DataFrame:
    """Alerts (brand, signal): appeared, disappeared, spike or drop; the ``top`` most alerted brands."""
    signals = brand_signals(df, t, 4, min_this, min_trailing)
    rows = signals.select("brand", "n_this", "n_past", F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(f"{s}_this").alias("this_week"), F.col(f"{s}_past").alias("trailing_avg"))
        for s in SIGNALS])))
    change = pct_change("this_week", "trailing_avg")
    now, past = F.col("this_week"), F.col("trailing_avg")
    kind = (
        F.when((past == 0) & (now > 0), "appeared")
        .when((past > 0) & (now == 0), "disappeared")
        .when((past > 0) & (F.abs(change) > threshold), F.when(change > 0, "spike").otherwise("drop")))
    alerts = rows.withColumn("change_type", kind).where(F.col("change_type").isNotNull())
    alerts = alerts.withColumn("change_pct", F.when(F.col("change_type").isin("spike", "drop"), change))
    # at most five alerts per brand, so the per-brand array is bounded
    item = F.struct("signal", "this_week", "trailing_avg", "change_type", "change_pct")
    brands = alerts.groupBy("brand", "n_this", "n_past").agg(F.collect_list(item).alias("alerts"))
    brands = brands.withColumn("alert_count", F.size("alerts").cast("long"))
    return brands.orderBy(F.desc("alert_count"), F.desc("n_this"), "brand").limit(top)
