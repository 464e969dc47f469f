"""Sequences, windows, ranking and layout independence."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from mailprism.operators import filters, insights, profiles, ranking, stats


def test_window_of_eight_days_is_open_at_the_end(mails):
    rows = mails([("A", "2024-01-01 00:00:00", "x"), ("A", "2024-01-08 23:59:59", "y"), ("A", "2024-01-09 00:00:00", "z")])
    assert insights.longest_runs(rows, min_count=1).collect()[0]["run_count"] == 2
    assert insights.longest_runs(rows).count() == 0


def brute(rows, span=8 * 86_400, least=3):
    out = {}
    for brand in {r[0] for r in rows}:
        ts = sorted(t for b, t in rows if b == brand)
        best = (0, None)
        for t in ts:
            n = sum(1 for u in ts if t <= u < t + span)
            if n > best[0]:
                best = (n, t)
        if best[0] >= least:
            out[brand] = (best[1], best[0])
    return out


@pytest.mark.parametrize("minutes", [1, 60, 5000])
def test_runs_against_loop(spark, minutes):
    rnd = random.Random(minutes)
    # brand H holds most rows; times repeat and some gaps are exactly eight days
    rows = [("H", 1_700_000_000 + rnd.randrange(14 * 24) * 3600) for _ in range(400)]
    rows += [(b, 1_700_000_000 + rnd.randrange(14 * 86_400)) for b in "ABCDE" for _ in range(rnd.randrange(1, 9))]
    rows += [("Z", 1_700_000_000), ("Z", 1_700_000_000 + 8 * 86_400), ("Z", 1_700_000_000 + 8 * 86_400 - 1)]
    df = spark.createDataFrame(rows, "brand string, s long").select("brand", F.timestamp_seconds("s").alias("received_at"))
    got = {r["brand"]: (r["s"], r["run_count"]) for r in insights.longest_runs(df, bucket_minutes=minutes).withColumn("s", F.unix_seconds("anchor")).collect()}
    assert got == brute(rows)


def test_previous_time_equals_lag(spark, emails):
    from pyspark.sql import Window

    rows = emails.where("brand IS NOT NULL")
    plain = F.lag("received_at").over(Window.partitionBy("brand").orderBy("received_at", "id"))
    a = insights.previous_time(rows, "brand").select("id", "prev_at")
    b = rows.select("id", plain.alias("prev_at"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_diversity_cap(mails):
    rows = mails([("A", f"2024-01-0{9 - k} 00:00:00", "s") for k in range(5)] + [("B", "2024-01-01 00:00:00", "s"), (None, "2024-01-02 00:00:00", "s")])
    got = [(r["brand"], r["rank"]) for r in ranking.diverse_examples(rows).orderBy("rank").collect()]
    assert got == [("A", 1), ("A", 2), (None, 3), ("B", 4)]


def test_active_window_tries_seven_before_thirty(mails):
    recent = [("A", f"2024-01-29 0{k}:00:00", "s") for k in range(9)]
    rows = mails(recent + [("A", "2024-01-24 00:00:00", "s")])
    days = [filters.active_window(rows, AS_OF, p).collect()[0]["days"] for p in (1, 30)]
    assert days == [7, 30]
    few = mails(recent[:2])
    row = filters.active_window(few, AS_OF).collect()[0]
    assert str(row["since"]) == "2000-01-01 00:00:00" and row["label"] == "across our archive"


def test_mover_needs_three_mails_and_a_rise(mails):
    this = [("New", f"2024-01-29 0{k}:00:00", "s") for k in range(3)] + [("Two", "2024-01-29 00:00:00", "s")] * 2
    last = [("Old", "2024-01-23 00:00:00", "s")] * 5
    assert insights.biggest_mover(mails(this + last), AS_OF).collect()[0]["brand"] == "New"
    assert insights.biggest_mover(mails(last), AS_OF).count() == 0


def test_empty_week_gives_zeros(mails):
    row = insights.weekly_scoreboard(mails([("A", "2020-01-01 00:00:00", "s")]), AS_OF).collect()[0]
    assert (row["total_this"], row["total_change"], row["mover_brand"], row["busiest_day_this"]) == (0.0, 0.0, None, None)


def test_spotlight_falls_back_to_any(mails):
    long = "this subject has more than thirty characters in it"
    rows = mails([("A", f"2024-01-29 {k:02d}:00:00", long) for k in range(12)]).withColumn("type", F.lit(None).cast("string"))
    pools = {r["pool"] for r in stats.spotlight_candidates(rows, AS_OF).collect()}
    assert pools == {"any"}


def test_topic_counts_a_keyword_once_per_mail(mails, table):
    rows = mails([("A", f"2024-01-2{k} 00:00:00", "cart carts in your cart") for k in range(9)] + [("B", "2024-01-28 00:00:00", "Coffee")] * 3)
    rows = rows.withColumns({"type": F.lit("Sale"), "preview": F.lit("p")})
    got = stats.topic_match(rows, table([(1, "cart offers")], "text_id long, text string"), AS_OF).collect()
    assert [(r["keyword"], r["subject"]) for r in got] == [("cart", "cart carts in your cart")]


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_layout_does_not_change_results(emails, parts):
    def rows(df):
        return sorted(map(str, df.collect()))

    moved = emails.repartition(parts, F.rand(3))
    for fn in (profiles.brand_profile, profiles.brand_stats, stats.archive_stats, lambda d: insights.brand_sequences(d, AS_OF), lambda d: profiles.similar_emails(d)):
        assert rows(fn(emails)) == rows(fn(moved))


def test_festival_range_ends_at_midnight(mails, spark):
    from mailprism import dims

    fest = dims.festival_table(spark, [("f", "F", ["gift"], {2024: ("2024-01-02", "2024-01-03")})])
    rows = mails([("A", "2024-01-01 23:59:59", "s"), ("A", "2024-01-02 00:00:00", "gift"), ("A", "2024-01-03 00:00:00", "s"), ("A", "2024-01-03 00:00:01", "s")])
    rows = rows.withColumn("type", F.lit("Sale"))
    got = {(r["id"], r["relevant"]) for r in profiles.festival_rows(rows, fest).collect()}
    assert got == {(1, True), (2, True)}


def test_plans_have_no_cross_joins_and_limit_groups_early(emails):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for df in (profiles.similar_emails(emails), profiles.related_brands(emails), stats.archive_stats(emails), insights.brand_sequences(emails, AS_OF)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
    assert "WindowGroupLimit" in plan(profiles.similar_emails(emails))
    assert "ReadSchema: struct<user_id:bigint>" in plan(profiles.value_counts(emails, "brand")) or "html" not in plan(profiles.brand_stats(emails))


def test_festival_counts_go_to_the_mails(mails, spark):
    from mailprism import dims

    rows = mails([("A", f"2024-01-02 10:00:0{n}", "gift" if n < 5 else "x") for n in range(7)] + [("A", "2024-02-02 10:00:00", "x")])
    rows = rows.withColumn("type", F.lit(None).cast("string"))
    fest = dims.festival_table(spark, [("f", "F", ["gift"], {2024: ("2024-01-02 00:00:00", "2024-01-03 00:00:00")}),
                                       ("g", "G", ["gift"], {2024: ("2024-02-02 00:00:00", "2024-02-03 00:00:00")})])
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(kept, ("-1", "false")):  # as with counts over tables that are not known to be small
            spark.conf.set(c, v)
        out = profiles.festival_selection(rows, fest)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {(r["slug"], r["id"]) for r in out.collect()} == {*(("f", n) for n in range(5)), ("g", 7)}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert "BroadcastHashJoin [slug" in plan and "SortMergeJoin [slug" not in plan
