"""Plans, reminders, payments, library caps and keyed stores on small rows."""

from pyspark.sql import functions as F

from conftest import AS_OF
from mailprism import dims
from mailprism.operators import accounts
from mailprism.sources import store

USER = "id long, subscription_tier string, subscription_expires_at string, trial_ends_at string, billing_cycle string, trial_emails_sent string"
EVENT = "event_id long, user_id long, event_time string, event string, subscription_id string, tier string, billing_cycle string"


def users(table, rows):
    df = table(rows, USER)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("subscription_expires_at", "trial_ends_at")})


def test_effective_plan(table):
    rows = users(table, [
        (1, "pro", "2024-01-01", "2024-02-05", None, None), (2, "pro", None, None, None, None), (3, "free", None, "2024-01-30 00:00:01", None, None),
        (4, None, None, None, None, None), (5, "agency", "2024-01-30 00:00:01", "2024-02-05", None, None)])
    got = {r["id"]: (r["plan"], r["is_on_trial"], r["is_pro"]) for r in accounts.effective_plan(rows, AS_OF).collect()}
    assert got == {1: ("starter", True, False), 2: ("pro", False, True), 3: ("starter", True, False), 4: ("free", False, False), 5: ("agency", False, True)}


def test_reminder_windows(table):
    ends = ["2024-02-02 05:00:00", "2024-01-31 01:00:00", "2024-01-30 20:00:00", "2024-01-29 00:00:00", "2024-01-27 00:00:00"]
    rows = users(table, [(n, "free", None, e, None, None) for n, e in enumerate(ends)] + [
        (8, None, None, ends[0], None, None), (9, "free", None, ends[0], None, '["day4"]')])
    got = {r["id"]: (r["reminder"], r["trial_emails_sent"]) for r in accounts.reminder_cohort(rows, AS_OF).collect()}
    assert got == {0: ("day4", '["day4"]'), 1: ("day6", '["day6"]'), 3: ("day8", '["day8"]')}


def payments(table, rows):
    full = [(n, u, t, f"subscription.{e}", s, *(extra or (None, None))) for n, (u, t, e, s, *extra) in enumerate(rows)]
    return table(full, EVENT).withColumn("event_time", F.col("event_time").cast("timestamp"))


PAYMENTS = [
    (7, "2024-01-01", "charged", "a"), (7, "2024-01-05", "cancelled", "a"), (7, "2024-01-09", "charged", "a"),  # nothing after the end
    (8, "2024-01-02", "charged", "b"), (8, "2024-01-03", "paused", "b"),
    (10, "2024-01-02", "charged", "c"), (10, "2024-01-03", "cancelled", "c"), (10, "2024-01-10", "activated", "c2", "starter", "annual"),  # comes back
    (10, "2024-01-12", "charged", "c"), (10, "2024-01-11", "cancelled", "c"),  # of the old one
    (11, "2024-01-02", "activated", "d2", "pro", "monthly"), (11, "2024-01-20", "charged", "d2"), (11, "2024-01-25", "cancelled", "d2"),
]
USERS_BEFORE = [(7, "pro", None, None, "monthly", None), (8, "pro", None, None, "annual", None), (9, "pro", "2024-05-05", None, None, None),
                (10, "pro", None, None, "monthly", None), (11, "free", None, None, None, None)]


def test_payments_by_subscription(table):
    rows = users(table, USERS_BEFORE).withColumn("subscription_id", F.element_at(F.array(*map(F.lit, "abzcd")), (F.col("id") - 6).cast("int")))
    got = {r["id"]: (str(r["subscription_expires_at"])[:10], r["has_subscription"], r["subscription_tier"], r["subscription_id"]) for r in accounts.fold_payments(rows, payments(table, PAYMENTS)).collect()}
    assert got == {7: ("2024-02-05", False, "pro", None), 8: ("2025-01-06", True, "pro", "b"), 9: ("2024-05-05", True, "pro", "z"),
                   10: ("2025-01-14", True, "starter", "c2"), 11: ("2024-02-24", False, "pro", None)}


def test_payments_fold_batch_by_batch(spark, table):
    whole = {r["user_id"]: r.asDict() for r in accounts.fold_events(payments(table, sorted(PAYMENTS, key=lambda r: r[1]))).collect()}
    state, rows = None, sorted(PAYMENTS, key=lambda r: r[1])
    for at in range(0, len(rows), 3):
        found = accounts.fold_events(payments(table, rows[at:at + 3]), state)
        state = spark.createDataFrame(found.collect(), found.schema)
    assert {r["user_id"]: r.asDict() for r in state.collect()} == whole


def test_limits_and_upgrades(spark, table):
    limits = dims.plan_limits_table(spark)
    usage = table([("free", "collections", 5), ("starter", "seats", 0), ("pro", "alerts", 9), ("agency", "alerts", 9), ("free", "ai_generator", 0)], "plan string, feature string, used long")
    got = {(r["plan"], r["feature"]): (r["allowed"], r["remaining"], r["upgrade_to"]) for r in accounts.limit_check(usage, limits).collect()}
    assert got == {("free", "collections"): (False, 0, "starter"), ("starter", "seats"): (True, 1, "pro"), ("pro", "alerts"): (False, 0, "agency"),
                   ("agency", "alerts"): (True, None, None), ("free", "ai_generator"): (False, 0, "pro")}


def test_library_cap_keeps_first_rows(table):
    rows = users(table, [(1, "free", None, None, None, None), (2, "pro", None, None, None, None)])
    lib = table([(u, f"b{n}", f"2024-01-{n + 1:02d}") for u in (1, 2) for n in range(6)], "user_id long, brand_name string, created_at string")
    kept = accounts.cap_library(lib, rows, AS_OF, "follows").collect()
    assert sorted(r["brand_name"] for r in kept if r["user_id"] == 1) == ["b0", "b1", "b2"]
    assert sum(r["user_id"] == 2 for r in kept) == 6
    assert [(r["user_id"], r["over"]) for r in accounts.over_cap(lib, rows, AS_OF, "follows").collect()] == [(1, 3)]


def test_append_skips_known_and_repeated(table):
    stored = table([("a",)], "gmail_id string")
    batch = table([("a", 1), ("b", 2), ("b", 3)], "gmail_id string, n long")
    new, report = store.append_new(stored, batch, order=["n"])
    assert [tuple(r) for r in new.collect()] == [("b", 2)]
    assert tuple(report.collect()[0]) == (1, 2)


def test_label_upsert(table):
    schema = "brand_name string, industry string, confidence double, classified_by string"
    cache = table([("A", "X", 1.0, "manual"), ("B", "X", 0.9, "keyword"), ("C", "X", 0.9, "ai")], schema)
    new = table([("a", "Y", 0.8, "ai"), ("b", "Y", 0.8, "ai"), ("c", "Y", 0.8, "keyword"), ("D", "Y", 0.8, "keyword")], schema)
    got = {r["brand_name"]: r["industry"] for r in store.merge_classifications(cache, new).collect()}
    assert got == {"A": "X", "B": "Y", "C": "X", "D": "Y"}
    manual = store.set_manual(cache, table([("b", "Z")], "brand_name string, industry string"))
    assert {(r["brand_name"], r["classified_by"]) for r in manual.collect()} == {("A", "manual"), ("C", "ai"), ("b", "manual")}


def test_log_compaction(table):
    log = table([(1, 5, "add", 1, 1), (1, 5, "remove", 2, 2), (1, 6, "add", 1, 3), (2, 5, "remove", 1, 4), (2, 5, "add", 1, 5)], "user_id long, email_id long, op string, ts long, seq long")
    got = {(r["user_id"], r["email_id"]) for r in accounts.compact_log(log, ["user_id", "email_id"]).collect()}
    assert got == {(1, 6), (2, 5)}
