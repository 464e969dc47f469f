"""Message exports, HTML trees, insight store and streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, SMALL
from mailprism.plans import registry
from mailprism.sources import mail, store
from mailprism.streaming import jobs, payments


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def part(kind, text=None, parts=None):
    return {"mimeType": kind, "body": {"data": b64(text)} if text else {}, **({"parts": parts} if parts else {})}


MESSAGES = {
    "plain": part("text/plain", "only text"),
    "top": part("text/html", "<p>top ü>>></p>"),
    "nested": part("multipart/mixed", parts=[part("text/plain", "t"), part("multipart/alternative", parts=[part("text/plain", "t"), part("text/html", "<p>nested</p>")])]),
    "direct": part("multipart/mixed", parts=[part("multipart/alternative", parts=[part("text/html", "<p>inner</p>")]), part("text/html", "<p>direct</p>")]),
    "two": part("multipart/mixed", parts=[part("x/a", parts=[part("text/html", "first")]), part("x/b", parts=[part("text/html", "second")])]),
}


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    folder = tmp_path_factory.mktemp("inbox")
    heads = [{"name": "From", "value": "Old <o@o.com>"}, {"name": "From", "value": "Acme Widgets <n@acme.com>"}, {"name": "Date", "value": "Wed, 28 Jan 2026 10:00:00 +0530"}]
    for n, (key, payload) in enumerate(MESSAGES.items()):
        (folder / f"{n}.json").write_text(json.dumps({"id": key, "payload": {**payload, "headers": heads}}))
    return str(folder)


def test_headers_and_bodies(spark, inbox):
    rows = mail.read_messages(spark, inbox)
    first = rows.where("id = 'top'").collect()[0]
    assert (first["subject"], first["sender"]) == ("no-subject", "Acme Widgets <n@acme.com>")
    got = {r["id"]: r["html"] for r in mail.extract_body(rows).collect()}
    assert got == {"top": "<p>top ü>>></p>", "nested": "<p>nested</p>", "direct": "<p>direct</p>", "two": "second"}


def test_mail_dates(table):
    cases = {
        "Wed, 28 Jan 2026 10:00:00 +0530": "2026-01-28 04:30:00", "28 Jan 2026 10:00:00 GMT": "2026-01-28 10:00:00", "Wed, 28 jan 2026 10:00 -0800 (PST)": "2026-01-28 18:00:00",
        "Thu,  1 Feb 2024 09:05:07 EST": "2024-02-01 14:05:07", "garbage": AS_OF, None: AS_OF,
    }
    rows = table([(n, d) for n, d in enumerate(cases)], "n long, d string").orderBy("n")
    assert [str(r[0]) for r in rows.select(mail.parse_mail_date("d", AS_OF)).collect()] == list(cases.values())


def test_html_tree(spark, tmp_path):
    for brand, name in [("northwind", "2026-01-28_the-sale-is-here.html"), ("hello", "2026-01-29_hi.html"), ("hello", "oddname.html")]:
        (tmp_path / brand).mkdir(exist_ok=True)
        (tmp_path / brand / name).write_text("<p>x\ny</p>")
    rows = mail.read_html_tree(spark, str(tmp_path)).collect()
    assert [(r["brand"], str(r["date"]), r["subject"], r["path"], r["html"]) for r in rows] == [
        ("Hello", "2026-01-29", "Hi", "hello/2026-01-29_hi.html", "<p>x\ny</p>"), ("Northwind", "2026-01-28", "The Sale Is Here", "northwind/2026-01-28_the-sale-is-here.html", "<p>x\ny</p>"),
        ("Hello", "0001-01-01", "oddname", "hello/oddname.html", "<p>x\ny</p>")]
    assert mail.read_html_tree(spark, str(tmp_path), with_html=False).count() == 3


def test_incremental_ingest_twice(spark, inbox, tmp_path):
    for run in ("a", "b"):  # a fresh checkpoint replays every file; nothing is added twice
        jobs.start_ingest(spark, inbox, str(tmp_path / "mails"), str(tmp_path / run), AS_OF, files_per_trigger=2).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "mails"))
    assert sorted(r["gmail_id"] for r in rows.collect()) == ["direct", "nested", "top", "two"]
    assert {r["brand"] for r in rows.collect()} == {"Acme Widgets"}


def test_insight_store_replaces_a_week(spark, emails, tmp_path):
    path = str(tmp_path / "store")
    report = registry.run_all(emails, AS_OF, path, "2024-01-30 01:00:00")
    assert {r["status"] for r in report.values()} == {"ok"}
    before = spark.read.parquet(path).count()
    registry.compute_and_store("subject_formulas", emails, AS_OF, path, "2024-01-30 02:00:00")
    assert spark.read.parquet(path).count() == before
    with pytest.raises(ValueError):
        registry.compute_and_store("nope", emails, AS_OF, path)


def test_registry_reports_a_failing_insight(emails, tmp_path):
    def broken(df, t):
        raise RuntimeError("no luck")

    registry.register("broken", broken)
    try:
        report = registry.run_all(emails, AS_OF, str(tmp_path / "s"))
    finally:
        del registry.INSIGHTS["broken"]
    assert report["broken"] == {"status": "error", "error": "no luck"} and report["new_tactics"]["status"] == "ok"


@pytest.mark.parametrize("files", [1, 5])
def test_stream_replay_equals_batch(spark, emails, tmp_path, files):
    folder = str(tmp_path / "in")
    rows = emails.select("id", "gmail_id", "brand", "subject", "received_at")
    rows.repartitionByRange(files, "received_at").write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.run_available(jobs.weekly_metrics_stream(stream, "60 days"), str(tmp_path / "out"))
    got = jobs.newest_state(spark, str(tmp_path / "out"), ["week_start", "formula"])
    from mailprism.functions.subjects import subject_formula

    want = rows.groupBy(F.date_trunc("week", "received_at").alias("week_start"), subject_formula("subject").alias("formula")).count()
    pairs = lambda df, c: sorted((str(r["week_start"]), r["formula"], r[c]) for r in df.collect())
    assert pairs(got, "emails") == pairs(want, "count")


def test_current_state_holds_one_version_per_week(spark, emails, tmp_path):
    rows = emails.select("id", "gmail_id", "brand", "subject", "received_at")
    rows.repartitionByRange(4, "received_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_current(jobs.weekly_metrics_stream(stream, "60 days"), str(tmp_path / "out"), ["week_start", "formula"], "week_start")
    got = jobs.current_state(spark, str(tmp_path / "out"))
    from mailprism.functions.subjects import subject_formula

    want = rows.groupBy(F.date_trunc("week", "received_at").alias("week_start"), subject_formula("subject").alias("formula")).count()
    pairs = lambda df, c: sorted((str(r["week_start"]), r["formula"], r[c]) for r in df.collect())
    assert pairs(got, "emails") == pairs(want, "count")
    weeks = [p for p in (tmp_path / "out/data").iterdir() if p.name.startswith("period=")]
    assert len(weeks) == rows.select(F.date_trunc("week", "received_at")).distinct().count() and all(len(list(w.iterdir())) == 1 for w in weeks)


def test_insights_of_touched_weeks_only(spark, emails, tmp_path):
    source, store_path, mark = (str(tmp_path / n) for n in ("mails", "store", "mark"))
    first = emails.where("received_at < '2024-01-15'")
    first.coalesce(1).write.parquet(source)
    run = lambda: jobs.refresh_insights(spark, source, emails.schema, store_path, mark, ["weekly_scoreboard"])
    written = lambda: {str(p.relative_to(store_path)): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    run()
    before = written()
    run()  # no new files
    assert written() == before and len(before) == first.select(F.date_trunc("week", "received_at")).distinct().count()
    emails.where("received_at >= '2024-01-22'").coalesce(1).write.mode("append").parquet(source)
    run()
    after = written()
    assert {k: v for k, v in after.items() if k in before} == before and len(after) > len(before)


def test_payment_stream_in_batches(spark, table, tmp_path):
    events = [(1, 7, "2024-01-01 00:00:00", "charged", "a"), (2, 7, "2024-01-05 00:00:00", "cancelled", "a"), (3, 7, "2024-01-09 00:00:00", "charged", "a"),
              (4, 8, "2024-01-09 00:00:00", "charged", "b"), (5, 7, "2024-01-10 00:00:00", "activated", "a2"), (6, 7, "2024-01-11 00:00:00", "charged", "a2"),
              (7, 9, "2024-03-01 00:00:00", "charged", "c"), (8, 9, "2024-03-02 00:00:00", "paused", "c")]
    schema = "event_id long, user_id long, event_time timestamp, event string, subscription_id string, tier string, billing_cycle string"
    for n, (i, u, t, e, s) in enumerate(events):
        made = table([(i, u, t, f"subscription.{e}", s, None, None)], schema.replace("timestamp", "string")).withColumn("event_time", F.col("event_time").cast("timestamp"))
        made.coalesce(1).write.parquet(str(tmp_path / "ev" / f"p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "ev"))
    for _ in range(2):  # the second run finds no new events
        got = {r["user_id"]: (r["subscription_id"], str(r["last_charge"]), r["cancelled"]) for r in payments.payment_state(spark, stream, str(tmp_path / "st")).collect()}
        assert got == {7: ("a2", "2024-01-11 00:00:00", False), 8: ("b", "2024-01-09 00:00:00", False), 9: ("c", "2024-03-01 00:00:00", False)}
    changes = spark.read.parquet(str(tmp_path / "st/changes"))
    per_batch = {r["batch"]: r["u"] for r in changes.where("NOT expired").groupBy("batch").agg(F.array_sort(F.collect_set("user_id")).alias("u")).collect()}
    assert all(len(users) == 1 for users in per_batch.values()) and len(per_batch) == 7  # a batch emits its own users only
    late = {r["user_id"] for r in changes.where("expired").collect()}
    assert late == {7, 8}  # their paid month is over when March begins
    assert {r["user_id"] for r in payments.current_subscriptions(spark, str(tmp_path / "st")).where("expired").collect()} == {7, 8}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_payment_stream_equals_batch(spark, tmp_path, parts):
    from mailprism.operators.accounts import fold_events
    from mailprism.plans import fixtures

    events = fixtures.view(spark, SMALL, "payment_events")
    times = [r["event_time"] for r in events.select("event_time").orderBy("event_time").collect()]
    cuts = [times[len(times) * k // parts] for k in range(1, parts)]
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        rows = events.where((F.lit(low is None) | (F.col("event_time") >= F.lit(low))) & (F.lit(high is None) | (F.col("event_time") < F.lit(high))))
        rows.coalesce(1).write.parquet(str(tmp_path / "ev" / f"p{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "ev"))
    names = ["user_id", "subscription_id", "tier", "billing_cycle", "activated_at", "last_charge", "cancelled"]
    rows_of = lambda df: sorted(map(str, df.select(names).collect()))
    assert rows_of(payments.payment_state(spark, stream, str(tmp_path / "st"))) == rows_of(fold_events(events))


def test_payment_stream_with_first_states(spark, table, tmp_path):
    users = table([(7, "a", "pro", "annual"), (8, "b", "starter", "monthly")], "user_id long, subscription_id string, tier string, billing_cycle string")
    schema = "event_id long, user_id long, event_time timestamp, event string, subscription_id string, tier string, billing_cycle string"
    made = table([(1, 7, "2024-01-01 00:00:00", "subscription.charged", "other", None, None), (2, 7, "2024-01-02 00:00:00", "subscription.charged", "a", None, None)], schema.replace("timestamp", "string"))
    made.withColumn("event_time", F.col("event_time").cast("timestamp")).write.parquet(str(tmp_path / "ev"))
    out = payments.payment_state(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "ev")), str(tmp_path / "st"), start=payments.as_state(users))
    got = {r["user_id"]: (r["subscription_id"], r["tier"], str(r["last_charge"])) for r in out.collect()}
    assert got == {7: ("a", "pro", "2024-01-02 00:00:00"), 8: ("b", "starter", "None")}


def tree_of(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_html_sink(spark, table, tmp_path):
    rows = [(1, "Big Brand!", "2024-01-02 10:00:00", "Hello, World", "<p>é\n1</p>"), (2, "Big Brand!", "2024-01-02 11:00:00", "hello world", "<p>2</p>"),
            (3, None, None, "新商品", None), (4, "品", "2024-01-02 10:00:00", None, "")]
    mails = table(rows, "id long, brand string, at string, subject string, html string").withColumn("received_at", F.col("at").cast("timestamp"))
    mail.write_html_tree(mails, str(tmp_path / "t"))
    want = {"big-brand/2024-01-02_hello-world.html": "<p>é\n1</p>", "big-brand/2024-01-02_hello-world-2.html": "<p>2</p>", "unknown/untitled.html": "", "unknown/2024-01-02_.html": ""}
    assert tree_of(tmp_path / "t") == want
    mail.write_html_tree(mails.where("id = 4"), str(tmp_path / "t"), mode="append")
    assert tree_of(tmp_path / "t") == want
    mail.write_html_tree(mails.where("id = 1"), f"file:{tmp_path}/t")
    assert tree_of(tmp_path / "t") == dict(list(want.items())[:1])
    assert [r["html"] for r in mail.read_html_tree(spark, str(tmp_path / "t")).collect()] == ["<p>é\n1</p>"]


def test_html_sink_leaves_nothing_of_failed_and_repeated_tasks(spark, tmp_path):
    spark.dataSource.register(mail.HtmlTreeSource)
    rows = spark.range(40).select(F.lit("a").alias("folder"), F.concat("id", F.lit(".html")).alias("name"), F.col("id").cast("string").alias("content"))
    rows.where("id < 10").write.format("html_tree").mode("append").save(str(tmp_path / "t"))
    bad = rows.repartition(4).withColumn("content", F.when(F.col("name") == "33.html", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("html_tree").mode("overwrite").save(str(tmp_path / "t"))
    assert tree_of(tmp_path / "t") == {f"a/{k}.html": str(k) for k in range(10)}  # the old tree, no staging folder

    from mailprism.sources.html_tree import HtmlTreeWriter, TaskFiles

    writer = HtmlTreeWriter(str(tmp_path / "u"), False)
    for attempt in ("0-1", "0-2"):  # two attempts of one task; only the second is committed
        folder = tmp_path / "u" / writer.stage.rsplit("/", 1)[1] / attempt / "a"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "x.html").write_text(attempt)
    writer.commit([TaskFiles(str(folder.parent), 1), None])
    assert tree_of(tmp_path / "u") == {"a/x.html": "0-2"} and [p.name for p in (tmp_path / "u").iterdir()] == ["a"]


def test_read_write_emails(spark, emails, tmp_path):
    rows = emails.withColumn("html", F.lit("<p>"))
    mail.write_emails(rows, str(tmp_path / "e"), str(tmp_path / "h"))
    back = mail.read_emails(spark, str(tmp_path / "e"))
    assert "html" not in back.columns and back.count() == emails.count()
    assert spark.read.parquet(str(tmp_path / "h")).where("month = '2024-01'").count() == emails.count()
    assert store.LABEL_COLUMNS[0] == "brand_name"


def test_weekly_reports_open_their_months_only(spark, mails, tmp_path):
    from mailprism.operators import insights

    made = mails([("A", f"2024-0{m}-1{d} 10:00:00", "hello there") for m in (1, 2, 3) for d in (0, 1, 8)])
    path = str(tmp_path / "emails")
    mail.write_emails(made, path)
    report = insights.weeks_slice(mail.read_emails(spark, path), "2024-03-19 00:00:00", 1)
    assert report.count() == 2
    plan = report._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-03" in plan
    assert all("month=2024-03" in f for f in {r[0] for r in report.select("_metadata.file_path").collect()})


def test_html_at_any_depth(spark, tmp_path):
    import base64
    import json

    def nested(level):
        part = {"mimeType": "text/html", "body": {"data": base64.urlsafe_b64encode(f"<p>{level}</p>".encode()).decode()}}
        for _ in range(level - 1):
            part = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {"data": "eA"}}, part]}
        return {"id": f"m{level}", "payload": {"mimeType": "multipart/mixed", "headers": [], "parts": [part]}}

    (tmp_path / "box.json").write_text("\n".join(json.dumps(nested(n)) for n in range(1, 41)))
    rows = mail.extract_body(mail.read_messages(spark, str(tmp_path))).collect()
    assert {r["id"]: r["html"] for r in rows} == {f"m{n}": f"<p>{n}</p>" for n in range(1, 41)}


def test_sessions_over_several_batches(spark, mails, tmp_path):
    from pyspark.sql import functions as F

    from mailprism.streaming import jobs, payments

    times = ["2024-01-09 10:00:00", "2024-01-10 20:00:00", "2024-01-12 01:00:00", "2024-01-20 00:00:00", "2024-01-08 09:00:00", "2024-01-21 23:00:00", "2024-01-30 00:00:00"]
    made = mails([("A", t, "x") for t in times])
    want = sorted((r["w"]["start"], r["emails"]) for r in made.groupBy(F.session_window("received_at", "48 hours").alias("w")).agg(F.count("id").alias("emails")).collect())
    for files in (1, 3, 7):
        source = tmp_path / f"in{files}"
        for n, start in enumerate(reversed(range(0, 7, 7 // files if files < 7 else 1))):
            part = made.where((F.col("id") >= start) & (F.col("id") < start + (7 // files if files < 7 else 1)))
            part.coalesce(1).write.parquet(str(source / f"p{n}"))
        stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
        path = str(tmp_path / f"out{files}")
        jobs.run_available(jobs.activity_windows(stream, "session", "90 days"), path, "complete")
        got = sorted((r["window_start"], r["emails"]) for r in jobs.whole_result(spark, path).collect())
        assert got == want


def test_html_tree_names_are_made_without_html(spark):
    """With a table of pages the HTML joins once, after the names; the files are those of mails that hold their HTML."""
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>b</p>")], "page_id long, html string")
    rows = [(n, "A b", "Hi", 1 + n % 3) for n in range(9)]
    mails = spark.createDataFrame(rows, "id long, brand string, subject string, page_id long").withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    apart = mail.tree_files(mails, pages=pages)
    joined = mail.tree_files(mails.join(pages, "page_id"))
    assert sorted(apart.collect()) == sorted(joined.collect()) and apart.count() == 6
    last = lambda df: next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "page_id" in last(apart) and "folder" in last(joined)


def test_a_body_is_decoded_once(table):
    rows = table([("a",)], "id string").withColumn("payload", F.from_json(F.lit('{"mimeType":"text/html","body":{"data":"PGI-"}}'), mail.message_schema()["payload"].dataType))
    out = mail.extract_body(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("unbase64") == 1 and "regexp_replace" not in plan
    assert [r["html"] for r in out.collect()] == ["<b>"]


def sorted_rows(df):
    """What the sort at the top of a plan gets, as a JVM Dataset."""
    child = df._jdf.queryExecution().optimizedPlan().children().head()
    return df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, child)


def test_html_tree_is_read_in_few_tasks(spark, tmp_path):
    """Many small files come in as many tasks as a shuffle has (4 here), not a few files a task; none is lost."""
    (tmp_path / "a").mkdir()
    for n in range(400):
        (tmp_path / "a" / f"2024-01-{1 + n % 28:02d}_{n}.html").write_text(f"<p>{n}</p>")
    for with_html in (True, False):
        files = mail.read_html_tree(spark, str(tmp_path), with_html)
        assert sorted_rows(files).rdd().getNumPartitions() == 4
        assert {r["path"] for r in files.collect()} == {f"a/2024-01-{1 + n % 28:02d}_{n}.html" for n in range(400)}
    assert {r["html"] for r in mail.read_html_tree(spark, str(tmp_path)).collect()} == {f"<p>{n}</p>" for n in range(400)}


def test_html_tree_is_sorted_without_html(spark, table, tmp_path):
    """What is asked of the HTML is taken before the files are sorted; the rows are those that hold their HTML."""
    rows = [(n, "A b", f"Hi {n % 3}", f"2024-01-0{1 + n % 2} 10:00:00", "<p>é\n" * (n + 1)) for n in range(8)]
    mails = table(rows, "id long, brand string, subject string, at string, html string").withColumn("received_at", F.col("at").cast("timestamp"))
    mail.write_html_tree(mails, str(tmp_path / "t"))
    names = ["brand", "date", "subject", "path"]
    short = mail.read_html_tree(spark, str(tmp_path / "t"), of_html=F.md5("html").alias("html_md5"))
    whole = mail.read_html_tree(spark, str(tmp_path / "t")).select(F.md5("html").alias("html_md5"), *names)
    assert short.collect() == whole.collect() and short.count() == 8
    assert list(sorted_rows(short).columns()) == ["html_md5", *names]


def test_s05_sorts_no_html(spark):
    from __spark_entry__ import queries

    plan = queries()["s05_html_tree"](spark, SMALL)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Sort":
        plan = plan.children().head()
    assert "html_md5#" in plan.output().toString() and "html#" not in plan.output().toString()
