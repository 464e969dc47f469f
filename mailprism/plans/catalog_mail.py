"""Scalar functions, filters, lists, ranking and set operations over the mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailprism import dims
from mailprism.functions import brands as br
from mailprism.functions import scalars as sc
from mailprism.functions import subjects as sub
from mailprism.operators import filters as fl
from mailprism.operators import insights as ins
from mailprism.operators import ranking as rk
from mailprism.operators import stats as st
from mailprism.plans import sqltext as s
from mailprism.plans.catalog import query
from mailprism.session import local_table

T = s.T


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# --- scalar functions -------------------------------------------------------


@query("f01_pct", f"""
SELECT brand, {s.count_if(s.discount('subject'))} AS hits, count(*) AS total,
 {s.pct(s.count_if(s.discount('subject')), 'count(*)')} AS rate FROM emails GROUP BY brand""")
def _(i):
    out = i.emails.groupBy("brand").agg(F.count_if(sub.is_discount("subject")).alias("hits"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", sc.pct("hits", "total"))


@query("f02_pct_change", f"""
WITH x AS (SELECT brand, type, {s.count_if(f"received_at >= {T} - INTERVAL 1 DAY")} AS cur,
 {s.count_if(f"received_at < {T} - INTERVAL 1 DAY AND received_at >= {T} - INTERVAL 2 DAY")} AS prev FROM emails GROUP BY brand, type)
SELECT brand, type, cur, prev, {s.pct_change('cur', 'prev')} AS change FROM x""")
def _(i):
    t, day, ts = F.lit(i.t).cast("timestamp"), F.expr("INTERVAL 1 DAY"), F.col("received_at")
    out = i.emails.groupBy("brand", "type").agg(
        F.count_if(ts >= t - day).alias("cur"), F.count_if((ts < t - day) & (ts >= t - day - day)).alias("prev"))
    return out.withColumn("change", sc.pct_change("cur", "prev"))


@query("f03_weeks", f"""
SELECT strftime(received_at, '%G-W%V') AS week, {s.ts("date_trunc('week', received_at)")} AS week_start,
 CAST(floor(date_diff('day', date_trunc('week', received_at), date_trunc('week', {T})) / 7) AS BIGINT) AS weeks_back, count(*) AS n
FROM emails GROUP BY 1, 2, 3""")
def _(i):
    ts = F.col("received_at")
    return i.emails.groupBy(
        sc.week_label(ts).alias("week"), stamp(sc.week_start(ts)).alias("week_start"),
        sc.weeks_back(ts, F.lit(i.t).cast("timestamp")).alias("weeks_back")).agg(F.count(F.lit(1)).alias("n"))


@query("f04_is_discount", f"SELECT id, {s.discount('subject')} AS is_discount FROM emails")
def _(i):
    return i.emails.select("id", sub.is_discount("subject").alias("is_discount"))


@query("f05_emoji", f"""
SELECT id, {s.emoji('subject', 'insights')} AS insights, {s.emoji('subject', 'analytics')} AS analytics,
 {s.emoji('subject', 'scoring')} AS scoring, {s.emoji('subject', 'plane')} AS plane,
 array_to_string(regexp_extract_all(subject, {s.q(sub.emoji_class('analytics') + '+')}), '|') AS found FROM emails""")
def _(i):
    flags = [sub.has_emoji("subject", p).alias(p) for p in ("insights", "analytics", "scoring", "plane")]
    return i.emails.select("id", *flags, F.array_join(sub.extract_emojis("subject"), "|").alias("found"))


@query("f06_day_and_time", f"SELECT {s.day_name('received_at')} AS day, {s.bucket('received_at')} AS bucket, count(*) AS n FROM emails GROUP BY 1, 2")
def _(i):
    return i.emails.groupBy(sc.day_name("received_at").alias("day"), sc.time_bucket("received_at").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("f07_safe_filename", """
SELECT id, regexp_replace(left(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), 60), '^-+|-+$', '', 'g') AS file_key FROM emails""")
def _(i):
    return i.emails.select("id", sc.safe_filename("subject").alias("file_key"))


_W = f"round_even(CAST(n AS DOUBLE) / {s.days('lo', 'hi')} * 7, 1)"
_FREQ = (f"(CASE WHEN {s.days('lo', 'hi')} > 0 THEN CASE WHEN {_W} >= 7 THEN CAST(CAST(round_even({_W} / 7, 0) AS BIGINT) AS VARCHAR) || 'x/day' "
         f"WHEN {_W} >= 1 THEN CAST(CAST(round_even({_W}, 0) AS BIGINT) AS VARCHAR) || 'x/week' "
         f"ELSE CAST(CAST(round_even({_W} * 4, 0) AS BIGINT) AS VARCHAR) || 'x/month' END ELSE '1x' END)")


@query("f08_send_frequency", f"""
WITH x AS (SELECT subject, type, count(*) AS n, min(received_at) AS lo, max(received_at) AS hi FROM emails GROUP BY subject, type)
SELECT subject, type, n, {_FREQ} AS label FROM x""")
def _(i):
    x = i.emails.groupBy("subject", "type").agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("lo"), F.max("received_at").alias("hi"))
    return x.select("subject", "type", "n", sc.send_frequency_label("n", "lo", "hi").alias("label"))


@query("f09_per_week", f"""
WITH x AS (SELECT subject, count(*) AS n, min(received_at) AS lo, max(received_at) AS hi FROM emails GROUP BY subject)
SELECT subject, CASE WHEN {s.days('lo', 'hi')} > 0 THEN {_W} ELSE CAST(n AS DOUBLE) END AS span,
 round_even(CAST(n AS DOUBLE) / greatest({s.days('lo', 'hi')}, 1) * 7, 1) AS span1,
 round_even(CAST(n AS DOUBLE) / 30 * 7, 1) AS window30,
 CASE WHEN {s.days('lo', 'hi')} > 0 THEN {_W} ELSE 0.0 END AS strict FROM x""")
def _(i):
    x = i.emails.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("lo"), F.max("received_at").alias("hi"))
    return x.select(
        "subject", sc.per_week("n", "lo", "hi").alias("span"), sc.per_week("n", "lo", "hi", "span1").alias("span1"),
        sc.per_week("n", mode="window", days=F.lit(30)).alias("window30"), sc.per_week("n", "lo", "hi", "strict").alias("strict"))


@query("f10_registrable_domain", f"SELECT sender, {s.domain('sender')} AS domain, {s.icon(s.domain('sender'))} AS icon_url, count(*) AS n FROM emails GROUP BY 1, 2, 3")
def _(i):
    d = sc.registrable_domain("sender")
    return i.emails.groupBy("sender", d.alias("domain"), sc.icon_url(d).alias("icon_url")).agg(F.count(F.lit(1)).alias("n"))


_SPLIT = "list_filter(regexp_split_to_array(subject, '\\s+'), lambda w: w <> '')"


@query("f11_words", f"""
SELECT id, CAST(len({_SPLIT}) AS BIGINT) AS words,
 CAST(len(list_filter({_SPLIT}, lambda w: length(w) > 2 AND w = upper(w) AND w <> lower(w))) AS BIGINT) AS shouted FROM emails""")
def _(i):
    return i.emails.select("id", F.size(sub.words_of("subject")).cast("long").alias("words"), sub.shouted_words("subject").cast("long").alias("shouted"))


@query("f12_all_caps", "SELECT id, (subject = upper(subject) AND length(subject) > 3) AS all_caps FROM emails")
def _(i):
    return i.emails.select("id", sub.is_all_caps("subject").alias("all_caps"))


@query("f13_like_families", f"""
SELECT id, (lower(subject) LIKE '% off%' OR lower(subject) LIKE '%off %') AS off_word,
 (lower(subject) LIKE '% off%' OR lower(subject) LIKE '%sale%' OR lower(subject) LIKE '%discount%') AS discount_word,
 subject LIKE '%!%' AS exclaimed, subject LIKE '%?%' AS asked,
 {', '.join(f"{s.has_any('subject', w)} AS urgent_{k}" for k, w in sub.URGENCY_WORDS.items())} FROM emails""")
def _(i):
    return i.emails.select(
        "id", sub.mentions_off("subject").alias("off_word"), sub.mentions_discount("subject").alias("discount_word"),
        F.contains("subject", F.lit("!")).alias("exclaimed"), F.contains("subject", F.lit("?")).alias("asked"),
        *[sub.is_urgent("subject", k).alias(f"urgent_{k}") for k in sub.URGENCY_WORDS])


@query("f14_keywords", f"""
WITH {s.keyword_cte('documents', 'doc_id', 'text')}
SELECT d.doc_id, coalesce((SELECT string_agg(word, ' ' ORDER BY pos) FROM kw WHERE kw.doc_id = d.doc_id), '') AS keywords FROM documents d""")
def _(i):
    return i.spread(i.table("documents"), "doc_id").select("doc_id", F.array_join(sub.keywords("text"), " ").alias("keywords"))


@query("f15_window_label", f"""
WITH x AS (SELECT {s.days('received_at', T)} AS d FROM emails)
SELECT d AS days, CASE WHEN d <= 1 THEN 'today' WHEN d <= 7 THEN 'this week' WHEN d <= 30 THEN 'this month'
 WHEN d <= 90 THEN 'in the last 3 months' ELSE 'across our archive' END AS label, count(*) AS n FROM x GROUP BY 1, 2""")
def _(i):
    x = i.emails.select(sc.floor_days("received_at", F.lit(i.t).cast("timestamp")).alias("days"))
    return x.groupBy("days", sc.window_label("days").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_cut", "SELECT doc_id, CASE WHEN length(text) > 255 THEN left(text, 254) || '…' ELSE text END AS short, left(text, 60) AS snippet FROM documents")
def _(i):
    return i.table("documents").select("doc_id", sc.ellipsize("text").alias("short"), sc.snippet("text").alias("snippet"))


@query("f17_split_parts", """
WITH x AS (SELECT id, list_filter(list_transform(string_split(concat(subject, '---', preview, '--- ---', type), '---'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM emails)
SELECT id, CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS pos, unnest(parts) AS part FROM x""")
def _(i):
    text = F.concat("subject", F.lit("---"), "preview", F.lit("--- ---"), F.coalesce("type", F.lit("")))
    out = i.emails.select("id", F.posexplode(sc.split_parts(text)).alias("pos", "part"))
    return out.select("id", (F.col("pos") + 1).cast("long").alias("pos"), "part")


@query("f18_codecs", """
SELECT id, subject AS decoded, md5(subject) AS check_sum, strftime(received_at, '%Y-%m') AS month, strftime(received_at, '%A') AS weekday FROM emails""")
def _(i):
    packed = F.translate(F.base64(F.encode("subject", "UTF-8")), "+/=\r\n", "-_")
    text = sc.base64url_text(packed)
    return i.emails.select(
        "id", text.alias("decoded"), F.md5(text).alias("check_sum"), F.date_format("received_at", "yyyy-MM").alias("month"),
        F.date_format("received_at", "EEEE").alias("weekday"))


@query("f19_type_slug", f"""
WITH slugs(slug, type) AS (VALUES {s.values(dims.TYPE_SLUGS)})
SELECT e.id, s.slug FROM emails e JOIN slugs s ON e.type = s.type""")
def _(i):
    return i.emails.join(i.slugs.select("type", "slug"), "type").select("id", "slug")


@query("f20_slug_title", f"""
WITH x AS (SELECT id, regexp_replace(left(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), 60), '^-+|-+$', '', 'g') AS k FROM emails)
SELECT id, {s.title("replace(k, '-', ' ')")} AS title FROM x""")
def _(i):
    return i.emails.select("id", sc.title_case(F.replace(sc.safe_filename("subject"), F.lit("-"), F.lit(" "))).alias("title"))


@query("f21_lenient_json", """
SELECT id, subject, preview FROM emails""")
def _(i):
    from mailprism.functions.answers import answer_fields

    body = F.to_json(F.struct("subject", F.col("preview").alias("preview_text"), F.concat(F.lit("<p>\"x\"</p>"), F.coalesce("type", F.lit(""))).alias("html")))
    broken = F.concat(F.lit("Here you go: "), F.replace(body, F.lit("}"), F.lit(",}")))
    text = F.when(F.col("id") % 3 == 0, body).when(F.col("id") % 3 == 1, F.concat(F.lit("Sure! "), body, F.lit(" done"))).otherwise(broken)
    out = rk.computed_once(i.mails.select("id", text.alias("text")), a=answer_fields("text"))
    return out.select("id", "a.subject", F.col("a.preview_text").alias("preview"))


# --- filters and lists ------------------------------------------------------

_LIST = "id, subject, brand, type, " + s.ts("received_at") + " AS received_at"


def _listed(df):
    return df.select("id", "subject", "brand", "type", stamp("received_at").alias("received_at"))


@query("p01_list_emails", f"SELECT {_LIST} FROM emails WHERE type = 'Sale' AND industry = 'Home & Living' ORDER BY emails.received_at DESC, id LIMIT 50 OFFSET 10")
def _(i):
    return _listed(fl.list_emails(i.emails, type="Sale", industry="Home & Living", skip=10, limit=50))


@query("p02_search", f"""SELECT {_LIST} FROM emails WHERE coalesce(subject ILIKE '%new%', false) OR coalesce(preview ILIKE '%new%', false)
 OR coalesce(brand ILIKE '%new%', false) OR coalesce(type ILIKE '%new%', false) OR coalesce(industry ILIKE '%new%', false)""")
def _(i):
    return _listed(fl.list_emails(i.emails, q="new"))


@query("p03_client_search", f"""SELECT {_LIST} FROM emails
 WHERE contains(lower(concat(coalesce(subject,''), ' ', coalesce(brand,''), ' ', coalesce(preview,''))), 'sale ') AND industry = 'Food & Beverage'""")
def _(i):
    return _listed(fl.search_text(i.emails, "Sale ", industry="Food & Beverage"))


_DEPTH = dict(zip(dims.PLANS, dims.PLAN_LIMITS["archive_days"]))


@query("p04_archive_depth", f"""
WITH d(plan, archive_days) AS (VALUES {s.values(list(_DEPTH.items()))})
SELECT plan, CAST(archive_days AS BIGINT) AS archive_days, (SELECT count(*) FROM emails WHERE archive_days IS NULL OR received_at >= {T} - to_days(CAST(archive_days AS INTEGER))) AS visible FROM d""")
def _(i):
    return fl.archive_counts(i.emails, _DEPTH, i.t)


@query("p05_slim", f"SELECT id, gmail_id, subject, sender, brand, category, type, industry, {s.ts('received_at')} AS received_at, preview FROM emails")
def _(i):
    return fl.slim(i.emails).withColumn("received_at", stamp("received_at"))


@query("p06_html_for_ids", """
WITH ids AS (SELECT DISTINCT page_id FROM emails WHERE type = 'Welcome' ORDER BY page_id LIMIT 50)
SELECT page_id, md5(html) AS html_md5 FROM email_html WHERE page_id IN (SELECT page_id FROM ids)""")
def _(i):
    ids = i.emails.where("type = 'Welcome'").select("page_id").distinct()
    return fl.html_for(i.view("email_html"), ids, 50, "page_id").select("page_id", F.md5("html").alias("html_md5"))


@query("p07_email_detail", f"""
SELECT e.id, e.subject, e.brand, {s.ts('e.received_at')} AS received_at, 'https://cdn.example.com/' || e.page_id || '.png' AS image
FROM emails e WHERE e.id = (SELECT max(id) FROM emails)""")
def _(i):
    from mailprism.operators.html import first_image

    newest = i.emails.agg(F.max("id")).scalar()
    one = fl.email_detail(i.emails, newest).join(i.view("email_html"), "page_id")
    return one.select("id", "subject", "brand", stamp("received_at").alias("received_at"), first_image("html").alias("image"))


@query("p08_subject_lines", f"""
SELECT id, subject, brand, industry, type AS campaign_type, strftime(received_at, '%Y-%m-%d') AS date, CAST(length(subject) AS BIGINT) AS length,
 {s.emoji('subject', 'analytics')} AS has_emoji FROM emails WHERE brand ILIKE 'k%' ORDER BY received_at DESC, id LIMIT 900""")
def _(i):
    return fl.subject_lines(i.emails, brand="k%", limit=900)


@query("p09_mask", f"""
WITH x AS (SELECT brand, count(*) AS n, {s.mean('sum(length(subject))', 'count(*)')} AS avg_len FROM emails WHERE brand IS NOT NULL GROUP BY brand)
SELECT brand, CASE WHEN brand = 'Nykaa' THEN CAST(n AS VARCHAR) ELSE 'xx' END AS n, CASE WHEN brand = 'Nykaa' THEN CAST(avg_len AS VARCHAR) ELSE 'xx' END AS avg_len FROM x""")
def _(i):
    x = i.emails.where(rk.has_brand()).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), sc.mean_len(F.sum(F.length("subject")), F.count(F.lit(1))).alias("avg_len"))
    return fl.mask(x, ["n", "avg_len"], False, sample=F.col("brand") == "Nykaa")


@query("p10_unknown_brands", f"SELECT {_LIST} FROM emails WHERE brand IS NULL OR brand IN ('Unknown', 'unknown')")
def _(i):
    return _listed(fl.unknown_brands(i.emails))


@query("p12_unlabelled", """
SELECT id, subject, (SELECT count(*) FROM emails WHERE type IS NULL AND subject IS NOT NULL) AS remaining
FROM emails WHERE type IS NULL AND subject IS NOT NULL ORDER BY id LIMIT 40 OFFSET 5""")
def _(i):
    return fl.unlabelled(i.emails, limit=40, offset=5).select("id", "subject", "remaining")


@query("p13_active_window", f"""
SELECT p AS preferred, {s.ts('since')} AS since, {s.days('since', T)} AS days,
 CASE WHEN {s.days('since', T)} <= 1 THEN 'today' WHEN {s.days('since', T)} <= 7 THEN 'this week' ELSE 'this month' END AS label
FROM (SELECT 1 AS p, {s.window_start(1)} AS since UNION ALL SELECT 7, {s.window_start(7)} UNION ALL SELECT 30, {s.window_start(30)})""")
def _(i):
    out = None
    for p in (1, 7, 30):
        one = fl.active_window(i.emails, i.t, p).select(F.lit(p).alias("preferred"), stamp("since").alias("since"), "days", "label")
        out = one if out is None else out.unionByName(one)
    return out


_TAX = s.values([(x,) for x in dims.INDUSTRIES if x != "Pets"])


@query("p14_orphan_industries", f"""
WITH tax(industry) AS (VALUES {_TAX})
SELECT industry, count(*) AS cnt FROM emails WHERE industry IS NOT NULL AND industry NOT IN (SELECT industry FROM tax) GROUP BY industry""")
def _(i):
    tax = dims.taxonomy_table(i.spark).where("industry <> 'Pets'")
    return fl.orphan_industries(i.emails, tax)


@query("p15_queue_and_targets", """
WITH q AS (SELECT o_orderkey AS id, concat(o_orderpriority, ' ', o_orderstatus) AS content, CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'draft' ELSE 'approved' END AS status, o_orderdate AS created_at FROM orders),
t AS (SELECT s_suppkey AS id, s_name AS handle, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(floor(s_acctbal) AS BIGINT) END AS follower_count, s_nationkey % 2 = 0 AS is_active FROM supplier)
SELECT status AS part, id, content AS label, CAST(length(content) AS BIGINT) AS number FROM q
UNION ALL SELECT 'target', id, handle, coalesce(follower_count, -1) FROM t WHERE is_active""")
def _(i):
    status = F.when(F.col("o_orderstatus") == "F", "posted").when(F.col("o_orderstatus") == "O", "draft").otherwise("approved")
    queue = i.table("orders").select(
        F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("content"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    accounts = i.table("supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("handle"), (F.col("s_nationkey") % 2 == 0).alias("is_active"), F.lit(None).cast("string").alias("category"),
        F.when(F.col("s_suppkey") % 5 != 0, F.floor("s_acctbal").cast("long")).alias("follower_count"))
    listed = [fl.queue_list(queue, x).select(F.lit(x).alias("part"), "id", F.col("content").alias("label"), F.col("char_count").alias("number")) for x in ("approved", "posted", "draft")]
    top = fl.targets(accounts).select(F.lit("target").alias("part"), "id", F.col("handle").alias("label"), F.coalesce("follower_count", F.lit(-1)).cast("long").alias("number"))
    return listed[0].unionByName(listed[1]).unionByName(listed[2]).unionByName(top)


@query("p16_newest_users", f"SELECT id, email, {s.ts('created_at')} AS created_at, (SELECT count(*) FROM users) AS total FROM users ORDER BY users.created_at DESC, id LIMIT 50 OFFSET 20")
def _(i):
    return fl.newest(i.view("users"), 20, 50).select("id", "email", stamp("created_at").alias("created_at"), "total")


@query("p17_id_dates", f"SELECT id, {s.ts('received_at')} AS received_at FROM emails")
def _(i):
    return fl.id_dates(i.emails).withColumn("received_at", stamp("received_at"))


@query("p18_library_ids", """
SELECT 'bookmark' AS kind, CAST(email_id AS VARCHAR) AS item FROM bookmarks WHERE user_id = (SELECT max(user_id) FROM bookmarks)
UNION ALL SELECT 'follow', brand_name FROM follows WHERE user_id = (SELECT max(user_id) FROM follows)""")
def _(i):
    marks, follows = i.view("bookmarks"), i.view("follows")
    a = fl.library_ids(marks, marks.agg(F.max("user_id")).scalar(), "email_id").select(F.lit("bookmark").alias("kind"), F.col("email_id").cast("string").alias("item"))
    b = fl.library_ids(follows, follows.agg(F.max("user_id")).scalar(), "brand_name").select(F.lit("follow").alias("kind"), F.col("brand_name").alias("item"))
    return a.unionByName(b)


_CACHE = [("nykaa", "manual"), ("BOAT", "ai"), ("Gucci", "keyword"), ("Outer", "manual")]


@query("p19_brands_to_label", f"""
WITH cache(brand_name, classified_by) AS (VALUES {s.values(_CACHE)}),
b AS (SELECT brand, arg_max(id, (received_at, -id)) AS sample_id FROM emails WHERE {s.KNOWN} GROUP BY brand)
SELECT 'new' AS mode, brand, sample_id FROM b WHERE lower(brand) NOT IN (SELECT lower(brand_name) FROM cache)
UNION ALL SELECT 'force', brand, sample_id FROM b WHERE lower(brand) NOT IN (SELECT lower(brand_name) FROM cache WHERE classified_by = 'manual')""")
def _(i):
    cache = local_table(i.spark, _CACHE, "brand_name string, classified_by string")
    parts = [fl.brands_to_label(i.emails, cache, force).select(F.lit(mode).alias("mode"), "brand", "sample_id") for mode, force in (("new", False), ("force", True))]
    return parts[0].unionByName(parts[1])


# --- ranking, sampling and sets ---------------------------------------------


@query("t01_top_k", "SELECT subject, count(*) AS cnt FROM emails GROUP BY subject ORDER BY cnt DESC, subject LIMIT 15")
def _(i):
    return rk.top_k(i.emails, "subject", 15)


@query("t02_page", "SELECT id, subject, (SELECT count(*) FROM emails) AS total FROM emails ORDER BY received_at DESC, id LIMIT 25 OFFSET 100")
def _(i):
    return rk.page(i.emails, 100, 25).select("id", "subject", "total")


@query("t03_nulls_last", """
SELECT id, category, type, CAST(row_number() OVER (ORDER BY category DESC NULLS LAST, type ASC NULLS LAST, id) AS BIGINT) AS pos
FROM emails ORDER BY pos LIMIT 200""")
def _(i):
    order = [F.desc_nulls_last("category"), F.asc_nulls_last("type"), F.asc("id")]
    return rk.top_n_per(i.emails, None, order, 200, "pos").select("id", "category", "type", F.col("pos").cast("long").alias("pos"))


@query("t04_null_times_last", f"""
WITH x AS (SELECT id, brand, CASE WHEN id % 4 = 0 THEN NULL ELSE received_at END AS received_at FROM emails WHERE brand IS NOT NULL)
SELECT brand, id, CAST(row_number() OVER (PARTITION BY brand ORDER BY received_at DESC NULLS LAST, id) AS INTEGER) AS rank FROM x QUALIFY rank <= 20""")
def _(i):
    x = i.emails.where(rk.has_brand()).withColumn("received_at", F.when(F.col("id") % 4 != 0, F.col("received_at")))
    return rk.top_n_per(x, "brand", rk.newest_first(), 20).select("brand", "id", "rank")


@query("t05_hash_sample", """
SELECT brand, id, CAST(row_number() OVER (PARTITION BY brand ORDER BY md5(CAST(id AS VARCHAR) || '7'), id) AS INTEGER) AS sample_no FROM emails QUALIFY sample_no <= 8""")
def _(i):
    return rk.hash_sample(i.emails, 8, "7", by="brand").select("brand", "id", "sample_no")


@query("t06_top_words", f"""
WITH w AS (SELECT brand, unnest({s.words('subject', sub.TOP_WORD_STOPS)}) AS word FROM emails),
c AS (SELECT brand, word, count(*) AS cnt FROM w GROUP BY brand, word)
SELECT brand, word, cnt, CAST(row_number() OVER (PARTITION BY brand ORDER BY cnt DESC, word) AS INTEGER) AS rank FROM c QUALIFY rank <= 10""")
def _(i):
    return rk.top_words(i.mails, "brand", 10).select("brand", "word", "cnt", "rank")


@query("w03_diverse_examples", f"""
WITH a AS {s.top_n('emails', 'type, brand', 'received_at DESC, id', 2, 'r')}, b AS {s.top_n('a', 'type', 'received_at DESC, id', 15)}
SELECT type, id, brand, rank FROM b""")
def _(i):
    return rk.diverse_examples(i.emails, "type").select("type", "id", "brand", "rank")


@query("w04_formula_examples", f"""
WITH x AS (SELECT *, {s.formula('subject')} AS formula FROM emails WHERE received_at >= TIMESTAMP '2024-01-29' AND received_at < TIMESTAMP '2024-02-05'),
r AS {s.top_n('x', 'formula', 'received_at, id', 3)}
SELECT formula, rank, id, subject FROM r""")
def _(i):
    return ins.formula_examples(i.emails, i.t)


@query("w05_newest_per_month", f"""
WITH x AS (SELECT *, strftime(received_at, '%Y-%m') AS month FROM emails WHERE brand IS NOT NULL), r AS {s.top_n('x', 'brand, month', 'received_at DESC, id', 10)}
SELECT brand, month, rank, id FROM r""")
def _(i):
    x = i.emails.where(rk.has_brand()).withColumn("month", F.date_format("received_at", "yyyy-MM"))
    return rk.top_n_per(x, ["brand", "month"], rk.newest_first(), 10).select("brand", "month", "rank", "id")


@query("w06_latest_per_key", f"WITH r AS {s.top_n('emails', 'brand', 'received_at DESC, id', 1)} SELECT brand, id, subject FROM r")
def _(i):
    return rk.latest_per(i.emails, "brand").select("brand", "id", "subject")


@query("w07_modal", f"""
WITH a AS (SELECT brand, type, count(*) AS n FROM emails WHERE type IS NOT NULL GROUP BY brand, type),
b AS (SELECT brand, {s.day_name('received_at')} AS day, isodow(received_at) AS d, count(*) AS n FROM emails GROUP BY 1, 2, 3)
SELECT a.brand, arg_min(a.type, (-a.n, a.type)) AS modal_type, (SELECT arg_min(b.day, (-b.n, b.day)) FROM b WHERE b.brand IS NOT DISTINCT FROM a.brand) AS modal_day FROM a GROUP BY a.brand""")
def _(i):
    x = i.emails.withColumn("day", sc.day_name("received_at"))
    a, b = rk.modal(x, "brand", "type", "modal_type"), rk.modal(x, "brand", "day", "modal_day")
    return a.join(b, a["brand"].eqNullSafe(b["brand"])).select(a["brand"], "modal_type", "modal_day")


@query("w08_share", "SELECT type, count(*) AS cnt, round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM emails) * 100, 1) AS pct FROM emails WHERE type IS NOT NULL GROUP BY type")
def _(i):
    return rk.share(i.emails, "type")


@query("w09_newest_subjects", f"""
WITH x AS (SELECT brand, subject, max(received_at) AS received_at FROM emails WHERE subject <> '' GROUP BY brand, subject), r AS {s.top_n('x', 'brand', 'received_at DESC, subject', 5)}
SELECT brand, subject, rank FROM r""")
def _(i):
    return rk.newest_subjects(i.emails, "brand", 5).select("brand", "subject", "rank")


@query("w10_top_brands_per_industry", f"""
WITH x AS (SELECT industry, brand, count(*) AS cnt FROM emails WHERE {s.KNOWN} AND industry IS NOT NULL GROUP BY industry, brand), r AS {s.top_n('x', 'industry', 'cnt DESC, brand', 5)}
SELECT industry, brand, cnt, rank FROM r""")
def _(i):
    x = rk.counts(i.emails.where(rk.known_brand() & F.col("industry").isNotNull()), ["industry", "brand"])
    return rk.top_n_per(x, "industry", [F.desc("cnt"), F.asc("brand")], 5)


@query("w12_trailing_weeks", """
WITH x AS (SELECT date_trunc('week', received_at) AS w, count(*) AS cnt FROM emails GROUP BY 1)
SELECT strftime(a.w, '%G-W%V') AS week_label, a.cnt, CAST(coalesce((SELECT sum(b.cnt) FROM x b WHERE b.w < a.w AND b.w >= a.w - INTERVAL 28 DAY), 0) AS BIGINT) AS trailing FROM x a""")
def _(i):
    return ins.weekly_trailing_counts(i.emails)


_SHORT = "length(subject) BETWEEN 5 AND 30"


@query("o01_candidate_pools", f"""
WITH x AS (SELECT *, md5(CAST(id AS VARCHAR) || '0') AS h FROM emails WHERE received_at >= {s.window_start(7)} AND subject IS NOT NULL),
pools AS (SELECT 'short' AS pool, * FROM (SELECT * FROM x WHERE {_SHORT} ORDER BY h, id LIMIT 10)
 UNION ALL SELECT 'question', * FROM (SELECT * FROM x WHERE contains(subject, '?') ORDER BY h, id LIMIT 10)
 UNION ALL SELECT 'urgency', * FROM (SELECT * FROM x ORDER BY h, id LIMIT 30) WHERE {s.has_any('subject', sub.URGENCY_WORDS['spotlight'])})
SELECT pool, id, coalesce(brand, 'Unknown') AS brand, subject, coalesce(type, 'Promotional') AS type, {s.tactic('subject')} AS tactic FROM pools""")
def _(i):
    return st.spotlight_candidates(i.emails, i.t).select("pool", "id", "brand", "subject", "type", "tactic")


@query("o03_formula_union", f"""
WITH x AS (SELECT {s.formula('subject')} AS formula, received_at >= TIMESTAMP '2024-01-29' AS now FROM emails WHERE received_at >= TIMESTAMP '2024-01-01' AND received_at < TIMESTAMP '2024-02-05')
SELECT DISTINCT formula FROM x WHERE now UNION SELECT formula FROM x WHERE NOT now""")
def _(i):
    weeks = ins.formula_weeks(i.emails, i.t)
    now, past = weeks.where("week_no = 0").select("formula"), weeks.where("week_no > 0").select("formula")
    return now.union(past).distinct()


@query("o04_distinct_keywords", f"""
WITH {s.keyword_cte('emails', 'id', 'subject')}
SELECT id, CAST(count(*) AS BIGINT) AS n, string_agg(word, ' ' ORDER BY pos) AS keywords FROM kw GROUP BY id""")
def _(i):
    k = i.mails.select("id", sub.keywords("subject").alias("k")).where(F.size("k") > 0)
    return k.select("id", F.size("k").cast("long").alias("n"), F.array_join("k", " ").alias("keywords"))


@query("o05_set_difference", """
SELECT 'unbookmarked' AS part, CAST(id AS VARCHAR) AS item FROM emails WHERE id NOT IN (SELECT email_id FROM bookmarks)
UNION ALL (SELECT 'no_industry', brand FROM (SELECT DISTINCT brand FROM emails WHERE brand IS NOT NULL EXCEPT SELECT DISTINCT brand FROM emails WHERE industry IS NOT NULL AND brand IS NOT NULL))""")
def _(i):
    e = i.emails
    loose = e.join(i.view("bookmarks").select(F.col("email_id").alias("id")), "id", "left_anti").select(F.lit("unbookmarked").alias("part"), F.col("id").cast("string").alias("item"))
    every = e.where(rk.has_brand()).select("brand").distinct()
    placed = e.where(rk.has_brand() & F.col("industry").isNotNull()).select("brand").distinct()
    return loose.unionByName(every.join(placed, "brand", "left_anti").select(F.lit("no_industry").alias("part"), F.col("brand").alias("item")))


def _norm_sql(col):
    out = f"trim(lower(coalesce({col}, '')))"
    for rx in br.SUFFIX_PATTERNS:
        out = f"trim(regexp_replace({out}, {s.q(rx)}, '', 'gi'))"
    return out


def clean_sql(col):
    out = f"trim({col})"
    for rx in br.NOISE_PATTERNS:
        out = f"regexp_replace({out}, {s.q(rx)}, '', 'gi')"
    out = f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"
    out = f"regexp_replace({out}, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g')"
    return f"(CASE WHEN length({out}) >= 2 THEN {s.title(out)} END)"


@query("c07_clean_brand", f"""
WITH x AS (SELECT DISTINCT regexp_extract(sender, '^([^<]+)<', 1) || ' Official Team' AS raw FROM emails WHERE sender IS NOT NULL UNION SELECT DISTINCT 'The ' || brand || ' Newsletter!' FROM emails WHERE brand IS NOT NULL
 UNION SELECT DISTINCT s_name || ' pvt. ltd.' FROM supplier)
SELECT raw, {clean_sql('raw')} AS clean FROM x""")
def _(i):
    e = i.emails
    a = e.where("sender IS NOT NULL").select(F.concat(F.regexp_extract("sender", r"^([^<]+)<", 1), F.lit(" Official Team")).alias("raw"))
    b = e.where(rk.has_brand()).select(F.concat(F.lit("The "), "brand", F.lit(" Newsletter!")).alias("raw"))
    c = i.table("supplier").select(F.concat("s_name", F.lit(" pvt. ltd.")).alias("raw"))
    return a.union(b).union(c).distinct().select("raw", br.clean_brand("raw").alias("clean"))


@query("c08_normalize_brand", f"""
WITH x AS (SELECT DISTINCT brand FROM emails WHERE brand IS NOT NULL UNION SELECT DISTINCT brand || ' Rewards' FROM emails WHERE brand IS NOT NULL)
SELECT brand, {_norm_sql('brand')} AS norm FROM x""")
def _(i):
    b = i.emails.where(rk.has_brand()).select("brand")
    x = b.union(b.select(F.concat("brand", F.lit(" Rewards")))).distinct()
    return x.select("brand", br.normalize_brand("brand").alias("norm"))


@query("c04_subject_formula", f"SELECT id, {s.formula('subject')} AS formula FROM emails")
def _(i):
    return i.mails.select("id", sub.subject_formula("subject").alias("formula"))


@query("c05_tactic", f"SELECT id, {s.tactic('subject')} AS tactic FROM emails")
def _(i):
    return i.emails.select("id", sub.tactic("subject").alias("tactic"))


@query("q10_subject_flags", f"""
SELECT id, CAST(length(subject) AS BIGINT) AS char_count, CAST(len({_SPLIT}) AS BIGINT) AS word_count, {s.emoji('subject', 'analytics')} AS has_emoji,
 contains(subject, '?') AS has_question, regexp_matches(subject, '\\d') AS has_number, {s.has_any('subject', sub.FLAG_TOKENS)} AS has_personalization,
 {s.has_any('subject', sub.URGENCY_WORDS['flags'])} AS has_urgency FROM emails""")
def _(i):
    return i.emails.select("id", *sub.subject_flags("subject"))
