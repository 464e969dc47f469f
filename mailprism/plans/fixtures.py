"""Deterministic campaign views over the generated star-schema tables.

The SQL text is valid in Spark and DuckDB alike; ``views`` runs it in Spark and
``PREFIX`` is prepended to every oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-30 00:00:00"
TABLES = ["customer", "events", "orders", "lineitem", "pages"]

EMAILS = """
brand_dim(brand_no, brand, sender) AS (VALUES
 (0,'Nykaa','Nykaa <hello@mail.nykaa.com>'),
 (1,'Caratlane - A Tata Product','CaratLane <news@em.caratlane.com>'),
 (2,'Kiehl''s Since 1851','Kiehl''s <kiehls@e.kiehls.co.uk>'),
 (3,'Zomato','noreply@zomato.com'),
 (4,'Gucci','Gucci <news@gucci.com>'),
 (5,'Anthropologie Sale','Anthropologie <anthro@email.anthropologie.com>'),
 (6,'Unknown','info@xyz.org'),
 (7,CAST(NULL AS STRING),CAST(NULL AS STRING)),
 (8,'Supertails+ Clinic','Supertails <pets@supertails.co.in>'),
 (9,'Wakefit','Wakefit <sleep@news.wakefit.co>'),
 (10,'Outer','Outer <hi@liveouter.com>'),
 (11,'Maeve By Anthropologie','Maeve <m@maeve.com>'),
 (12,'Boat','boAt <promo@boat-lifestyle.com>'),
 (13,'Ledger','Ledger <x@ledger.com>'),
 (14,'Graza','Graza <oil@graza.co>'),
 (15,'Acme Widgets','Acme Widgets <acme@widgets.io>')),
subject_dim(tmpl_no, tmpl) AS (VALUES
 (0,'{n}% off everything'),(1,'Flat {n}% off - hurry, sale ends tonight!'),
 (2,'Last chance: final hours'),(3,'{n} ways to style denim'),
 (4,'Your picks are waiting for you'),(5,'Something big is coming soon'),
 (6,'Bestsellers everyone loves'),(7,'Ready for summer?'),
 (8,'Shop the new collection'),(9,'Welcome to the family'),
 (10,'You left something in your cart'),(11,'Your order has shipped'),
 (12,'Back in stock: the sofa'),(13,'We miss you'),
 (14,'Happy Diwali gift guide'),(15,'Earn double points this week'),
 (16,'Please confirm your email'),(17,'How was your order? Rate us'),
 (18,'Skincare tips: serum and moisturizer'),(19,'The weekly digest'),
 (20,'Behind the scenes with our founder'),(21,'You''re invited: pop-up store opening'),
 (22,'Refer a friend and earn'),(23,'NEW ARRIVALS JUST LANDED'),
 (24,'Coffee for your morning'),(25,'Sale 🔥 today only'),
 (26,'新商品のお知らせ'),(27,'hey bestie'),
 (28,'Know before you go'),(29,'Hotel deals and flight offers for your trip'),
 (30,'Ok'),(31,'12345')),
emails AS (
 SELECT e.event_id AS id,
  md5(CAST(e.event_id AS STRING)) AS gmail_id,
  replace(s.tmpl, '{n}', CAST(5 + CAST(floor(e.value) AS BIGINT) % 70 AS STRING)) AS subject,
  b.sender, b.brand,
  CASE WHEN b.brand_no IN (0,2) THEN 'Beauty & Personal Care' WHEN b.brand_no IN (1,11) THEN 'Apparel & Accessories'
       WHEN b.brand_no IN (3,14) THEN 'Food & Beverage' WHEN b.brand_no IN (9,10) THEN 'Home & Living'
       WHEN b.brand_no = 4 THEN CASE WHEN e.event_id % 3 = 0 THEN 'Apparel & Accessories' ELSE 'Luxury & High-End Goods' END
       WHEN b.brand_no IN (12,13) THEN 'Electronics & Tech' WHEN b.brand_no = 8 THEN 'Pets' END AS industry,
  CASE WHEN s.tmpl_no IN (0,1,2,25,29) THEN 'Sale' WHEN s.tmpl_no IN (3,18) THEN 'Educational'
       WHEN s.tmpl_no IN (5,8,23) THEN 'New Arrival' WHEN s.tmpl_no = 9 THEN 'Welcome' WHEN s.tmpl_no = 10 THEN 'Abandoned Cart'
       WHEN s.tmpl_no = 11 THEN 'Order Update' WHEN s.tmpl_no = 12 THEN 'Back in Stock' WHEN s.tmpl_no = 13 THEN 'Re-engagement'
       WHEN s.tmpl_no = 14 THEN 'Festive' WHEN s.tmpl_no = 19 THEN 'Newsletter' WHEN s.tmpl_no IN (30,31) THEN NULL
       ELSE 'Product Showcase' END AS type,
  CASE WHEN b.brand_no IN (0,2) THEN 'Skincare' WHEN b.brand_no = 12 THEN '' END AS category,
  CAST(e.ts AS TIMESTAMP) AS received_at,
  concat('Preview of ', CAST(e.user_id AS STRING), ' ', e.event_type) AS preview,
  e.event_id % (SELECT count(*) FROM pages) AS page_id
 FROM events e
 JOIN brand_dim b ON b.brand_no = e.user_id % 16
 JOIN subject_dim s ON s.tmpl_no = (e.event_id * 7 + CAST(floor(e.event_id / 97) AS BIGINT) * (e.user_id % 5)
      + CASE WHEN e.ts >= TIMESTAMP '2024-01-29 00:00:00' AND e.user_id % 16 IN (4,9,13) THEN (e.event_id % 4) * 8 ELSE 0 END) % 32
)"""

USERS = """
users AS (SELECT c_custkey AS id, concat('user', CAST(c_custkey AS STRING), '@example.com') AS email,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'free' WHEN 'BUILDING' THEN 'starter' WHEN 'FURNITURE' THEN 'pro' WHEN 'MACHINERY' THEN 'agency' END AS subscription_tier,
  CAST(DATE '2023-12-15' + CAST(c_custkey % 47 AS INT) AS TIMESTAMP) AS created_at,
  CAST(DATE '2023-12-22' + CAST(c_custkey % 47 AS INT) AS TIMESTAMP) AS trial_ends_at,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2024-06-01 00:00:00' END AS subscription_expires_at,
  CASE WHEN c_custkey % 2 = 0 THEN 'monthly' ELSE 'annual' END AS billing_cycle,
  CASE WHEN c_custkey % 4 = 0 THEN '["day4"]' END AS trial_emails_sent,
  concat('sub', CAST(c_custkey AS STRING), '-0') AS subscription_id FROM customer),
usage_daily AS (SELECT user_id, CAST(ts AS DATE) AS usage_date, sum(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS html_views,
  sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS brand_views, sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS html_exports,
  sum(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) AS ai_generations FROM events GROUP BY user_id, CAST(ts AS DATE)),
bookmarks AS (SELECT o_custkey AS user_id, o_orderkey % (SELECT count(*) FROM events) AS email_id, CAST(min(o_orderdate) AS TIMESTAMP) AS created_at
  FROM orders GROUP BY o_custkey, o_orderkey % (SELECT count(*) FROM events)),
payment_events AS (SELECT event_id, user_id, event_time, event,
  concat('sub', CAST(user_id AS STRING), '-', CAST(CASE WHEN event <> 'subscription.activated' AND event_id % 7 = 0 AND started > 0 THEN started - 1 ELSE started END AS STRING)) AS subscription_id,
  CASE WHEN event = 'subscription.activated' THEN CASE event_id % 2 WHEN 0 THEN 'starter' ELSE 'pro' END END AS tier,
  CASE WHEN event = 'subscription.activated' THEN CASE event_id % 3 WHEN 0 THEN 'annual' ELSE 'monthly' END END AS billing_cycle
  FROM (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS event_time,
   CASE event_type WHEN 'purchase' THEN 'subscription.charged' WHEN 'signup' THEN 'subscription.activated' ELSE 'subscription.cancelled' END AS event,
   count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS started
   FROM events WHERE event_type IN ('purchase','error','signup')) pe),
follows AS (SELECT o_custkey AS user_id, concat('brand', CAST(o_orderkey % 23 AS STRING)) AS brand_name, CAST(min(o_orderdate) AS TIMESTAMP) AS created_at
  FROM orders GROUP BY o_custkey, concat('brand', CAST(o_orderkey % 23 AS STRING))),
collections AS (SELECT o_orderkey AS id, o_custkey AS user_id, concat('Board ', o_orderpriority) AS name, CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM orders WHERE o_orderstatus = 'P'),
collection_emails AS (SELECT l.l_orderkey AS collection_id, (l.l_orderkey * 13 + l.l_linenumber) % (SELECT count(*) FROM events) AS email_id,
  CAST(min(o.o_orderdate) AS TIMESTAMP) AS added_at
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'P' AND l.l_linenumber < l.l_orderkey % 5
  GROUP BY l.l_orderkey, (l.l_orderkey * 13 + l.l_linenumber) % (SELECT count(*) FROM events))"""

# An e-mail body per page: the page wrapped with the elements mails have (pixel, hero, button, layout).
HTML = """
email_html AS (SELECT page_id,
  concat('<meta name="viewport" content="width=device-width"><img src="https://cdn.example.com/', CAST(page_id AS STRING), '.png" alt="',
   CASE WHEN page_id % 3 = 0 THEN '' ELSE 'hero shot' END, '" width="600"><img src="https://t.example.com/o.gif" width="1" height="1">',
   CASE WHEN page_id % 2 = 0 THEN '<table><tr><td style="padding:4px">Layout cell with some text</td></tr></table>' ELSE '' END,
   '<style></style><!--[if mso]>x<![endif]--><p data-track="p', CAST(page_id AS STRING), '" onclick="go()">Hi {first_name}, take a look</p>',
   html, '<a class="btn" href="https://shop.example.com/', CAST(page_id AS STRING), '">Shop now</a><a href="/u">Unsubscribe</a>') AS html
  FROM pages)"""

PREFIX = "WITH " + EMAILS.strip() + ",\n" + USERS.strip() + ",\n" + HTML.strip() + "\n"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One generated table; naive timestamps are read as UTC instants."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views as a DataFrame (only the tables it needs are scanned)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for table in TABLES:
        load(spark, sf_dir, table).createOrReplaceTempView(table)
    out = spark.sql(f"{PREFIX} SELECT * FROM {name}")
    naive = [f.name for f in out.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return out.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "emails")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exported message per page: single HTML body, nested multipart, or no HTML at all."""
    html = view(spark, sf_dir, "email_html")
    data = F.translate(F.base64(F.encode("html", "UTF-8")), "+/=\r\n", "-_")
    plain = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(F.lit("cGxhaW4").alias("data")).alias("body"), _no_parts().alias("parts"))
    rich = F.struct(F.lit("text/html").alias("mimeType"), F.struct(data.alias("data")).alias("body"), _no_parts().alias("parts"))
    inner = F.struct(
        F.lit("multipart/alternative").alias("mimeType"), F.struct(F.lit(None).cast("string").alias("data")).alias("body"),
        F.array(_leaf(plain), _leaf(rich)).alias("parts"))
    n = F.col("page_id")
    kind = F.when(n % 13 == 5, "none").when(n % 3 == 0, "single").otherwise("nested")
    sent = F.timestamp_seconds(F.lit(1_704_067_200) + n * 3_607)
    headers = F.filter(F.array(
        F.when(n % 7 != 0, F.struct(F.lit("Subject").alias("name"), F.concat(F.lit("Offer "), n.cast("string"), F.lit("% off")).alias("value"))),
        F.struct(F.lit("From").alias("name"), F.concat(F.lit("Shop "), (n % 9).cast("string"), F.lit(" <news@shop"), (n % 9).cast("string"), F.lit(".com>")).alias("value")),
        F.struct(F.lit("Date").alias("name"), F.when(n % 5 == 0, F.lit("garbage")).otherwise(
            F.concat(F.lit("Wed, "), F.date_format(sent, "d MMM yyyy HH:mm:ss"), F.lit(" +0530"))).alias("value")),
    ), lambda h: h.isNotNull())
    top = F.struct(
        F.when(kind == "single", "text/html").otherwise("multipart/mixed").alias("mimeType"), headers.alias("headers"),
        F.struct(F.when(kind == "single", data).alias("data")).alias("body"),
        F.when(kind == "nested", F.array(_branch(plain), inner)).when(kind == "none", F.array(_branch(plain))).alias("parts"))
    return html.select(F.concat(F.lit("m"), n.cast("string")).alias("id"), top.alias("payload"))


def _no_parts():
    return F.lit(None).cast("array<struct<mimeType:string,body:struct<data:string>>>")


def _leaf(part):
    return F.struct(part["mimeType"].alias("mimeType"), part["body"].alias("body"))


def _branch(part):
    return F.struct(part["mimeType"].alias("mimeType"), part["body"].alias("body"), part["parts"].alias("parts"))
