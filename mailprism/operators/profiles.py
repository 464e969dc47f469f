"""Brand, industry, type, festival and comparison profiles.

All profiles share ``profile``: one scan, one explode of every mail into its
(section, item) facts, one partially aggregated shuffle, then one row per group.
Raw rows of a hot brand are reduced before the shuffle, so a group never has to
fit in one task; only its distinct items do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions.scalars import (
    day_name, floor_days, icon_url, mean_len, pct, per_week, ratio, registrable_domain,
    send_frequency_label, time_bucket,
)
from mailprism.functions.subjects import has_emoji, subject_flags, subject_words
from mailprism.operators.ranking import (
    newest_first, _cols, counts, diverse_examples, has_brand, known_brand, modal, newest_subjects, present,
    tally_cells, top_n_per,
)

ALL = "all"
TOP = 10  # words and brands kept per group
MIN_RANGE_ROWS = 5  # festival: fewer relevant mails fall back to all mails in range


def _sections(names) -> dict:
    made = {
        "type": present("type"),
        "industry": present("industry"),
        "day": day_name("received_at"),
        "bucket": time_bucket("received_at"),
        "month": F.date_format("received_at", "yyyy-MM"),
        "brand": F.when(known_brand(), present("brand")),
    }
    return {n: made[n] for n in names if n in made}


def _fact(section: str, item: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"))


OPEN = ["word", "brand"]  # sections whose items are not a taxonomy


def section_counts(df: DataFrame, by, sections, lowest=()) -> DataFrame:
    """Long form (by…, section, item, cnt, chars, subjects, emoji, first_at, last_at, is_open).

    ``lowest`` names further columns listed as sections of their own. The subject measures are
    taken on the one ``all`` fact of a mail only. Every buffer is a number or a time, so Spark
    aggregates by hashing and not by sorting the facts.
    """
    by = _cols(by)
    facts = F.array(_fact(ALL, F.lit("")), *[_fact(n, c) for n, c in _sections(sections).items()], *[_fact(c, F.col(c)) for c in lowest])
    if "word" in sections:
        words = F.coalesce(subject_words("subject"), F.array().cast("array<string>"))
        facts = F.concat(facts, F.transform(words, lambda w: _fact("word", w)))
    rows = df.select(*by, "received_at", present("subject").alias("subject"), F.inline(facts)).where(F.col("item").isNotNull())
    subject = F.when(F.col("section") == ALL, F.col("subject"))
    return rows.groupBy(*by, "section", "item").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.coalesce(F.sum(F.length(subject)), F.lit(0)).alias("chars"),
        F.count(subject).alias("subjects"),
        F.count_if(has_emoji(subject, "analytics")).alias("emoji"),
        F.min("received_at").alias("first_at"),
        F.max("received_at").alias("last_at"),
        # an aggregate, so that filters on it stay above the exchange and all readers share one
        F.max(F.col("section").isin(*OPEN)).alias("is_open"),
    )


def profile(df: DataFrame, by, sections, lowest=()) -> DataFrame:
    """One row per group: totals plus, per section, array<struct<neg, item, cnt, first_at, last_at>>.

    Arrays are ordered by count descending then item. ``word`` and ``brand`` keep the
    top ten (``n_brand`` and ``brand_mails`` still count all); the other sections are small taxonomies.
    """
    by = _cols(by)
    tally = section_counts(df, by, sections, lowest)
    kept = tally.where("NOT is_open")
    opened = [s for s in sections if s in OPEN]
    if opened:  # cut with a group limit before the shuffle: a group's words and brands never meet in one task
        best = top_n_per(tally.where("is_open"), [*by, "section"], [F.desc("cnt"), F.asc("item")], TOP, "_rank")
        kept = kept.unionByName(best.drop("_rank"))
    if "brand" in opened:
        every = tally.where("is_open").groupBy(*by).agg(*[
            F.sum(F.when(F.col("section") == "brand", x)).alias(n) for n, x in (("cnt", F.lit(1)), ("chars", F.col("cnt")))])
        kept = kept.unionByName(every.withColumn("section", F.lit("all brands")), allowMissingColumns=True)
    entry = F.struct((-F.col("cnt")).alias("neg"), "item", "cnt", "first_at", "last_at")

    def only(section, value):
        return F.when(F.col("section") == section, value)

    def listed(section):
        return F.array_sort(F.collect_list(only(section, entry))).alias(section)

    aggs = [F.max(only(ALL, F.col(c))).alias(n) for c, n in
            [("cnt", "total"), ("chars", "chars"), ("subjects", "subjects"), ("emoji", "emoji"),
             ("first_at", "first_at"), ("last_at", "last_at")]]
    aggs += [F.min(only(c, F.col("item"))).alias(c) for c in lowest]
    aggs += [listed(s) for s in sections]
    if "brand" in sections:
        aggs += [F.coalesce(F.max(only("all brands", F.col("cnt"))), F.lit(0)).alias("n_brand"), F.max(only("all brands", F.col("chars"))).alias("brand_mails")]
    out = kept.groupBy(*by).agg(*aggs)
    return out.withColumns({
        "avg_subject_length": mean_len("chars", "subjects"),
        "emoji_rate": pct("emoji", "subjects"),
    })


def first_item(section: str) -> Column:
    """Most common item of a profile section, null when there is none."""
    return F.get(F.col(section), 0)["item"]


def listing(section, with_count: bool = True) -> Column:
    """Profile section as flat text ``item:cnt|item:cnt``."""
    arr = F.col(section) if isinstance(section, str) else section
    one = (lambda e: F.concat(e["item"], F.lit(":"), e["cnt"].cast("string"))) if with_count else (lambda e: e["item"])
    return F.array_join(F.transform(arr, one), "|")


def as_map(section: str) -> Column:
    """Profile section as map item -> count."""
    return F.map_from_entries(F.transform(F.col(section), lambda e: F.struct(e["item"], e["cnt"])))


def with_brand_key(df: DataFrame) -> DataFrame:
    """Case-insensitive brand key for look-ups by name."""
    return df.withColumn("brand_key", F.lower("brand"))


def pick(df: DataFrame, col: str, value, pattern: bool = False) -> DataFrame:
    """Rows of one value, case-insensitive; ``pattern`` keeps % and _ as wildcards."""
    if value is None:
        return df
    return df.where(F.col(col).ilike(value) if pattern else F.lower(col) == value.lower())


# --- counts -----------------------------------------------------------------


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per non-empty value."""
    return counts(df.where(present(col).isNotNull()), col)


def distinct_values(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    out = df if where is None else df.where(where)
    return out.where(present(col).isNotNull()).select(col).distinct().orderBy(col)


def brands_without_industry(df: DataFrame) -> DataFrame:
    """Known brands with mails lacking an industry, and how many."""
    return counts(df.where(known_brand() & F.col("industry").isNull()), "brand")


# --- brands -----------------------------------------------------------------


def brand_stats(df: DataFrame) -> DataFrame:
    """Count, date range, send-frequency label, modal industry and icon per known brand.

    Mails are first reduced to (brand, industry, sender) cells, so both the totals and
    the modal industry come from one shuffle of already combined rows.
    """
    cells = df.where(known_brand()).groupBy("brand", "industry", "sender").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("received_at").alias("lo"), F.max("received_at").alias("hi"))
    per_industry = cells.groupBy("brand", "industry").agg(
        F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("sender").alias("sender"))
    vote = F.when(F.col("industry").isNotNull(), F.struct((-F.col("cnt")).alias("neg"), F.col("industry").alias("value")))
    out = per_industry.groupBy("brand").agg(
        F.sum("cnt").alias("email_count"), F.min("lo").alias("first_email"), F.max("hi").alias("last_email"),
        F.min(vote)["value"].alias("industry"), F.min("sender").alias("sender"))
    domain = registrable_domain("sender")
    return out.select(
        "brand", "email_count", "first_email", "last_email",
        send_frequency_label("email_count", "first_email", "last_email").alias("send_frequency"),
        "industry", domain.alias("domain"), icon_url(domain).alias("icon_url"))


BRAND_SECTIONS = ["type", "industry", "day", "bucket", "word"]


def brand_profile(df: DataFrame, brand: str | None = None) -> DataFrame:
    """Profile per (case-insensitive) brand: rate, breakdowns, subject statistics, icon."""
    rows = with_brand_key(pick(df, "brand", brand)).where(has_brand())
    out = profile(rows, "brand_key", BRAND_SECTIONS, lowest=["sender"])
    return out.select(
        "brand_key", "total", first_item("industry").alias("primary_industry"),
        per_week("total", "first_at", "last_at").alias("emails_per_week"),
        F.col("first_at").alias("first_email"), F.col("last_at").alias("last_email"),
        F.col("type").alias("campaign_breakdown"), F.col("day").alias("send_days"),
        F.col("bucket").alias("send_times"), F.col("word").alias("top_words"),
        "avg_subject_length", "emoji_rate", icon_url(registrable_domain("sender")).alias("icon_url"))


def compare_brands(df: DataFrame, brands: list[str]) -> DataFrame:
    """Two to five requested brands side by side; a brand without mails keeps an error row."""
    if not 2 <= len(brands) <= 5:
        raise ValueError("compare 2 to 5 brands")
    asked = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(b.strip()) for b in brands])).alias("pos", "brand")
    ).withColumn("brand_key", F.lower("brand"))
    rows = with_brand_key(df).where(F.lower("brand").isin([b.strip().lower() for b in brands]))
    base = profile(rows, "brand_key", ["type", "industry"])
    facts = base.select(
        "brand_key", "total", first_item("industry").alias("industry"),
        per_week("total", "first_at", "last_at", mode="span1").alias("emails_per_week"),
        first_item("type").alias("top_type"), "avg_subject_length", "emoji_rate")
    out = asked.join(facts, "brand_key", "left")
    return out.select(
        "brand", "total", "industry", "emails_per_week", "top_type", "avg_subject_length", "emoji_rate",
        F.when(F.col("total").isNull(), "No emails found").alias("error"))


def calendar(df: DataFrame, t, brand: str | None = None, months: int = 3, examples: int = 10) -> DataFrame:
    """Per brand and month of the last ``months`` × 30 days: total, types, newest mails."""
    since = F.lit(t).cast("timestamp") - F.make_dt_interval(F.lit(months * 30))
    rows = with_brand_key(pick(df, "brand", brand)).where(has_brand() & (F.col("received_at") >= since))
    rows = rows.withColumn("month", F.date_format("received_at", "yyyy-MM"))
    base = profile(rows, ["brand_key", "month"], ["type"]).select(
        "brand_key", "month", "total", F.col("type").alias("campaign_breakdown"))
    newest = top_n_per(rows, ["brand_key", "month"], newest_first(), examples)
    item = F.struct("rank", F.date_format("received_at", "yyyy-MM-dd").alias("date"), "subject", "type")
    listed = newest.groupBy("brand_key", "month").agg(F.array_sort(F.collect_list(item)).alias("emails"))
    return base.join(listed, ["brand_key", "month"], "left")


def primary_industry(df: DataFrame) -> DataFrame:
    return modal(with_brand_key(df).where(has_brand()), "brand_key", "industry", "primary_industry")


def related_brands(df: DataFrame, n: int = 12) -> DataFrame:
    """First ``n`` other brands (by name) that mail in a brand's primary industry.

    Each industry keeps only its first n+1 names, so no pair list is ever built.
    """
    names = df.where(known_brand() & F.col("industry").isNotNull()).select(
        F.lower("industry").alias("_ind"), "brand").distinct()
    # case variants of the asked brand are skipped, so keep n names beyond each lower-case key
    firsts = names.withColumn("_key", F.lower("brand"))
    keyed = firsts.groupBy("_ind", "_key").agg(F.min("brand").alias("_min"))
    keep = top_n_per(keyed, "_ind", [F.asc("_min"), F.asc("_key")], n + 1, "_r").select("_ind", "_key")
    pool = firsts.join(keep, ["_ind", "_key"], "left_semi")
    listed = pool.groupBy("_ind").agg(F.array_sort(F.collect_list(F.struct("brand", "_key"))).alias("pool"))
    own = primary_industry(df).where(F.col("primary_industry").isNotNull()).withColumn("_ind", F.lower("primary_industry"))
    others = F.filter(F.col("pool"), lambda e: e["_key"] != F.col("brand_key"))
    out = own.join(listed, "_ind").select(
        "brand_key", "primary_industry", F.slice(F.transform(others, lambda e: e["brand"]), 1, n).alias("related"))
    return out.where(F.size("related") > 0)


def brand_public_profile(df: DataFrame, festivals: DataFrame, brand: str | None = None) -> DataFrame:
    """Brand profile with newest subjects and mails, festival counts and related brands."""
    rows = with_brand_key(pick(df, "brand", brand)).where(has_brand())
    out = brand_profile(df, brand)
    subjects = newest_subjects(rows, "brand_key", 5).groupBy("brand_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "subject"))).alias("sample_subjects"))
    recent = top_n_per(rows, "brand_key", newest_first(), 10).groupBy("brand_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "subject", "type", "received_at"))).alias("recent_emails"))
    fest = festival_rows(rows, festivals).where("relevant")
    fest = fest.groupBy("brand_key", "slug", "name", "year").agg(F.count(F.lit(1)).alias("cnt"))
    fest = fest.groupBy("brand_key").agg(
        F.array_sort(F.collect_list(F.struct("name", "year", "cnt"))).alias("festivals"))
    related = related_brands(df).select("brand_key", "related")
    for part in (subjects, recent, fest, related):
        out = out.join(part, "brand_key", "left")
    return out


def more_from_brand(df: DataFrame, n: int = 5) -> DataFrame:
    """For every mail the newest ``n`` other mails of its brand (case-insensitive)."""
    return _neighbours(with_brand_key(df).where(present("brand").isNotNull()), ["brand_key"], n)


def similar_emails(df: DataFrame, n: int = 5) -> DataFrame:
    """For every mail the newest ``n`` others of the same type and industry."""
    rows = df.where(present("type").isNotNull() & present("industry").isNotNull())
    return _neighbours(rows, ["type", "industry"], n)


def _neighbours(rows: DataFrame, by, n: int) -> DataFrame:
    # Each group is cut to its newest n+1 before the join, which then has one small row per group.
    top = top_n_per(rows, by, newest_first(), n + 1, "_r").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_r", F.col("id").alias("other_id")))).alias("_pool"))
    joined = rows.select("id", *by).join(top, by)
    others = F.filter(F.col("_pool"), lambda e: e["other_id"] != F.col("id"))
    picked = F.slice(F.transform(others, lambda e: e["other_id"]), 1, n)
    return joined.select("id", F.posexplode(picked).alias("pos", "other_id")).withColumn("pos", F.col("pos") + 1)


def email_public(df: DataFrame, email_id: int | None = None) -> DataFrame:
    """Public record of a mail: fields, subject flags, ids of related mails."""
    rows = df if email_id is None else df.where(F.col("id") == email_id)
    wanted = None if email_id is None else rows.select("id")

    def listed(pairs, name):
        pairs = pairs if wanted is None else pairs.join(wanted, "id", "left_semi")
        return pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "other_id"))).alias(name))

    out = rows.select("id", "subject", "brand", "sender", "type", "industry", "received_at", "preview", *subject_flags("subject"))
    out = out.join(listed(more_from_brand(df), "more_from_brand"), "id", "left")
    return out.join(listed(similar_emails(df), "similar_emails"), "id", "left")


# --- industries -------------------------------------------------------------


def industry_profile(df: DataFrame, industry: str | None = None) -> DataFrame:
    """Totals, top brands, type mix in percent of all rows, send days, averages."""
    rows = pick(df, "industry", industry).where(F.col("industry").isNotNull()).withColumn("industry_key", F.lower("industry"))
    out = profile(rows, "industry_key", ["type", "day", "brand"])
    mix = F.transform(F.col("type"), lambda e: F.struct(e["item"].alias("item"), F.bround(e["cnt"] / F.col("total") * 100, 1).alias("pct")))
    return out.select(
        "industry_key", "total", F.col("n_brand").alias("total_brands"), F.col("brand").alias("top_brands"),
        mix.alias("type_mix"), F.col("day").alias("send_days"),
        F.coalesce(F.bround(ratio("brand_mails", "n_brand"), 1), F.lit(0.0)).alias("avg_emails_per_brand"),
        "avg_subject_length")


def industry_public_profile(df: DataFrame, industry: str | None = None, recent: int = 15, months: int = 12) -> DataFrame:
    """Public industry page: top brands with rate, type shares, peaks, seasonality, newest mails.

    The full brand list of an industry is ``distinct_values`` in long form, not an array.
    """
    rows = pick(df, "industry", industry).where(F.col("industry").isNotNull()).withColumn("industry_key", F.lower("industry"))
    base = profile(rows, "industry_key", ["type", "day", "bucket", "brand", "month"])
    newest = top_n_per(rows, "industry_key", newest_first(), recent).groupBy("industry_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("recent_emails"))
    days = floor_days("first_at", "last_at")
    rate = F.when((days > 0) & (F.col("n_brand") > 0),
                  F.bround(ratio("total", "n_brand") / days * 7, 1)).otherwise(0.0)
    top = F.transform("brand", lambda e: F.struct(
        e["item"].alias("item"), e["cnt"].alias("cnt"),
        per_week(e["cnt"], e["first_at"], e["last_at"], mode="strict").alias("emails_per_week")))
    types = F.transform("type", lambda e: F.struct(
        e["item"].alias("item"), e["cnt"].alias("cnt"), F.bround(e["cnt"] / F.col("total") * 100, 1).alias("pct")))
    by_month = F.array_sort(F.transform("month", lambda e: F.struct(e["item"].alias("item"), e["cnt"].alias("cnt"))))
    tail = F.slice(by_month, F.greatest(F.size(by_month) - (months - 1), F.lit(1)), months)
    out = base.join(newest, "industry_key", "left")
    return out.select(
        "industry_key", F.col("n_brand").alias("total_brands"), "total", top.alias("top_brands"), types.alias("types"),
        "recent_emails", rate.alias("avg_emails_per_brand_per_week"), "avg_subject_length", "emoji_rate",
        first_item("day").alias("peak_send_day"), first_item("bucket").alias("peak_send_time"), tail.alias("seasonal"))


def industry_block(df: DataFrame, industry: str | None = None, n: int = 5) -> DataFrame:
    """Brands, total, top types and top brands (placeholder brand included) per industry."""
    rows = pick(df, "industry", industry).where(F.col("industry").isNotNull()).withColumn("industry_key", F.lower("industry"))
    cells = rows.groupBy("industry_key", "type", "brand").agg(F.count(F.lit(1)).alias("cnt"))
    totals = cells.groupBy("industry_key").agg(
        F.sum("cnt").alias("total"), F.count_distinct(F.when(known_brand(), F.col("brand"))).alias("total_brands"))

    def top(col, name):
        ranked = top_n_per(tally_cells(cells, col, ["industry_key"]), "industry_key", [F.desc("cnt"), F.asc("item")], n)
        return ranked.groupBy("industry_key").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "cnt"))).alias(name))

    out = totals.where("total_brands > 0")
    return out.join(top("type", "top_types"), "industry_key", "left").join(top("brand", "top_brands"), "industry_key", "left")


def overview(df: DataFrame, top: int = 10) -> DataFrame:
    """Whole-archive counts in long form (section, item, cnt); all sections share one set of cells."""
    cells = df.groupBy("brand", "industry", "type").agg(F.count(F.lit(1)).alias("cnt"))
    cells = cells.withColumn("known", F.when(known_brand(), F.col("brand")))

    def part(section, rows):
        return rows.select(F.lit(section).alias("section"), "item", "cnt")

    one = cells.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("emails"), F.count_distinct("known").alias("brands"))
    heads = one.select(F.inline(F.array(*[
        F.struct(F.lit("total").alias("section"), F.lit(c).alias("item"), F.col(c).alias("cnt")) for c in ("emails", "brands")])))
    best = tally_cells(cells, "known").orderBy(F.desc("cnt"), "item").limit(top)
    return (
        heads.unionByName(part("industry", tally_cells(cells, "industry")))
        .unionByName(part("type", tally_cells(cells, "type"))).unionByName(part("top_brand", best)))


# --- types ------------------------------------------------------------------


def type_list(df: DataFrame, slugs: DataFrame) -> DataFrame:
    """Types that have a page slug, most common first."""
    return counts(df.where(F.col("type").isNotNull()), "type").join(slugs.select("type", "slug"), "type").orderBy(F.desc("cnt"), "type")


def type_profile(df: DataFrame, slugs: DataFrame, slug: str | None = None) -> DataFrame:
    """Totals, brands, industries in percent, diverse examples, subjects, words and peak day per type."""
    asked = slugs if slug is None else slugs.where(F.col("slug") == slug)
    keys = asked.select(F.lower("type").alias("type_key"), "type", "slug")
    rows = df.withColumn("type_key", F.lower("type")).drop("type").join(keys, "type_key")
    base = profile(rows, "slug", ["industry", "brand", "day", "word"])
    examples = diverse_examples(rows, "slug").groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("examples"))
    subjects = newest_subjects(rows, "slug", 10).groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("rank", "subject"))).alias("sample_subjects"))
    others = slugs.agg(F.array_sort(F.collect_list(F.struct("pos", "slug"))).alias("s")).scalar()
    industries = F.transform("industry", lambda e: F.struct(
        e["item"].alias("item"), e["cnt"].alias("cnt"), F.bround(e["cnt"] / F.col("total") * 100, 1).alias("pct")))
    related = F.slice(F.transform(F.filter(F.col("_all"), lambda e: e["slug"] != F.col("slug")), lambda e: e["slug"]), 1, 5)
    out = base.join(examples, "slug", "left").join(subjects, "slug", "left").withColumn("_all", others)
    return out.select(
        "slug", "total", F.col("n_brand").alias("total_brands"), F.col("brand").alias("top_brands"),
        industries.alias("industries"), "examples", "avg_subject_length", "emoji_rate",
        F.col("word").alias("top_words"), "sample_subjects", first_item("day").alias("peak_send_day"),
        related.alias("related_types"))


# --- comparisons ------------------------------------------------------------


def compare_pairs(df: DataFrame, top: int = 5, min_emails: int = 20) -> DataFrame:
    """All pairs of the top brands of each industry (at most C(5,2) per industry)."""
    tally = counts(df.where(known_brand() & F.col("industry").isNotNull()).withColumn("_ind", F.lower("industry")), ["_ind", "brand"])
    best = top_n_per(tally, "_ind", [F.desc("cnt"), F.asc("brand")], top).where(F.col("cnt") >= min_emails)
    names = df.where(F.col("industry").isNotNull()).select("industry", F.lower("industry").alias("_ind")).distinct()
    listed = best.groupBy("_ind").agg(F.array_sort(F.collect_list("brand")).alias("b"))
    pairs = F.flatten(F.transform("b", lambda x, i: F.transform(
        F.filter(F.col("b"), lambda y: y > x), lambda y: F.struct(x.alias("brand_a"), y.alias("brand_b")))))
    return names.join(listed, "_ind").select("industry", F.inline(pairs))


def compare_summary(df: DataFrame, a: str, b: str) -> DataFrame:
    """Which of two brands is more active, writes longer subjects, uses more emoji (ties favour ``a``)."""
    asked = df.where(F.lower("brand").isin(a.lower(), b.lower()))
    base = profile(with_brand_key(asked), "brand_key", ["industry"])
    facts = F.struct(per_week("total", "first_at", "last_at").alias("rate"), "avg_subject_length", "emoji_rate",
                     first_item("industry").alias("industry"))
    # two groups at most, folded into one row
    one = base.select("brand_key", facts.alias("f")).agg(
        F.max(F.when(F.col("brand_key") == a.lower(), F.col("f"))).alias("a"),
        F.max(F.when(F.col("brand_key") == b.lower(), F.col("f"))).alias("b"),
    ).where("a IS NOT NULL AND b IS NOT NULL")

    def winner(field):
        return F.when(F.col(f"a.{field}") >= F.col(f"b.{field}"), a).otherwise(b)

    shared = F.when(F.lower(F.col("a.industry")) == F.lower(F.col("b.industry")), F.col("a.industry"))
    return one.select(
        F.lit(a).alias("brand_a"), F.lit(b).alias("brand_b"), winner("rate").alias("more_active"),
        winner("avg_subject_length").alias("longer_subjects"), winner("emoji_rate").alias("more_emoji"),
        shared.alias("shared_industry"))


# --- festivals --------------------------------------------------------------


def festival_rows(df: DataFrame, festivals: DataFrame) -> DataFrame:
    """Mails in each festival range (both ends included) with a ``relevant`` flag.

    The range join runs as an equi join: every festival is exploded to its calendar
    days, mails join on their day, and the exact bounds are checked afterwards.
    """
    days = festivals.withColumn("_day", F.explode(F.sequence(F.to_date("start_at"), F.to_date("end_at"))))
    rows = df.withColumn("_day", F.to_date("received_at")).join(days, "_day")
    rows = rows.where(F.col("received_at").between(F.col("start_at"), F.col("end_at"))).drop("_day")
    low = F.lower(F.coalesce(F.col("subject"), F.lit("")))
    named = F.exists("keywords", lambda k: F.contains(low, k))
    festive = F.coalesce(F.lower("type").isin("festive", "sale"), F.lit(False))
    return rows.withColumn("relevant", festive | named)


def festival_list(df: DataFrame, festivals: DataFrame, min_rows: int = MIN_RANGE_ROWS) -> DataFrame:
    """Festivals with enough mails in range, newest year first."""
    tally = counts(festival_rows(df, festivals), ["slug", "name", "year"])
    return tally.where(F.col("cnt") >= min_rows).orderBy(F.desc("year"), F.desc("name"))


def festival_selection(df: DataFrame, festivals: DataFrame, slug: str | None = None, year: int | None = None) -> DataFrame:
    """Relevant mails per festival and year, or all in range when fewer than five are relevant.

    The counts have one row per festival and year, so they go to the mails: a shuffle would bring all mails of a festival into one task.
    """
    if slug is not None:
        festivals = festivals.where(F.col("slug") == slug)
    if year is not None:
        festivals = festivals.where(F.col("year") == year)
    rows = festival_rows(df, festivals)
    thin = rows.groupBy("slug", "year").agg((F.count_if("relevant") < MIN_RANGE_ROWS).alias("_thin"))
    return rows.join(F.broadcast(thin), ["slug", "year"]).where(F.col("relevant") | F.col("_thin")).drop("_thin")


def festival_profile(df: DataFrame, festivals: DataFrame, slug: str | None = None, year: int | None = None) -> DataFrame:
    """Totals, industries, brands, types, diverse subject lines, newest mails and words per festival."""
    rows = festival_selection(df, festivals, slug, year)
    keys = ["slug", "year"]
    base = profile(rows, keys, ["industry", "brand", "type", "day", "word"])
    lines = diverse_examples(rows.where(present("subject").isNotNull()), keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best_subject_lines"))
    newest = top_n_per(rows, keys, newest_first(), 10).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best_emails"))
    industries = F.transform("industry", lambda e: F.struct(
        e["item"].alias("item"), e["cnt"].alias("cnt"), F.bround(e["cnt"] / F.col("total") * 100, 1).alias("pct")))
    out = base.join(lines, keys, "left").join(newest, keys, "left")
    return out.select(
        *keys, "total", F.col("n_brand").alias("total_brands"), industries.alias("industries"),
        F.col("brand").alias("top_brands"), F.col("type").alias("campaign_types"), "best_subject_lines", "best_emails",
        "avg_subject_length", "emoji_rate", first_item("day").alias("peak_send_day"), F.col("word").alias("top_words"))
