"""Rule columns: industry, campaign type, brand; overrides, label merging and backfills."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism import dims
from mailprism.dims import Rules
from mailprism.functions.brands import clean_brand, letters_and_digits, normalize_brand
from mailprism.functions.scalars import title_case
from mailprism.functions.subjects import contains_any
from mailprism.operators import patterns
from mailprism.operators.numbering import numbered
from mailprism.operators.ranking import computed_once, counts, known_brand
from mailprism.session import local_table

MIN_SCORE = 4
AMBIGUITY = 0.7
MIN_LABEL_CONFIDENCE = 0.8


def _low(col) -> Column:
    return F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))


def _has(df: DataFrame, col: str) -> Column:
    return F.col(col) if col in df.columns else F.lit(None).cast("string")


def _rule_array(rows, *names) -> Column:
    """Literal array<struct<names>> of rule rows (folded to one constant)."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def _points(hits: Column, slots: int, worth) -> Column:
    """Points per slot: ``worth(hit)`` added to slot ``hit.pos`` for every hit."""
    zeros = F.array_repeat(F.lit(0), F.lit(slots))

    def add(acc, hit):
        return F.transform(acc, lambda x, i: F.when(i == hit["pos"], x + worth(hit)).otherwise(x))

    return F.aggregate(hits, zeros, add)


def industry_by_keywords(df: DataFrame, rules: Rules | None = None, min_score: int = MIN_SCORE, ambiguity: float = AMBIGUITY,
                         body: str | None = "body_text", name: str = "kw_industry") -> DataFrame:
    """Adds the industry with a clear lead in keyword points, else null.

    A keyword adds its weight once, twice when the subject contains it. The whole body
    counts. A tie or a close second gives null. Rules that are a DataFrame are joined (see ``patterns``), a list becomes one expression.
    """
    keywords = (rules or Rules()).industry_keywords
    if isinstance(keywords, DataFrame):
        return _industry_by_table(df, keywords, min_score, ambiguity, body, name)
    industries = list(dict.fromkeys(i for i, _, _ in keywords))
    table = _rule_array([(industries.index(i), k, w) for i, k, w in keywords], "pos", "k", "w")
    parts = [F.col("subject"), _has(df, "preview")]
    if body and body in df.columns:
        parts.append(F.col(body))
    # the lower-case texts become columns first, so the keyword lambdas do not repeat that work
    out = df.withColumns({"_subject": _low("subject"), "_text": F.lower(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))})
    hits = F.filter(table, lambda r: F.contains(F.col("_text"), r["k"]) | F.contains(F.col("_subject"), r["k"]))
    points = _points(hits, len(industries), lambda h: F.when(F.contains(F.col("_subject"), h["k"]), h["w"] * 2).otherwise(h["w"]))
    out = out.withColumn("_s", F.reverse(F.array_sort(F.transform(points, lambda x, i: F.struct(x.alias("x"), (-i).alias("neg"))))))
    best, second = F.get("_s", 0), F.get("_s", 1)
    clear = F.coalesce(F.try_divide(second["x"].cast("double"), best["x"]) <= ambiguity, F.lit(True))
    label = F.get(F.array(*[F.lit(i) for i in industries]), -best["neg"])
    return computed_once(out, **{name: F.when((best["x"] >= min_score) & clear, label)}).drop("_s", "_subject", "_text")


def _mail_texts(df: DataFrame, body: str | None) -> dict[str, Column]:
    """Lower-case subject, and subject, preview and body in one text."""
    parts = [F.col("subject"), _has(df, "preview")]
    if body and body in df.columns:
        parts.append(F.col(body))
    return {"_subject": _low("subject"), "_text": F.lower(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))}


def _industry_by_table(df: DataFrame, keywords: DataFrame, min_score: int, ambiguity: float, body: str | None, name: str) -> DataFrame:
    held, distinct = patterns.with_text_id(df, _mail_texts(df, body))
    order = keywords.groupBy("industry").agg(F.min("pos").alias("order"))
    once = keywords.groupBy("industry", "keyword").agg(F.sum(F.col("weight").cast("long")).alias("weight")).join(order, "industry")
    found = patterns.hits(distinct, once, ["_subject", "_text"], ["_text"])
    worth = F.col("weight") * F.when(F.col("in_subject"), 2).otherwise(1)
    points = found.groupBy("_text_id", "industry").agg(F.sum(worth).alias("x"), F.min("order").alias("order"))
    ranked = points.groupBy("_text_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("x", (-F.col("order")).alias("neg"), "industry")), asc=False), 1, 2).alias("s"))
    best, second = F.get("s", 0), F.get("s", 1)
    clear = F.coalesce(F.try_divide(second["x"].cast("double"), best["x"]) <= ambiguity, F.lit(True))
    label = ranked.select("_text_id", F.when((best["x"] >= min_score) & clear, best["industry"]).alias(name)).where(F.col(name).isNotNull())
    return held.join(label, "_text_id", "left").drop("_text_id")


def keyword_hits(df: DataFrame, rules: Rules | None = None, key: str = "id") -> DataFrame:
    """(key, industry, keyword, weight, in_subject) for every industry keyword found in subject or preview."""
    keywords = (rules or Rules()).industry_keywords
    if isinstance(keywords, DataFrame):
        held, distinct = patterns.with_text_id(df, {"_subject": _low("subject"), "_text": F.lower(F.concat_ws(" ", "subject", _has(df, "preview")))})
        found = patterns.hits(distinct, keywords, ["_subject", "_text"], ["_text"])
        return held.select(key, "_text_id").join(found, "_text_id").select(key, "industry", "keyword", F.col("weight").cast("int").alias("weight"), "in_subject")
    table = _rule_array(keywords, "industry", "keyword", "weight")
    out = df.withColumns({"_subject": _low("subject"), "_text": F.lower(F.concat_ws(" ", "subject", _has(df, "preview")))})
    hits = F.filter(table, lambda r: F.contains(F.col("_text"), r["keyword"]) | F.contains(F.col("_subject"), r["keyword"]))
    found = out.select(key, "_subject", F.inline(hits))
    return found.select(key, "industry", "keyword", "weight", F.contains("_subject", F.col("keyword")).alias("in_subject"))


# --- campaign type ----------------------------------------------------------


def campaign_type(df: DataFrame, rules: Rules | None = None, body: str | None = "body_text",
                  name: str = "kw_type") -> DataFrame:
    """Adds the campaign type: a percentage in the subject is a sale, else the best score.

    Scores count keywords in subject, preview and body with weights 5, 2 and 1; among the types
    over their threshold the highest score wins, the earlier type on ties. The whole preview and body count.
    """
    kinds = [k for k, _ in dims.CAMPAIGN_TYPES]
    keywords = (rules or Rules()).type_keywords
    if isinstance(keywords, DataFrame):
        return _type_by_table(df, keywords, body, name)
    table = _rule_array([(kinds.index(t), k) for t, k in keywords], "pos", "k")
    texts = {"_subject": (_low("subject"), "subject")}
    if "preview" in df.columns:
        texts["_preview"] = (_low("preview"), "preview")
    if body and body in df.columns:
        texts["_body"] = (_low(body), "body")
    out = df.withColumns({c: text for c, (text, _) in texts.items()})

    def worth(hit):
        total = F.lit(0)
        for c, (_, source) in texts.items():
            total = total + F.contains(F.col(c), hit["k"]).cast("int") * dims.TYPE_SOURCE_WEIGHTS[source]
        return total

    hits = F.filter(table, lambda r: reduce(or_, [F.contains(F.col(c), r["k"]) for c in texts]))
    needs = F.array(*[F.lit(n) for _, n in dims.CAMPAIGN_TYPES])
    rows = F.transform(_points(hits, len(kinds), worth), lambda x, i: F.struct((-x).alias("neg"), i.alias("pos"), (x >= F.get(needs, i)).alias("enough")))
    best = F.array_min(F.filter(rows, lambda r: r["enough"]))["pos"]
    label = F.when(_percent_sale("_subject"), "Sale").otherwise(F.get(F.array(*[F.lit(k) for k in kinds]), best))
    return computed_once(out, **{name: label}).drop(*texts)


def _percent_sale(subject: str) -> Column:
    """A percentage that names a sale, or that no other word explains."""
    percent = F.rlike(subject, F.lit(r"\p{Nd}+(?U:\s)*%"))
    return percent & (contains_any(subject, dims.PERCENT_SALE_WORDS) | ~contains_any(subject, dims.PERCENT_OTHER_WORDS))


def _type_by_table(df: DataFrame, keywords: DataFrame, body: str | None, name: str) -> DataFrame:
    sources = {"_subject": "subject"} | ({"_preview": "preview"} if "preview" in df.columns else {}) | ({"_body": body} if body and body in df.columns else {})
    weights = {c: dims.TYPE_SOURCE_WEIGHTS[c[1:]] for c in sources}
    held, distinct = patterns.with_text_id(df, {c: _low(source) for c, source in sources.items()})
    once = keywords.groupBy("type", "keyword").agg(F.count(F.lit(1)).alias("times"))
    found = patterns.hits(distinct, once, list(sources))
    score = reduce(lambda x, y: x + y, [F.col(f"in{c}").cast("int") * w for c, w in weights.items()]) * F.col("times")
    kinds = local_table(df.sparkSession, [(k, t, need) for k, (t, need) in enumerate(dims.CAMPAIGN_TYPES)], "order int, type string, need int")
    scores = found.groupBy("_text_id", "type").agg(F.sum(score).alias("x")).join(F.broadcast(kinds), "type").where("x >= need")
    best = scores.groupBy("_text_id").agg(F.min_by("type", F.struct(-F.col("x"), "order")).alias("_best"))
    out = held.join(best, "_text_id", "left").withColumn("_low", _low("subject"))
    return out.withColumn(name, F.when(_percent_sale("_low"), "Sale").otherwise(F.col("_best"))).drop("_text_id", "_best", "_low")


# --- industry from the brand ------------------------------------------------


def exact_brand_match(brands: DataFrame, mapping: DataFrame) -> DataFrame:
    """brand rows with the industry whose key equals the normalised brand."""
    keyed = brands.withColumn("key", normalize_brand("brand"))
    return keyed.join(mapping.select("key", "industry"), "key", "left").drop("key")


def _substrings(text: Column, low: int, high: Column | None = None) -> Column:
    """Distinct substrings of at least ``low`` (and at most ``high``) characters."""
    none = F.array().cast("array<string>")

    def from_start(i):
        most = F.length(text) - i + 1
        most = most if high is None else F.least(most, high)
        return F.when(most >= low, F.transform(F.sequence(F.lit(low), most), lambda n: F.substr(text, i, n))).otherwise(none)

    starts = F.when(F.length(text) >= low, F.sequence(F.lit(1), F.length(text) - (low - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, from_start)))


def _long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 3))


def _probes(**texts) -> Column:
    """array<struct<kind, text>> of named single texts or text arrays."""
    def tagged(kind, arr):
        return F.transform(arr, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    return F.concat(*[tagged(kind, text if is_array else F.array(text)) for kind, (text, is_array) in texts.items()])


def fuzzy_brand_match(brands: DataFrame, mapping: DataFrame) -> DataFrame:
    """(brand, industry, confidence) for each distinct brand that matches a key.

    A key matches when it is contained in the brand, contains the brand (longer than three)
    or shares a word longer than three. An equal key wins at once, then an equal form, else the
    longest key, the earlier one on ties. All of it is one equi join: each brand is expanded to
    its probes (itself, its substrings, its words) and the keys to the matching entries, where
    every text keeps only its best key, so a probe meets at most one entry.
    """
    norm, full = F.col("norm"), F.col("full")
    keys = mapping.select("pos", "industry", F.col("key").alias("full"), letters_and_digits("key").alias("norm"))
    entries = keys.select("pos", "industry", F.length("full").alias("len"), F.inline(_probes(
        exact=(full, False), equal=(norm, False), inside=(norm, False), around=(_substrings(norm, 4), True), word=(_long_words(norm), True))))
    rank = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "equal", 1).otherwise(2)
    size = F.when(rank < 2, F.lit(0)).otherwise(-F.col("len"))
    best = F.min(F.struct(rank.alias("rank"), size.alias("neg"), "pos", "industry"))
    table = entries.groupBy("kind", "text").agg(best.alias("m"))

    names = brands.select("brand").distinct().withColumn("full", normalize_brand("brand"))
    longest = keys.agg(F.max(F.length("norm"))).scalar()
    names = names.withColumns({"norm": letters_and_digits("full"), "_longest": longest})
    whole = F.when(F.length("norm") > 3, F.array("norm")).otherwise(F.array().cast("array<string>"))
    inner = F.concat(F.array(F.lit("")), _substrings(norm, 1, F.col("_longest")))
    probes = names.select("brand", F.inline(_probes(
        exact=(full, False), equal=(norm, False), inside=(inner, True), around=(whole, True), word=(_long_words(norm), True))))
    out = probes.join(table, ["kind", "text"]).groupBy("brand").agg(F.min("m").alias("m"))
    return out.select("brand", "m.industry", F.when(F.col("m.rank") == 0, 1.0).otherwise(0.9).alias("confidence"))


def classify_industry(df: DataFrame, rules: Rules | None = None, labeler=None, body: str | None = "body_text") -> DataFrame:
    """Adds new_industry, new_category, classified_by and confidence.

    Cascade: brand map (exact, then fuzzy), labels, keywords. Unknown brands go straight to
    the keywords. ``labeler`` maps a frame of distinct unmatched brands to
    (brand, industry, subcategory, campaign_type, confidence) answers.
    """
    rules = rules or Rules()
    spark = df.sparkSession
    known = df.where(known_brand() & (F.col("brand") != "")).select("brand").distinct()
    matched = fuzzy_brand_match(known, dims.brand_industry_table(spark, rules)).select(
        "brand", F.col("industry").alias("_m_ind"), F.col("confidence").alias("_m_conf"))
    out = df.join(matched, "brand", "left")
    if labeler is not None:
        answers = labeler(known.join(matched, "brand", "left_anti"))
        labels = validated(answers).select(
            "brand", F.col("industry").alias("_l_ind"), F.col("subcategory").alias("_l_cat"), F.col("confidence").alias("_l_conf"))
        out = out.join(labels, "brand", "left")
    else:
        out = out.withColumns({"_l_ind": F.lit(None).cast("string"), "_l_cat": F.lit(None).cast("string"), "_l_conf": F.lit(None).cast("double")})
    out = industry_by_keywords(out, rules, body=body, name="_k_ind")
    by = (
        F.when(F.col("_m_ind").isNotNull(), "keyword").when(F.col("_l_ind").isNotNull(), "ai")
        .when(F.col("_k_ind").isNotNull(), "content"))
    return out.withColumns({
        "new_industry": F.coalesce("_m_ind", "_l_ind", "_k_ind"),
        "new_category": F.when(F.col("_m_ind").isNull(), F.col("_l_cat")),
        "classified_by": by,
        "confidence": F.coalesce("_m_conf", "_l_conf"),
    }).drop("_m_ind", "_m_conf", "_l_ind", "_l_cat", "_l_conf", "_k_ind")


# --- brand ------------------------------------------------------------------


def _known(rules: Rules) -> Column:
    return _rule_array(rules.known_senders, "key", "brand")


def brand_from_sender(sender, rules: Rules) -> Column:
    """First known domain part contained in the sender, else null."""
    low = _low(sender)
    return F.get(F.filter(_known(rules), lambda r: F.contains(low, r["key"])), 0)["brand"]


def _group(text, pattern, group=1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def display_name(sender) -> Column:
    raw = F.trim(_group(F.col(sender) if isinstance(sender, str) else sender, r"^([^<]+)<"))
    return F.btrim(F.btrim(raw, F.lit('"')), F.lit("'"))


def domain_name(sender) -> Column:
    """First label of the sender's domain that is not generic and longer than two characters."""
    col = F.col(sender) if isinstance(sender, str) else sender
    full = F.regexp_extract(col, r"@([a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)*)\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})?", 1)
    generic = F.array(*[F.lit(g) for g in dims.GENERIC_SUBDOMAINS])
    labels = F.filter(F.split(full, r"\."), lambda p: (F.length(p) > 2) & ~F.array_contains(generic, F.lower(p)))
    return title_case(F.get(labels, 0))


# Brand in front of a subject; name next to a copyright sign.
_NAME = r"([A-Za-z][A-Za-z0-9\s&]+?)"
SUBJECT_BRAND = [r"^\[" + _NAME + r"\]", r"^" + _NAME + r":\s", r"^" + _NAME + r"\s*[-|]\s"]
FOOTER_BRAND = [
    r"©\s*\d{4}\s+" + _NAME + r"(?:\s*[,\.|]|$)",
    r"copyright\s*(?:©?\s*\d{4})?\s+" + _NAME + r"(?:\s*[,\.|]|$)",
    _NAME + r"\s*©\s*\d{4}",
]
TEXT_BRAND = r"©\s*\d{4}\s+([A-Za-z][A-Za-z0-9\s&]{2,30}?)(?:\s*[,\.|All]|$)"
# candidate source -> confidence
BRAND_SCORES = {"display": 80, "domain": 60, "site_name": 90, "twitter_site": 85, "app_name": 85, "logo": 75,
                "footer": 70, "text": 65, "subject": 50}
MAX_SUBJECT_BRAND = 30


def _candidate(source: str, text: Column, n=0) -> Column:
    group = list(BRAND_SCORES).index(source)
    order = F.lit(group * 100) + n
    return F.struct(F.lit(-BRAND_SCORES[source]).alias("neg"), order.alias("pos"), F.lit(group).alias("grp"), text.alias("text"))


def brand_candidates(html: bool = False) -> Column:
    """array<struct<neg, pos, grp, text>> of raw candidate names, in the order they are tried."""
    single = [_candidate("display", display_name("sender")), _candidate("domain", domain_name("sender"))]
    single += [_candidate("subject", _group(F.col("subject"), "(?U)" + rx), n) for n, rx in enumerate(SUBJECT_BRAND)]
    if not html:
        return F.array(*single)
    sig = F.col("signals")
    single += [
        _candidate("site_name", sig["site_name"]), _candidate("twitter_site", F.ltrim(sig["twitter_site"], F.lit("@"))),
        _candidate("app_name", sig["app_name"])]
    single += [_candidate("footer", _group(sig["footer_text"], "(?iU)" + rx), n) for n, rx in enumerate(FOOTER_BRAND)]
    single.append(_candidate("text", F.when(sig["footer_text"].isNull(), _group(sig["all_text"], "(?iU)" + TEXT_BRAND))))
    logos = F.transform(sig["logo_alts"], lambda alt, i: _candidate("logo", alt, i))
    return F.concat(F.array(*single), logos)


def extract_brand(df: DataFrame, rules: Rules | None = None, html: bool = False, name: str = "new_brand") -> DataFrame:
    """Adds the brand: known sender, else the best of the scored candidates, else 'Unknown'.

    With ``html`` the frame must carry the ``signals`` struct made by ``html.html_features``. Every
    source gives at most one name, its first usable one. The names are compared with the known
    senders in score order (containment both ways); without a hit the best name wins.
    """
    rules = rules or Rules()
    domain, subject = list(BRAND_SCORES).index("domain"), list(BRAND_SCORES).index("subject")

    def named(c):
        clean = F.when(c["grp"] == domain, c["text"]).otherwise(clean_brand(c["text"]))
        return F.struct(c["neg"].alias("neg"), c["pos"].alias("pos"), c["grp"].alias("grp"), clean.alias("name"))

    def usable(c):
        return c["name"].isNotNull() & ((c["grp"] != subject) | (F.length(c["name"]) <= MAX_SUBJECT_BRAND))

    out = df.withColumn("_all", F.filter(brand_candidates(html), lambda c: c["text"].isNotNull()))
    out = out.withColumn("_c", F.array_sort(F.filter(F.transform("_all", named), usable)))
    firsts = F.filter("_c", lambda c, i: (i == 0) | (F.get(F.col("_c"), i - 1)["grp"] != c["grp"]))
    table = _known(rules)

    def mapped(cand):
        low = F.lower(cand["name"])
        return F.get(F.filter(table, lambda r: F.contains(low, r["key"]) | F.contains(r["key"], low)), 0)["brand"]

    hits = F.filter(F.transform(firsts, mapped), lambda b: b.isNotNull())
    best = F.coalesce(brand_from_sender("sender", rules), F.get(hits, 0), F.get("_c", 0)["name"], F.lit("Unknown"))
    return computed_once(out, **{name: best}).drop("_all", "_c")


# --- overrides, renames, labels ---------------------------------------------


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Industry and category replaced per brand (exact case); ``changed`` marks rows that differ."""
    out = df.join(overrides, "brand", "left")
    hit = F.col("new_industry").isNotNull()
    changed = hit & (~F.col("industry").eqNullSafe(F.col("new_industry")) | ~F.col("category").eqNullSafe(F.col("new_category")))
    return out.withColumns({
        "old_industry": F.col("industry"), "old_category": F.col("category"), "changed": changed,
        "industry": F.coalesce("new_industry", "industry"), "category": F.coalesce("new_category", "category"),
    }).drop("new_industry", "new_category")


def override_log(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per overridden brand the rows that really change."""
    out = apply_overrides(df, overrides).where("changed")
    return out.groupBy("brand", "industry", "category").agg(
        F.count(F.lit(1)).alias("changed"), F.min("old_industry").alias("old_industry"))


def rename_values(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Values of ``col`` replaced by a (old, new) table."""
    out = df.join(mapping.withColumnRenamed("old", col), col, "left")
    return out.withColumns({"renamed": F.col("new").isNotNull(), col: F.coalesce("new", col)}).drop("new")


def propagate_brand_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Brand-level (brand_name, industry) given to all mails of the brand, case-insensitive."""
    keyed = labels.select(F.lower("brand_name").alias("_key"), F.col("industry").alias("_label"))
    out = df.withColumn("_key", F.lower("brand")).join(keyed, "_key", "left")
    return out.withColumn("industry", F.coalesce("_label", "industry")).drop("_key", "_label")


def _unfenced(col) -> Column:
    """Answer text without surrounding code fences."""
    col = F.col(col) if isinstance(col, str) else col
    inner = F.regexp_extract(col, r"(?s)^\s*```(?:json)?(.*?)(?:```|$)", 1)
    return F.btrim(F.when(inner != "", inner).otherwise(col), F.lit(" \n\r\t"))


def merge_label_answers(rows: DataFrame, answers: DataFrame, allowed=None) -> DataFrame:
    """Types from batch answers: rows (batch_id, pos, …) ⋈ answers (batch_id, answer).

    An answer is a JSON array of {i, t}, maybe inside code fences; i counts from 1, an unknown
    type becomes Promotional, positions outside the batch are ignored, the last entry wins.
    """
    allowed = allowed or [k for k, _ in dims.CAMPAIGN_TYPES]
    items = F.from_json(_unfenced("answer"), "array<struct<i:int,t:string,index:int,type:string>>")
    flat = answers.select("batch_id", F.posexplode(items).alias("n", "a"))
    label = F.coalesce("a.t", "a.type", F.lit("Promotional"))
    flat = flat.select(
        "batch_id", "n", F.coalesce("a.i", "a.index").alias("pos"),
        F.when(label.isin(allowed), label).otherwise("Promotional").alias("new_type"))
    last = flat.groupBy("batch_id", "pos").agg(F.max_by("new_type", "n").alias("new_type"))
    return rows.join(last, ["batch_id", "pos"])


def label_batches(df: DataFrame, size: int = 10, order: str = "id", ranges: int | None = None) -> DataFrame:
    """Adds batch_id and pos (1..size), numbering the rows by a unique ``order`` (see ``numbered``)."""
    n = F.col("_n")
    return numbered(df, order, name="_n", ranges=ranges).withColumns({"batch_id": F.floor(n / size).cast("long"), "pos": (n % size + 1).cast("int")}).drop("_n")


def validated(answers: DataFrame) -> DataFrame:
    """Brand-level labels checked against the taxonomy, with defaults for anything invalid."""
    types = [k for k, _ in dims.CAMPAIGN_TYPES]
    pairs = [f"{i}|{sub}" for i, subs in dims.SUBCATEGORIES.items() for sub in subs]
    industry = F.when(F.col("industry").isin(dims.INDUSTRIES), F.col("industry")).otherwise(dims.DEFAULT_INDUSTRY)
    out = answers.withColumn("industry", industry)
    fits = F.concat_ws("|", "industry", "subcategory").isin(pairs)
    return out.withColumns({
        "subcategory": F.when(fits, F.col("subcategory")).otherwise("Others"),
        "campaign_type": F.when(F.col("campaign_type").isin(types), F.col("campaign_type")).otherwise("Newsletter"),
        "confidence": F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(0.8),
    })


def validate_brand_labels(answers: DataFrame) -> DataFrame:
    """(brand, answer JSON text) → validated labels; unreadable text gives the defaults at 0.5."""
    schema = "industry string, subcategory string, campaign_type string, confidence string, _bad string"
    parsed = answers.withColumn("_a", F.from_json(_unfenced("answer"), schema, {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_a").isNull() | F.col("_a._bad").isNotNull()
    fields = parsed.select(
        *answers.columns, broken.alias("_broken"), F.col("_a.industry").alias("industry"), F.col("_a.subcategory").alias("subcategory"),
        F.col("_a.campaign_type").alias("campaign_type"), F.col("_a.confidence").try_cast("double").alias("confidence"))
    out = validated(fields)
    return out.withColumn("confidence", F.when(F.col("_broken"), 0.5).otherwise(F.col("confidence"))).drop("_broken")


def resolve_labels(current: DataFrame, labels: DataFrame, min_conf: float = MIN_LABEL_CONFIDENCE) -> DataFrame:
    """(brand, current_industry, emails) ⋈ labels → final industry, category and disagreement flag."""
    valid = dims.INDUSTRIES
    out = current.join(labels.select("brand", "industry", "subcategory", "confidence"), "brand")
    sure = (F.col("confidence") >= min_conf) & F.col("industry").isin(valid)
    keep = F.coalesce(F.col("current_industry").isin(valid), F.lit(False))
    return out.select(
        "brand", "current_industry", "emails", F.col("industry").alias("label_industry"), "confidence",
        F.when(sure, F.col("industry")).when(keep, F.col("current_industry")).otherwise(F.col("industry")).alias("final_industry"),
        F.col("subcategory").alias("final_category"),
        (keep & (F.col("industry") != F.col("current_industry"))).alias("disagrees"))


# --- backfills --------------------------------------------------------------


def reprocess(df: DataFrame, columns=("brand", "industry", "type"), only_missing: bool = True, rules: Rules | None = None,
              labeler=None, html: bool = False) -> DataFrame:
    """Recomputes rule columns; each keeps its previous value as ``old_<column>``.

    ``only_missing`` fills nulls (and unknown brands) only. A new value never replaces an old
    one by null.
    """
    rules = rules or Rules()
    out = df.withColumns({f"old_{c}": F.col(c) for c in columns})
    if "brand" in columns:
        out = extract_brand(out, rules, html=html, name="_new")
        lost = F.col("brand").isNull() | F.col("brand").isin("Unknown", "unknown")
        take = (F.col("_new") != "Unknown") & (lost if only_missing else F.lit(True))
        out = computed_once(out, brand=F.when(take, F.col("_new")).otherwise(F.col("brand"))).drop("_new")
    if "industry" in columns:
        out = classify_industry(out, rules, labeler)
        fresh = F.coalesce("industry", "new_industry") if only_missing else F.coalesce("new_industry", "industry")
        out = out.withColumn("industry", fresh).drop("new_industry", "new_category", "classified_by", "confidence")
    if "type" in columns:
        out = campaign_type(out, rules, name="_new")
        fresh = F.coalesce("type", "_new") if only_missing else F.coalesce("_new", "type")
        out = out.withColumn("type", fresh).drop("_new")
    return out


def change_report(df: DataFrame, columns=("brand", "industry", "type")) -> DataFrame:
    """(column, metric, cnt): processed, updated and still unclassified rows after ``reprocess``."""
    aggs = [F.count(F.lit(1)).alias("processed")]
    for c in columns:
        aggs += [F.count_if(~F.col(c).eqNullSafe(F.col(f"old_{c}"))).alias(f"{c}_updated"), F.count_if(F.col(c).isNull()).alias(f"{c}_null")]
    one = df.agg(*aggs)
    rows = []
    for c in columns:
        for metric, source in (("processed", "processed"), ("updated", f"{c}_updated"), ("unclassified", f"{c}_null")):
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(metric).alias("metric"), F.col(source).alias("cnt")))
    return one.select(F.inline(F.array(*rows)))


def unmatched_brands(df: DataFrame, n: int = 50) -> DataFrame:
    """Known brands that still have no industry, most mails first."""
    todo = df.where(known_brand() & F.col("industry").isNull())
    return counts(todo, "brand").orderBy(F.desc("cnt"), "brand").limit(n)
