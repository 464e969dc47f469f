"""Classifiers, overrides, label merging, HTML operators and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailprism import dims
from mailprism.operators import classify as cl
from mailprism.operators import html as ht
from mailprism.operators import ranking as rk
from mailprism.operators import scoring as sg
from mailprism.plans import sqltext as s
from mailprism.plans.catalog import query
from mailprism.plans.catalog_mail import _norm_sql, clean_sql
from mailprism.session import local_table

RULES = dims.Rules()


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# --- rule tables as SQL -----------------------------------------------------

_INDS = list(dict.fromkeys(i for i, _, _ in RULES.industry_keywords))
KW = f"ikw(pos, industry, k, w) AS (VALUES {s.values([(_INDS.index(i), i, k, w) for i, k, w in RULES.industry_keywords])})"
TK = f"tkw(type, k) AS (VALUES {s.values(RULES.type_keywords)}), tneed(pos, type, need) AS (VALUES {s.values([(n, t, x) for n, (t, x) in enumerate(dims.CAMPAIGN_TYPES)])})"
KEYS = f"bkey(pos, key, industry) AS (VALUES {s.values([(n, k, v) for n, (k, v) in enumerate(RULES.brand_industry)])})"
SENDERS = f"known(pos, key, brand) AS (VALUES {s.values([(n, k, b) for n, (k, b) in enumerate(RULES.known_senders)])})"


def kw_industry(src: str, name: str) -> str:
    """CTEs: <name>(id, industry) by weighted keywords."""
    return (f"{name}_t AS (SELECT id, lower(subject) AS sj, lower(concat_ws(' ', subject, preview)) AS tx FROM {src}), "
            f"{name}_s AS (SELECT id, industry, sum(w * CASE WHEN contains(sj, k) THEN 2 ELSE 1 END) AS sc FROM {name}_t JOIN ikw ON contains(tx, k) GROUP BY id, industry), "
            f"{name}_r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC) AS r, lead(sc) OVER (PARTITION BY id ORDER BY sc DESC) AS nx FROM {name}_s), "
            f"{name} AS (SELECT id, industry FROM {name}_r WHERE r = 1 AND sc >= 4 AND (nx IS NULL OR CAST(nx AS DOUBLE) / sc <= 0.7))")


def kw_type(src: str, name: str) -> str:
    """CTEs: <name>(id, type) by keyword scores."""
    sale = s.has_any("subject", dims.PERCENT_SALE_WORDS)
    other = s.has_any("subject", dims.PERCENT_OTHER_WORDS)
    return (f"{name}_s AS (SELECT id, tkw.type, sum(5 * CAST(contains(lower(subject), k) AS INT) + 2 * CAST(contains(lower(preview), k) AS INT)) AS sc FROM {src} "
            f"JOIN tkw ON contains(lower(subject), k) OR contains(lower(preview), k) GROUP BY id, tkw.type), "
            f"{name}_b AS (SELECT id, arg_min(n.type, (-sc, n.pos)) AS type FROM {name}_s z JOIN tneed n ON z.type = n.type WHERE sc >= need GROUP BY id), "
            f"{name} AS (SELECT e.id, CASE WHEN regexp_matches(lower(e.subject), '\\d+\\s*%') AND ({sale.replace('subject', 'e.subject')} OR NOT {other.replace('subject', 'e.subject')}) THEN 'Sale' ELSE b.type END AS type "
            f"FROM {src} e LEFT JOIN {name}_b b ON e.id = b.id)")


def fuzzy(brands: str, name: str) -> str:
    """CTEs: <name>(brand, industry, confidence) by exact, equal, contained or shared-word keys."""
    def alnum(x):
        return f"regexp_replace({x}, '[^a-z0-9\\s]', '', 'g')"

    def long_words(x):
        return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: length(w) > 3)"

    return (f"{name}_b AS (SELECT brand, full_, {alnum('full_')} AS norm FROM (SELECT DISTINCT brand, {_norm_sql('brand')} AS full_ FROM {brands})), "
            f"{name}_k AS (SELECT *, {alnum('key')} AS knorm FROM bkey), "
            f"{name}_m AS (SELECT brand, industry, pos, length(key) AS kl, CASE WHEN full_ = key THEN 0 WHEN norm = knorm THEN 1 ELSE 2 END AS rk FROM {name}_b JOIN {name}_k ON full_ = key OR norm = knorm "
            f"OR contains(norm, knorm) OR (length(norm) > 3 AND contains(knorm, norm)) OR list_has_any({long_words('norm')}, {long_words('knorm')})), "
            f"{name} AS (SELECT brand, arg_min(industry, (rk, CASE WHEN rk < 2 THEN 0 ELSE -kl END, pos)) AS industry, CASE WHEN min(rk) = 0 THEN 1.0 ELSE 0.9 END AS confidence FROM {name}_m GROUP BY brand)")


def brand_of(src: str, name: str) -> str:
    """CTEs: <name>(sender, subject, brand) from sender and subject."""
    generic = "[" + ", ".join(s.q(g) for g in dims.GENERIC_SUBDOMAINS) + "]"
    full = "regexp_extract(sender, '@([a-zA-Z0-9\\-]+(?:\\.[a-zA-Z0-9\\-]+)*)\\.[a-zA-Z]{2,}(?:\\.[a-zA-Z]{2,})?', 1)"
    disp = "trim(trim(trim(regexp_extract(sender, '^([^<]+)<', 1)), '\"'), '''')"
    subj = []
    for rx in cl.SUBJECT_BRAND:
        c = clean_sql(f"nullif(regexp_extract(subject, {s.q(rx)}, 1), '')")
        subj.append(f"CASE WHEN length({c}) BETWEEN 2 AND 30 THEN {c} END")

    def mapped(c):
        return f"(SELECT arg_min(brand, pos) FROM known WHERE contains(lower(x.{c}), key) OR contains(key, lower(x.{c})))"

    return (f"{name}_x AS (SELECT sender, subject, {clean_sql(f'nullif({disp}, {chr(39)*2})')} AS c1, "
            f"{s.title(f'list_filter(string_split({full}, {s.q(chr(46))}), lambda p: length(p) > 2 AND NOT list_contains({generic}, lower(p)))[1]')} AS c2, "
            f"coalesce({', '.join(subj)}) AS c3, (SELECT arg_min(k.brand, pos) FROM known k WHERE contains(lower(d.sender), key)) AS hit FROM (SELECT DISTINCT sender, subject FROM {src}) d), "
            f"{name} AS (SELECT sender, subject, coalesce(hit, {mapped('c1')}, {mapped('c2')}, {mapped('c3')}, nullif(c1, ''), nullif(c2, ''), c3, 'Unknown') AS brand FROM {name}_x x)")


# --- classifiers ------------------------------------------------------------


@query("c01_industry_keywords", f"WITH {KW}, {kw_industry('emails', 'ki')} SELECT e.id, ki.industry AS kw_industry FROM emails e LEFT JOIN ki ON e.id = ki.id")
def _(i):
    return cl.industry_by_keywords(i.mails, i.rules).select("id", "kw_industry")


@query("w11_best_and_second", f"""
WITH {KW}, {kw_industry('emails', 'ki')}, best AS (SELECT id, max(sc) FILTER (WHERE r = 1) AS b, max(sc) FILTER (WHERE r = 2) AS s2 FROM ki_r GROUP BY id)
SELECT CASE WHEN b IS NULL THEN 'none' WHEN b < 4 THEN 'weak' WHEN CAST(s2 AS DOUBLE) / b > 0.7 THEN 'ambiguous' ELSE 'clear' END AS state, count(*) AS n FROM emails e LEFT JOIN best ON e.id = best.id GROUP BY 1""")
def _(i):
    lax = cl.industry_by_keywords(i.mails, i.rules, min_score=1, ambiguity=1.0, name="any_ind")
    both = cl.industry_by_keywords(lax, i.rules, ambiguity=1.0, name="strong")
    both = cl.industry_by_keywords(both, i.rules)
    state = (
        F.when(F.col("any_ind").isNull(), "none").when(F.col("strong").isNull(), "weak")
        .when(F.col("kw_industry").isNull(), "ambiguous").otherwise("clear"))
    return rk.counts(both, state.alias("state"), "n")


@query("j12_keyword_hits", f"""
WITH {KW} SELECT e.id, ikw.industry, k AS keyword, w AS weight, contains(lower(subject), k) AS in_subject FROM emails e JOIN ikw ON contains(lower(concat_ws(' ', subject, preview)), k)""")
def _(i):
    return cl.keyword_hits(i.mails, i.rules)


@query("c02_campaign_type", f"WITH {TK}, {kw_type('emails', 'kt')} SELECT id, type AS kw_type FROM kt")
def _(i):
    return cl.campaign_type(i.mails, i.rules).select("id", "kw_type")


# A keyword per part: what previews say of the user with the part's number.
_IND = s.values([(n, x) for n, x in enumerate(dims.INDUSTRIES)])
_KINDS = s.values([(n, t) for n, (t, _) in enumerate(dims.CAMPAIGN_TYPES)])
PART_KW = f"""inds(n, industry) AS (VALUES {_IND}), ikw AS (SELECT n AS pos, industry, 'of ' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END AS k, p_size % 7 + 1 AS w FROM part JOIN inds ON p_partkey % {len(dims.INDUSTRIES)} = n)"""
PART_TK = f"""kinds(n, type) AS (VALUES {_KINDS}), tkw AS (SELECT type, ' ' || p_partkey || ' ' AS k FROM part JOIN kinds ON p_partkey % {len(dims.CAMPAIGN_TYPES)} = n UNION ALL SELECT type, lower(p_name) FROM part JOIN kinds ON p_partkey % {len(dims.CAMPAIGN_TYPES)} = n),
 tneed(pos, type, need) AS (VALUES {s.values([(n, t, x) for n, (t, x) in enumerate(dims.CAMPAIGN_TYPES)])})"""


def part_rules(i):
    """Keyword rules as tables that grow with ``part``."""
    part = i.table("part")
    inds = local_table(i.spark, list(enumerate(dims.INDUSTRIES)), "n int, industry string")
    kinds = local_table(i.spark, [(n, t) for n, (t, _) in enumerate(dims.CAMPAIGN_TYPES)], "n int, type string")
    tail = F.when(F.col("p_size") % 2 == 0, " ").otherwise("")
    key = F.concat(F.lit("of "), F.col("p_partkey").cast("string"), tail)
    industry = part.join(inds, F.col("p_partkey") % len(dims.INDUSTRIES) == F.col("n")).select("industry", key.alias("keyword"), (F.col("p_size") % 7 + 1).alias("weight"), F.col("n").alias("pos"))
    typed = part.join(kinds, F.col("p_partkey") % len(dims.CAMPAIGN_TYPES) == F.col("n"))
    number = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))
    types = typed.select("type", F.explode(F.array(number, F.lower("p_name"))).alias("keyword"), F.col("n").alias("pos"))
    return dims.Rules(industry_keywords=industry, type_keywords=types)


@query("c01_industry_rule_table", f"WITH {PART_KW}, {kw_industry('emails', 'ki')} SELECT e.id, ki.industry AS kw_industry FROM emails e LEFT JOIN ki ON e.id = ki.id")
def _(i):
    return cl.industry_by_keywords(i.mails, part_rules(i)).select("id", "kw_industry")


@query("c02_type_rule_table", f"WITH {PART_TK}, {kw_type('emails', 'kt')} SELECT id, type AS kw_type FROM kt")
def _(i):
    return cl.campaign_type(i.mails, part_rules(i)).select("id", "kw_type")


@query("j12_hits_rule_table", f"""
WITH {PART_KW} SELECT e.id, ikw.industry, k AS keyword, w AS weight, contains(lower(subject), k) AS in_subject FROM emails e JOIN ikw ON contains(lower(concat_ws(' ', subject, preview)), k)""")
def _(i):
    return cl.keyword_hits(i.mails, part_rules(i))


@query("j09_exact_brand", f"WITH {KEYS} SELECT b.brand, bkey.industry FROM (SELECT DISTINCT brand FROM emails WHERE brand IS NOT NULL) b LEFT JOIN bkey ON {_norm_sql('b.brand')} = bkey.key")
def _(i):
    brands = i.emails.where(rk.has_brand()).select("brand").distinct()
    return cl.exact_brand_match(brands, dims.brand_industry_table(i.spark, i.rules)).select("brand", "industry")


_BRANDS = """names AS (SELECT DISTINCT brand FROM emails WHERE brand IS NOT NULL UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT s_name || ' by apple store' FROM supplier UNION SELECT DISTINCT n_name FROM nation)"""


@query("j10_fuzzy_brand", f"WITH {KEYS}, {_BRANDS}, {fuzzy('names', 'fz')} SELECT brand, industry, CAST(confidence AS DOUBLE) AS confidence FROM fz")
def _(i):
    names = (
        i.emails.where(rk.has_brand()).select("brand").union(i.table("part").select("p_name"))
        .union(i.table("supplier").select(F.concat("s_name", F.lit(" by apple store")))).union(i.table("nation").select("n_name")))
    return cl.fuzzy_brand_match(names, dims.brand_industry_table(i.spark, i.rules))


_CASCADE = f"""{KEYS}, {KW}, {fuzzy(f'(SELECT brand FROM emails WHERE {s.KNOWN})', 'fz')}, {kw_industry('emails', 'ki')}"""


@query("c03_classify_industry", f"""
WITH {_CASCADE} SELECT e.id, coalesce(fz.industry, ki.industry) AS new_industry, CASE WHEN fz.industry IS NOT NULL THEN 'keyword' WHEN ki.industry IS NOT NULL THEN 'content' END AS classified_by, coalesce(CAST(fz.confidence AS DOUBLE), 0.0) AS confidence
FROM emails e LEFT JOIN fz ON e.brand = fz.brand LEFT JOIN ki ON e.id = ki.id""")
def _(i):
    out = cl.classify_industry(i.mails, i.rules)
    return out.select("id", "new_industry", "classified_by", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("j11_sender_domain", f"WITH {SENDERS} SELECT sender, (SELECT arg_min(k.brand, pos) FROM known k WHERE contains(lower(e.sender), key)) AS known_brand, count(*) AS n FROM emails e GROUP BY sender")
def _(i):
    return i.emails.groupBy("sender", cl.brand_from_sender("sender", i.rules).alias("known_brand")).agg(F.count(F.lit(1)).alias("n"))


@query("c06_extract_brand", f"WITH {SENDERS}, {brand_of('emails', 'bo')} SELECT e.id, bo.brand AS new_brand FROM emails e JOIN bo ON e.sender IS NOT DISTINCT FROM bo.sender AND e.subject = bo.subject")
def _(i):
    return cl.extract_brand(i.mails, i.rules).select("id", "new_brand")


@query("c06_extract_brand_html")
def _(i):
    signals = ht.html_features(i.html, ("signals",), keep_html=False)
    return cl.extract_brand(i.mails.join(signals, "page_id"), i.rules, html=True).select("id", "new_brand")


# --- overrides and renames --------------------------------------------------

_OVR = f"ovr(brand, ni, nc) AS (VALUES {s.values(RULES.overrides)})"


@query("j17_overrides", f"""
WITH {_OVR} SELECT e.brand, ni AS industry, nc AS category, count(*) AS changed, min(e.industry) AS old_industry FROM emails e JOIN ovr o ON e.brand = o.brand
WHERE e.industry IS DISTINCT FROM ni OR e.category IS DISTINCT FROM nc GROUP BY e.brand, ni, nc""")
def _(i):
    return cl.override_log(i.emails, dims.overrides_table(i.spark, i.rules))


_REN = [*dims.INDUSTRY_RENAMES, ("Pets", "Pet Care"), ("Home & Living", "Home")]


@query("j18_renames", f"WITH ren(o, n) AS (VALUES {s.values(_REN)}) SELECT e.id, coalesce(r.n, e.industry) AS industry, r.n IS NOT NULL AS renamed FROM emails e LEFT JOIN ren r ON e.industry = r.o")
def _(i):
    return cl.rename_values(i.emails, "industry", local_table(i.spark, _REN, "old string, new string")).select("id", "industry", "renamed")


_LBL = [("NYKAA", "Luxury & High-End Goods"), ("boat", "Entertainment"), ("Nobody", "Pets")]


@query("j24_propagate_label", f"WITH l(b, x) AS (VALUES {s.values(_LBL)}) SELECT e.id, coalesce(l.x, e.industry) AS industry FROM emails e LEFT JOIN l ON lower(e.brand) = lower(l.b)")
def _(i):
    return cl.propagate_brand_label(i.emails, local_table(i.spark, _LBL, "brand_name string, industry string")).select("id", "industry")


# --- backfills and labels ---------------------------------------------------

_REP = f"""{SENDERS}, {KEYS}, {KW}, {TK}, {brand_of('emails', 'bo')},
e2 AS (SELECT e.id, e.subject, e.preview, e.industry AS old_industry, e.type AS old_type, e.brand AS old_brand, CASE WHEN (e.brand IS NULL OR e.brand IN ('Unknown', 'unknown')) AND bo.brand <> 'Unknown' THEN bo.brand ELSE e.brand END AS brand
 FROM emails e JOIN bo ON e.sender IS NOT DISTINCT FROM bo.sender AND e.subject = bo.subject),
{fuzzy(f'(SELECT brand FROM e2 WHERE {s.KNOWN})', 'fz')}, {kw_industry('e2', 'ki')}, {kw_type('e2', 'kt')},
fin AS (SELECT e2.id, e2.brand, old_brand, coalesce(old_industry, fz.industry, ki.industry) AS industry, old_industry, coalesce(old_type, kt.type) AS type, old_type
 FROM e2 LEFT JOIN fz ON e2.brand = fz.brand LEFT JOIN ki ON e2.id = ki.id LEFT JOIN kt ON e2.id = kt.id)"""


@query("c09_reprocess", f"WITH {_REP} SELECT id, brand, industry, type FROM fin")
def _(i):
    return cl.reprocess(i.mails, rules=i.rules).select("id", "brand", "industry", "type")


_REPORT = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'processed' AS metric, count(*) AS cnt FROM fin UNION ALL SELECT '{c}', 'updated', {s.count_if(f'{c} IS DISTINCT FROM old_{c}')} FROM fin "
    f"UNION ALL SELECT '{c}', 'unclassified', {s.count_if(f'{c} IS NULL')} FROM fin" for c in ("brand", "industry", "type"))


@query("a38_change_report", f"WITH {_REP} {_REPORT}")
def _(i):
    return cl.change_report(cl.reprocess(i.mails, rules=i.rules))


@query("a38_unmatched_brands", f"SELECT brand, count(*) AS cnt FROM emails WHERE {s.KNOWN} AND industry IS NULL GROUP BY brand ORDER BY cnt DESC, brand LIMIT 50")
def _(i):
    return cl.unmatched_brands(i.emails)


@query("c10_label_answers", f"""
WITH b AS (SELECT id, type, (row_number() OVER (ORDER BY id) - 1) // 10 AS batch_id, CAST((row_number() OVER (ORDER BY id) - 1) % 10 + 1 AS INTEGER) AS pos FROM emails)
SELECT id, CAST(batch_id AS BIGINT) AS batch_id, pos, CASE WHEN id % 7 = 0 THEN 'Promotional' ELSE coalesce(type, 'Sale') END AS new_type FROM b""")
def _(i):
    rows = cl.label_batches(i.emails.select("id", "type"))
    item = F.struct(F.col("pos").alias("i"), F.when(F.col("id") % 7 == 0, "Nope").otherwise(F.coalesce("type", F.lit("Sale"))).alias("t"))
    # an answer text per batch of ten, half of them fenced, with one position outside the batch
    text = F.to_json(F.concat(F.array_sort(F.collect_list(item)), F.array(F.struct(F.lit(99).alias("i"), F.lit("Sale").alias("t")))))
    fenced = F.when(F.col("batch_id") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    answers = rows.groupBy("batch_id").agg(text.alias("text")).select("batch_id", fenced.alias("answer"))
    return cl.merge_label_answers(rows, answers).select("id", "batch_id", "pos", "new_type")


_ANSWER = """CASE s_suppkey % 5 WHEN 0 THEN '{"industry":"Pets","subcategory":"Pet Food","campaign_type":"Sale","confidence":0.9}' WHEN 1 THEN '{"industry":"Nope","subcategory":"Pet Food","campaign_type":"Sale","confidence":0.7}'
 WHEN 2 THEN '{"industry":"Pets","subcategory":"Lamps","campaign_type":"Unheard","confidence":1.7}' WHEN 3 THEN 'I am not sure' ELSE concat('```json', chr(10), '{"industry":"Home & Living","subcategory":"Lighting"}', chr(10), '```') END"""


@query("c11_validate_labels", """
SELECT s_name AS brand, CASE s_suppkey % 5 WHEN 1 THEN 'General / Department Store' WHEN 3 THEN 'General / Department Store' WHEN 4 THEN 'Home & Living' ELSE 'Pets' END AS industry,
 CASE s_suppkey % 5 WHEN 0 THEN 'Pet Food' WHEN 4 THEN 'Lighting' ELSE 'Others' END AS subcategory, CASE WHEN s_suppkey % 5 IN (0, 1) THEN 'Sale' ELSE 'Newsletter' END AS campaign_type,
 CAST(CASE s_suppkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 3 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence FROM supplier""")
def _(i):
    answers = i.table("supplier").select(F.col("s_name").alias("brand"), F.expr(_ANSWER).alias("answer"))
    return cl.validate_brand_labels(answers).select("brand", "industry", "subcategory", "campaign_type", "confidence")


_CUR = "cur AS (SELECT brand, arg_min(industry, (-n, industry)) AS current_industry, CAST(sum(n) AS BIGINT) AS emails FROM (SELECT brand, industry, count(*) AS n FROM emails WHERE brand IS NOT NULL AND industry IS NOT NULL GROUP BY brand, industry) GROUP BY brand)"


@query("c12_resolve_labels", f"""
WITH {_CUR}, lab AS (SELECT brand, CASE length(brand) % 3 WHEN 0 THEN 'Pets' WHEN 1 THEN 'Nope' ELSE 'Entertainment' END AS industry, CAST(length(brand) % 10 AS DOUBLE) / 10 + 0.1 AS confidence FROM cur), tax(i) AS (VALUES {s.values([(x,) for x in dims.INDUSTRIES])})
SELECT c.brand, c.current_industry, c.emails, l.industry AS label_industry, l.confidence,
 CASE WHEN l.confidence >= 0.8 AND l.industry IN (SELECT i FROM tax) THEN l.industry WHEN c.current_industry IN (SELECT i FROM tax) THEN c.current_industry ELSE l.industry END AS final_industry, 'Others' AS final_category,
 (c.current_industry IN (SELECT i FROM tax) AND l.industry <> c.current_industry) AS disagrees FROM cur c JOIN lab l ON c.brand = l.brand""")
def _(i):
    e = i.emails.where(rk.has_brand() & F.col("industry").isNotNull())
    current = rk.modal(e, "brand", "industry", "current_industry").join(rk.counts(e, "brand", "emails"), "brand")
    n = F.length("brand")
    kind = F.when(n % 3 == 0, "Pets").when(n % 3 == 1, "Nope").otherwise("Entertainment")
    labels = current.select("brand", kind.alias("industry"), F.lit("Others").alias("subcategory"), ((n % 10).cast("double") / 10 + F.lit(0.1)).alias("confidence"))
    return cl.resolve_labels(current, labels)


@query("u05_labeller_hook", f"""
WITH {_CASCADE} SELECT e.id, coalesce(fz.industry, CASE WHEN {s.KNOWN.replace('brand', 'e.brand')} THEN 'Gifts & Lifestyle' END, ki.industry) AS new_industry,
 CASE WHEN fz.industry IS NOT NULL THEN 'keyword' WHEN {s.KNOWN.replace('brand', 'e.brand')} THEN 'ai' WHEN ki.industry IS NOT NULL THEN 'content' END AS classified_by
FROM emails e LEFT JOIN fz ON e.brand = fz.brand LEFT JOIN ki ON e.id = ki.id""")
def _(i):
    def labeler(brands):
        return brands.select(
            "brand", F.lit("Gifts & Lifestyle").alias("industry"), F.lit("Gift Cards").alias("subcategory"),
            F.lit("Sale").alias("campaign_type"), F.lit(0.9).alias("confidence"))

    return cl.classify_industry(i.mails, i.rules, labeler).select("id", "new_industry", "classified_by")


# --- HTML -------------------------------------------------------------------

# the pages use four entities; tags are dropped after scripts, styles and comments
_UNESC = "replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_BARE = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->|<!.*?>', chr(1), 'g')"
_CHUNKS = f"list_filter(list_transform(string_split(regexp_replace({_BARE}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda c: trim({_UNESC.format(x='c')})), lambda c: c <> '')"


@query("h01_clean_html", f"""
SELECT page_id, md5({"replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34))".format(x="replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '<img[^>]* width=.1. [^>]*>', '', 'g'), ' onclick=\"go()\"', '')")}) AS clean_md5 FROM email_html""")
def _(i):
    return ht.clean_html(i.html).select("page_id", F.md5("html").alias("clean_md5"))


@query("h02_visible_text", f"SELECT page_id, md5(array_to_string({_CHUNKS}, ' ')) AS text_md5, left(array_to_string({_CHUNKS}, ' '), 200) AS preview FROM email_html")
def _(i):
    return ht.visible_text(i.html).select("page_id", F.md5("visible_text").alias("text_md5"), "preview")


def _n_of(rx):
    return f"CAST(len(regexp_extract_all(html, {s.q(rx)})) AS BIGINT)"


# copy text of the scorers: link texts and styles out, script text stays (the page script has two words)
_COPY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' var t ', 'g'), '(?is)<style[^>]*>.*?</style>|<a [^>]*>.*?</a>', ' ', 'g'), '(?s)<!--.*?-->|<!.*?>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_COPY = _UNESC.format(x=_COPY)


@query("h03_structure", f"""
SELECT page_id, {_n_of('<a ')} AS links, {_n_of('<img ')} AS images, {_n_of('</h[1-4]>')} AS headings, {_n_of('<(?:ul|ol)[ >]')} AS lists, true AS has_viewport, false AS has_dark_mode,
 CAST(len(regexp_extract_all({_COPY}, '\\S+')) AS BIGINT) AS words FROM email_html""")
def _(i):
    f = ht.html_features(i.html, ("structure",), keep_html=False)
    return f.select(
        "page_id", F.size("links").cast("long").alias("links"), F.size("images").cast("long").alias("images"), F.size("headings").cast("long").alias("headings"),
        F.col("list_count").cast("long").alias("lists"), "has_viewport", "has_dark_mode", sg._word_count(F.col("copy_text")).cast("long").alias("words"))


_SLIM = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
         "'<img[^>]*width=\"1\"[^>]*>', '', 'g'), '(?s)<!--[^\\[].*?-->', '', 'g'), '(?i)\\s+data-[a-z0-9_-]+\\s*=\\s*\"[^\"]*\"', '', 'g'), "
         "'\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]{4,}', ' ', 'g'), '(?i)<style[^>]*>\\s*</style>', '', 'g')")


@query("h04_slim_html", f"SELECT page_id, md5(trim({_SLIM})) AS slim_md5, CAST(length(trim({_SLIM})) AS BIGINT) AS chars FROM email_html")
def _(i):
    h = i.html.select("page_id", ht.slim_html("html").alias("h"))
    return h.select("page_id", F.md5("h").alias("slim_md5"), F.length("h").cast("long").alias("chars"))


@query("h05_first_image", "SELECT page_id, regexp_extract(html, '<img src=\"([^\"]*)\"', 1) AS image FROM email_html")
def _(i):
    return i.html.select("page_id", ht.first_image("html").alias("image"))


@query("h06_template_blocks")
def _(i):
    return ht.template_blocks(i.html)


@query("h06_template_structure", """
SELECT page_id, true AS has_hero_image, CAST(2 AS BIGINT) AS images FROM email_html""")
def _(i):
    out = ht.template_structure(i.html)
    return out.select("page_id", "has_hero_image", F.size(F.filter("slots", lambda x: x.startswith("image_"))).cast("long").alias("images"))


_FOOT = _UNESC.format(x="regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")


@query("h07_brand_signals", f"SELECT page_id, {_FOOT} AS footer_text, CAST(0 AS BIGINT) AS logos, true AS no_meta FROM email_html")
def _(i):
    f = ht.html_features(i.html, ("signals",), keep_html=False)
    sig = F.col("signals")
    return f.select(
        "page_id", sig["footer_text"].alias("footer_text"), F.size(sig["logo_alts"]).cast("long").alias("logos"),
        (sig["site_name"].isNull() & sig["twitter_site"].isNull() & sig["app_name"].isNull()).alias("no_meta"))


_IMG = "unnest(regexp_extract_all(html, '<img [^>]*>')) AS x, generate_subscripts(regexp_extract_all(html, '<img [^>]*>'), 1) AS n"
_HEAD = "unnest(regexp_extract_all(html, '(?s)<h[1-3][^>]*>.*?</h[1-3]>')) AS x, generate_subscripts(regexp_extract_all(html, '(?s)<h[1-3][^>]*>.*?</h[1-3]>'), 1) AS n"
_BTN = "unnest(regexp_extract_all(html, '<a class=\"btn\"[^>]*>[^<]*</a>')) AS x, generate_subscripts(regexp_extract_all(html, '<a class=\"btn\"[^>]*>[^<]*</a>'), 1) AS n"
_INNER = _UNESC.format(x="regexp_extract(x, '(?s)^<[^>]*>(.*)</[^>]*>$', 1)")


@query("u04_html_udf", f"""
WITH i AS (SELECT page_id, {_IMG} FROM email_html), h0 AS (SELECT page_id, {_HEAD} FROM email_html), b AS (SELECT page_id, {_BTN} FROM email_html),
h1 AS (SELECT page_id, regexp_extract(x, '^<(h[1-3])', 1) AS tag, trim({_INNER}) AS text, n FROM h0), h AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) AS k FROM h1 WHERE length(text) > 2)
SELECT page_id, 'image' AS type, 'image_' || n AS slot, NULL AS tag, NULL AS text, regexp_extract(x, 'src="([^"]*)"', 1) AS url, regexp_extract(x, 'alt="([^"]*)"', 1) AS alt, regexp_extract(x, 'width="([^"]*)"', 1) AS width FROM i
UNION ALL SELECT page_id, 'heading', 'heading_' || k, tag, text, NULL, NULL, NULL FROM h
UNION ALL SELECT page_id, 'cta', 'cta_' || n, 'a', {_INNER}, regexp_extract(x, 'href="([^"]*)"', 1), NULL, NULL FROM b""")
def _(i):
    i.html.createOrReplaceTempView("html_pages")
    i.spark.udtf.register("page_blocks", ht.TemplateBlocks)
    return i.spark.sql("SELECT page_id, b.type, b.slot, b.tag, b.text, b.url, b.alt, b.width FROM html_pages, LATERAL page_blocks(html, NULL, NULL) AS b WHERE b.type <> 'text'")


# --- scores -----------------------------------------------------------------


def grade(x):
    return "CASE " + " ".join(f"WHEN {x} >= {lo} THEN {s.q(g)}" for lo, g in sg.GRADES) + " ELSE 'F' END"


def flag(cond, points):
    return f"CASE WHEN {cond} THEN {points} ELSE 0 END"


_WORDS = "list_filter(string_split_regex(subject, '\\s+'), lambda w: w <> '')"
_SUBJECT = f"""ss AS (SELECT id, length(subject) AS n, len({_WORDS}) AS wn, len(list_filter({_WORDS}, lambda w: length(w) > 2 AND w = upper(w) AND w <> lower(w))) AS lw,
 {s.has_any('subject', sg.TOKENS)} AS tok, {s.has_any('subject', sg.URGENCY)} AS urg, {s.has_any('subject', sg.POWER)} AS pow, regexp_matches(subject, '\\d') AS dig, {s.emoji('subject', 'scoring')} AS emo, contains(subject, '?') AS qm FROM emails),
sp AS (SELECT id, lw, wn, n, tok, greatest(0, least(100, 50 + CASE WHEN n BETWEEN 30 AND 60 THEN 15 WHEN n BETWEEN 20 AND 29 THEN 8 WHEN n BETWEEN 61 AND 80 THEN 5 WHEN n > 80 THEN -10 ELSE -5 END
 + {flag('tok', 10)} + {flag('urg', 8)} + {flag('pow', 5)} + {flag('dig', 5)} + {flag('emo', 3)} + {flag('qm', 3)} + CASE WHEN lw > wn * 0.5 AND wn > 2 THEN -15 WHEN lw > 0 THEN 2 ELSE 0 END)) AS score FROM ss)"""


@query("q01_score_subject", f"""
WITH {_SUBJECT} SELECT id, CAST(score AS INTEGER) AS score, {grade('score')} AS grade, CAST(CASE WHEN n > 80 OR n < 20 THEN 1 ELSE 0 END + CASE WHEN tok THEN 0 ELSE 1 END + CASE WHEN lw > wn * 0.5 AND wn > 2 THEN 1 ELSE 0 END AS BIGINT) AS bad FROM sp""")
def _(i):
    out = sg.score_dimensions(i.mails, ["subject"]).select("id", "subject_score.*")
    return out.select("id", "score", "grade", F.size(F.filter("findings", lambda f: f["type"] == "bad")).cast("long").alias("bad"))


_STRATEGY = f"""st AS (SELECT id, 50 + {flag("type <> ''", 15)} + {flag("industry <> ''", 10)} + CASE WHEN isodow(received_at) IN (2, 3, 4) THEN 10 WHEN isodow(received_at) IN (1, 5) THEN 5 ELSE 0 END
 + CASE WHEN hour(received_at) BETWEEN 9 AND 11 THEN 8 WHEN hour(received_at) BETWEEN 13 AND 15 THEN 6 WHEN hour(received_at) BETWEEN 6 AND 20 THEN 3 ELSE 0 END AS score FROM emails)"""


@query("q05_score_strategy", f"WITH {_STRATEGY} SELECT id, CAST(score AS INTEGER) AS score, {grade('score')} AS grade FROM st")
def _(i):
    return sg.score_dimensions(i.mails, ["strategy"]).select("id", "strategy_score.score", "strategy_score.grade")


@query("q06_grade", f"SELECT id, id % 101 AS score, {grade('id % 101')} AS grade FROM emails")
def _(i):
    return i.emails.select("id", (F.col("id") % 101).alias("score")).withColumn("grade", sg.calculate_grade("score"))


_DIMS = {"subject": "id % 101", "copy": "id * 7 % 101", "cta": "id * 13 % 101", "design": "id * 29 % 101", "strategy": "id * 31 % 101"}
_TOTAL = "round_even(" + " + ".join(f"CAST(({e}) AS DOUBLE) * {w} / 100" for (d, e), w in zip(_DIMS.items(), sg.WEIGHTS.values())) + ", 0)"


@query("q07_overall", f"SELECT id, CAST({_TOTAL} AS INTEGER) AS overall_score, {grade(_TOTAL)} AS overall_grade FROM emails")
def _(i):
    out = i.emails.select("id", sg.overall_score({d: F.expr(e).cast("double") for d, e in _DIMS.items()}).alias("overall_score"))
    return out.withColumn("overall_grade", sg.calculate_grade("overall_score"))


@query("q09_teaser", f"SELECT id, CAST({_TOTAL} AS INTEGER) AS overall_score, " + ", ".join(f"CASE WHEN id % 2 = 0 THEN {e} ELSE -1 END AS {d}_score" for d, e in _DIMS.items()) + " FROM emails")
def _(i):
    out = i.emails.select("id", *[F.struct(F.expr(e).alias("score")).alias(f"{d}_score") for d, e in _DIMS.items()])
    out = out.withColumn("overall_score", sg.overall_score({d: F.col(f"{d}_score.score").cast("double") for d in _DIMS}))
    out = sg.teaser(out, F.when(F.col("id") % 2 == 0, "full").otherwise("teaser"))
    return out.select("id", "overall_score", *[F.coalesce(f"{d}_score", F.lit(-1)).alias(f"{d}_score") for d in _DIMS])


def html_scored(i):
    """Mails with all five scores; only narrow HTML measures and scores join."""
    parsed = ht.html_features(i.html, ("structure",))
    return sg.score_emails(i.mails.join(sg.score_pages(sg.html_measures(parsed, "page_id")), "page_id"))


_PAGE = f"""pg AS (SELECT page_id, len(regexp_extract_all(cp, '\\S+')) AS wn, len(regexp_extract_all(cp, '[^\\s.!?][^.!?]*')) AS sn, len(regexp_extract_all(cp, '[^\\s.!?]+')) AS sw, html FROM (SELECT page_id, html, {_COPY} AS cp FROM email_html)),
cs AS (SELECT page_id, greatest(0, least(100, 50 + CASE WHEN wn BETWEEN 50 AND 500 THEN 15 WHEN wn BETWEEN 501 AND 1000 THEN 8 WHEN wn > 1000 THEN 2 WHEN wn BETWEEN 20 AND 49 THEN 5 ELSE -5 END
 + CASE WHEN sw * 1.0 / sn <= 20 THEN 10 WHEN sw * 1.0 / sn <= 30 THEN 5 ELSE 0 END + {flag(f"{_n_of('</h[1-4]>')} > 0", 8)} + {flag(f"{_n_of('<(?:ul|ol)[ >]')} > 0", 5)} + 5 + {flag(s.has_any('html', sg.TOKENS), 5)})) AS copy_points,
 50 + 10 + CASE WHEN page_id % 3 = 0 THEN 0 ELSE 3 END + CASE WHEN 200.0 / wn < 5 THEN 5 ELSE 0 END + 10 + {flag("contains(lower(html), '<table')", 5)} + {flag("len(regexp_extract_all(lower(html), 'style=\"')) > 5", 3)} AS design_points FROM pg),
lk AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1), lambda t: trim(t)), lambda t: length(t) > 1 AND NOT {s.has_any('t', sg.SKIPPED_LINKS)}) AS l, html FROM email_html),
ct AS (SELECT page_id, CASE WHEN len(l) = 0 THEN 30 ELSE greatest(0, least(100, 50 + CASE WHEN len(l) <= 3 THEN 15 WHEN len(l) <= 5 THEN 10 ELSE 3 END + {flag(f"len(list_filter(l, lambda t: {s.has_any('t', sg.ACTION_VERBS)})) > 0", 10)}
 + {flag(s.has_any('html', sg.BUTTON_MARKS), 10)} + {flag("position(l[1] IN html) - 1 > 0 AND position(l[1] IN html) - 1 < length(html) * 0.3", 5)})) END AS cta_points FROM lk)"""


def _dimension(name, points, table):
    @query(name, f"WITH {_PAGE} SELECT e.id, CAST({points} AS INTEGER) AS score, {grade(points)} AS grade FROM emails e JOIN {table} USING (page_id)")
    def _(i):
        dim = points.split("_")[0]
        parsed = ht.html_features(i.html, ("structure",))
        measured = i.mails.join(sg.html_measures(parsed, "page_id"), "page_id")
        return sg.score_dimensions(measured, [dim]).select("id", f"{dim}_score.score", f"{dim}_score.grade")


_dimension("q02_score_copy", "copy_points", "cs")
_dimension("q03_score_cta", "cta_points", "ct")
_dimension("q04_score_design", "design_points", "cs")

_ALL5 = f"""{_SUBJECT}, {_STRATEGY}, {_PAGE}, al AS (SELECT e.id, e.brand, CAST(round_even(CAST(sp.score AS DOUBLE) * 20 / 100 + CAST(copy_points AS DOUBLE) * 25 / 100 + CAST(cta_points AS DOUBLE) * 20 / 100 + CAST(design_points AS DOUBLE) * 15 / 100 + CAST(st.score AS DOUBLE) * 20 / 100, 0) AS INTEGER) AS overall_score
 FROM emails e JOIN sp ON e.id = sp.id JOIN st ON e.id = st.id JOIN cs ON e.page_id = cs.page_id JOIN ct ON e.page_id = ct.page_id)"""


@query("q07_score_emails", f"WITH {_ALL5} SELECT id, overall_score, {grade('overall_score')} AS overall_grade FROM al")
def _(i):
    return html_scored(i).select("id", "overall_score", "overall_grade")


@query("q08_suggestions")
def _(i):
    return sg.suggestions(html_scored(i))


@query("q11_score_rollup", f"""
WITH {_ALL5}, g AS (SELECT brand, {grade('overall_score')} AS grade, overall_score FROM al), h AS (SELECT brand, grade, count(*) AS n, min(-overall_score) AS o FROM g GROUP BY brand, grade)
SELECT g.brand, count(*) AS emails, round_even(avg(overall_score), 1) AS avg_score, (SELECT string_agg(grade || ':' || n, '|' ORDER BY o) FROM h WHERE h.brand IS NOT DISTINCT FROM g.brand) AS grades FROM g GROUP BY g.brand""")
def _(i):
    out = sg.score_rollup(html_scored(i), "brand")
    return out.withColumn("grades", F.array_join(F.transform("grades", lambda g: F.concat_ws(":", g["grade"], g["cnt"].cast("string"))), "|"))
