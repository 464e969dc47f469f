"""Weekly insights, archive statistics, digests, trends and the cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailprism.functions import subjects as sub
from mailprism.operators import insights as ins
from mailprism.operators import profiles as pr
from mailprism.operators import ranking as rk
from mailprism.operators import sketches
from mailprism.operators import stats as st
from mailprism.plans import registry
from mailprism.plans import sqltext as s
from mailprism.plans.catalog import ORACLES, query
from mailprism.session import scratch_path

T = s.T
THIS, LAST, END, PAST = (f"TIMESTAMP '2024-{d} 00:00:00'" for d in ("01-29", "01-22", "02-05", "01-01"))
NOW = f"received_at >= {THIS} AND received_at < {END}"
PREV = f"received_at >= {LAST} AND received_at < {THIS}"


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def d(expr):
    return f"CAST({expr} AS DOUBLE)"


# --- scoreboard -------------------------------------------------------------

_WEEK = f"""wk AS (SELECT CASE WHEN received_at >= {THIS} THEN 0 ELSE 1 END AS w, * FROM emails WHERE received_at >= {LAST} AND received_at < {END} AND subject IS NOT NULL),
m AS (SELECT CAST(w AS BIGINT) AS week_no, count(*) AS total, {s.mean('sum(length(subject))', 'count(*)')} AS avg_subject_length,
 {s.pct(s.count_if(s.discount('subject')), 'count(*)')} AS discount_pct, {s.pct(s.count_if(s.emoji('subject', 'insights')), 'count(*)')} AS emoji_pct,
 {s.pct(s.count_if('isodow(received_at) >= 6'), 'count(*)')} AS weekend_pct FROM wk GROUP BY w),
bd AS (SELECT w, arg_min(day, (-n, dw)) AS busiest_day FROM (SELECT w, {s.day_name('received_at')} AS day, isodow(received_at) AS dw, count(*) AS n FROM wk GROUP BY 1, 2, 3) GROUP BY w)"""
_MOVER = f"""bw AS (SELECT brand, {s.count_if('w = 0')} AS this_count, {s.count_if('w = 1')} AS last_count FROM wk WHERE {s.KNOWN} GROUP BY brand),
mv AS (SELECT *, {s.pct_change('this_count', 'last_count')} AS change_pct FROM bw), mover AS (SELECT * FROM mv WHERE this_count >= 3 AND change_pct > 0 ORDER BY change_pct DESC, brand LIMIT 1)"""


@query("a17_week_metrics", f"WITH {_WEEK} SELECT m.*, bd.busiest_day FROM m JOIN bd ON m.week_no = bd.w")
def _(i):
    return ins.week_metrics(i.emails, i.t)


_SCORES = ", ".join(
    f"coalesce({d('a.' + c)}, 0) AS {c}_this, coalesce({d('b.' + c)}, 0) AS {c}_last, {s.pct_change(f'coalesce({d("a." + c)}, 0)', f'coalesce({d("b." + c)}, 0)')} AS {c}_change"
    for c in ins.SCORES)


@query("a17_weekly_scoreboard", f"""
WITH {_WEEK}, {_MOVER}, one AS (SELECT 1 AS x)
SELECT '2024-W05' AS week, {_SCORES}, (SELECT busiest_day FROM bd WHERE w = 0) AS busiest_day_this, (SELECT busiest_day FROM bd WHERE w = 1) AS busiest_day_last,
 (SELECT brand FROM mover) AS mover_brand, (SELECT change_pct FROM mover) AS mover_change_pct, (SELECT this_count FROM mover) AS mover_this_count, (SELECT last_count FROM mover) AS mover_last_count
FROM one LEFT JOIN m a ON a.week_no = 0 LEFT JOIN m b ON b.week_no = 1""")
def _(i):
    return ins.weekly_scoreboard(i.emails, i.t)


@query("j05_brand_weeks", f"WITH {_WEEK}, {_MOVER} SELECT brand, this_count, last_count FROM bw")
def _(i):
    return ins.brand_weeks(i.emails, i.t)


# --- sequences --------------------------------------------------------------

_RUN = f"""sw AS (SELECT *, epoch_us(received_at) AS us FROM emails WHERE received_at >= {LAST} AND received_at < {END} AND {s.KNOWN} AND subject IS NOT NULL),
fr AS (SELECT brand, us, count(*) OVER (PARTITION BY brand ORDER BY us RANGE BETWEEN CURRENT ROW AND 691199999999 FOLLOWING) AS n FROM sw),
best AS (SELECT brand, arg_min(us, (-n, us)) AS anchor, max(n) AS run_count FROM fr GROUP BY brand HAVING max(n) >= 3)"""
_MEM = f"""{_RUN}, top AS (SELECT * FROM best ORDER BY run_count DESC, brand LIMIT 20),
mem AS (SELECT sw.*, top.run_count FROM sw JOIN top ON sw.brand = top.brand AND sw.us >= top.anchor AND sw.us < top.anchor + 691200000000)"""


@query("w01_longest_runs", f"WITH {_RUN} SELECT brand, {s.ts('make_timestamp(anchor)')} AS anchor, run_count FROM best")
def _(i):
    out = ins.longest_runs(ins.sequence_window(i.emails, i.t))
    return out.select("brand", stamp("anchor").alias("anchor"), "run_count")


@query("w02_sequence_gaps", f"""
WITH {_MEM} SELECT brand, id, round_even((us - lag(us) OVER (PARTITION BY brand ORDER BY us, id)) / 3600000000.0, 1) AS gap_hours FROM mem""")
def _(i):
    return ins.sequence_members(i.emails, i.t).select("brand", "id", "gap_hours")


_OV = "[" + ", ".join(s.q(w) for w in sub.OVERLAP_STOPS) + "]"


@query("o02_brand_sequences", f"""
WITH {_MEM}, w AS (SELECT DISTINCT brand, id, unnest(regexp_extract_all(lower(subject), {s.q(sub.WORD_PATTERN)})) AS word FROM mem),
common AS (SELECT w.brand, word FROM w JOIN best b ON w.brand = b.brand WHERE NOT list_contains({_OV}, word) GROUP BY w.brand, word, b.run_count HAVING count(*) = b.run_count
 QUALIFY row_number() OVER (PARTITION BY w.brand ORDER BY word) <= 5)
SELECT mem.brand, max(run_count) AS email_count, CAST(floor((max(us) - min(us)) / 86400000000.0) AS BIGINT) AS span_days,
 coalesce((SELECT string_agg(word, ' ' ORDER BY word) FROM common c WHERE c.brand = mem.brand), '') AS keyword_overlap FROM mem GROUP BY mem.brand""")
def _(i):
    return ins.brand_sequences(i.emails, i.t).withColumn("keyword_overlap", F.array_join("keyword_overlap", " "))


@query("o02_shared_words", f"""
WITH x AS (SELECT type, id, subject, count(*) OVER (PARTITION BY type) AS n FROM emails WHERE type IS NOT NULL), w AS (SELECT DISTINCT type, id, n, unnest(regexp_extract_all(lower(subject), {s.q(sub.WORD_PATTERN)})) AS word FROM x)
SELECT type, word, CAST(row_number() OVER (PARTITION BY type ORDER BY word) AS INTEGER) AS rank FROM (SELECT type, word FROM w WHERE NOT list_contains({_OV}, word) GROUP BY type, word, n HAVING count(*) = n) QUALIFY rank <= 5""")
def _(i):
    e = i.emails.where("type IS NOT NULL")
    sized = e.join(rk.counts(e, "type", "n"), "type")
    return ins.shared_words(sized, "type", "n").select("type", "word", "rank")


# --- formulas and tactics ---------------------------------------------------

_FORM = f"""x AS (SELECT {s.formula('subject')} AS formula, CAST(date_diff('day', date_trunc('week', received_at), {THIS}) / 7 AS BIGINT) AS week_no FROM emails
 WHERE received_at >= {PAST} AND received_at < {END} AND subject IS NOT NULL)"""


@query("j06_formula_weeks", f"WITH {_FORM} SELECT formula, week_no, count(*) AS cnt FROM x GROUP BY formula, week_no")
def _(i):
    return ins.formula_weeks(i.emails, i.t)


@query("a18_subject_formulas", f"""
WITH {_FORM}, tot AS (SELECT {s.count_if('week_no = 0')} AS now_n, greatest(count(DISTINCT CASE WHEN week_no > 0 THEN week_no END), 1) AS wks, {s.count_if('week_no > 0')} AS past_n FROM x),
f AS (SELECT formula, {s.count_if('week_no = 0')} AS c, {s.count_if('week_no > 0')} AS p FROM x GROUP BY formula),
g AS (SELECT formula, c AS this_week_count, {s.pct('c', 'now_n')} AS this_week_pct, {s.pct(f'({d("p")} / wks)', f'({d("past_n")} / wks)')} AS trailing_avg_pct FROM f, tot),
h AS (SELECT *, {s.pct_change('this_week_pct', 'trailing_avg_pct')} AS change_pct FROM g)
SELECT *, CASE WHEN change_pct >= 20 THEN 'rising' WHEN change_pct <= -20 THEN 'falling' ELSE 'stable' END AS trend FROM h""")
def _(i):
    return ins.subject_formulas(i.mails, i.t)


_HITS = {"emoji_rate": s.emoji("subject", "insights"), "discount_rate": s.discount("subject"), "question_rate": "contains(subject, '?')",
         "personalization_rate": f"regexp_matches(subject, {s.q('(?i)' + sub.PERSONAL_PATTERN)})"}


def _side(side, cond):
    rates = ", ".join(f"{s.pct(s.count_if(f'{cond} AND {h}'), s.count_if(cond))} AS {n}_{side}" for n, h in _HITS.items())
    return f"{s.count_if(cond)} AS n_{side}, {rates}, {s.mean(f'coalesce(sum(length(subject)) FILTER (WHERE {cond}), 0)', s.count_if(cond))} AS avg_subject_length_{side}"


_SIG = f"""x AS (SELECT *, received_at >= {THIS} AS now FROM emails WHERE received_at >= {PAST} AND received_at < {END} AND {s.KNOWN} AND subject IS NOT NULL),
sig AS (SELECT brand, {_side('this', 'now')}, {_side('past', 'NOT now')} FROM x GROUP BY brand HAVING {s.count_if('now')} >= 3 AND {s.count_if('NOT now')} >= 5)"""


@query("j07_brand_signals", f"WITH {_SIG} SELECT * FROM sig")
def _(i):
    return ins.brand_signals(i.emails, i.t)


_LONG = " UNION ALL ".join(f"SELECT brand, n_this, n_past, '{n}' AS signal, {n}_this AS this_week, {n}_past AS trailing_avg FROM sig" for n in ins.SIGNALS)


@query("a19_new_tactics", f"""
WITH {_SIG}, l AS ({_LONG}), c AS (SELECT *, {s.pct_change('this_week', 'trailing_avg')} AS ch FROM l),
a AS (SELECT *, CASE WHEN trailing_avg = 0 AND this_week > 0 THEN 'appeared' WHEN trailing_avg > 0 AND this_week = 0 THEN 'disappeared'
 WHEN trailing_avg > 0 AND abs(ch) > 50 THEN CASE WHEN ch > 0 THEN 'spike' ELSE 'drop' END END AS change_type FROM c),
k AS (SELECT brand, count(*) AS alert_count, max(n_this) AS nt FROM a WHERE change_type IS NOT NULL GROUP BY brand ORDER BY alert_count DESC, nt DESC, brand LIMIT 30)
SELECT a.brand, a.n_this, a.n_past, k.alert_count, signal, this_week, trailing_avg, change_type, CASE WHEN change_type IN ('spike', 'drop') THEN ch ELSE 0.0 END AS change_pct
FROM a JOIN k ON a.brand = k.brand WHERE change_type IS NOT NULL""")
def _(i):
    out = ins.new_tactics(i.emails, i.t).select("brand", "n_this", "n_past", "alert_count", F.inline("alerts"))
    return out.withColumn("change_pct", F.coalesce("change_pct", F.lit(0.0)))


# --- digests ----------------------------------------------------------------


def _in(days):
    return f"received_at >= {s.window_start(days)}"


@query("a21_daily_digest", f"""
SELECT brand, count(*) AS cnt, left(arg_max(subject, (received_at, -id)), 60) AS snippet, CAST(row_number() OVER (ORDER BY count(*) DESC, brand) AS INTEGER) AS rank, 'today' AS "window"
FROM emails WHERE {_in(1)} AND brand IS NOT NULL GROUP BY brand QUALIFY rank <= 5""")
def _(i):
    return st.daily_digest(i.emails, i.t)


@query("j20_top_brand_subjects", """
SELECT brand, count(*) AS cnt, left(arg_max(subject, (received_at, -id)), 60) AS snippet, CAST(row_number() OVER (ORDER BY count(*) DESC, brand) AS INTEGER) AS rank
FROM emails WHERE brand IS NOT NULL GROUP BY brand QUALIFY rank <= 12""")
def _(i):
    return st.top_brand_subjects(i.emails, 12)


@query("a22_weekly_digest", f"""
WITH x AS (SELECT * FROM emails WHERE {_in(7)})
SELECT 'this week' AS "window", count(*) AS emails, count(DISTINCT brand) AS brands,
 (SELECT brand FROM x WHERE brand IS NOT NULL GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 1) AS top_brand,
 (SELECT type FROM x WHERE type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 1) AS trending_type FROM x""")
def _(i):
    return st.weekly_digest(i.emails, i.t)


@query("a22_weekly_samples", f"""
SELECT CAST(row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '0'), id) AS INTEGER) AS sample_no, brand, left(subject, 60) AS subject FROM emails WHERE {_in(7)} AND subject IS NOT NULL QUALIFY sample_no <= 5""")
def _(i):
    return st.weekly_digest_samples(i.emails, i.t)


@query("a23_brand_spotlight", f"""
WITH x AS (SELECT *, {s.day_name('received_at')} AS day, isodow(received_at) AS dw FROM emails WHERE {_in(7)} AND brand IS NOT NULL),
dd AS (SELECT brand, arg_min(day, (-n, dw)) AS favourite_day FROM (SELECT brand, day, dw, count(*) AS n FROM x GROUP BY 1, 2, 3) GROUP BY brand)
SELECT x.brand, count(*) AS emails, any_value(dd.favourite_day) AS favourite_day, CAST(round_even({d('sum(length(subject))')} / count(*), 0) AS BIGINT) AS avg_subject_length
FROM x JOIN dd ON x.brand = dd.brand GROUP BY x.brand HAVING count(*) >= 3""")
def _(i):
    return st.brand_spotlight(i.emails, i.t)


@query("a23_spotlight_samples", f"""
SELECT brand, CAST(row_number() OVER (PARTITION BY brand ORDER BY md5(CAST(id AS VARCHAR) || '0'), id) AS INTEGER) AS sample_no, left(subject, 70) AS subject FROM emails WHERE brand IS NOT NULL QUALIFY sample_no <= 8""")
def _(i):
    return st.spotlight_samples(i.emails)


_RATES = {"questions": "contains(subject, '?')", "with_emoji": s.emoji("subject", "plane"), "with_numbers": "regexp_matches(subject, '\\d')", "with_urgency": s.has_any("subject", sub.URGENCY_WORDS["rates"])}


@query("a24_subject_rates", f"""
SELECT count(*) AS total, {', '.join(f'{s.count_if(c)} AS {n}' for n, c in _RATES.items())}, {', '.join(f'CAST({s.pct(s.count_if(c), "count(*)", 0)} AS BIGINT) AS {n}_pct' for n, c in _RATES.items())}
FROM emails WHERE {_in(7)} AND subject IS NOT NULL""")
def _(i):
    return st.subject_rates(i.emails, i.t)


# --- archive statistics -----------------------------------------------------

_OFF = "(lower(subject) LIKE '% off%' OR lower(subject) LIKE '%off %')"
_DISC = "(lower(subject) LIKE '% off%' OR lower(subject) LIKE '%sale%' OR lower(subject) LIKE '%discount%')"


def _avgl(n="count(*)"):
    return f"round({d('sum(length(subject))')} / {n}, 1)"


def _rate(cond, n="count(*)"):
    return f"round({d(s.count_if(cond))} / {n} * 100, 1)"


def _ranked(section, source, order, n, value, extra="NULL"):
    return (f"SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY {order}, brand) AS INTEGER) AS rank, brand AS item, {d(value)} AS value, "
            f"CAST({extra} AS DOUBLE) AS extra FROM {source} QUALIFY rank <= {n}")


@query("a25_archive_stats", f"""
WITH x AS (SELECT * FROM emails WHERE subject IS NOT NULL),
b AS (SELECT brand, count(*) AS n, {_avgl()} AS avg_len, {s.count_if("subject LIKE '%!%'")} AS ex, {_rate("subject LIKE '%!%'")} AS ex_pct,
 {_rate('subject = upper(subject) AND length(subject) > 3')} AS caps FROM x WHERE brand IS NOT NULL GROUP BY brand), g AS (SELECT * FROM b WHERE n >= 20),
ca AS (SELECT brand, count(*) AS n FROM x WHERE {s.has_any('subject', sub.CASUAL_PARTS)} GROUP BY brand)
SELECT * FROM ({_ranked('top_brands', 'b', 'n DESC', 10, 'n', 'avg_len')}) UNION ALL
SELECT 'zero_exclamation', 0, brand, {d('n')}, NULL FROM g WHERE ex = 0 UNION ALL
SELECT * FROM ({_ranked('most_exclamation', 'g', 'ex_pct DESC', 5, 'ex_pct', 'n')}) UNION ALL
SELECT * FROM ({_ranked('shortest_subjects', 'g', 'avg_len', 5, 'avg_len', 'n')}) UNION ALL
SELECT * FROM ({_ranked('longest_subjects', 'g', 'avg_len DESC', 5, 'avg_len', 'n')}) UNION ALL
SELECT * FROM ({_ranked('all_caps', 'g', 'caps DESC', 5, 'caps', 'n')}) UNION ALL
SELECT * FROM ({_ranked('casual', 'ca', 'n DESC', 5, 'n').replace('n DESC, brand', 'n DESC, brand NULLS FIRST')}) UNION ALL
SELECT 'totals', 1, 'emails', {d('count(*)')}, NULL FROM x UNION ALL SELECT 'totals', 2, 'avg_subject_length', {_avgl()}, NULL FROM x UNION ALL
SELECT 'totals', 3, 'brands', {d('count(DISTINCT brand)')}, NULL FROM x UNION ALL SELECT 'totals', 4, 'discount_pct', {_rate(_OFF)}, NULL FROM x UNION ALL
SELECT 'totals', 5, 'exclamation_pct', {_rate("subject LIKE '%!%'")}, NULL FROM x UNION ALL SELECT 'totals', 6, 'question_pct', {_rate("subject LIKE '%?%'")}, NULL FROM x UNION ALL
SELECT 'totals', 7, 'urgency_pct', {_rate(s.has_any('subject', sub.URGENCY_WORDS['archive']))}, NULL FROM x""")
def _(i):
    return st.archive_stats(i.emails).withColumn("rank", F.coalesce("rank", F.lit(0)))


@query("a25_short_subjects", """
SELECT CAST(row_number() OVER (ORDER BY length(subject), id) AS INTEGER) AS rank, id, brand, subject FROM emails WHERE length(subject) BETWEEN 3 AND 20 QUALIFY rank <= 25""")
def _(i):
    return st.short_subjects(i.emails)


@query("a25_subject_samples", """
SELECT brand, CAST(row_number() OVER (PARTITION BY brand ORDER BY md5(CAST(id AS VARCHAR) || '0'), id) AS INTEGER) AS sample_no, id, subject FROM emails WHERE brand IN ('Nykaa', 'Zomato') QUALIFY sample_no <= 10""")
def _(i):
    return st.brand_subject_samples(i.emails, ["Nykaa", "Zomato"])


_OUT = f"o AS (SELECT brand, count(*) AS n, {_avgl()} AS avg_len, {s.count_if("subject LIKE '%!%'")} AS ex, {s.count_if(_DISC)} AS dc FROM emails WHERE {_in(30)} AND brand IS NOT NULL GROUP BY brand)"


@query("a33_outlier_brands", f"""
WITH {_OUT}, g AS (SELECT * FROM o WHERE n >= 10)
SELECT * FROM ({_ranked('zero_exclamation', '(SELECT * FROM g WHERE ex = 0)', 'n DESC', 5, 'n')}) UNION ALL SELECT * FROM ({_ranked('shortest_subjects', 'g', 'avg_len', 3, 'avg_len')}) UNION ALL
SELECT * FROM ({_ranked('most_frequent', 'o', 'n DESC', 3, 'n', f'round_even({d("n")} / {s.window_days(30)} * 7, 1)')}) UNION ALL
SELECT * FROM ({_ranked('never_discount', '(SELECT * FROM g WHERE dc = 0)', 'n DESC', 3, 'n')})""")
def _(i):
    return st.outlier_brands(i.emails, i.t)


@query("a30_contrarian_points", f"""
WITH {_OUT}, g AS (SELECT * FROM o WHERE n >= 5)
SELECT * FROM ({_ranked('shortest_subjects', 'g', 'avg_len', 5, 'avg_len')}) UNION ALL SELECT * FROM ({_ranked('never_discount', '(SELECT * FROM g WHERE dc = 0)', 'n DESC', 5, 'n')}) UNION ALL
SELECT * FROM ({_ranked('zero_exclamation', '(SELECT * FROM g WHERE ex = 0)', 'n DESC', 5, 'n')})""")
def _(i):
    return st.contrarian_points(i.emails, i.t)


# --- brand strategy ---------------------------------------------------------


@query("a26_brand_strategy", f"""
WITH x AS (SELECT *, {_in(30)} AS w FROM emails WHERE brand IS NOT NULL),
ty AS (SELECT brand, string_agg(type || ':' || n, '|' ORDER BY n DESC, type) AS v, arg_min(type, (-n, type)) AS best FROM (SELECT brand, type, count(*) AS n FROM x WHERE w AND type IS NOT NULL GROUP BY brand, type) GROUP BY brand)
SELECT x.brand, coalesce(min(industry), 'DTC/Ecommerce') AS industry, {s.count_if('w')} AS total, round_even({d(s.count_if('w'))} / {s.window_days(30)} * 7, 1) AS emails_per_week,
 CAST(round_even({d('sum(length(subject))')} / count(subject), 0) AS BIGINT) AS avg_subject_length, coalesce(any_value(ty.best), 'Newsletter') AS top_type, coalesce(any_value(ty.v), '') AS types
FROM x LEFT JOIN ty ON x.brand = ty.brand GROUP BY x.brand HAVING {s.count_if('w')} >= 10""")
def _(i):
    return st.brand_strategy(i.emails, i.t).withColumn("types", pr.listing("types"))


def _one(brand):
    return f"""(SELECT round_even({d(s.count_if(_in(30)))} / {s.window_days(30)} * 7, 1) AS rate, CAST(round_even({d('sum(length(subject))')} / count(subject), 0) AS BIGINT) AS len,
 (SELECT type FROM emails WHERE brand = '{brand}' AND type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 1) AS ty, coalesce(min(industry), 'DTC/Ecommerce') AS ind FROM emails WHERE brand = '{brand}')"""


@query("a27_brand_difference", f"""
SELECT 'Gucci' AS brand_a, 'Graza' AS brand_b, CASE WHEN abs(a.rate - b.rate) > 1 THEN 'send frequency' WHEN abs(a.len - b.len) > 10 THEN 'subject line length' WHEN a.ty <> b.ty THEN 'email types' ELSE 'overall email strategy approach' END AS difference,
 a.rate AS rate_a, b.rate AS rate_b, a.len AS length_a, b.len AS length_b, a.ty AS type_a, b.ty AS type_b, a.ind AS industry FROM {_one('Gucci')} a, {_one('Graza')} b""")
def _(i):
    return st.brand_difference(i.emails, i.t, "Gucci", "Graza")


@query("a42_teardown", f"""
WITH x AS (SELECT brand, count(*) AS n, arg_max(id, (received_at, -id)) AS id FROM emails WHERE {_in(7)} AND brand IS NOT NULL GROUP BY brand HAVING count(*) >= 3)
SELECT x.brand, coalesce(e.type, 'Promotional') AS type, e.subject, {s.tactic('e.subject')} AS tactic, round_even({d('n')} / {s.window_days(7)} * 7, 1) AS emails_per_week FROM x JOIN emails e ON x.id = e.id""")
def _(i):
    return st.teardown(i.emails, i.t)


@query("j22_sample_per_brand", "WITH x AS (SELECT brand, arg_max(id, (received_at, -id)) AS id FROM emails WHERE brand IS NOT NULL GROUP BY brand) SELECT x.brand, x.id, e.subject, e.preview FROM x JOIN emails e ON x.id = e.id")
def _(i):
    return st.sample_per_brand(i.emails)


# --- trends -----------------------------------------------------------------

_TC = f"""tc AS (SELECT type, {s.count_if(f"received_at >= {T} - INTERVAL 7 DAY")} AS this_count, {s.count_if(f"received_at < {T} - INTERVAL 7 DAY")} AS last_count FROM emails
 WHERE received_at >= {T} - INTERVAL 14 DAY AND received_at < {T} AND type IS NOT NULL GROUP BY type),
ch AS (SELECT *, CAST(round_even({d('this_count - last_count')} / last_count * 100, 0) AS BIGINT) AS change_pct FROM tc WHERE this_count > 0 AND last_count > 0), tr AS (SELECT * FROM ch WHERE abs(change_pct) >= 10)"""


@query("a28_type_changes", f"WITH {_TC} SELECT * FROM tr")
def _(i):
    return st.type_changes(i.emails, i.t)


@query("a28_weekly_roundup", f"""
WITH {_TC}, best AS (SELECT * FROM tr ORDER BY abs(change_pct) DESC, this_count DESC LIMIT 1)
SELECT best.type, best.change_pct, CASE WHEN best.change_pct > 0 THEN 'more' ELSE 'fewer' END AS direction, CAST(row_number() OVER (ORDER BY count(*) DESC, brand) AS INTEGER) AS rank, brand, count(*) AS cnt
FROM emails e JOIN best ON e.type = best.type WHERE received_at >= {T} - INTERVAL 7 DAY AND brand IS NOT NULL GROUP BY best.type, best.change_pct, brand QUALIFY rank <= 3""")
def _(i):
    return st.weekly_roundup(i.emails, i.t)


def _mt(k, name, cond):
    r = lambda side: f"round({d(s.count_if(f'{side} AND {cond}'))} / {s.count_if(side)} * 100, 1)"
    return (f"SELECT {k} AS pos, '{name}' AS metric, CASE WHEN a > b THEN 'up' ELSE 'down' END AS direction, a AS this_month, b AS last_month, abs(round(a - b, 1)) AS change "
            f"FROM (SELECT {r('now')} AS a, {r('NOT now')} AS b FROM x) WHERE a <> 0 AND b <> 0 AND abs(round(a - b, 1)) >= 2")


_SHIFT = "(CASE WHEN id % 5 < 2 THEN received_at - INTERVAL 31 DAY ELSE received_at END)"


@query("a32_month_trends", f"""
WITH x AS (SELECT *, {_SHIFT} >= TIMESTAMP '2024-01-01' AS now FROM emails WHERE {_SHIFT} >= TIMESTAMP '2023-12-01'),
v AS (SELECT {s.count_if('now')} AS a, {s.count_if('NOT now')} AS b FROM x), vv AS (SELECT *, round_even({d('a - b')} / b * 100, 0) AS p FROM v WHERE a > 0 AND b > 0)
SELECT 1 AS pos, 'volume' AS metric, CASE WHEN p > 0 THEN 'up' ELSE 'down' END AS direction, {d('a')} AS this_month, {d('b')} AS last_month, abs(p) AS change FROM vv WHERE abs(p) >= 5 UNION ALL
{_mt(2, 'urgency language', s.has_any('subject', sub.URGENCY_WORDS['trend']))} UNION ALL {_mt(3, 'discount mentions', _DISC)} UNION ALL {_mt(4, 'question marks in subjects', "contains(subject, '?')")}""")
def _(i):
    # the events cover one month: two of five ids move back 31 days
    moved = F.when(F.col("id") % 5 < 2, F.col("received_at") - F.expr("INTERVAL 31 DAYS")).otherwise(F.col("received_at"))
    return st.month_trends(i.emails.withColumn("received_at", moved), i.t)


@query("a29_data_points", f"""
WITH x AS (SELECT * FROM emails WHERE {_in(30)})
SELECT 'totals' AS section, 1 AS rank, 'emails' AS item, {d('count(*)')} AS value, CAST(NULL AS DOUBLE) AS extra FROM x UNION ALL SELECT 'totals', 2, 'brands', {d('count(DISTINCT brand)')}, NULL FROM x
UNION ALL SELECT 'totals', 3, 'avg_subject_length', round_even({d('sum(length(subject))')} / count(subject), 1), NULL FROM x UNION ALL SELECT 'totals', 4, 'question_pct', {s.pct(s.count_if("contains(subject, '?')"), 'count(subject)')}, NULL FROM x
UNION ALL SELECT 'totals', 5, 'exclamation_pct', {s.pct(s.count_if("contains(subject, '!')"), 'count(subject)')}, NULL FROM x
UNION ALL SELECT 'totals', 6, 'urgency_pct', {s.pct(s.count_if(s.has_any('subject', sub.URGENCY_WORDS['data_points'])), 'count(subject)')}, NULL FROM x
UNION ALL SELECT 'top_types', CAST(row_number() OVER (ORDER BY n DESC, type) AS INTEGER) AS r, type, {d('n')}, NULL FROM (SELECT type, count(*) AS n FROM x WHERE type IS NOT NULL GROUP BY type) QUALIFY r <= 5
UNION ALL SELECT 'top_brands', CAST(row_number() OVER (ORDER BY n DESC, brand) AS INTEGER) AS r, brand, {d('n')}, NULL FROM (SELECT brand, count(*) AS n FROM x WHERE brand IS NOT NULL GROUP BY brand) QUALIFY r <= 5""")
def _(i):
    return st.data_points(i.emails, i.t)


@query("a31_tip_points", f"""
SELECT count(DISTINCT brand) AS brands, count(*) AS emails, CAST(round_even({d('sum(length(subject))')} / count(subject), 0) AS BIGINT) AS avg_subject_length,
 {s.pct(s.count_if(s.has_any('subject', sub.TIP_PERSONAL_PARTS)), 'count(subject)')} AS personalized_pct FROM emails WHERE {_in(30)}""")
def _(i):
    return st.tip_points(i.emails, i.t)


_DOW = "(['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'])[dow + 1]"


@query("a34_timing_patterns", f"""
WITH x AS (SELECT *, dayofweek(received_at) AS dow FROM emails WHERE {_in(30)}), dd AS (SELECT dow, count(*) AS n FROM x GROUP BY dow), t AS (SELECT sum(n) AS total FROM dd)
SELECT 'peak_day' AS section, 1 AS rank, {_DOW} AS item, round_even({d('n')} / total * 100, 0) AS value, CAST(NULL AS DOUBLE) AS extra FROM (SELECT * FROM dd ORDER BY n DESC, dow LIMIT 1), t
UNION ALL SELECT 'lowest_day', 1, {_DOW}, round_even({d('n')} / total * 100, 0), NULL FROM (SELECT * FROM dd ORDER BY n, dow DESC LIMIT 1), t
UNION ALL SELECT 'weekend_senders', CAST(row_number() OVER (ORDER BY n DESC, brand) AS INTEGER) AS r, brand, {d('n')}, NULL FROM (SELECT brand, count(*) AS n FROM x WHERE dow IN (0, 6) AND brand IS NOT NULL GROUP BY brand HAVING count(*) >= 3) QUALIFY r <= 3""")
def _(i):
    return st.timing_patterns(i.emails, i.t)


_BURST = f"""bd AS (SELECT brand, CAST(received_at AS DATE) AS day, count(*) AS cnt FROM emails WHERE {_in(14)} AND brand IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
bt AS (SELECT *, CAST(row_number() OVER (ORDER BY cnt DESC, brand, day) AS INTEGER) AS burst_rank FROM bd QUALIFY burst_rank <= 5)"""


@query("a35_burst_days", f"WITH {_BURST} SELECT brand, CAST(day AS VARCHAR) AS day, cnt, burst_rank AS rank FROM bt")
def _(i):
    return st.burst_days(i.emails, i.t).withColumn("day", F.col("day").cast("string"))


@query("j23_burst_subjects", f"""
WITH {_BURST} SELECT bt.brand, CAST(bt.day AS VARCHAR) AS day, cnt, burst_rank, CAST(row_number() OVER (PARTITION BY bt.brand, bt.day ORDER BY received_at, id) AS INTEGER) AS rank, left(subject, 50) AS subject
FROM emails e JOIN bt ON e.brand = bt.brand AND CAST(e.received_at AS DATE) = bt.day QUALIFY rank <= 3""")
def _(i):
    return st.burst_subjects(i.emails, i.t).withColumn("day", F.col("day").cast("string"))


@query("j21_topic_match", f"""
WITH {s.keyword_cte('documents', 'doc_id', 'text', 5)},
x AS (SELECT *, lower(subject) AS low FROM emails WHERE {_in(30)} AND subject IS NOT NULL AND brand IS NOT NULL), ks AS (SELECT DISTINCT word FROM kw),
h AS (SELECT ks.word, x.*, row_number() OVER (PARTITION BY ks.word ORDER BY md5(CAST(x.id AS VARCHAR) || '0'), x.id) AS sn FROM ks JOIN x ON contains(x.low, ks.word) QUALIFY sn <= 5),
f AS (SELECT kw.doc_id, kw.pos, h.* FROM kw JOIN h ON kw.word = h.word QUALIFY row_number() OVER (PARTITION BY kw.doc_id, h.subject ORDER BY kw.pos, h.sn) = 1)
SELECT doc_id AS text_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, sn) AS INTEGER) AS rank, word AS keyword, id, brand, subject, coalesce(type, 'Promotional') AS type, left(coalesce(preview, ''), 120) AS preview,
 strftime(received_at, '%A') AS day FROM f QUALIFY rank <= 10""")
def _(i):
    texts = i.spread(i.table("documents"), "doc_id").select(F.col("doc_id").alias("text_id"), "text")
    return st.topic_match(i.mails, texts, i.t)


# --- distributions ----------------------------------------------------------


@query("a36_distribution", """
SELECT 'industry' AS col, industry AS item, count(*) AS cnt, round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM emails) * 100, 1) AS pct FROM emails GROUP BY industry
UNION ALL SELECT * FROM (SELECT 'type', type, count(*) AS cnt, round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM emails) * 100, 1) FROM emails GROUP BY type ORDER BY cnt DESC, type NULLS FIRST LIMIT 8)""")
def _(i):
    a = st.distribution(i.emails, "industry").select(F.lit("industry").alias("col"), F.col("industry").alias("item"), "cnt", "pct")
    return a.unionByName(st.distribution(i.emails, "type", 8).select(F.lit("type").alias("col"), F.col("type").alias("item"), "cnt", "pct"))


@query("a37_brand_industries", """
SELECT brand, coalesce((SELECT string_agg(DISTINCT e2.industry, '|' ORDER BY e2.industry) FROM emails e2 WHERE e2.brand = e.brand AND e2.industry IS NOT NULL), '') AS industries, count(*) AS cnt FROM emails e WHERE brand IS NOT NULL GROUP BY brand""")
def _(i):
    return st.brand_industries(i.emails).withColumn("industries", F.array_join("industries", "|"))


@query("a40_summary_cube", """
WITH x AS (SELECT *, strftime(received_at, '%Y-%m') AS month FROM emails)
SELECT industry, brand, type, month, CAST(grouping(industry, brand, type, month) AS BIGINT) AS level, count(*) AS emails, CAST(sum(length(subject)) AS BIGINT) AS chars FROM x GROUP BY CUBE (industry, brand, type, month)""")
def _(i):
    return st.summary_cube(i.emails)


@query("a41_totals", f"""
SELECT 'all' AS part, count(*) AS emails, count(DISTINCT brand) AS brands FROM emails UNION ALL SELECT 'week', count(*), count(DISTINCT brand) FROM emails WHERE {_in(7)}""")
def _(i):
    a, b = st.totals(i.emails), st.totals(i.emails, i.t, 7)
    return a.select(F.lit("all").alias("part"), "*").unionByName(b.select(F.lit("week").alias("part"), "*"))


@query("a41_sketch_totals", """
WITH d AS (SELECT unnest([7, 14, 30]) AS days), x AS (SELECT id, brand, page_id, received_at FROM emails)
SELECT d.days, count(*) AS emails, count(DISTINCT brand) AS brands FROM x JOIN d ON CAST(x.received_at AS DATE) >= DATE '2024-01-30' - to_days(CAST(d.days AS INTEGER)) AND CAST(x.received_at AS DATE) < DATE '2024-01-30' GROUP BY 1""")
def _(i):
    path = scratch_path(i.spark, "cells")
    sketches.distinct_cells(i.emails, ["brand"]).write.parquet(path)  # computed once; every window reads cells only
    cells = i.spark.read.parquet(path)
    windows = [sketches.window_totals(cells, ["brand"], i.t, days).select(F.lit(days).cast("int").alias("days"), "emails", F.col("brand").alias("brands")) for days in (7, 14, 30)]
    return windows[0].unionByName(windows[1]).unionByName(windows[2])


# --- registries and packs ---------------------------------------------------


# Every insight by name: the query whose SQL has the same rows, and its columns.
_SCORE_COLUMNS = [f"{c}_{side}" for c in ins.SCORES for side in ("this", "last", "change")]
_REGISTERED = {
    "weekly_scoreboard": ("a17_weekly_scoreboard", ["week", *_SCORE_COLUMNS, "busiest_day_this", "busiest_day_last", "mover_brand", "mover_change_pct", "mover_this_count", "mover_last_count"]),
    "brand_sequences": ("o02_brand_sequences", ["brand", "email_count", "span_days", "keyword_overlap"]),
    "subject_formulas": ("a18_subject_formulas", ["formula", "this_week_count", "this_week_pct", "trailing_avg_pct", "change_pct", "trend"]),
    "new_tactics": ("a19_new_tactics", ["brand", "n_this", "n_past", "alert_count", "signal", "this_week", "trailing_avg", "change_type", "change_pct"]),
}
_FLAT = {
    "brand_sequences": lambda rows: rows.withColumn("keyword_overlap", F.array_join("keyword_overlap", " ")),
    "new_tactics": lambda rows: rows.select("brand", "n_this", "n_past", "alert_count", F.inline("alerts")).withColumn("change_pct", F.coalesce("change_pct", F.lit(0.0))),
}


@query("u01_insight_registry")
def _(i):
    """The rows of every insight as text: name=value of each column in a fixed order."""
    out = None
    for name, (_, columns) in _REGISTERED.items():
        rows = _FLAT.get(name, lambda x: x)(registry.run(name, i.emails, i.t))
        texts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns]
        one = rows.select(F.lit(name).alias("insight"), F.concat_ws("|", *texts).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


ORACLES["u01_insight_registry"] = "\nUNION ALL ".join(
    "SELECT '{}' AS insight, concat_ws('|', {}) AS row FROM ({}) x".format(
        name, ", ".join(f"concat('{c}=', coalesce(CAST({c} AS VARCHAR), '-'))" for c in columns), ORACLES[q]) for name, (q, columns) in _REGISTERED.items())


@query("u02_statistic_registry")
def _(i):
    out = None
    for name in registry.STATISTICS:
        one = registry.run(name, i.emails, i.t)
        rows = one.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("statistic"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


_PACK_TEXT = "A coffee sale for every morning trip"
_PACK_KW = s.keyword_cte(f"(SELECT 0 AS doc_id, '{_PACK_TEXT}' AS text)", "doc_id", "text", 5)


@query("u03_examples", f"""
SELECT CAST(row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '0'), id) AS INTEGER) AS rank, id, brand, type, subject FROM emails WHERE {_in(30)} AND brand IS NOT NULL AND subject IS NOT NULL QUALIFY rank <= 8""")
def _(i):
    rows = st.in_active_window(i.emails, i.t, 30).where("brand IS NOT NULL AND subject IS NOT NULL")
    return rk.hash_sample(rows, st.EXAMPLES).select(F.col("sample_no").alias("rank"), "id", "brand", "type", "subject")


@query("u03_stat_packs")
def _(i):
    return st.stat_packs(i.emails, i.t, text=_PACK_TEXT)


# the mails cover one month, so there are no trends
ORACLES["u03_stat_packs"] = f"""
WITH outliers AS (SELECT 'outliers' AS section, rank, concat_ws(' ', section, item, CAST(value AS VARCHAR)) AS line FROM ({ORACLES["a33_outlier_brands"]}) x),
timing AS (SELECT 'timing' AS section, rank, concat_ws(' ', section, item, CAST(value AS VARCHAR)) AS line FROM ({ORACLES["a34_timing_patterns"]}) x),
bursts AS (SELECT 'bursts' AS section, rank, concat_ws(' ', brand, day, CAST(cnt AS VARCHAR)) AS line FROM ({ORACLES["a35_burst_days"]}) x WHERE rank <= 3),
topic AS (SELECT 'topic' AS section, rank, concat_ws(' | ', brand, type, subject) AS line FROM ({ORACLES["j21_topic_match"].replace(s.keyword_cte('documents', 'doc_id', 'text', 5), _PACK_KW)}) x),
examples AS (SELECT 'examples' AS section, rank, concat_ws(' | ', brand, coalesce(type, 'Promo'), left(subject, 80)) AS line FROM (
 {ORACLES["u03_examples"]}) x)
SELECT pack, section, rank, line FROM (SELECT unnest(['counter', 'playbook', 'builder']) AS pack, * FROM outliers UNION ALL SELECT unnest(['counter', 'playbook']), * FROM timing
 UNION ALL SELECT 'playbook', * FROM bursts UNION ALL SELECT 'proof', * FROM topic UNION ALL SELECT 'proof', * FROM examples UNION ALL SELECT 'builder', * FROM examples WHERE rank <= 5) y"""
