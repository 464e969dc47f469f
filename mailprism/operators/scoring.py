"""E-mail quality scores: five dimensions, grade, weighted total, suggestions, roll-up.

All scores are Catalyst expressions over subject, times and the parsed HTML struct.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions.scalars import DAY_NAMES, ratio
from mailprism.functions.subjects import contains_any, has_digit, has_emoji, shouted_words
from mailprism.session import local_table

# ---------------------------------------------------------------------------
# Word lists, grade bounds, weights and the suggestion table.
# ---------------------------------------------------------------------------
GRADES = [(95, "A+"), (90, "A"), (85, "A-"), (80, "B+"), (70, "B"), (60, "C"), (50, "D")]
WEIGHTS = {"subject": 20, "copy": 25, "cta": 20, "design": 15, "strategy": 20}
STRONG = 80  # dimensions from here on get no suggestions
MAX_SUGGESTIONS = 4
NOTE = "struct<text:string,type:string>"

URGENCY = ["now", "today", "hurry", "limited", "ending", "last chance", "final", "expires", "rush",
           "don't miss", "act now", "hours left", "ends tonight", "running out", "urgent", "deadline",
           "only", "exclusive", "flash"]
POWER = ["free", "new", "save", "exclusive", "guaranteed", "proven", "best", "top", "discover", "secret",
         "ultimate", "amazing", "bonus", "instant", "premium", "introducing", "special", "unlock", "win",
         "deal", "offer", "launch", "trending"]
TOKENS = ["{first_name}", "{name}", "{firstname}", "{{first_name}}", "{{name}}", "%%first_name%%",
          "*|fname|*", "*|name|*"]
ACTION_VERBS = ["shop", "buy", "get", "order", "grab", "claim", "start", "try", "explore", "discover",
                "download", "join", "sign up", "subscribe", "learn", "read", "view", "watch", "save",
                "book", "reserve", "add to cart", "checkout", "register"]
SKIPPED_LINKS = ["unsubscribe", "privacy", "terms", "manage preferences", "view in browser"]
BUTTON_MARKS = ["background-color", "bgcolor", "btn", "button", "padding:", "border-radius"]

PERSONALIZE = "Add personalization (e.g., subscriber's first name) to your subject line to boost open rates"
MIDWEEK = "Consider sending on Tuesday-Thursday between 9-11 AM for peak engagement"
SUGGESTIONS = [
    ("subject", "No personalization detected", PERSONALIZE),
    ("subject", "Very short", "Aim for 30-60 characters in your subject line — long enough to be descriptive, short enough to not get truncated"),
    ("subject", "Too long", "Shorten your subject line to under 60 characters so it displays fully on mobile"),
    ("subject", "No personalization", PERSONALIZE),
    ("copy", "No headings", "Add headings (H1, H2) to break up your email copy and improve scannability"),
    ("copy", "No bullet", "Use bullet points or numbered lists to make key information easy to scan"),
    ("copy", "No preview text", "Add compelling preview text — it's the second thing readers see after the subject line"),
    ("copy", "Dense copy", "Shorten your sentences to under 20 words for better readability"),
    ("copy", "Very long copy", "Consider trimming your email copy — shorter emails tend to have higher engagement"),
    ("copy", "Minimal copy", "Add more body copy to provide context and drive the reader toward your CTA"),
    ("cta", "No CTA links", "Add at least one clear call-to-action link or button to guide readers"),
    ("cta", "No strong action verbs", "Use action verbs like 'Shop', 'Get', 'Discover' in your CTA text"),
    ("cta", "Text-only CTAs", "Style your CTAs as buttons with a contrasting background color for higher click-through"),
    ("cta", "Many CTAs", "Reduce the number of CTAs to 2-3 to maintain focus and avoid decision fatigue"),
    ("design", "No images", "Add relevant images to make your email more visually engaging"),
    ("design", "missing alt text", "Add alt text to all images for better accessibility and deliverability"),
    ("design", "No viewport meta", "Add a viewport meta tag to ensure your email renders well on mobile devices"),
    ("design", "No dark mode", "Add prefers-color-scheme CSS media query to support dark mode email clients"),
    ("design", "Heavy on images", "Balance your image-to-text ratio — too many images can trigger spam filters"),
    ("design", "No images have alt text", "Add descriptive alt text to every image for accessibility and when images are blocked"),
    ("strategy", "Saturday", MIDWEEK),
    ("strategy", "Sunday", MIDWEEK),
    ("strategy", "off-peak", "Try sending during peak hours: 9-11 AM or 1-3 PM for better open rates"),
    ("strategy", "No campaign type", "Classify your campaign type (e.g., Sale, Newsletter) to better track performance"),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def calculate_grade(score) -> Column:
    score = _c(score)
    out = None
    for low, grade in GRADES:
        out = F.when(score >= low, grade) if out is None else out.when(score >= low, grade)
    return out.otherwise("F")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


class _Numbered(NamedTuple):
    """A text around a number."""

    before: str
    value: Column
    after: str


def _text(text) -> Column:
    if isinstance(text, _Numbered):
        return F.concat(F.lit(text.before), text.value.cast("string"), F.lit(text.after))
    return F.lit(text) if isinstance(text, str) or text is None else text


def _fitting(dimension: str, text) -> Column:
    """Suggestions of a bad finding (an array): those whose trigger its text holds, in the order of the table. For texts that
    are known beforehand but for a number, which is in no trigger, they are literals."""
    table = [(trigger.lower(), suggestion) for d, trigger, suggestion in SUGGESTIONS if d == dimension]
    if isinstance(text, Column):
        # The lambda also keeps the sheets of a mail out of Spark's whole-stage method, which would be too long for the JVM to compile.
        rows = F.array(*[F.struct(F.lit(k).alias("trigger"), F.lit(x).alias("text")) for k, x in table])
        return F.transform(F.filter(rows, lambda r: F.contains(F.lower(text), r["trigger"])), lambda r: r["text"])
    fixed = [x.lower() for x in ((text.before, text.after) if isinstance(text, _Numbered) else (text,))]
    held = [F.lit(x) for k, x in table if any(k in f for f in fixed)]
    return F.array(*held) if held else _none("string")


class _Sheet:
    """Collects the rules of one dimension: points added, findings reported and what the bad ones suggest."""

    def __init__(self, dimension: str):
        self.dimension, self.points, self.findings, self.suggested = dimension, [F.lit(50)], [], []

    def choose(self, *branches):
        """First branch that holds: (condition, points, kind, text); kind None reports nothing."""
        points = finding = suggested = None
        for cond, worth, kind, text in branches:
            note = F.array(F.struct(_text(text).alias("text"), F.lit(kind).alias("type"))) if kind else _none(NOTE)
            advice = F.array(_fitting(self.dimension, text)) if kind == "bad" else _none("array<string>")
            points = F.when(cond, worth) if points is None else points.when(cond, worth)
            finding = F.when(cond, note) if finding is None else finding.when(cond, note)
            suggested = F.when(cond, advice) if suggested is None else suggested.when(cond, advice)
        if any(worth for _, worth, _, _ in branches):
            self.points.append(F.coalesce(points, F.lit(0)))
        if any(kind for _, _, kind, _ in branches):
            self.findings.append(finding.otherwise(_none(NOTE)))
        if any(kind == "bad" for _, _, kind, _ in branches):
            self.suggested.append(suggested.otherwise(_none("array<string>")))

    def score(self) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(100), reduce(add, self.points)))

    def notes(self) -> Column:
        # flatten is compiled together with the rules in it; a function with a lambda has all below it interpreted
        return F.flatten(F.array(*self.findings))

    def advice(self) -> Column:
        """Of every bad finding its suggestions."""
        return F.flatten(F.array(*self.suggested))

    def filled(self, missing=None, worth: int = 0, text: str = "") -> tuple[Column, Column, Column]:
        """Score, findings and advice; where ``missing`` holds, a fixed score and one bad finding instead."""
        whole = self.score(), self.notes(), self.advice()
        if missing is None:
            return whole
        instead = F.lit(worth), _note(text), F.array(_fitting(self.dimension, text))
        return tuple(F.when(missing, x).otherwise(y) for x, y in zip(instead, whole))


def _note(text: str) -> Column:
    return F.array(F.struct(F.lit(text).alias("text"), F.lit("bad").alias("type")))


def _n(before: str, value: Column, after: str) -> _Numbered:
    return _Numbered(before, value, after)


def _array(col, kind: str) -> Column:
    return F.coalesce(_c(col), F.array().cast(kind))


# Each dimension has two parts: measures (expensive, computed once per mail as columns)
# and a sheet of rules over those measures.


def subject_measures(subject="subject") -> dict:
    s = F.coalesce(_c(subject), F.lit(""))
    low = F.lower(s)
    return {
        "length": F.length(s), "token": contains_any(low, TOKENS), "urgent": contains_any(low, URGENCY), "power": contains_any(low, POWER), "low": low,
        "digit": has_digit(s), "emoji": has_emoji(s, "scoring"), "question": F.contains(s, F.lit("?")),
        "words": _word_count(s), "loud": shouted_words(s),
    }


def subject_sheet(m) -> tuple[Column, Column, Column]:
    n, words, loud = m["length"], m["words"], m["loud"]
    sheet = _Sheet("subject")
    sheet.choose(
        (n.between(30, 60), 15, "good", _n("Good length (", n, " chars)")),
        (n.between(20, 29), 8, "neutral", _n("Slightly short (", n, " chars)")),
        (n.between(61, 80), 5, "neutral", _n("Slightly long (", n, " chars)")),
        (n > 80, -10, "bad", _n("Too long (", n, " chars) — may get truncated")),
        (F.lit(True), -5, "bad", _n("Very short (", n, " chars)")),
    )
    sheet.choose((m["token"], 10, "good", "Has personalization token"), (F.lit(True), 0, "bad", "No personalization detected"))
    sheet.choose((m["urgent"], 8, "good", "Contains urgency words"))
    # found only where there is one
    power = F.filter(F.array(*[F.lit(w) for w in POWER]), lambda w: F.contains(m["low"], w))
    sheet.choose((m["power"], 5, "good", F.concat(F.lit("Power words: "), F.array_join(F.slice(power, 1, 3), ", "))))
    sheet.choose((m["digit"], 5, "good", "Contains numbers (good for engagement)"))
    sheet.choose((m["emoji"], 3, "good", "Has emoji"))
    sheet.choose((m["question"], 3, "good", "Has question mark (drives curiosity)"))
    sheet.choose(
        ((loud > words * 0.5) & (words > 2), -15, "bad", "Excessive ALL CAPS — may trigger spam filters"),
        (loud > 0, 2, "neutral", _n("", loud, " emphasized word(s)")),
    )
    return sheet.filled(n == 0, 0, "No subject line")


def _word_count(text) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def copy_measures(text="copy_text", headings="headings", lists="list_count", html="html") -> dict:
    """Measures of the body; ``preview`` is added per mail by ``preview_measure``."""
    text = F.coalesce(_c(text), F.lit(""))
    return {
        "words": _word_count(text),
        # sentences end at . ! ?; both counts skip blank sentences
        "sentences": F.regexp_count(text, F.lit(r"(?U)[^\s.!?][^.!?]*")),
        "sentence_words": F.regexp_count(text, F.lit(r"(?U)[^\s.!?]+")),
        "headings": F.size(_array(headings, "array<struct<tag:string,text:string>>")), "lists": F.coalesce(_c(lists), F.lit(0)),
        "token": contains_any(F.lower(F.coalesce(_c(html), F.lit(""))), TOKENS),
    }


def preview_measure(preview="preview") -> Column:
    return F.coalesce(F.length(F.regexp_replace(_c(preview), r"(?U)^\s+|\s+$", "")) > 10, F.lit(False))


def copy_sheet(m) -> tuple[Column, Column, Column]:
    n, heads, lists = m["words"], m["headings"], m["lists"]
    mean = ratio(m["sentence_words"], m["sentences"])
    shown = F.bround(mean, 0).cast("long")
    sheet = _Sheet("copy")
    sheet.choose(
        (n.between(50, 500), 15, "good", _n("Good word count (", n, ")")),
        (n.between(501, 1000), 8, "neutral", _n("Lengthy copy (", n, " words)")),
        (n > 1000, 2, "bad", _n("Very long copy (", n, " words) — consider trimming")),
        (n.between(20, 49), 5, "neutral", _n("Short copy (", n, " words)")),
        (F.lit(True), -5, "bad", _n("Minimal copy (", n, " words)")),
    )
    sheet.choose(
        (mean <= 20, 10, "good", _n("Good readability (avg ", shown, " words/sentence)")),
        (mean <= 30, 5, "neutral", _n("Moderate readability (avg ", shown, " words/sentence)")),
        (mean > 30, 0, "bad", _n("Dense copy (avg ", shown, " words/sentence)")),
    )
    sheet.choose(
        (heads > 0, 8, "good", _n("", heads, " heading(s) found — good structure")),
        (F.lit(True), 0, "bad", "No headings — consider adding structure"),
    )
    sheet.choose((lists > 0, 5, "good", _n("", lists, " list(s) found — scannable")), (F.lit(True), 0, "bad", "No bullet/numbered lists found"))
    sheet.choose((m["preview"], 5, "good", "Has preview text"), (F.lit(True), 0, "bad", "No preview text detected"))
    sheet.choose((m["token"], 5, "good", "Body uses personalization"))
    return sheet.filled()


def cta_measures(links="links", html="html") -> dict:
    html = F.coalesce(_c(html), F.lit(""))
    skipped = F.array(*[F.lit(p) for p in SKIPPED_LINKS])
    verbs = F.array(*[F.lit(v) for v in ACTION_VERBS])

    def is_cta(link):
        text = F.lower(link["text"])
        return (F.length(text) > 1) & ~F.exists(skipped, lambda p: F.contains(text, p))

    ctas = F.filter(_array(links, "array<struct<href:string,text:string>>"), is_cta)
    used = F.transform(ctas, lambda c: F.get(F.filter(verbs, lambda v: F.contains(F.lower(c["text"]), v)), 0))
    return {
        "ctas": F.size(ctas), "verbs": F.array_compact(used), "button": contains_any(F.lower(html), BUTTON_MARKS),
        "place": F.position(F.get(ctas, 0)["text"], html) - 1, "html_length": F.length(html),
    }


def cta_sheet(m) -> tuple[Column, Column, Column]:
    n = m["ctas"]
    sheet = _Sheet("cta")
    sheet.choose((F.lit(True), 0, "neutral", _n("", n, " CTA link(s) found")))
    sheet.choose(
        (n <= 3, 15, "good", "Good number of CTAs"),
        (n <= 5, 10, None, None),
        (F.lit(True), 3, "bad", _n("Many CTAs (", n, ") — may dilute focus")),
    )
    sheet.choose(
        (F.size(m["verbs"]) > 0, 10, "good", F.concat(F.lit("Action verbs: "), F.array_join(F.slice(F.array_distinct(m["verbs"]), 1, 3), ", "))),
        (F.lit(True), 0, "bad", "No strong action verbs in CTAs"),
    )
    sheet.choose((m["button"], 10, "good", "Styled button CTA detected"), (F.lit(True), 0, "bad", "Text-only CTAs — consider styled buttons"))
    sheet.choose(((m["place"] > 0) & (m["place"] < m["html_length"] * 0.3), 5, "good", "CTA placed above the fold"))
    return sheet.filled(n == 0, 30, "No CTA links found")


def design_measures(images="images", text="copy_text", viewport="has_viewport", dark="has_dark_mode", html="html") -> dict:
    images = _array(images, "array<struct<src:string,alt:string>>")
    html = F.lower(F.coalesce(_c(html), F.lit("")))
    return {
        "images": F.size(images), "words": _word_count(F.coalesce(_c(text), F.lit(""))),
        "bare": F.size(F.filter(images, lambda i: F.regexp_replace(i["alt"], r"(?U)\s", "") == "")),
        "viewport": F.coalesce(_c(viewport), F.lit(False)), "dark": F.coalesce(_c(dark), F.lit(False)),
        "layout": contains_any(html, ["<table", "display:flex", "display: flex"]),
        "inline": F.regexp_count(html, F.lit('style="')),
    }


def design_sheet(m) -> tuple[Column, Column, Column]:
    n, bare = m["images"], m["bare"]
    per_word = ratio(n, m["words"]) * 100
    some = n > 0
    sheet = _Sheet("design")
    sheet.choose((some, 10, "good", _n("", n, " image(s) found")), (F.lit(True), 0, "bad", "No images — consider adding visuals"))
    sheet.choose(
        (some & (bare == 0), 8, "good", "All images have alt text"),
        (some & (bare < n), 3, "bad", _n("", bare, " image(s) missing alt text")),
        (some, 0, "bad", "No images have alt text — accessibility issue"),
    )
    sheet.choose(
        (some & (per_word < 5), 5, "good", "Good image-to-text ratio"),
        (some & (per_word > 20), 0, "bad", "Heavy on images vs text — may affect deliverability"),
    )
    sheet.choose((m["viewport"], 10, "good", "Has viewport meta tag (responsive)"), (F.lit(True), 0, "bad", "No viewport meta tag — may not render well on mobile"))
    sheet.choose((m["dark"], 8, "good", "Dark mode support detected"), (F.lit(True), 0, "bad", "No dark mode styles found"))
    sheet.choose((m["layout"], 5, "good", "Structured layout detected"))
    sheet.choose((m["inline"] > 5, 3, "good", "Uses inline styles (email-safe)"))
    return sheet.filled()


def strategy_measures(kind="type", industry="industry", received_at="received_at") -> dict:
    ts = _c(received_at)
    return {"kind": _c(kind), "industry": _c(industry), "day": F.weekday(ts), "hour": F.hour(ts)}


def strategy_sheet(m) -> tuple[Column, Column, Column]:
    kind, industry, day, hour = m["kind"], m["industry"], m["day"], m["hour"]
    name = F.get(F.array(*[F.lit(d) for d in DAY_NAMES]), day)
    sheet = _Sheet("strategy")
    sheet.choose((kind != "", 15, "neutral", F.concat(F.lit("Campaign type: "), kind)), (F.lit(True), 0, "bad", "No campaign type identified"))
    sheet.choose((industry != "", 10, "neutral", F.concat(F.lit("Industry: "), industry)), (F.lit(True), 0, "bad", "No industry classification"))
    sheet.choose(
        (day.between(1, 3), 10, "good", F.concat(F.lit("Sent on "), name, F.lit(" (optimal)"))),
        (day.isin(0, 4), 5, "neutral", F.concat(F.lit("Sent on "), name, F.lit(" (good)"))),
        (day >= 5, 0, "bad", F.concat(F.lit("Sent on "), name, F.lit(" (lower engagement typical)"))),
    )
    sheet.choose(
        (hour.between(9, 11), 8, "good", _n("Sent at ", hour, ":00 (morning peak)")),
        (hour.between(13, 15), 6, "good", _n("Sent at ", hour, ":00 (afternoon peak)")),
        (hour.between(6, 20), 3, "neutral", _n("Sent at ", hour, ":00 (business hours)")),
        (hour.isNotNull(), 0, "bad", _n("Sent at ", hour, ":00 (off-peak)")),
    )
    return sheet.filled()


MAIL_DIMENSIONS = {"subject": subject_measures, "strategy": strategy_measures}
HTML_DIMENSIONS = {"copy": copy_measures, "cta": cta_measures, "design": design_measures}
SHEETS = {"subject": subject_sheet, "copy": copy_sheet, "cta": cta_sheet, "design": design_sheet, "strategy": strategy_sheet}


def overall_score(scores: dict) -> Column:
    """Weighted total of the five dimension scores, rounded half to even."""
    terms = [_c(scores[d]) * w / 100 for d, w in WEIGHTS.items()]
    return F.bround(reduce(add, terms), 0).cast("int")


def html_measures(features: DataFrame, key) -> DataFrame:
    """Narrow per-mail measures (key, ``_copy_…``, ``_cta_…``, ``_design_…``) of parsed HTML.

    ``features`` carries html and the ``structure`` part of ``html.html_features``. The result
    is what joins with the mails, so the HTML itself is never shuffled.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = {f"_{d}_{k}": c for d, measures in HTML_DIMENSIONS.items() for k, c in measures().items()}
    return features.select(*keys, *[c.alias(n) for n, c in cols.items()])


def score_pages(measures: DataFrame) -> DataFrame:
    """``html_measures`` with what follows from a page alone, so that it is not done again for every mail that joins it:
    the scores of links and design (``cta_score``, ``design_score``). The copy is left to the mails, whose preview counts."""
    return score_dimensions(measures, ["cta", "design"], keep=["copy"])


def score_dimensions(df: DataFrame, dimensions=tuple(WEIGHTS), keep=()) -> DataFrame:
    """Adds ``<dimension>_score`` structs (score, grade, findings, advice: the suggestions of every bad finding).

    The HTML dimensions need the columns of ``html_measures``; the measures of those in ``keep`` stay. Three projections: measures,
    scores over measures, grades over scores. Every expensive value is referenced several
    times by the next step, so Catalyst keeps the steps apart and evaluates it once.
    """
    measured = {f"_{d}_{k}": c for d, m in MAIL_DIMENSIONS.items() if d in dimensions for k, c in m().items()}
    if "copy" in dimensions:
        measured["_copy_preview"] = preview_measure() if "preview" in df.columns else F.lit(False)
    out = df.withColumns(measured)
    names = [c for c in df.columns if not c.startswith(tuple(f"_{d}_" for d in SHEETS if d not in keep))]
    scored = {}
    for d in dimensions:
        prefix = f"_{d}_"
        m = {c[len(prefix):]: F.col(c) for c in out.columns if c.startswith(prefix)}
        scored[f"_{d}_points"], scored[f"_{d}_notes"], scored[f"_{d}_advice"] = SHEETS[d](m)
    out = out.select(*names, *[c.alias(n) for n, c in scored.items()])
    return out.select(*names, *[
        F.struct(F.col(f"_{d}_points").alias("score"), calculate_grade(f"_{d}_points").alias("grade"), F.col(f"_{d}_notes").alias("findings"),
                 F.col(f"_{d}_advice").alias("advice")).alias(f"{d}_score")
        for d in dimensions])


def score_emails(df: DataFrame) -> DataFrame:
    """Adds the dimension structs that ``df`` has not yet (see ``html_measures`` and ``score_pages``), overall_score and overall_grade."""
    out = score_dimensions(df, [d for d in WEIGHTS if f"{d}_score" not in df.columns])
    total = overall_score({d: F.col(f"{d}_score.score") for d in WEIGHTS})
    return out.withColumn("overall_score", total).withColumn("overall_grade", calculate_grade("overall_score"))


def suggestion_table(spark) -> DataFrame:
    rows = [(n, d, trigger, text) for n, (d, trigger, text) in enumerate(SUGGESTIONS)]
    return local_table(spark, rows, "pos int, dimension string, trigger string, suggestion string")


def suggestions(scored: DataFrame, key: str = "id") -> DataFrame:
    """Up to four distinct suggestions per mail, weakest dimension first.

    Every bad finding of a weak dimension takes the first of its ``advice`` (found from the texts where the structs have none)
    that has not been given yet.
    """
    def advice(d):
        if "advice" in scored.schema[f"{d}_score"].dataType.names:
            return F.col(f"{d}_score.advice")
        return F.transform(F.filter(F.col(f"{d}_score.findings"), lambda f: f["type"] == "bad"), lambda f: _fitting(d, f["text"]))

    dims = F.array(*[
        F.struct(F.col(f"{d}_score.score").alias("score"), F.lit(n).alias("pos"),
                 F.when(F.col(f"{d}_score.score") < STRONG, advice(d)).otherwise(_none("array<string>")).alias("advice"))
        for n, d in enumerate(WEIGHTS)])
    per_finding = F.flatten(F.transform(F.sort_array(dims), lambda d: d["advice"]))  # array<array<suggestion>>

    def take(acc, texts):
        fresh = F.array_except(texts, acc)
        return F.when((F.size(acc) < MAX_SUGGESTIONS) & (F.size(fresh) > 0), F.concat(acc, F.slice(fresh, 1, 1))).otherwise(acc)

    picked = F.aggregate(per_finding, _none("string"), take)
    return scored.select(key, F.posexplode(picked).alias("pos", "suggestion")).withColumn("pos", F.col("pos") + 1)


def teaser(scored: DataFrame, level: Column) -> DataFrame:
    """Dimension scores only for callers with the full analysis; the overall score for all."""
    full = F.coalesce(level == "full", F.lit(False))
    cols = {f"{d}_score": F.when(full, F.col(f"{d}_score.score")) for d in WEIGHTS}
    return scored.withColumns(cols)


def score_rollup(scored: DataFrame, by) -> DataFrame:
    """Per group: mails, average overall score, grade counts."""
    by = [by] if isinstance(by, str) else list(by)
    grades = [g for _, g in GRADES] + ["F"]
    tally = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("emails"), F.bround(F.avg("overall_score"), 1).alias("avg_score"),
        *[F.count_if(F.col("overall_grade") == g).alias(f"grade_{n}") for n, g in enumerate(grades)])
    pairs = F.array(*[F.struct(F.lit(g).alias("grade"), F.col(f"grade_{n}").alias("cnt")) for n, g in enumerate(grades)])
    return tally.withColumn("grades", F.filter(pairs, lambda p: p["cnt"] > 0)).drop(*[f"grade_{n}" for n in range(len(grades))])
