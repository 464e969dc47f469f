"""Column functions on hand-made edge values."""

import re

import pytest
from pyspark.sql import functions as F

from mailprism.functions import brands, scalars, subjects
from mailprism.functions.answers import answer_fields
from mailprism.plans.fixtures import AS_OF


@pytest.fixture(scope="module")
def values(table):
    def run(rows, schema, *cols):
        return [tuple(r) for r in table([(n, *row) for n, row in enumerate(rows)], "k long, " + schema).orderBy("k").select(*cols).collect()]

    return run


def one(values, texts, fn):
    return [r[0] for r in values([(t,) for t in texts], "s string", fn(F.col("s")))]


def test_pct_and_change(values):
    assert values([(5, 0), (0, 0), (3, 4), (0, 3)], "a long, b long", scalars.pct_change("a", "b"), scalars.pct("a", "b")) == [
        (100.0, 0.0), (0.0, 0.0), (-25.0, 75.0), (-100.0, 0.0)]


def test_rounding_equals_python(spark):
    pairs = [(a, b) for a in range(1, 120) for b in range(1, 120)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", scalars.pct("a", "b").alias("p"))
    assert all(r["p"] == round(r["a"] / r["b"] * 100, 1) for r in df.collect())


def test_weeks(values):
    ts = F.col("s").cast("timestamp")
    got = values([("2027-01-01 00:00:00",), ("2024-01-29 00:00:00",), ("2024-01-28 23:59:59",)], "s string", scalars.week_label(ts), scalars.week_start(ts).cast("string"))
    assert got == [("2026-W53", "2026-12-28 00:00:00"), ("2024-W05", "2024-01-29 00:00:00"), ("2024-W04", "2024-01-22 00:00:00")]


def test_floor_days_counts_whole_days(values):
    got = values([("2024-01-01 23:00:00", "2024-01-02 01:00:00"), ("2024-01-02 00:00:00", "2024-01-01 23:00:00"), ("2024-01-01 00:00:00", "2024-01-09 00:00:00")],
                 "a string, b string", scalars.floor_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")))
    assert got == [(0,), (-1,), (8,)]


def test_send_frequency(values):
    rows = [(30, 10), (3, 14), (2, 60), (1, 0)]
    last = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("d") * 86_400)
    got = values(rows, "n long, d long", scalars.send_frequency_label("n", F.timestamp_seconds(F.lit(1_700_000_000)), last))
    assert [g[0] for g in got] == ["3x/day", "2x/week", "1x/month", "1x"]


def test_registrable_domain(values):
    got = one(values, ["Kiehl's <kiehls@e.kiehls.co.uk>", "hello@mail.nykaa.com", "pets@supertails.co.in", "noreply@zomato.com", "nobody", None], scalars.registrable_domain)
    assert got == ["kiehls.co.uk", "nykaa.com", "supertails.co.in", "zomato.com", None, None]


def test_title_case_equals_python(values):
    texts = ["levi's net-a-porter", "o'neill 3rd x2y", "ÉCOLE d'été", "", "a--b"]
    assert one(values, texts, scalars.title_case) == [t.title() for t in texts]


def test_safe_filename(values):
    texts = ["The Summer Sale is Almost Here!", "--A--", "x" * 59 + " y z", "100% ₹ off"]
    want = [re.sub(r"[^a-z0-9]+", "-", t.lower())[:60].strip("-") for t in texts]
    assert one(values, texts, scalars.safe_filename) == want


def test_base64url(values):
    import base64

    text = "<p>ü🔥??>>~~</p>"
    data = base64.urlsafe_b64encode(text.encode()).decode()
    bad = base64.urlsafe_b64encode(b"ab\xffcd").decode()
    assert one(values, [data, data.rstrip("="), bad], scalars.base64url_text) == [text, text, "abcd"]


def test_split_and_cut(values):
    assert one(values, ["a --- b\n---\n---c"], scalars.split_parts) == [["a", "b", "c"]]
    assert one(values, ["x" * 255, "x" * 256], scalars.ellipsize) == ["x" * 255, "x" * 254 + "…"]


def test_substring_keywords(values):
    assert one(values, ["Coffee for your morning", "Hello"], subjects.is_discount) == [True, False]
    assert one(values, ["Know before you go"], lambda c: subjects.is_urgent(c, "rates")) == [True]


def test_emoji_profiles(values):
    texts = ["新商品のお知らせ", "Sale 🔥 today only", "Ready for summer?"]
    assert one(values, texts, lambda c: subjects.has_emoji(c, "insights")) == [True, True, False]
    assert one(values, texts, lambda c: subjects.has_emoji(c, "scoring")) == [False, True, False]
    assert one(values, texts, lambda c: subjects.has_emoji(c, "plane")) == [False, False, False]


FORMULA_CASES = {
    "Flat 30% off - hurry, sale ends tonight!": "discount_led", "Last chance: final hours": "urgency", "12 ways to style denim": "number_list",
    "Your picks are waiting for you": "personalization", "Something big is coming soon": "curiosity_teaser", "Bestsellers everyone loves": "social_proof",
    "Ready for summer?": "question", "Shop the new collection": "command", "Welcome to the family": "other", "Hotel deals and flight offers for your trip": "personalization",
}


def test_formula_cases(values):
    assert one(values, list(FORMULA_CASES), subjects.subject_formula) == list(FORMULA_CASES.values())


def test_formula_and_tactic_against_loops(spark, emails):
    def formula(s):
        return next((n for n, rx in subjects.FORMULAS if re.search(rx, s, re.I)), "other")

    def tactic(s):
        for label, parts in subjects.TACTICS:
            if ("?" in s) if parts is None else any(p in s.lower() for p in parts):
                return label
        return subjects.NO_TACTIC

    rows = emails.select("subject", subjects.subject_formula("subject").alias("f"), subjects.tactic("subject").alias("t"), F.size(subjects.words_of("subject")).alias("n")).distinct().collect()
    assert len(rows) > 30
    for r in rows:
        assert (r["f"], r["t"], r["n"]) == (formula(r["subject"]), tactic(r["subject"]), len(r["subject"].split()))


def test_keywords_keep_first_order(values):
    assert one(values, ["Why do my Email campaigns beat email LISTS and ads, campaigns?"], subjects.keywords) == [["email", "campaigns", "beat", "lists", "ads"]]


def test_normalize_brand(values):
    texts = ["Caratlane - A Tata Product", "Anthropologie Sale", "Maeve By Anthropologie", "Supertails+ Clinic", "Net-A-Porter Rewards", None]
    assert one(values, texts, brands.normalize_brand) == ["caratlane", "anthropologie", "maeve", "supertails", "net-a-porter", ""]


def test_clean_brand(values):
    texts = ["Nykaa Newsletter", "The Sleep Company Team", "Hello Sugar Pvt. Ltd.", "!!", "info", "  'Levi's' "]
    assert one(values, texts, brands.clean_brand) == ["Nykaa", "Sleep Company", "Sugar", None, None, "Levi'S"]


def test_lenient_answers(values):
    texts = ['{"subject":"a","preview_text":"p","html":"<b>"}', 'Sure: {"subject":"b","preview_text":"p","html":"x"} ok',
             'no {"subject": "c", "html": "<p class=\\"k\\">t</p>", oops', "nothing"]
    got = one(values, texts, answer_fields)
    assert [g["subject"] if g else None for g in got] == ["a", "b", "c", None]
    assert got[2]["html"] == '<p class="k">t</p>'


def test_window_labels(values):
    assert [r[0] for r in values([(0,), (7,), (8,), (90,), (91,)], "d long", scalars.window_label("d"))] == [
        "today", "this week", "this month", "in the last 3 months", "across our archive"]
    assert AS_OF.startswith("2024-01-30")


def test_template_blocks_come_a_few_pages_at_a_time(spark):
    import pandas as pd
    from mailprism.operators import html

    pages = pd.Series(["<h1>Big news</h1>", None] * 100)
    made = list(html._block_udf().func(iter([pages])))
    assert max(map(len, made)) <= html.ROWS and sum(map(len, made)) == len(pages)
    assert [len(x) for x in pd.concat(made)] == [1, 0] * 100
