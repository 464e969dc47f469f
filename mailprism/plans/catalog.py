"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailprism import dims
from mailprism.plans import fixtures
from mailprism.plans.fixtures import AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS: dict[tuple, DataFrame] = {}


class Inputs:
    """Lazy input frames of one query run."""

    t = AS_OF

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def view(self, name: str) -> DataFrame:
        """A derived view; its (lazy) plan is built once per session and folder."""
        key = (self.spark.sparkContext.applicationId, id(self.spark), self.sf_dir, name)
        if key not in _VIEWS:
            _VIEWS[key] = fixtures.view(self.spark, self.sf_dir, name)
        return _VIEWS[key]

    def table(self, name: str) -> DataFrame:
        return fixtures.load(self.spark, self.sf_dir, name)

    @property
    def emails(self) -> DataFrame:
        return self.view("emails")

    def spread(self, df: DataFrame, source: str) -> DataFrame:
        """For work that is heavy per row: rows spread by key, whatever the layout of the files."""
        return df.repartition(self.spark.sparkContext.defaultParallelism, source)

    @property
    def mails(self) -> DataFrame:
        """The e-mails for operators that are heavy per row."""
        return self.spread(self.emails, "id")

    @property
    def html(self) -> DataFrame:
        return self.spread(self.view("email_html"), "page_id")

    @property
    def rules(self) -> dims.Rules:
        return dims.Rules()

    @property
    def festivals(self) -> DataFrame:
        return dims.festival_table(self.spark, TEST_FESTIVALS)

    @property
    def slugs(self) -> DataFrame:
        return dims.type_slug_table(self.spark)

    @property
    def limits(self) -> DataFrame:
        return dims.plan_limits_table(self.spark)


# Two real festivals inside the events' month and one narrow range for the thin-range rule.
TEST_FESTIVALS = [
    *[f for f in dims.FESTIVALS if f[0] in ("republic-day-sale", "new-year")],
    ("sparse", "Sparse", ["sparse"], {2024: ("2024-01-10 00:00:00", "2024-01-10 00:05:00")}),
]


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs)`` under a name, with the SQL that must give the same rows."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            joined = "," + text[4:] if text[:4].upper() == "WITH" else text
            ORACLES[name] = fixtures.PREFIX.rstrip() + ("" if joined.startswith(",") else "\n") + joined
        return fn

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from mailprism.plans import catalog_accounts, catalog_insights, catalog_mail, catalog_profiles, catalog_rules  # noqa: F401
