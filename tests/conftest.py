import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"
AS_OF = "2024-01-30 00:00:00"


@pytest.fixture(scope="session")
def spark():
    from mailprism.session import build_session

    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def emails(spark):
    from mailprism.plans import fixtures

    return fixtures.emails(spark, SMALL)


@pytest.fixture(scope="session")
def table(spark):
    from mailprism.session import local_table

    return lambda rows, schema: local_table(spark, rows, schema)


def mail_rows(items):
    """(brand, 'YYYY-MM-DD HH:MM:SS', subject) → id, brand, subject, received_at text."""
    return [(n, b, s, t) for n, (b, t, s) in enumerate(items)]


@pytest.fixture(scope="session")
def mails(table):
    from pyspark.sql import functions as F

    def make(items):
        raw = table(mail_rows(items), "id long, brand string, subject string, received_at string")
        return raw.withColumn("received_at", F.col("received_at").cast("timestamp"))

    return make
