"""Merged sketches against exact distinct counts."""

import pytest
from pyspark.sql import functions as F

from mailprism.operators import sketches


@pytest.mark.parametrize("days", [1, 7, 40])
def test_windows_from_cells(spark, days):
    rows = spark.range(60_000).select((F.col("id") * 7919 % 41_000).alias("user"), F.when(F.col("id") % 9 != 0, F.col("id") % 17).alias("brand"), (F.col("id") % 3).alias("kind"),
                                      F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("received_at"))
    t = "2023-12-10 12:00:00"
    cells = sketches.distinct_cells(rows, ["user", "brand"], ["kind"]).cache()
    got = sketches.window_totals(cells, ["user", "brand"], t, days).first()
    inside = rows.where((F.col("received_at") < "2023-12-10") & (F.col("received_at") >= F.date_sub(F.lit("2023-12-10").cast("date"), days)))
    want = inside.agg(F.count(F.lit(1)), F.count_distinct("user"), F.count_distinct("brand")).first()
    assert got["emails"] == want[0] and got["brand"] == want[2]
    assert abs(got["user"] - want[1]) <= 0.03 * want[1]
    per_kind = {r["kind"]: r["brand"] for r in sketches.window_totals(cells, ["user", "brand"], t, days, "kind").collect()}
    assert per_kind == {r["kind"]: r["n"] for r in inside.groupBy("kind").agg(F.count_distinct("brand").alias("n")).collect()}
    month = sketches.estimates(sketches.merge_cells(cells, ["user", "brand"], F.trunc("day", "month").alias("month")), ["user", "brand"])
    exact = {r["m"]: r["n"] for r in rows.groupBy(F.trunc("received_at", "month").alias("m")).agg(F.count_distinct("user").alias("n")).collect()}
    assert all(abs(r["user"] - exact[r["month"]]) <= 0.03 * exact[r["month"]] for r in month.collect())


def test_no_rows(spark):
    none = spark.range(0).select("id", F.lit(None).cast("timestamp").alias("received_at"))
    assert [tuple(r) for r in sketches.window_totals(sketches.distinct_cells(none, ["id"]), ["id"], "2024-01-01", 7).collect()] == [(None, 0)]
