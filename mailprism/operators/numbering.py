"""Running numbers over a sorted table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailprism.session import scratch_path

INDEX_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def numbered(df: DataFrame, *order: str, name: str = "number", ranges: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, … in the order of the columns ``order``.

    Rows are spread by ranges whose bounds Spark samples from the data, so clustered values lie in as many ranges as spread
    ones. Each row knows its range and its place there; a prefix sum over one count per range gives the rest. The
    placed rows are written below the checkpoint folder, so that a repeated task cannot place them anew.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    path = scratch_path(spark, "numbered")
    placed.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(df.schema.add("_at", "long")).parquet(path)
    place = {"_range": F.shiftright("_at", INDEX_BITS), "_at": F.col("_at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))}
    rows = rows.withColumns(place)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(shift, "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")
