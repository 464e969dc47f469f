"""Counting, top-k, modal value, share, sampling and diversity helpers.

``row_number() <= n`` filters run with Spark's partial group limit before the
shuffle, so a hot group sends at most n rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism.functions.subjects import subject_words

def newest_first() -> list:
    """Order: newest mail first, unknown times last, then by id."""
    return [F.desc_nulls_last("received_at"), F.asc("id")]


def _cols(by) -> list:
    return [] if by is None else [by] if isinstance(by, (str, Column)) else list(by)


def known_brand(col: str = "brand") -> Column:
    """Brand present and not the placeholder."""
    return F.col(col).isNotNull() & (F.col(col) != "Unknown")


def has_brand(col: str = "brand") -> Column:
    """Brand present, placeholder included (used by the archive statistics)."""
    return F.col(col).isNotNull()


def in_months(df: DataFrame, low: Column, high: Column | None = None) -> DataFrame:
    """Only the months from ``low`` to ``high`` of a table that is partitioned by month (``sources.mail.write_emails``)."""
    if "month" not in df.columns:
        return df
    df = df.where(F.col("month") >= F.date_format(low, "yyyy-MM"))
    return df if high is None else df.where(F.col("month") <= F.date_format(high, "yyyy-MM"))


def present(col) -> Column:
    """The value, null when empty."""
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(""))


def computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """``withColumns`` behind a one-row generator.

    Filters and projections above cannot be substituted into the expressions, so an expensive
    column is evaluated once per row however often it is used later.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def top_n_per(df: DataFrame, by, order, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of every group with their rank; ``by`` empty means the whole frame."""
    by = _cols(by)
    if not by:
        head = df.orderBy(*order).limit(n)  # TakeOrderedAndProject: n rows per task
        return head.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def latest_per(df: DataFrame, key, order=None) -> DataFrame:
    """Newest row of every key."""
    return top_n_per(df, key, order or newest_first(), 1, "_rank").drop("_rank")


def counts(df: DataFrame, by, name: str = "cnt") -> DataFrame:
    return df.groupBy(*_cols(by)).agg(F.count(F.lit(1)).alias(name))


def tally_cells(cells: DataFrame, col: str, by=(), weight: str = "cnt") -> DataFrame:
    """(by…, item, cnt) of one column of pre-aggregated cells, nulls left out.

    The null test is on an aggregate result, so it is not pushed below the cells: every tally
    of the same cells shares one scan and one exchange.
    """
    out = cells.groupBy(*by, col).agg(F.max(col).alias("item"), F.sum(weight).alias("cnt"))
    return out.where(F.col("item").isNotNull()).select(*by, "item", "cnt")


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """Most common values, ties by value."""
    return counts(df.where(F.col(col).isNotNull()), col).orderBy(F.desc("cnt"), col).limit(k)


def modal(df: DataFrame, key, col: str, name: str | None = None) -> DataFrame:
    """Most common value of ``col`` per key, ties by value."""
    keys = _cols(key)
    tally = counts(df.where(present(col).isNotNull()), keys + [col])
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col(col).alias("value")))
    return tally.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.value").alias(name or col))


def share(df: DataFrame, col: str, total: Column | None = None) -> DataFrame:
    """Counts of ``col`` with their percentage of all rows."""
    everything = total if total is not None else df.agg(F.count(F.lit(1))).scalar()
    tally = counts(df.where(F.col(col).isNotNull()), col)
    return tally.withColumn("pct", F.bround(F.col("cnt").cast("double") / everything * 100, 1))


def page(df: DataFrame, skip: int = 0, limit: int | None = None, order=None) -> DataFrame:
    """Rows ``skip``.. in order, with the total number of rows as ``total``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    out = df.orderBy(*(order or newest_first()))
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.withColumn("total", total)


def hash_sample(df: DataFrame, n: int, seed: str = "0", by=None, key: str = "id") -> DataFrame:
    """``n`` rows (per group) in the order of a seeded hash: repeatable on any layout."""
    order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)]
    return top_n_per(df, by, order, n, "sample_no")


def top_words(df: DataFrame, by=None, k: int = 10) -> DataFrame:
    """Most common subject words (stop words removed) per group."""
    by = _cols(by)
    words = df.where(F.col("subject").isNotNull()).select(*by, F.explode(subject_words("subject")).alias("word"))
    return top_n_per(counts(words, by + ["word"]), by, [F.desc("cnt"), F.asc("word")], k)


def newest_subjects(df: DataFrame, by, n: int = 5) -> DataFrame:
    """Newest ``n`` distinct subjects per group."""
    by = _cols(by)
    seen = df.where(present("subject").isNotNull()).groupBy(*by, "subject").agg(F.max("received_at").alias("received_at"))
    return top_n_per(seen, by, [F.desc_nulls_last("received_at"), F.asc("subject")], n)


def diverse_examples(df: DataFrame, by=None, per: int = 2, n: int = 15, brand: str = "brand") -> DataFrame:
    """Newest ``n`` rows per group with at most ``per`` of one brand (null is one brand)."""
    by = _cols(by)
    capped = top_n_per(df, by + [brand], newest_first(), per, "_of_brand").drop("_of_brand")
    return top_n_per(capped, by, newest_first(), n)
