"""Many keywords against many texts: an equi join on grams instead of one expression per keyword.

Every keyword is filed under one of its grams, the one that fewest keywords have. Its grams have the largest number of
characters out of ``SIZES`` that fits in it, so that longer tables with longer keywords have more grams and not more keywords
per gram. A text is expanded to its distinct grams of the sizes in use. Those that a Bloom filter over the filed grams rules out
go no further; the others meet the keywords filed there, and the pairs that come out are compared in full. The plan is the same
for ten keywords and for ten million, nothing is collected, and the keywords are broadcast only where Spark knows them to be
small; the filter (``BITS`` per gram, see ``keyed``) is always.

Equal texts are looked at once: the result belongs to ``text_id``, a hash of the texts, and goes back to the rows by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.sources.keyed import bucket_of, filters_of, may_hold

SIZES = (1, 2, 3, 4, 8, 16)  # characters of a gram
FILTERS = 256  # parts of the Bloom filter


def text_id(*texts: Column) -> Column:
    """First 16 bytes of the SHA-256 over the lengths and characters of the texts."""
    parts = [x for t in texts for x in (F.length(t).cast("string"), t)]
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", *parts), 256)), 1, 16)


def gram_size(text: Column) -> Column:
    """Characters of the grams of a keyword: the largest of ``SIZES`` that fits (those under four fit exactly)."""
    out = F.lit(SIZES[0])
    for n in SIZES[1:]:
        out = F.when(F.length(text) >= n, n).otherwise(out)
    return out


def grams(text: Column, sizes: Column) -> Column:
    """Distinct substrings of the given sizes (an array)."""
    none = F.array().cast("array<string>")

    def of(size: Column) -> Column:
        last = F.length(text) - (size - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda at: F.substr(text, at, size))).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def filed(keywords: DataFrame) -> DataFrame:
    """``keywords`` with the gram that each is filed under; empty and null ones are none. The text of a keyword is looked at once,
    however often it stands in the table."""
    once = keywords.where(F.length("keyword") > 0).select("keyword").distinct()
    spread = once.select("keyword", F.explode(grams(F.col("keyword"), F.array(gram_size(F.col("keyword"))))).alias("gram"))
    shared = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = spread.join(shared, "gram").groupBy("keyword").agg(F.min(F.struct("n", "gram")).alias("m"))
    return keywords.join(rarest.select("keyword", F.col("m.gram").alias("gram")), "keyword")


def in_use(spread: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``spread`` whose gram may be one that ``table`` files a keyword under."""
    used = table.select("gram").distinct().select(bucket_of("gram", FILTERS).alias("bucket"), F.col("gram").alias("key"))
    marked = spread.withColumn("bucket", bucket_of("gram", FILTERS)).join(F.broadcast(filters_of(used)), "bucket")
    return marked.where(may_hold("gram")).select(*spread.columns)


def with_text_id(df: DataFrame, texts: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_text_id``, and the distinct texts (``_text_id`` and the named texts)."""
    held = df.withColumns(texts)
    held = held.withColumn("_text_id", text_id(*[F.col(c) for c in texts]))
    distinct = held.groupBy("_text_id").agg(*[F.first(c).alias(c) for c in texts])
    return held.drop(*texts), distinct


def hits(distinct: DataFrame, keywords: DataFrame, names: list[str], within: list[str] | None = None) -> DataFrame:
    """One row per text and row of ``keywords`` (with a column ``keyword``) that occurs in one of the texts ``names``:
    ``_text_id``, the columns of ``keywords`` and a boolean ``in<name>`` per text. ``within``: those of the texts that hold the others."""
    over = within or names
    whole = F.col(over[0]) if len(over) == 1 else F.concat_ws("\n", *over)
    table = filed(keywords)
    sizes = keywords.where(F.length("keyword") > 0).agg(F.sort_array(F.collect_set(gram_size(F.col("keyword"))))).scalar()
    # columns first, so that nothing is put together anew for every gram
    held = distinct.select("_text_id", whole.alias("_whole"), sizes.alias("_sizes"))
    spread = held.select("_text_id", F.explode(grams(F.col("_whole"), F.col("_sizes"))).alias("gram"))
    met = in_use(spread, table).join(table, "gram").drop("gram")
    found = met.join(distinct, "_text_id")
    inside = {f"in{c}": F.contains(F.col(c), F.col("keyword")) for c in names}
    found = found.select("_text_id", *keywords.columns, *[x.alias(c) for c, x in inside.items()])
    return found.where(" OR ".join(inside))
