"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Three masks over a window of 12 tokens keep two runs of three tokens and ignore the rest:
``111111``, ``111...111`` and ``111......111``. Cut a window into four runs of three: two substitutions
leave two runs whole, whichever they hit, and some mask at some place keeps just these. So no window with at
most two substituted tokens can be missed; what the masks find by chance goes in the check afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import Scratch, fresh, spark_of

GAPS = (3, 6, 9)  # from the first kept run of three tokens to the second
WINDOW = 12
SUBSTITUTED = 2
MASKED = 6  # tokens of an item that a mask can cover; shorter items are sought whole
TELLING = 3  # tokens of an item whose occurrence makes a document go
BROADCAST_ROWS = 400_000  # seeds of 24 bytes that every executor may hold


# Scripts without spaces between words: each of their characters is a token.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def words(text: str) -> Column:
    """Runs of letters and digits, lower-cased, and single characters of scripts without spaces; null and empty texts have none."""
    apart = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "([" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "])", " $1 ")
    return F.array_remove(F.split(apart, r"[^\p{L}\p{N}]+"), "")


def whole(tokens: Column) -> Column:
    """Hash of all tokens of a list."""
    return F.xxhash64(F.size(tokens), tokens)


def seeds(df: DataFrame, tokens: str, keep: list[str]) -> DataFrame:
    """Per token position and mask the hash of the tokens that the mask keeps: ``keep``, at, seed."""
    t = F.col(tokens)
    runs = F.transform(t, lambda x, i: F.xxhash64(x, F.get(t, i + 1), F.get(t, i + 2)))
    hashed = df.withColumn("runs", F.slice(runs, 1, F.greatest(F.size(t) - 2, F.lit(0))))
    zipped = F.arrays_zip(F.col("runs").alias("r0"), *(F.slice("runs", gap + 1, F.size("runs")).alias(f"r{gap}") for gap in GAPS))
    placed = hashed.select(*keep, F.posexplode(zipped).alias("at", "r"))
    masked = F.array(*(F.when(F.col(f"r.r{gap}").isNotNull(), F.xxhash64(F.lit(gap), "r.r0", f"r.r{gap}")) for gap in GAPS))
    return placed.select(*keep, "at", F.explode(masked).alias("seed")).where("seed IS NOT NULL")


def stretches(df: DataFrame, tokens: str, keep: list[str], sizes: list[int]) -> DataFrame:
    """Per token position and size the hash of as many tokens: ``keep``, at, seed."""
    t = F.col(tokens)
    place = lambda n: lambda x, i: F.when(i + n <= F.size(t), F.struct(i.alias("at"), whole(F.slice(t, i + 1, n)).alias("seed")))
    hashed = [F.transform(t, place(n)) for n in sizes]
    return df.select(*keep, F.explode(F.concat(*hashed)).alias("s")).where("s IS NOT NULL").select(*keep, "s.at", "s.seed")


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
             item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents that hold a passage of a benchmark item with at most two substituted tokens in twelve.

    One row per document and item: ``doc_id``, ``text_id`` (hash of the document's text), ``item_id``, ``item_copies`` (items of equal tokens: the smallest
    id stands for all), ``item_tokens``, ``doc_start`` (token of the document that lies on the item's first,
    below zero if the document begins inside the item), ``overlap`` (tokens compared), ``matching`` (equal ones),
    ``best_window`` (most equal tokens in twelve in a row). Items of fewer than 12 tokens have to occur whole and
    unchanged; those of fewer than 6, which no mask covers, are sought by a hash of all their tokens. Null and empty texts give no
    rows, nor do empty tables; rows that repeat a key and a text are one document; a null key is a key like any other. Other
    columns are not looked at.

    The training side is never shuffled for the search while the seeds are few (counted, at most
    ``broadcast_rows``); beyond that both sides are shuffled by seed. Hits are reduced to alignments
    before they move.
    """
    scratch = Scratch(spark_of(docs), "decontamination")
    bench = (items.select(F.col(item_key).alias("item_id"), words(item_text).alias("item_words"))
             .where(F.size("item_words") > 0)
             .groupBy("item_words").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("item_copies")))
    bench = scratch.save(bench)
    sizes = [r[0] for r in bench.where(F.size("item_words") < MASKED).select(F.size("item_words")).distinct().collect()]  # five numbers at most
    sought = seeds(bench, "item_words", ["item_id"])
    if sizes:
        sought = sought.unionByName(bench.where(F.size("item_words") < MASKED).select("item_id", F.lit(0).alias("at"), whole(F.col("item_words")).alias("seed")))
    sought = scratch.save(sought.withColumnRenamed("at", "item_at"))
    if sought.count() <= broadcast_rows:
        sought = F.broadcast(sought)
    own = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_id"), F.col(text).alias("text"))
    cut = own.select("doc_id", "text_id", words("text").alias("doc_words"))
    placed = seeds(cut, "doc_words", ["doc_id", "text_id"])
    if sizes:
        placed = placed.unionByName(stretches(cut, "doc_words", ["doc_id", "text_id"], sorted(sizes)))
    hits = placed.join(sought, "seed").select("doc_id", "text_id", "item_id", (F.col("at") - F.col("item_at")).alias("doc_start"))
    hits = scratch.save(hits.distinct())

    texts = own.where("text IS NOT NULL").alias("d")
    found = texts.join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_id") == F.col("h.text_id"))).select("h.*", words("d.text").alias("doc_words"))
    found = found.join(bench, F.col("h.item_id").eqNullSafe(bench["item_id"])).select(
        "doc_id", "text_id", "h.item_id", "doc_start", "doc_words", "item_words", "item_copies")
    found = found.withColumn("first", F.greatest(-F.col("doc_start"), F.lit(0))).withColumn(
        "overlap", F.least(F.size("item_words"), F.size("doc_words") - F.col("doc_start")) - F.col("first")).where("overlap > 0")
    same = F.zip_with(F.slice("item_words", F.col("first") + 1, F.col("overlap")),
                      F.slice("doc_words", F.col("first") + F.col("doc_start") + 1, F.col("overlap")), lambda a, b: (a == b).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.col("overlap") - WINDOW + 1, F.lit(1))),
                        lambda i: total(F.slice(F.col("same"), i, WINDOW)))
    scored = found.withColumn("same", same).select(
        "doc_id", "text_id", "item_id", "item_copies", F.size("item_words").alias("item_tokens"), "doc_start", "overlap",
        total(F.col("same")).alias("matching"), F.array_max(spans).alias("best_window"))
    enough = F.least(F.lit(WINDOW - SUBSTITUTED), F.greatest(F.col("item_tokens"), F.lit(0)))
    good = scored.where(F.when(F.col("item_tokens") >= WINDOW, (F.col("overlap") >= WINDOW) & (F.col("best_window") >= enough))
                        .otherwise(F.col("matching") == F.col("item_tokens")))
    best = F.max(F.struct("best_window", "matching", "overlap", (-F.col("doc_start")).alias("back"))).alias("m")
    return good.groupBy("doc_id", "text_id", "item_id", "item_copies", "item_tokens").agg(best).select(
        "doc_id", "text_id", "item_id", "item_copies", "item_tokens", (-F.col("m.back")).alias("doc_start"),
        F.col("m.overlap").alias("overlap"), F.col("m.matching").alias("matching"), F.col("m.best_window").alias("best_window"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without passages of a benchmark item, with their columns. Items of one or two tokens occur in any
    text and make no document go; ``overlaps`` reports them."""
    found = overlaps(docs, items, key, text).where(F.col("item_tokens") >= TELLING).select(F.col("doc_id").alias("key"), "text_id").distinct()
    marked = docs.withColumn(mark := fresh("text_id", docs), F.xxhash64(F.col(text)))
    kept = marked.join(found, marked[key].eqNullSafe(found["key"]) & (marked[mark] == found["text_id"]), "left_anti")
    return kept.select(*docs.columns)


_TOKENS = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([" + "".join(rf"\p{{{x}}}" for x in UNSPACED) + r"])', ' \1 ', 'g'), '[\p{L}\p{N}]+')"

ORACLE = r"""
WITH bench AS (
 SELECT words, min(item_id) AS item_id, count(*) AS item_copies
 FROM (SELECT item_id, <tokens> AS words FROM benchmark)
 WHERE len(words) > 0 GROUP BY words),
docs AS (SELECT doc_id, <tokens> AS words FROM documents),
short AS (SELECT DISTINCT len(words) AS size FROM bench WHERE len(words) < 6),
gaps(gap) AS (VALUES (3), (6), (9)),
sought AS (
 SELECT item_id, pos - 1 AS item_at, gap, array_to_string(words[pos:pos + 2] || words[pos + gap:pos + gap + 2], ' ') AS seed
 FROM (SELECT *, unnest(range(1, len(words) + 1)) AS pos FROM bench), gaps WHERE pos + gap + 2 <= len(words)
 UNION ALL SELECT item_id, 0, -len(words), array_to_string(words, ' ') FROM bench WHERE len(words) < 6),
placed AS (
 SELECT doc_id, pos - 1 AS pos, gap, array_to_string(words[pos:pos + 2] || words[pos + gap:pos + gap + 2], ' ') AS seed
 FROM (SELECT *, unnest(range(1, len(words) + 1)) AS pos FROM docs), gaps WHERE pos + gap + 2 <= len(words)
 UNION ALL SELECT doc_id, pos - 1, -size, array_to_string(words[pos:pos + size - 1], ' ')
 FROM (SELECT *, unnest(range(1, len(words) + 1)) AS pos FROM docs), short WHERE pos + size - 1 <= len(words)),
hits AS (SELECT DISTINCT doc_id, item_id, pos - item_at AS doc_start FROM placed JOIN sought USING (gap, seed)),
found AS (
 SELECT h.doc_id, h.item_id, doc_start, b.words AS bw, d.words AS dw, item_copies, greatest(-doc_start, 0) AS first,
  least(len(b.words), len(d.words) - doc_start) - greatest(-doc_start, 0) AS overlap
 FROM hits h JOIN docs d ON d.doc_id = h.doc_id JOIN bench b ON b.item_id = h.item_id),
compared AS (
 SELECT *, [CASE WHEN bw[i] = dw[i + doc_start] THEN 1 ELSE 0 END FOR i IN range(first + 1, first + overlap + 1)] AS same
 FROM found WHERE overlap > 0),
scored AS (
 SELECT doc_id, item_id, item_copies, len(bw) AS item_tokens, doc_start, overlap, list_sum(same) AS matching,
  list_max([list_sum(same[i:i + 11]) FOR i IN range(1, greatest(overlap - 11, 1) + 1)]) AS best_window
 FROM compared),
good AS (
 SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_window DESC, matching DESC, overlap DESC, doc_start) AS r
 FROM scored WHERE CASE WHEN item_tokens >= 12 THEN overlap >= 12 AND best_window >= 10 ELSE matching = item_tokens END)
SELECT doc_id, item_id, item_copies, CAST(item_tokens AS INTEGER) AS item_tokens, CAST(doc_start AS INTEGER) AS doc_start,
 CAST(overlap AS INTEGER) AS overlap, CAST(matching AS INTEGER) AS matching, CAST(best_window AS INTEGER) AS best_window
FROM good WHERE r = 1
""".replace("<tokens>", _TOKENS)
