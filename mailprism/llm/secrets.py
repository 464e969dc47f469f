"""Secret scans: a random forest removes false positives from candidate strings. DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import Scratch, fresh, spark_of

SHORTEST = 16  # characters of a candidate that nothing but its look marks; assigned ones have 6 or more
CANDIDATE = r"([A-Za-z0-9+/_\-]{16,}={0,2})"
SAMPLE = 10_000  # labelled findings of each class to fit on, at most
TREES, DEPTH = 25, 6
LETTERS = 9  # longest dictionary word
COMMON = 2e-5  # share of all letter triples from which on a triple counts as dictionary text

# Formats that public services document for their keys.
FORMATS = {
    "aws_access_key": r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    "github_token": r"^(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})$",
    "google_api_key": r"^AIza[0-9A-Za-z_\-]{35}$",
    "slack_token": r"^xox[abprs]-[0-9A-Za-z\-]{10,}$",
    "stripe_key": r"^[rs]k_(live|test)_[0-9A-Za-z]{16,}$",
    "json_web_token": r"^eyJ[A-Za-z0-9_\-]{14,}$",
}
CREDENTIAL = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth(?!ors?\b|ored|entic\b))"
ASSIGNED = CREDENTIAL + r"\S*\s*(:=|=|:|=>)\s*[\"']?$|://[^\s/:@?#]*:$"
NAME, SIGN = CREDENTIAL.replace("(passw(or)?d", "(?:passw(?:or)?d") + r"[^\s:=]*", r"(?:[:=]=|=>|[:=])"
# What is assigned: up to the closing quote, else up to the next blank or further assignment without the marks that end a clause.
VALUE = r"""["']?((?<=")[^"\s]{6,}|(?<=')[^'\s]{6,}|(?<!["'])[^\s"']\S{5,}?(?=[&;,]\w+=|[.,;)\]}>"'`]*$))"""
IN_URL = r"://[^\s/:@?#]*:([^\s/?#]{6,})@"
MAYBE = rf"{NAME}\s*[:=]|://"  # a text without it has no assigned values
PLACEHOLDER = r"^(\$\{.*\}?|\$[A-Z_]+|\{\{.*|<.*>|%\w+%?|[A-Za-z_]\w*(\.\w+)*[(\[].*)$"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/)"

FEATURES = ["length", "digits", "capitals", "small", "marks", "runs", "digit_turns", "case_turns", "variety", "vowels",
            "longest_letters", "hexadecimal", "coverage", "named", "assigned", "known_before", "known_after", "path_depth", "path_test"]


def candidates(docs: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """Every run of at least 16 key characters and every value of at least 6 characters of any kind that follows a
    credential word and an assignment sign or is a URL's password, with the words around it: key, text_id, at, value,
    before, after, path."""
    own = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_id"),
                      (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"),
                      F.coalesce(F.col(text).rlike(MAYBE), F.lit(False)).alias("maybe"),
                      F.split(F.coalesce(F.col(text), F.lit("")), r"\s+").alias("w"))
    w = F.col("w")
    two_before = lambda i: F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1))
    follows = lambda i: two_before(i).rlike(rf"{NAME}\s*{SIGN}$")
    signed = lambda x, i: x.rlike("^[:=]") & F.coalesce(F.get(w, i - 1).rlike(f"{NAME}$"), F.lit(False))
    looks = lambda x, i: (F.length(x) >= SHORTEST) | F.col("maybe") & (F.length(x) >= 6) & (
        x.rlike(rf"{NAME}[:=]|://") | signed(x, i) | follows(i))
    chosen = F.filter(F.transform(w, lambda x, i: F.when(looks(x, i), i)), lambda i: i.isNotNull())
    around = F.transform(chosen, lambda i: F.struct(
        i.alias("at"), F.get(w, i).alias("word"), two_before(i).alias("words_before"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("after"),
        follows(i).alias("follows"), signed(F.get(w, i), i).alias("signed")))
    found = own.select("key", "text_id", "path", F.inline(around))
    every = lambda pattern: F.regexp_extract_all("word", F.lit(pattern), F.lit(1))
    none = F.array().cast("array<string>")
    values = F.concat(every(CANDIDATE), every(f"{NAME}{SIGN}{VALUE}"), every(IN_URL), F.when(F.col("follows"), every(f"^{VALUE}")).otherwise(none),
                      F.when(F.col("signed"), every(f"^{SIGN}{VALUE}")).otherwise(none))
    found = found.withColumn("value", F.explode(F.array_distinct(values)))
    inside = F.expr("substring_index(word, value, 1)")
    return found.select("key", "text_id", "path", "at", "value", F.concat_ws(" ", "words_before", inside).alias("before"), "after")


def dictionary(docs: DataFrame, text: str) -> DataFrame:
    """Letter triples of the corpus' short words, by how much text they make up: at most 26 ** 3 rows."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\s.,;:!?]+")).alias("word"))
    words = words.where(F.col("word").rlike(f"^[a-z]{{3,{LETTERS}}}$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    parts = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, 3))).alias("triple"))
    counts = parts.groupBy("triple").agg(F.sum("n").alias("n"))
    return counts


def coverage(found: DataFrame, triples: DataFrame, total: int) -> DataFrame:
    """Per distinct value the share of its letter triples that are dictionary text."""
    known = triples.where(F.col("n") >= max(2.0, COMMON * total)).select("triple", F.lit(1.0).alias("known"))
    values = found.select("value").distinct().withColumn("low", F.lower("value"))
    parts = values.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substring("low", i, 3))).alias("triple"))
    joined = parts.join(F.broadcast(known), "triple", "left")
    return joined.groupBy("value").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage"))


def measured(found: DataFrame) -> DataFrame:
    """The forest's features (all doubles, never null) of candidates with their coverage."""
    v = F.col("value")
    size = F.length(v).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / size  # noqa: E731  of what is left
    count = lambda pattern: F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0))).cast("double")
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    word = r"^[A-Za-z]{1,14}[.,;:!?]?$"
    last = F.element_at(F.split(F.trim("before"), r"\s+"), -1)
    made = {
        "length": F.least(size, F.lit(200.0)), "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "small": share("[^a-z]"),
        "marks": share("[A-Za-z0-9]"), "runs": count("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+") / size,
        "digit_turns": count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])") / size, "case_turns": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / size,
        "variety": F.size(F.array_distinct(F.split(v, ""))) / size, "vowels": share("[^aeiouAEIOU]"),
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)) / size,
        "hexadecimal": flag(v.rlike("^[0-9a-fA-F]+$")), "coverage": F.coalesce("coverage", F.lit(0.0)),
        "named": flag(F.col("before").rlike(CREDENTIAL)), "assigned": flag(F.col("before").rlike(ASSIGNED)),
        "known_before": flag(last.rlike(word)), "known_after": flag(F.col("after").rlike(word)),
        "path_depth": F.coalesce(F.length(F.regexp_replace("path", "[^/]", "")), F.lit(0)).cast("double"),
        "path_test": flag(F.col("path").rlike(TEST_PATH)),
    }
    return found.withColumns({name: made[name].cast("double") for name in FEATURES})


def format_of(value: Column) -> Column:
    named = F.lit(None).cast("string")
    for name, pattern in FORMATS.items():
        named = F.when(value.rlike(pattern), F.lit(name)).otherwise(named)
    return named


def rule_labels(found: DataFrame) -> DataFrame:
    """Labels where no reviewed ones are at hand: 1 for documented formats and for mixed strings that are assigned to
    a credential, 0 for strings of letters that are not, for words of the corpus and for names of variables and calls
    that are, null otherwise."""
    v = F.col("value")
    filled_in = v.rlike(PLACEHOLDER)
    sure = format_of(v).isNotNull() | (F.col("before").rlike(ASSIGNED) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~filled_in)
    spelled = v.rlike("^[A-Z]?[a-z]+$") & (F.col("coverage") >= 0.75)
    plain = v.rlike(r"^[A-Za-z/_\-]+$") & ~F.col("before").rlike(ASSIGNED) & ~F.col("before").rlike(CREDENTIAL) | spelled | filled_in
    return found.withColumn("label", F.when(sure, 1.0).when(plain, 0.0))


def train(labelled: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest over labelled findings (features, label 0/1), at most ``sample`` of each class, drawn by their hash.

    None if a class is missing. The sample is one partition in a fixed order, so that training gives the same
    forest whatever the layout of the corpus.
    """
    drawn = [labelled.where(F.col("label") == one).select("value", "label", *FEATURES).orderBy(F.xxhash64("value", "before", "after"), "value").limit(sample)
             for one in (0.0, 1.0)]
    rows = scratch.save(drawn[0].unionByName(drawn[1]).repartition(1).sortWithinPartitions("label", "value", *FEATURES))
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, featureSubsetStrategy="sqrt", maxMemoryInMB=64)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def findings(docs: DataFrame, labels=rule_labels, sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
             path: str | None = None) -> DataFrame:
    """Secrets in whole texts: key, ``text_id`` (hash of the row's text), ``at`` (number of the word), ``value``,
    ``format`` (a documented one, else null), ``score`` (forest, 0 to 1); those of at least a half.

    ``labels``: function that adds a column ``label`` (1, 0 or null) to candidates (value, before, after, path and
    features), for example a join with reviewed findings. Where a class has no labelled finding there is no forest
    and the labels alone decide. Null, empty and blank texts have no candidates; a value that a word holds twice is
    one finding; repeated rows give repeated findings; a null key stays null; empty tables give no rows; a column
    ``path`` names the file of a text, other columns are not looked at.
    """
    scratch = Scratch(spark_of(docs), "secrets")
    found = scratch.save(candidates(docs, key, text, path))
    triples = scratch.save(dictionary(docs, text))
    total = triples.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    covered = found.join(coverage(found, triples, total), "value")
    ready = scratch.save(labels(measured(covered)))
    model = train(ready, scratch, sample)
    if model is None:
        scored = ready.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    kept = scored.where(F.col("score") >= 0.5)
    return kept.select(F.col("key").alias(key), "text_id", "at", "value", format_of(F.col("value")).alias("format"), "score")


def redact(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found value in its text replaced by ``mark``; rows without findings stay as they are."""
    names = [fresh(x, docs) for x in ("found_key", "found_text", "found_values")]
    values = found.groupBy(F.col(key).alias(names[0]), F.col("text_id").alias(names[1])).agg(F.collect_set("value").alias(names[2]))
    longest_first = F.array_sort(names[2], lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).otherwise(1))
    # A short value is replaced where it stands alone, not inside a longer word or number.
    alone = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    literal = F.lit(re.sub(r"([\\$])", r"\\\1", mark))
    cleaned = F.aggregate(longest_first, F.col(text), lambda t, v: F.when(F.length(v) < SHORTEST, F.regexp_replace(t, alone(v), literal)).otherwise(F.replace(t, v, F.lit(mark))))
    joined = docs.join(values, F.col(key).eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(text)) == F.col(names[1])), "left")
    return joined.withColumn(text, F.when(F.col(names[2]).isNull(), F.col(text)).otherwise(cleaned)).select(*docs.columns)
