"""HTML operators: one Arrow-batched read per page gives tokens; every rule is an expression over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mailprism.functions import blocks, markup

cloudpickle.register_pickle_by_value(markup)
cloudpickle.register_pickle_by_value(blocks)

PREVIEW_CHARS = 200
TEMPLATE_BLOCKS = 20
BODY_CHARS = 200
ROWS = 64  # pages whose tokens a worker holds at once

# Element groups and the marks of logo images.
DROPPED = ["script", "object", "embed"]
HEADINGS = ["h1", "h2", "h3", "h4"]
LOGO_MARKS = ["logo", "brand", "header-logo", "main-logo", "site-logo"]


def token_udf():
    """Vectorised UDF html -> struct of tokens and error. Tokens become Arrow arrays in one call; by way of pandas every value
    of every token would be copied in Python first."""
    read, rows, kind = markup.tokenize, ROWS, pa.struct(list(to_arrow_schema(StructType.fromDDL(markup.SCHEMA))))

    @F.arrow_udf(markup.SCHEMA)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                yield pa.array([read(h) for h in batch.slice(at, rows).to_pylist()], type=kind)

    return parse


# --- expressions over one token, and over the tokens of a page ----------------


def attribute(token: Column, name: str) -> Column:
    """Value of a token's last attribute of that name; empty when it has none."""
    found = F.filter(token["attrs"], lambda a: a["name"] == name)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))


def is_open(token: Column, *tags: str) -> Column:
    return (token["kind"] == "open") & token["tag"].isin(*tags)


def is_close(token: Column, *tags: str) -> Column:
    return (token["kind"] == "close") & token["tag"].isin(*tags)


def outside(token: Column, *tags: str) -> Column:
    return ~F.arrays_overlap(token["within"], F.array(*map(F.lit, tags)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def joined(tokens: Column, by: str) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), by)


def between(tokens: Column, low: Column, high: Column) -> Column:
    """Tokens after position ``low`` and before ``high``."""
    return F.filter(tokens, lambda t: (t["pos"] > low) & (t["pos"] < high))


def escaped(text: Column, quotes: bool) -> Column:
    for plain, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])]:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _clean(df: DataFrame) -> DataFrame:
    """Without dropped elements, one-pixel images and event handlers; all else as written."""
    def start(t: Column) -> Column:
        kept = F.filter(t["attrs"], lambda a: ~a["name"].startswith("on"))
        shown = F.transform(kept, lambda a: F.when(a["value"].isNull(), a["name"]).otherwise(
            F.concat(a["name"], F.lit('="'), escaped(a["value"], True), F.lit('"'))))
        again = F.concat(F.lit("<"), F.array_join(F.concat(F.array(t["tag"]), shown), " "), F.lit(">"))
        pixel = (t["tag"] == "img") & ((attribute(t, "width") == "1") | (attribute(t, "height") == "1"))
        return F.when(pixel, "").when(F.exists(t["attrs"], lambda a: a["name"].startswith("on")), again).otherwise(t["text"])

    def source(t: Column) -> Column:
        shown = (F.when(t["kind"] == "open", start(t)).when(t["kind"] == "close", F.concat(F.lit("</"), t["tag"], F.lit(">")))
                 .when(t["kind"] == "comment", F.concat(F.lit("<!--"), t["text"], F.lit("-->")))
                 .when(t["kind"] == "decl", F.concat(F.lit("<!"), t["text"], F.lit(">")))
                 .when(t["kind"] == "section", F.concat(F.lit("<!["), t["text"], F.lit("]>")))
                 .when(outside(t, "style"), escaped(t["text"], False)).otherwise(t["text"]))
        hidden = F.coalesce(t["tag"].isin(*DROPPED), F.lit(False)) | ~outside(t, *DROPPED)
        return F.when(hidden, "").otherwise(shown)

    return df.withColumn("clean", F.array_join(F.transform("_tokens", source), ""))


def _texts(df: DataFrame) -> DataFrame:
    """Shared lists: data outside scripts and styles, and data outside styles."""
    data = F.filter("_tokens", lambda t: t["kind"] == "text")
    return df.withColumns({"_seen": F.filter(data, lambda t: outside(t, "script", "style")), "_data": F.filter(data, lambda t: outside(t, "style"))})


def _text(df: DataFrame) -> DataFrame:
    shown = F.filter(F.transform("_seen", lambda t: strip(t["text"])), lambda x: x != "")
    return df.withColumns({"visible_text": F.array_join(shown, " "), "all_text": joined(F.col("_seen"), " ")})


def _structure(df: DataFrame) -> DataFrame:
    """A link reaches from a start tag to the next tag of a link; a heading's text is what directly follows its start tag.
    The tokens know these texts, so every list is one pass over them."""
    data, tokens = F.col("_data"), F.col("_tokens")
    links = F.transform(F.filter(tokens, lambda t: is_open(t, "a") & t["inner"].isNotNull()), lambda t: F.struct(
        attribute(t, "href").alias("href"), strip(t["inner"]).alias("text")))
    heads = F.transform(F.filter(tokens, lambda t: is_close(t, *HEADINGS)), lambda t: F.struct(t["tag"].alias("tag"), strip(t["inner"]).alias("text")))
    images = F.transform(F.filter(tokens, lambda t: is_open(t, "img")), lambda t: F.struct(attribute(t, "src").alias("src"), attribute(t, "alt").alias("alt")))
    viewport = lambda t: (F.lower(attribute(t, "name")) == "viewport") | F.lower(attribute(t, "content")).contains("viewport")
    return df.withColumns({
        "links": links, "images": images, "headings": heads,
        "list_count": F.size(F.filter(tokens, lambda t: is_open(t, "ul", "ol"))),
        "has_viewport": F.exists(tokens, lambda t: is_open(t, "meta") & viewport(t)),
        "has_dark_mode": F.exists(tokens, lambda t: (t["kind"] == "text") & ~outside(t, "style") & t["text"].contains("prefers-color-scheme")),
        "copy_text": strip(joined(F.filter(data, lambda t: ~t["linked"]), " ")),
    })


def _signals(df: DataFrame) -> DataFrame:
    """Names in meta tags, alt texts of logo images, and the text of the footer (the element, else its class)."""
    tokens = F.col("_tokens")
    first = lambda found: F.get(found, 0)
    meta = lambda key, value: F.nullif(attribute(first(F.filter(tokens, lambda t: is_open(t, "meta") & (attribute(t, key) == value))), "content"), F.lit(""))
    df = df.withColumn("_pictures", F.transform(F.filter(tokens, lambda t: is_open(t, "img")), lambda t: F.struct(
        *(F.lower(attribute(t, x)).alias(x) for x in ("class", "id", "src")), attribute(t, "alt").alias("alt"))))
    with_mark = lambda field, mark: first(F.filter("_pictures", lambda p: p[field].contains(mark)))
    logos = F.array(*(F.coalesce(with_mark("class", m), with_mark("id", m), with_mark("src", "logo"))["alt"] for m in LOGO_MARKS))
    footer = F.coalesce(first(F.filter(tokens, lambda t: is_open(t, "footer"))), first(F.filter(
        tokens, lambda t: (t["kind"] == "open") & ~t["tag"].isin(*sorted(markup.VOID)) & F.lower(attribute(t, "class")).contains("footer"))))
    df = df.withColumn("_footer", footer)
    inside = between(F.col("_seen"), F.col("_footer")["pos"], F.coalesce(F.col("_footer")["ends"], F.size(tokens)))
    return df.withColumn("signals", F.struct(
        meta("property", "og:site_name").alias("site_name"), meta("name", "twitter:site").alias("twitter_site"),
        meta("name", "application-name").alias("app_name"),
        F.filter(logos, lambda x: F.length(x).between(2, 49)).alias("logo_alts"),
        F.when(F.col("_footer").isNotNull(), joined(inside, "")).alias("footer_text"), joined(F.col("_seen"), "").alias("all_text")))


BLOCK = "struct<" + ",".join(f"{c}:string" for c in blocks.FIELDS) + ">"


def _block_udf():
    """Vectorised UDF html -> blocks; ``ROWS`` pages at a time."""
    find, rows = blocks.page_blocks, ROWS

    @F.pandas_udf(f"array<{BLOCK}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            for at in range(0, len(pages), rows):
                yield pages.iloc[at:at + rows].map(find)

    return found


@F.udtf(returnType="pos int, " + ", ".join(f"{c} string" for c in blocks.FIELDS))
class TemplateBlocks:
    """Table function: one row per template block of a page. A template is the ``first`` blocks with texts of at most ``body_chars``
    characters; null gives all blocks and whole texts."""

    def eval(self, html: str, first: int = TEMPLATE_BLOCKS, body_chars: int = BODY_CHARS):
        for pos, block in enumerate(blocks.page_blocks(html)[:first]):
            text = block["text"]
            yield (pos, *({**block, "text": text[:body_chars] if text is not None and block["type"] == "text" else text}).values())


PARTS = {
    "clean": (_clean, ["clean"]),
    "text": (_text, ["visible_text", "all_text"]),
    "structure": (_structure, ["links", "images", "headings", "list_count", "has_viewport", "has_dark_mode", "copy_text"]),
    "signals": (_signals, ["signals"]),
}


def html_features(df: DataFrame, parts=("text", "structure", "signals"), html: str = "html", keep_html: bool = True) -> DataFrame:
    """Adds the requested parts as columns; the HTML is read once. The part ``error`` says why a page's rest could not be
    read, the part ``blocks`` is the template's blocks, found in a pass of their own."""
    out = df
    if set(parts) - {"blocks"}:
        out = out.withColumn("_parsed", token_udf()(F.col(html))).withColumn("_tokens", F.col("_parsed.tokens"))
    if set(parts) - {"clean", "error", "blocks"}:
        out = _texts(out)
    alone = {"error": lambda d: d.withColumn("error", F.col("_parsed.error")), "blocks": lambda d: d.withColumn("blocks", _block_udf()(F.col(html)))}
    for part in parts:
        out = (alone.get(part) or PARTS[part][0])(out)
    made = [c for part in parts for c in ([part] if part in alone else PARTS[part][1])]
    return out.select(*(c for c in df.columns if keep_html or c != html), *made)


def clean_html(df: DataFrame, html: str = "html") -> DataFrame:
    """Without scripts, objects, embeds, event handlers and one-pixel images."""
    return html_features(df, ("clean",), html, keep_html=False).withColumnRenamed("clean", html)


def visible_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Visible text and its preview (first 200 characters)."""
    out = html_features(df, ("text",), html, keep_html=False)
    return out.withColumn("preview", F.left("visible_text", F.lit(PREVIEW_CHARS)))


def template_blocks(df: DataFrame, html: str = "html", first: int | None = TEMPLATE_BLOCKS, body_chars: int | None = BODY_CHARS) -> DataFrame:
    """One row per template block (image, heading, cta, text): ``df`` in a lateral join with ``TemplateBlocks``."""
    keys = [c for c in df.columns if c != html]
    limits = (F.lit(n).cast("int") for n in (first, body_chars))
    return df.lateralJoin(TemplateBlocks(F.col(html).outer(), *limits)).select(*keys, "pos", *blocks.FIELDS)


def template_structure(df: DataFrame, html: str = "html", first: int | None = TEMPLATE_BLOCKS) -> DataFrame:
    """Hero flag and block counts of every mail's template (its ``first`` blocks)."""
    out = html_features(df, ("blocks",), html, keep_html=False)
    if first is not None:
        out = out.withColumn("blocks", F.slice("blocks", 1, first))

    def number(kind):
        return F.size(F.filter("blocks", lambda b: b["type"] == kind))

    return out.withColumns({
        "has_hero_image": F.exists("blocks", lambda b: b["slot"] == "image_1"),
        "heading_count": number("heading"), "cta_count": F.greatest(number("cta"), F.lit(1)),
        "body_sections": number("text"), "slots": F.transform("blocks", lambda b: b["slot"]),
    }).drop("blocks")


# --- pure expressions -------------------------------------------------------

# Slimming steps (pattern, replacement), applied in order.
PIXEL = (
    r"(?i)<img[^>]*(?:width\s*=\s*[\"']?1[\"']?[^>]*height\s*=\s*[\"']?1[\"']?"
    r"|height\s*=\s*[\"']?1[\"']?[^>]*width\s*=\s*[\"']?1[\"']?)[^>]*/?\s*>"
)
SLIM_STEPS = [
    (PIXEL, ""),
    (r"(?s)<!--(?!\[if).*?-->", ""),
    (r"(?i)\s+data-[a-z0-9_-]+\s*=\s*\"[^\"]*\"", ""),
    (r"(?i)(<img[^>]*src\s*=\s*\")[^\"]{300,}(\")", "$1#$2"),
    (r"\n\s*\n\s*\n", "\n\n"),
    (r"[ \t]{4,}", " "),
    (r"(?i)<style[^>]*>\s*</style>", ""),
]


def slim_html(col) -> Column:
    """HTML without pixels, comments, data attributes, giant image sources and blank runs."""
    out = F.col(col) if isinstance(col, str) else col
    for pattern, replacement in SLIM_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def first_image(col) -> Column:
    """Source of the first image, null when there is none or it has no source."""
    tag = F.regexp_extract(F.col(col) if isinstance(col, str) else col, r"(?is)<img\b([^>]*)>", 1)
    src = F.regexp_extract(tag, r"(?is)(?:^|\s)src\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    return F.nullif(F.btrim(F.regexp_replace(src, r"(?is)^\s*src\s*=\s*", ""), F.lit("\"'")), F.lit(""))
