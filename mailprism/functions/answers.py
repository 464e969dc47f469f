"""Lenient reading of JSON-like answers written by a text generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ["subject", "preview_text", "html"]
_STRING = r'((?:[^"\\]|\\.)*)'


def _parsed(text: Column) -> Column:
    """Struct of the fields when the text is one valid JSON object, else null."""
    tree = F.try_parse_json(text)
    whole = F.to_json(tree)
    made = F.from_json(whole, ", ".join(f"{f} string" for f in FIELDS))
    return F.when(whole.startswith("{"), made)


def _field(text: Column, name: str) -> Column:
    raw = F.regexp_extract(text, f'(?s)"{name}"\\s*:\\s*"{_STRING}', 1)
    if name == "html":
        raw = F.replace(F.replace(F.replace(raw, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return raw


def answer_fields(text) -> Column:
    """struct<subject, preview_text, html>: the whole text as JSON, else its outermost braces, else field by field.

    Null when not even an html field is found.
    """
    text = F.col(text) if isinstance(text, str) else text
    outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    outer = F.when(outer != "", outer).otherwise(F.regexp_extract(text, r"(?s)\{.*", 0))
    loose = F.struct(*[_field(outer, f).alias(f) for f in FIELDS])
    return F.coalesce(_parsed(text), _parsed(outer), F.when(loose["html"] != "", loose))
