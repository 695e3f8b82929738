"""Markup stripping, entity decoding and newline normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, let, trim_ws

# Named entities, in the order they are decoded.
NAMED_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#039;", "'"),
    ("&rsquo;", "’"),
    ("&lsquo;", "‘"),
    ("&rdquo;", "”"),
    ("&ldquo;", "“"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
]


def _units_to_text(units: Column) -> Column:
    """4-digit hex UTF-16 units -> text; a surrogate without partner is U+FFFD."""
    spaced = F.array_join(units, " ")
    paired = F.regexp_replace(spaced, "(D[89AB][0-9A-F]{2}) (D[C-F][0-9A-F]{2})", "$1$2")
    safe = F.regexp_replace(paired, "(?<![0-9A-F])D[89A-F][0-9A-F]{2}(?![0-9A-F])", "FFFD")
    return F.decode(F.unhex(F.replace(safe, F.lit(" "), F.lit(""))), "UTF-16BE")


def _decode_runs(value: Column, entity: str, digits: str, to_hex) -> Column:
    """Decode every run of adjacent numeric entities in one pass.

    Text between the runs and the decoded runs are zipped back together, so decoded
    characters are never looked at again by the same pass.
    """
    run = f"((?:{entity})++)"  # possessive: matched in a loop, however long the run is

    def decode_run(r: Column) -> Column:
        codes = F.regexp_extract_all(r, F.lit(digits), 1)
        return _units_to_text(
            F.transform(codes, lambda d: F.lpad(F.right(to_hex(d), F.lit(4)), 4, "0"))
        )

    def decode_text(text: Column) -> Column:
        between = F.split(text, run, -1)
        decoded = F.transform(F.regexp_extract_all(text, F.lit(run), 1), decode_run)
        zipped = F.zip_with(between, decoded, lambda b, d: F.concat(b, F.coalesce(d, F.lit(""))))
        return F.when(F.rlike(text, F.lit(entity)), F.array_join(zipped, "")).otherwise(text)

    return let(value, decode_text)


def _decimal_to_hex(digits: Column) -> Column:
    """Hex digits of a decimal number; one of more than 18 digits is no character."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(short) > 18, "FFFD").otherwise(
        F.coalesce(F.conv(F.when(short != "", short).otherwise("0"), 10, 16), F.lit("0"))
    )


def decode_entities(value: Column | str) -> Column:
    """Numeric entities first, then the named ones; ``&amp;lt;`` decodes to ``<``."""
    text = as_col(value)
    text = _decode_runs(text, "&#[0-9]++;", "&#([0-9]++);", _decimal_to_hex)
    text = _decode_runs(
        text,
        "&#x[0-9a-fA-F]++;",
        "&#x([0-9a-fA-F]++);",
        F.upper,
    )
    for entity, plain in NAMED_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def squeeze_newlines(value: Column) -> Column:
    return trim_ws(F.regexp_replace(value, "\\n{3,}", "\n\n"))


def markup_to_text(value: Column | str) -> Column:
    text = F.replace(as_col(value), F.lit("</p>"), F.lit("\n\n"))
    text = F.replace(text, F.lit("<br/>"), F.lit("\n"))
    text = F.regexp_replace(text, "<[^>]+>", "")
    return squeeze_newlines(decode_entities(text))


def normalise_newlines(value: Column | str) -> Column:
    return squeeze_newlines(F.replace(as_col(value), F.lit("\r\n"), F.lit("\n")))
