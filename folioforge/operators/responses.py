"""Model responses as a table: strict tag parsing into rows, everything else into quarantine.

Parsing is one expression per row.  A row is either valid (``text``, ``flags``) or
carries an ``error_code`` with the message, the stage and the first 200 characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, as_col, count_literal, let, trim_ws

# The tag that carries each stage's text.
STAGE_TAGS = {
    "translator": "translation",
    "smoother": "smoothed",
    "transliterator": "transliteration",
}
_FENCE = f"(?s)\\A```(?:[a-zA-Z]+)?{WS}*\\n(.*?)\\n{WS}*```{WS}*\\z"
_RESULT = "struct<text:string,flags:array<string>,error_code:string,error:string>"


def strip_fences(raw: Column | str) -> Column:
    """Trim, and drop one outer code fence if it wraps the whole response."""
    return let(
        trim_ws(raw),
        lambda s: F.when(
            F.rlike(s, F.lit(_FENCE)), trim_ws(F.regexp_extract(s, _FENCE, 1))
        ).otherwise(s),
    )


def extract_single_tag(source: Column, tag: str, mode: str = "strict") -> Column:
    """``struct<value, code>``: the trimmed content of a tag that has to be there once.

    ``mode``: ``strict`` reports missing and repeated tags, ``closed`` only missing ones,
    ``first`` takes the first complete block.
    """
    opening, closing = f"<{tag}>", f"</{tag}>"

    def parse(s: Column) -> Column:
        start = F.instr(s, opening)
        rest = F.substring(s, start + len(opening), F.length(s))

        def inside(tail: Column) -> Column:
            end = F.instr(tail, closing)
            code = F.when(start == 0, f"missing_open:{tag}")
            if mode == "strict":
                code = code.when(count_literal(s, opening) > 1, f"multiple_open:{tag}")
            code = code.when(end == 0, f"missing_close:{tag}")
            if mode == "strict":
                code = code.when(count_literal(tail, closing) > 1, f"multiple_close:{tag}")
            return F.struct(
                trim_ws(F.substring(tail, F.lit(1), end - 1)).alias("value"), code.alias("code")
            )

        return let(rest, inside)

    return let(source, parse)


def extract_flags(block: Column) -> Column:
    found = F.regexp_extract_all(block, F.lit("(?s)<flag>(.*?)</flag>"), 1)
    return F.filter(F.transform(found, trim_ws), lambda f: f != "")


def _message(code: Column, stage: str) -> Column:
    kind, tag = F.split_part(code, F.lit(":"), F.lit(1)), F.split_part(code, F.lit(":"), F.lit(2))
    return (
        F.when(kind == "no_string", F.lit(f"Empty or non-string {stage} output"))
        .when(kind == "empty_output", F.lit(f"Empty {stage} output"))
        .when(kind == "empty_block", F.concat(F.lit("Empty <"), tag, F.lit("> block")))
        .when(kind == "missing_open", F.concat(F.lit("Missing <"), tag, F.lit("> opening tag")))
        .when(kind == "multiple_open", F.concat(F.lit("Multiple <"), tag, F.lit("> opening tags")))
        .when(kind == "missing_close", F.concat(F.lit("Missing </"), tag, F.lit("> closing tag")))
        .when(
            kind == "multiple_close", F.concat(F.lit("Multiple </"), tag, F.lit("> closing tags"))
        )
    )


def parse_response(raw: Column | str, stage: str, mode: str = "strict") -> Column:
    """Parse one stage's response; see the module text for the result struct."""
    tag = STAGE_TAGS[stage]
    no_flags = F.array().cast("array<string>")
    wants_flags = stage == "translator" and mode == "strict"

    def result(text: Column, flags: Column, code: Column) -> Column:
        ok = code.isNull()
        return F.struct(
            F.when(ok, text).alias("text"),
            F.when(ok, flags).alias("flags"),
            code.alias("error_code"),
            _message(code, stage).alias("error"),
        ).cast(_RESULT)

    def parse(s: Column) -> Column:
        def with_text(t: Column) -> Column:
            code = F.when(s.isNull(), F.lit("no_string:")).when(s == "", F.lit("empty_output:"))
            code = code.when(t["code"].isNotNull(), t["code"])
            code = code.when(t["value"] == "", F.lit(f"empty_block:{tag}"))
            if not wants_flags:
                return result(t["value"], no_flags, code)
            return let(
                extract_single_tag(s, "flags", mode),
                lambda f: result(
                    t["value"], extract_flags(f["value"]), F.coalesce(code, f["code"])
                ),
            )

        return let(extract_single_tag(s, tag, mode), with_text)

    source = as_col(raw) if mode == "first" else strip_fences(raw)
    return let(source, parse)


def annotate_responses(
    df: DataFrame,
    *,
    stage_col: str = "stage",
    raw_col: str = "raw",
    lenient: bool | str = False,
    stages: Sequence[str] = tuple(STAGE_TAGS),
) -> DataFrame:
    """Add ``text``, ``flags``, ``error_code``, ``error`` and ``preview`` to responses.

    ``lenient=True`` takes the first complete block; ``lenient="closed"`` only reports
    missing tags.
    """
    mode = {False: "strict", True: "first"}.get(lenient, "closed")
    parsed = F.lit(None).cast(_RESULT)
    for stage in stages:
        parsed = F.when(
            F.col(stage_col) == stage, parse_response(raw_col, stage, mode)
        ).otherwise(parsed)
    unknown = F.struct(
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("array<string>").alias("flags"),
        F.lit("unknown_stage:").alias("error_code"),
        F.lit("Unknown stage").alias("error"),
    )
    out = df.withColumn("__parsed", F.coalesce(parsed, unknown))
    return out.select(
        "*",
        F.col("__parsed")["text"].alias("text"),
        F.col("__parsed")["flags"].alias("flags"),
        F.col("__parsed")["error_code"].alias("error_code"),
        F.col("__parsed")["error"].alias("error"),
        F.when(
            F.col("__parsed")["error_code"].isNotNull(),
            F.coalesce(F.substring(strip_fences(raw_col), 1, 200), F.lit("null")),
        ).alias("preview"),
    ).drop("__parsed")


def parse_responses(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine)."""
    rows = annotate_responses(df, **options)
    valid = rows.filter(F.col("error_code").isNull()).drop("error_code", "error", "preview")
    bad = rows.filter(F.col("error_code").isNotNull()).drop("text", "flags")
    return valid, bad
