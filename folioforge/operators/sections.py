"""Prose and verse sections of finished text, and source/target paragraph pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    BLANK_LINE,
    DIACRITICS,
    NOT_EOL,
    as_col,
    explode_indexed,
    let,
    trim_ws,
    trimmed_lines,
)
from ..functions.verse import is_verse_like

_MEANING = f"^\\(({NOT_EOL}+)\\)\\z"


def blocks(text: Column | str) -> Column:
    """Trimmed, non-blank blocks between blank lines."""
    parts = F.transform(F.split(as_col(text), BLANK_LINE), trim_ws)
    return F.filter(parts, lambda b: b != "")


def verse_details(content: Column | str) -> Column:
    """``struct<transliteration, meaning>`` of a verse block."""

    def details(lines: Column) -> Column:
        meanings = F.filter(lines, lambda s: F.rlike(s, F.lit(_MEANING)))
        roman = F.filter(
            lines,
            lambda s: ~F.rlike(s, F.lit(_MEANING)) & F.rlike(s, F.lit(f"{DIACRITICS}|^[“”]")),
        )
        return F.struct(
            F.when(F.size(roman) > 0, F.array_join(roman, "\n")).alias("transliteration"),
            F.when(
                F.size(meanings) > 0,
                F.regexp_extract(F.try_element_at(meanings, F.lit(-1)), _MEANING, 1),
            ).alias("meaning"),
        )

    return let(trimmed_lines(content), details)


def parse_sections(
    df: DataFrame, *, id_col: str | list[str] = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, index, type, content, transliteration, meaning): one row per section."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    found = df.select(*ids, blocks(text_col).alias("__blocks"))
    rows = explode_indexed(found, "__blocks", ids, "index", "content", "section_count")
    typed = rows.withColumn("__verse", is_verse_like("content"))
    verse = F.when(F.col("__verse"), verse_details("content"))
    return typed.withColumn("__details", verse).select(
        *ids,
        "index",
        F.when(F.col("__verse"), "verse").otherwise("prose").alias("type"),
        "content",
        F.col("__details")["transliteration"].alias("transliteration"),
        F.col("__details")["meaning"].alias("meaning"),
    )


def align_paragraphs(
    df: DataFrame,
    *,
    id_cols: list[str],
    source_col: str = "original",
    target_col: str = "translation",
) -> DataFrame:
    """Source and target paragraphs side by side, by position (the shorter side is null)."""
    pairs = F.arrays_zip(blocks(source_col).alias("source"), blocks(target_col).alias("target"))
    rows = explode_indexed(
        df.select(*id_cols, pairs.alias("__pairs")), "__pairs", id_cols, "position", "pair", "n"
    )
    return rows.select(
        *id_cols,
        "position",
        F.col("pair")["source"].alias("source"),
        F.col("pair")["target"].alias("target"),
    )
