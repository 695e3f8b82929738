"""Verse predicates over a block of text.

Two different definitions are in use and both are kept: the packing step glues
``is_verse_block`` blocks to prose, the section step labels ``is_verse_like`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIACRITICS, NOT_EOL, as_col, let, one_line, trimmed_lines


def _mean_length(lines: Column) -> Column:
    total = F.aggregate(lines, F.lit(0), lambda acc, s: acc + F.length(s))
    return total.cast("double") / F.size(lines)


def _even_lines(lines: Column, mean: Column, share: float) -> Column:
    return F.forall(lines, lambda s: F.abs(F.length(s) - mean) < mean * F.lit(share))


def is_verse_block(value: Column | str) -> Column:
    def test(lines: Column) -> Column:
        n = F.size(lines)
        quoted = F.exists(
            lines, lambda s: F.rlike(s, F.lit("^[“”\"'‘’]")) & F.rlike(s, F.lit(DIACRITICS))
        )
        marked = F.size(F.filter(lines, lambda s: F.rlike(s, F.lit(DIACRITICS))))
        stanza = (marked >= n * F.lit(0.5)) & let(
            _mean_length(lines), lambda mean: _even_lines(lines, mean, 0.5)
        )
        return F.when(n < 2, F.lit(False)).otherwise(quoted | stanza)

    c = as_col(value)
    return F.when(one_line(c), F.lit(False)).otherwise(let(trimmed_lines(c), test))


def is_verse_like(value: Column | str) -> Column:
    def test(lines: Column) -> Column:
        n = F.size(lines)
        has_mark = lambda s: F.rlike(s, F.lit(DIACRITICS))
        curly_verse = F.exists(lines, lambda s: F.rlike(s, F.lit("^[“”]")) & has_mark(s))
        italic = F.exists(
            lines, lambda s: F.rlike(s, F.lit(f"^(?:_{NOT_EOL}*_|\\*{NOT_EOL}*\\*)\\z"))
        )
        marked = F.size(F.filter(lines, lambda s: has_mark(s) | F.rlike(s, F.lit("[“”]"))))
        stanza = let(
            _mean_length(lines), lambda mean: (mean < 80) & _even_lines(lines, mean, 0.6)
        )
        quoted = F.exists(lines, lambda s: F.rlike(s, F.lit("^[“\"']"))) & F.exists(lines, has_mark)
        return F.when(n < 1, F.lit(False)).otherwise(
            curly_verse | italic | ((n >= 2) & ((marked >= n * F.lit(0.5)) | stanza)) | quoted
        )

    return let(trimmed_lines(value), test)


def line_kind(line: Column | str) -> Column:
    c = as_col(line)
    return (
        F.when(F.rlike(c, F.lit(f"{DIACRITICS}|^[“”]")), "transliteration")
        .when(F.rlike(c, F.lit(f"^\\({NOT_EOL}*\\)\\z")), "meaning")
        .otherwise("plain")
    )
