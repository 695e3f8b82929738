"""Chapter detection: markers, table of contents, numbered headings, word-count sections.

Each strategy is an expression over the line array of one document, giving
``array<struct<title, start_line>>``; the first strategy that finds chapters wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    NOT_EOL,
    WS,
    as_col,
    explode_indexed,
    inner_word_count,
    let,
    trim_ws,
    word_count,
)

CHAPTERS = "array<struct<title:string,start_line:int>>"
STRATEGIES = ("marker", "toc", "number", "words")

_MARKER = f"(?i)^==={WS}*CHAPTER:{WS}*({NOT_EOL}+?){WS}*===\\z"
_TOC = f"^([0-9]{{1,2}})\\.\\t({NOT_EOL}+)"
_NUMBERED = f"(?i)^(?:chapter{WS}+[0-9]+(?::|{WS})|[0-9]{{1,2}}[.)]{WS})"
_NUMBER_PREFIX = f"^(?:chapter{WS}+[0-9]+(?:[:.]|{WS})|[0-9]{{1,2}}[.)]{WS}*)"


def _none() -> Column:
    return F.array().cast(CHAPTERS)


def _chapter(title: Column, line: Column) -> Column:
    return F.struct(title.alias("title"), line.cast("int").alias("start_line"))


def _indexed(lines: Column) -> Column:
    return F.transform(lines, lambda s, i: F.struct(trim_ws(s).alias("s"), i.alias("i")))


def _numbered(lines: Column) -> Column:
    """Lines as they are; trimming all of them costs more than most tests."""
    return F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("i")))


def _trimmed(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(trim_ws(x["s"]).alias("s"), x["i"].alias("i")))


def _blank(line: Column) -> Column:
    """Nothing but whitespace; the first character tells for most lines without trimming."""
    first = F.ascii(line)
    return ((first <= 32) | (first >= 160)) & (trim_ws(line) == "")


def skipped_lines(lines: Column) -> Column:
    """Front matter that is not searched: 5 % of the lines, at most 50."""
    return F.least(F.lit(50), F.floor(F.size(lines) * F.lit(0.05)).cast("int"))


def _mean_gap(found: Column) -> Column:
    first, last = F.element_at(found, 1), F.element_at(found, -1)
    return (last["start_line"] - first["start_line"]) / F.size(found)


def by_marker(lines: Column, skip: Column) -> Column:
    hits = F.filter(
        _indexed(lines), lambda x: (x["i"] >= skip) & F.rlike(x["s"], F.lit(_MARKER))
    )
    found = F.transform(hits, lambda x: _chapter(F.regexp_extract(x["s"], _MARKER, 1), x["i"]))
    return let(found, lambda f: F.when(F.size(f) > 1, f).otherwise(_none()))


def by_number(lines: Column, skip: Column) -> Column:
    hits = F.filter(
        _indexed(lines),
        lambda x: (x["i"] >= skip)
        & F.rlike(x["s"], F.lit(_NUMBERED))
        & (inner_word_count(x["s"]) <= 12),
    )

    def titled(x: Column) -> Column:
        return let(
            trim_ws(F.regexp_replace(x["s"], _NUMBER_PREFIX, "")),
            lambda t: _chapter(F.when(t == "", x["s"]).otherwise(t), x["i"]),
        )

    return let(
        F.transform(hits, titled),
        lambda f: F.when((F.size(f) > 1) & (_mean_gap_or_zero(f) > 30), f).otherwise(_none()),
    )


def _mean_gap_or_zero(found: Column) -> Column:
    return F.when(F.size(found) > 0, _mean_gap(found)).otherwise(F.lit(0.0))


def by_toc(lines: Column) -> Column:
    """Titles of a contents list, looked up among the heading-like lines after the list."""

    def accept(acc: Column, x: Column) -> Column:
        near = (F.size(acc) == 0) | (x["i"] - F.try_element_at(acc, F.lit(-1))["i"] < 8)
        return F.when(near, F.concat(acc, F.array(x))).otherwise(acc)

    def lookup(entries: Column) -> Column:
        body_from = F.element_at(entries, -1)["i"] + 5
        below_blank = F.filter(
            _numbered(lines), lambda x: (x["i"] >= body_from) & _blank(F.get(lines, x["i"] - 1))
        )
        headings = F.filter(_trimmed(below_blank), lambda x: (x["s"] != "") & (inner_word_count(x["s"]) <= 15))

        def locate(entry: Column, heads: Column) -> Column:
            title = trim_ws(F.regexp_extract(entry["s"], _TOC, 2))
            words = F.split(trim_ws(F.regexp_replace(title, "[\\t0-9.…]+\\z", "")), f"{WS}+")
            needle = F.array_join(F.slice(words, 1, 4), " ")
            return let(
                needle,
                lambda n: F.when(
                    F.length(n) >= 3,
                    F.get(F.filter(heads, lambda h: F.contains(h["s"], n)), F.lit(0)),
                ),
            )

        def assemble_hits(heads: Column) -> Column:
            hits = F.filter(
                F.transform(entries, lambda e: locate(e, heads)), lambda h: h.isNotNull()
            )
            return F.transform(hits, lambda h: _chapter(h["s"], h["i"]))

        return let(
            let(headings, assemble_hits),
            lambda f: F.when((F.size(f) >= 3) & (_mean_gap_or_zero(f) > 20), f).otherwise(_none()),
        )

    listed = F.filter(_numbered(lines), lambda x: F.contains(x["s"], F.lit(".\t")))
    matched = F.filter(_trimmed(listed), lambda x: F.rlike(x["s"], F.lit(_TOC)))
    entries = F.aggregate(matched, F.array().cast("array<struct<s:string,i:int>>"), accept)
    return let(entries, lambda e: F.when(F.size(e) >= 3, lookup(e)).otherwise(_none()))


def by_words(lines: Column, target_words: int) -> Column:
    """Sections of ``target_words``: cut after the next blank line within 20 lines."""
    skip = skipped_lines(lines)

    def fold(measured: Column) -> Column:
        n = F.size(measured)
        start = F.struct(
            F.lit(0).alias("words"), skip.alias("resume"), F.array(skip).alias("starts")
        )

        def step(acc: Column, i: Column) -> Column:
            words = acc["words"] + F.element_at(measured, i + 1)
            gap = F.array_position(F.slice(measured, i + 1, F.lit(20)), 0).cast("int")
            cut = i + gap
            kept = F.struct(
                words.alias("words"), acc["resume"].alias("resume"), acc["starts"].alias("starts")
            )
            split = F.struct(
                F.lit(0).alias("words"),
                cut.alias("resume"),
                F.concat(acc["starts"], F.array(cut)).alias("starts"),
            )
            return (
                F.when(i < acc["resume"], acc)
                .when(words < target_words, kept)
                .when((gap > 0) & (cut < n), split)
                .otherwise(kept)
            )

        starts = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["starts"]
        return let(
            starts,
            lambda s: F.when(
                F.size(s) > 1,
                F.transform(
                    s, lambda at, k: _chapter(F.concat(F.lit("Section "), k + 1), at)
                ),
            ).otherwise(_none()),
        )

    return let(F.transform(lines, word_count), fold)


def chapters_of(
    text: Column | str,
    strategies: Sequence[str] = STRATEGIES,
    target_words: int = 4000,
    skip_front: bool = True,
) -> Column:
    """``struct<strategy, chapters>``; no chapters gives a null strategy.

    A cheap test on the whole text guards every strategy, so most documents only pay for
    the guards.
    """

    def search(t: Column) -> Column:
        def on_lines(lines: Column) -> Column:
            skip = skipped_lines(lines) if skip_front else F.lit(0)
            guarded = {
                "marker": (F.rlike(t, F.lit("(?i)CHAPTER:")), by_marker(lines, skip)),
                "toc": (F.rlike(t, F.lit("[0-9]\\.\\t")), by_toc(lines)),
                "number": (
                    F.rlike(t, F.lit("(?i)chapter|[0-9][.)]")),
                    by_number(lines, skip),
                ),
                "words": (word_count(t) >= target_words, by_words(lines, target_words)),
            }
            tried = [
                F.struct(
                    F.lit(name).alias("strategy"),
                    F.when(guarded[name][0], guarded[name][1]).otherwise(_none()).alias("chapters"),
                )
                for name in strategies
            ]
            nothing = F.struct(
                F.lit(None).cast("string").alias("strategy"), _none().alias("chapters")
            )

            def first_found(attempts: list[Column]) -> Column:
                if not attempts:
                    return nothing

                def keep(a: Column) -> Column:
                    return F.when(F.size(a["chapters"]) > 0, a).otherwise(first_found(attempts[1:]))

                return let(attempts[0], keep)

            return first_found(tried)

        return let(F.split(t, "\n"), on_lines)

    return let(as_col(text), search)


def detect_chapters(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    strategies: Sequence[str] = STRATEGIES,
    target_words: int = 4000,
    skip_front: bool = True,
) -> DataFrame:
    """(id, strategy, chapter_index, title, start_line)."""
    found = df.select(
        id_col,
        chapters_of(text_col, strategies, target_words, skip_front).alias("__found"),
    ).select(
        id_col,
        F.col("__found")["strategy"].alias("strategy"),
        F.col("__found")["chapters"].alias("__chapters"),
    )
    rows = explode_indexed(
        found, "__chapters", [id_col, "strategy"], "chapter_index", "chapter", "chapter_count"
    )
    return rows.select(
        id_col,
        "strategy",
        "chapter_index",
        F.col("chapter")["title"].alias("title"),
        F.col("chapter")["start_line"].alias("start_line"),
    )


def slice_chapters(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    strategies: Sequence[str] = STRATEGIES,
    target_words: int = 4000,
    skip_front: bool = True,
) -> DataFrame:
    """(id, chapter_index, title, text, total_chapters).

    A chapter runs to the start of the next one; text before the first chapter is
    dropped and so are blank chapters (``total_chapters`` counts all of them).
    """
    found = df.select(
        id_col,
        F.split(text_col, "\n").alias("__lines"),
        chapters_of(text_col, strategies, target_words, skip_front)["chapters"].alias("__chapters"),
    )
    lines, chapters = F.col("__lines"), F.col("__chapters")

    def cut(chapter: Column, i: Column) -> Column:
        following = F.get(chapters, i + 1)["start_line"]
        end = F.coalesce(following, F.size(lines))
        size = F.greatest(end - chapter["start_line"], F.lit(0))
        return F.struct(
            chapter["title"].alias("title"),
            trim_ws(F.array_join(F.slice(lines, chapter["start_line"] + 1, size), "\n")).alias(
                "text"
            ),
        )

    sliced = found.select(id_col, F.transform(chapters, cut).alias("__texts"))
    rows = explode_indexed(
        sliced, "__texts", [id_col], "chapter_index", "chapter", "total_chapters"
    )
    return rows.select(
        id_col,
        "chapter_index",
        F.col("chapter")["title"].alias("title"),
        F.col("chapter")["text"].alias("text"),
        "total_chapters",
    ).filter(F.col("text") != "")
