"""Verse-aware greedy chunking of documents.

One narrow projection per document.  The packing is a fold over the paragraphs that
carries only counters and the list of break positions, so it is linear in the number of
paragraphs; the chunk texts are sliced out afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    BLANK_LINE,
    as_col,
    explode_indexed,
    inner_word_count,
    let,
    non_blank,
    trim_ws,
    word_count,
)
from ..functions.verse import is_verse_block


def _measure(parts: Column) -> Column:
    """Trimmed, non-blank parts with their word counts."""
    trimmed = F.filter(F.transform(parts, trim_ws), lambda p: p != "")
    return F.transform(
        trimmed, lambda p: F.struct(p.alias("text"), inner_word_count(p).alias("words"))
    )


def _breaks(paragraphs: Column, max_words: int, min_words: int, tail_words: int) -> Column:
    """Paragraph positions (0-based) at which a new chunk starts, first chunk excluded.

    Verse paragraphs belong to the group of the prose paragraph before them; leading
    verses wait for the first prose paragraph.  A group is only placed once it is
    complete: either the chunk so far is closed before it, or the group joins it.
    """
    measured = F.transform(
        paragraphs,
        lambda p, i: F.struct(
            i.alias("at"), p["words"].alias("words"), is_verse_block(p["text"]).alias("verse")
        ),
    )
    start = F.struct(
        F.lit(0).alias("chunk"),  # words placed in the open chunk
        F.lit(0).alias("group"),  # words of the group being collected
        F.lit(0).alias("group_at"),
        F.lit(False).alias("has_prose"),
        F.array().cast("array<int>").alias("breaks"),
    )

    def state(chunk, group, group_at, has_prose, breaks) -> Column:
        return F.struct(
            chunk.alias("chunk"),
            group.alias("group"),
            group_at.alias("group_at"),
            has_prose.alias("has_prose"),
            breaks.alias("breaks"),
        )

    def splits(acc: Column) -> Column:
        return (acc["chunk"] + acc["group"] > max_words) & (acc["chunk"] >= min_words)

    def step(acc: Column, p: Column) -> Column:
        joins_group = p["verse"] | ~acc["has_prose"]
        same = state(
            acc["chunk"],
            acc["group"] + p["words"],
            acc["group_at"],
            acc["has_prose"] | ~p["verse"],
            acc["breaks"],
        )
        closed = state(
            acc["group"],
            p["words"],
            p["at"],
            F.lit(True),
            F.concat(acc["breaks"], F.array(acc["group_at"])),
        )
        joined = state(
            acc["chunk"] + acc["group"], p["words"], p["at"], F.lit(True), acc["breaks"]
        )
        return F.when(joins_group, same).when(splits(acc), closed).otherwise(joined)

    def finish(acc: Column) -> Column:
        split_here = splits(acc)
        all_breaks = F.when(
            split_here, F.concat(acc["breaks"], F.array(acc["group_at"]))
        ).otherwise(acc["breaks"])
        tail = F.when(split_here, acc["group"]).otherwise(acc["chunk"] + acc["group"])
        short_tail = (tail < tail_words) & (F.size(all_breaks) > 0)
        return F.when(
            short_tail, F.slice(all_breaks, F.lit(1), F.size(all_breaks) - 1)
        ).otherwise(all_breaks)

    return F.aggregate(measured, start, step, finish)


def chunk_texts(
    text: Column | str, max_words: int = 500, min_words: int = 300, tail_words: int = 150
) -> Column:
    """``array<string>`` of chunk texts; empty for blank text."""

    def cut(paragraphs: Column) -> Column:
        def by_breaks(breaks: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), breaks)
            ends = F.concat(breaks, F.array(F.size(paragraphs)))
            texts = paragraphs["text"]
            return F.zip_with(
                starts,
                ends,
                lambda a, b: F.array_join(F.slice(texts, a + 1, b - a), "\n\n"),
            )

        return let(_breaks(paragraphs, max_words, min_words, tail_words), by_breaks)

    def whole(t: Column) -> Column:
        def by_size(parts: Column) -> Column:
            total = F.aggregate(parts, F.lit(0), lambda acc, p: acc + p["words"])
            too_long = F.exists(parts, lambda p: p["words"] > max_words)
            # one over-long paragraph: pack single lines instead
            units = F.when(too_long, _measure(F.split(t, "\n"))).otherwise(parts)
            return F.when(total <= max_words, F.array(t)).otherwise(let(units, cut))

        return F.when(t == "", F.array().cast("array<string>")).otherwise(
            let(_measure(F.split(t, BLANK_LINE)), by_size)
        )

    return let(trim_ws(as_col(text)), whole)


def chunk_documents(
    df: DataFrame,
    *,
    id_col: str | list[str] = "doc_id",
    text_col: str = "text",
    max_words: int = 500,
    min_words: int = 300,
    tail_words: int = 150,
) -> DataFrame:
    """(id, chunk_index, chunk_count, text, words): one row per chunk."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    chunks = df.select(
        *ids, chunk_texts(text_col, max_words, min_words, tail_words).alias("__chunks")
    )
    rows = explode_indexed(chunks, "__chunks", ids, "chunk_index", "text", "chunk_count")
    return rows.select(
        *ids, "chunk_index", "chunk_count", "text", word_count("text").alias("words")
    )


def blank_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that yield no chunk."""
    return df.filter(~F.coalesce(non_blank(F.col(text_col)), F.lit(False)))
