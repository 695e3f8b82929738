"""Ordered re-assembly of pieces, with removal of repeated boundary sentences.

A document may own a large share of all rows, so no step gathers a whole document in
one group:

1. Rows are grouped by ``(id, order div block_rows)``: at most ``block_rows`` pieces per
   group, sorted and folded inside the group.
2. How many sentences a piece loses (0, 1 or 2) depends on the piece before it only
   through that same number.  A block is therefore summarised by what it does for each
   of the three possible entries, plus its first and last two sentences.  The few
   documents with more than one block pass these summaries (not the text) through two
   levels of folds: each span of ``span_blocks`` blocks is folded by itself for every
   possible entry, one row per span is composed in document order, and a join tells every
   block its entry.
3. A document of one block is finished there: its texts are shuffled once.  The blocks
   of longer documents are joined per ``part``: if the caller gives ``part_chars``, a
   longer document comes out as several consecutive ``part`` rows whose texts, joined
   with the separator, are the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, sentences, trim_ws, word_count

BLOCK_ROWS = 256
#: Blocks whose summaries are folded by one task at a time.
SPAN_BLOCKS = 256
#: More characters than a row can hold: no document is cut into parts.
ONE_ROW = 1 << 31


def _take(arr: Column, n: int) -> Column:
    return trim_ws(F.array_join(F.slice(arr, 1, n), " "))


def _last(arr: Column, n: int) -> Column:
    start = F.greatest(F.size(arr) - (n - 1), F.lit(1))
    return trim_ws(F.array_join(F.slice(arr, start, F.lit(n)), " "))


def _loss(entry: Column, size: Column, same2: Column, same1: Column) -> Column:
    """Leading sentences a piece loses, given how many its predecessor lost.

    ``size`` is the predecessor's sentence count, ``same2``/``same1`` whether its last
    two/one sentences equal the first ones of this piece.
    """
    left = size - entry
    return F.when(same2 & (left >= 2), F.lit(2)).when(same1 & (left >= 1), F.lit(1)).otherwise(0)


def _summaries(pieces: Column) -> Column:
    def one(text: Column) -> Column:
        return let(
            sentences(text),
            lambda s: F.struct(
                text.alias("text"),
                F.size(s).alias("n"),
                _take(s, 1).alias("h1"),
                _take(s, 2).alias("h2"),
                _last(s, 1).alias("t1"),
                _last(s, 2).alias("t2"),
            ),
        )

    return F.transform(pieces, one)


def _loss_between(entry: Column, prev: Column, cur: Column) -> Column:
    same2 = (cur["n"] >= 2) & (prev["t2"] == cur["h2"])
    same1 = (cur["n"] >= 1) & (prev["t1"] == cur["h1"])
    return _loss(entry, prev["n"], same2, same1)


def _losses(parts: Column, entry: Column, max_overlap: int) -> Column:
    """Loss of every piece of a block when the first piece loses ``entry``."""
    start = F.array(entry.cast("int"))
    if max_overlap == 0:
        return F.transform(parts, lambda _: F.lit(0))

    def step(acc: Column, i: Column) -> Column:
        loss = _loss_between(
            F.element_at(acc, -1), F.element_at(parts, i), F.element_at(parts, i + 1)
        )
        return F.concat(acc, F.array(loss))

    return F.when(F.size(parts) <= 1, start).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), start, step
        )
    )


def _cut(part: Column, loss: Column) -> Column:
    rest = let(
        sentences(part["text"]),
        lambda s: F.array_join(F.slice(s, loss + 1, F.size(s)), " "),
    )
    return F.when(loss > 0, rest).otherwise(part["text"])


def assemble(
    df: DataFrame,
    *,
    id_col: str | list[str] = "doc_id",
    order_col: str = "chunk_index",
    text_col: str = "text",
    separator: str = "\n\n",
    max_overlap: int = 2,
    trim: bool = True,
    block_rows: int = BLOCK_ROWS,
    span_blocks: int = SPAN_BLOCKS,
    part_chars: int | None = None,
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """(id, part, text, pieces): ordered join of the rows of every id.

    A document is one row, unless ``part_chars`` asks for parts of about that length.
    ``totals`` adds figures of all rows of an id, blank ones too, from the same grouping:
    name -> (``sum`` or ``max``, column of whole numbers); not together with parts.

    ``order_col`` is an integer that is unique within an id.  Blank rows are skipped; a
    document of one row keeps its text untouched when ``trim`` is set.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    totals = totals or {}
    if totals and part_chars:
        raise ValueError("totals are of whole documents, not of parts")
    def block_of(order: Column) -> Column:
        return F.coalesce(F.floor(order / F.lit(block_rows)).cast("long"), F.lit(0).cast("long"))

    # The key is one struct, which is never null: a join on it adds no test for null below
    # the grouping in one branch only, which would break the reuse of its shuffle.
    key = F.struct(*[F.col(c).alias(c) for c in ids]).alias("key")
    on = ["key", "block"]
    raw = F.coalesce(F.col(text_col), F.lit(""))
    blocks = (
        df.groupBy(key, block_of(F.col(order_col)).alias("block"))
        .agg(
            F.array_sort(
                # totals lie beside the texts, or the branches below would not share one shuffle
                F.collect_list(
                    F.struct(
                        F.col(order_col).alias("o"),
                        raw.alias("t"),
                        *[c.cast("long").alias(f"_{n}") for n, (_, c) in totals.items()],
                    )
                )
            ).alias("rows")
        )
        .select(
            *on,
            block_of(F.col("rows")["o"][0]).alias("nth"),
            F.col("rows")["t"].alias("rows"),
            *[_total(F.col("rows")[f"_{n}"], kind).alias(n) for n, (kind, _) in totals.items()],
        )
    )
    kept = F.col("rows")
    if trim:
        kept = F.filter(F.transform(kept, trim_ws), lambda t: t != "")
    else:
        kept = F.filter(kept, lambda t: t != "")
    if max_overlap:
        parts = _summaries(kept)
    else:
        parts = F.transform(kept, lambda t: F.struct(t.alias("text")))
    # Documents with one block only have entry 0 and part 0; only the others need the fold.
    # All branches read the same columns of the same grouping, so its shuffle is reused;
    # the slim key table decides which blocks are summarised at all: those beyond block 0 and
    # the block 0 of their documents, so only they are dealt out for it, not every key.
    # (Inner joins on unique keys: a semi join would be pushed below the grouping and break
    # the reuse, and so would a test of the grouped block number; ``nth`` is the same number,
    # read from the rows.) Sentences are taken apart after the join, so no branch does it for
    # blocks it drops.
    both = F.explode(F.array(F.lit(0).cast("long"), "block")).alias("block")
    needed = blocks.filter(F.col("nth") != 0).select("key", both).distinct()
    summary = blocks.join(needed, on).withColumn("parts", parts).select(
        *[F.col("key")[c].alias(c) for c in ids],
        "block",
        F.size("parts").alias("n"),
        F.aggregate(
            "parts", F.lit(0).cast("long"), lambda acc, p: acc + F.length(p["text"])
        ).alias("chars"),
        *_block_edges(max_overlap),
    )
    folded = _fold_blocks(summary, ids, max_overlap, part_chars or ONE_ROW, span_blocks)
    entries = folded.select(key, F.coalesce("block", F.lit(0)).alias("block"), "entry", "part")

    def joined_text(entry: Column) -> Column:
        """Text of one block; null when the block has no piece."""
        if max_overlap:
            texts = F.zip_with("parts", _losses(F.col("parts"), entry, max_overlap), _cut)
        else:
            texts = F.col("parts")["text"]
        return F.when(F.size("parts") > 0, F.array_join(texts, separator))

    # One block: the document is finished where its block is, without another shuffle.
    # (A left join and a null test: an anti join would be pushed below the grouping.)
    alone = blocks.join(entries, on, "left").filter(F.col("entry").isNull()).withColumn("parts", parts)
    text = F.coalesce(joined_text(F.lit(0)), F.lit(""))
    if trim:
        text = F.when(F.size("rows") == 1, F.element_at("rows", 1)).otherwise(text)
    short = alone.select(
        "key.*",
        F.lit(0).alias("part"),
        text.alias("text"),
        F.size("parts").alias("pieces"),
        *totals,
    )
    # Several blocks: finished blocks are joined per part.
    long = (
        blocks.join(entries, on)
        .withColumn("parts", parts)
        .select(
            "key",
            "part",
            "block",
            F.size("parts").alias("pieces"),
            joined_text(F.col("entry")).alias("text"),
            F.when(F.size("rows") == 1, F.element_at("rows", 1)).alias("single"),
            *totals,
        )
        .groupBy("key", "part")
        .agg(
            F.array_sort(F.collect_list(F.struct("block", "text"))).alias("blocks"),
            F.sum("pieces").cast("int").alias("pieces"),
            F.max("single").alias("single"),
            *[(F.sum if kind == "sum" else F.max)(n).alias(n) for n, (kind, _) in totals.items()],
        )
    )
    whole = F.array_join(F.filter(F.col("blocks")["text"], lambda t: t.isNotNull()), separator)
    if trim:  # a document of one row whose order number lies beyond the first block
        only = (F.col("part") == 0) & (F.size("blocks") == 1) & F.col("single").isNotNull()
        whole = F.when(only, F.col("single")).otherwise(whole)
    long = long.select("key.*", "part", whole.alias("text"), "pieces", *totals)
    return short.unionByName(long)


def _total(values: Column, kind: str) -> Column:
    if kind == "max":
        return F.array_max(values)
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + F.coalesce(v, F.lit(0)))


def _block_edges(max_overlap: int) -> list[Column]:
    if not max_overlap:
        return []
    parts = F.col("parts")
    first, last = F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-1))
    exits = [
        F.try_element_at(_losses(parts, F.lit(k), max_overlap), F.lit(-1)).alias(f"exit{k}")
        for k in (0, 1, 2)
    ]
    return [
        first["n"].alias("n_first"),
        first["h1"].alias("h1"),
        first["h2"].alias("h2"),
        last["n"].alias("n_last"),
        last["t1"].alias("t1"),
        last["t2"].alias("t2"),
        *exits,
    ]


def _entry(prev: dict | None, loss: int, row: dict) -> int:
    """Leading sentences ``row`` loses after ``prev``, which itself lost ``loss``."""
    if prev is None:
        return 0
    left = prev["n_last"] - loss
    if left >= 2 and row["n_first"] >= 2 and prev["t2"] == row["h2"]:
        return 2
    return int(left >= 1 and row["n_first"] >= 1 and prev["t1"] == row["h1"])


_EDGES = ["n_first", "h1", "h2", "n_last", "t1", "t2", "exit0", "exit1", "exit2"]


def _fold_blocks(
    summary: DataFrame, ids: list[str], max_overlap: int, part_chars: int, span_blocks: int
) -> DataFrame:
    """Entry and part number of every block.

    Both passes hold one summary at a time: they stream over sorted Arrow batches.
    """
    fields = [f for f in summary.schema.fields if f.name in ids]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    span = F.floor(F.col("block") / F.lit(span_blocks)).cast("long")
    spans = summary.withColumn("span", span).repartition(*ids, "span")
    folded = spans.sortWithinPartitions(*ids, "span", "block").mapInPandas(
        _span_fold(ids, max_overlap),
        f"{names}, span long, block long, entries array<int>, before long, n int, "
        "n_first int, h1 string, h2 string, n_last int, t1 string, t2 string, "
        "exit0 int, exit1 int, exit2 int",
    )
    # a span's own row has no block; its ``before`` is the length of the whole span
    whole = folded.filter(F.col("block").isNull()).drop("block", "entries")
    starts = (
        whole.repartition(*ids)
        .sortWithinPartitions(*ids, "span")
        .mapInPandas(_compose_spans(ids, max_overlap), f"{names}, span long, entry int, ahead long")
    )
    return (
        folded.filter(F.col("block").isNotNull())
        .select(*ids, "span", "block", "entries", "before")
        .join(starts, [*ids, "span"])
        .select(
            *ids,
            "block",
            F.get("entries", F.col("entry")).alias("entry"),
            F.floor((F.col("ahead") + F.col("before")) / F.lit(part_chars)).cast("int").alias("part"),
        )
    )


def _span_fold(ids: list[str], max_overlap: int):
    """Folds the blocks of every span for each entry its first piece may have."""
    columns = [*ids, "span", "block", "entries", "before", "n", *_EDGES]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, last, losses, chars, n = None, None, None, [0, 0, 0], 0, 0

        def whole() -> tuple:
            none = first is None or not max_overlap
            edges = [None] * 6 if none else [first[c] for c in _EDGES[:3]] + [last[c] for c in _EDGES[3:6]]
            return (*key, None, None, chars, n, *edges, *(losses if not none else [0, 0, 0]))

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                k = (*(row[c] for c in ids), row["span"])
                if k != key:
                    if key is not None:
                        out.append(whole())
                    key, first, last, losses, chars, n = k, None, None, [0, 0, 0], 0, 0
                entries = [0, 0, 0]
                if max_overlap and row["n"] > 0:
                    entries = [0, 1, 2] if first is None else [_entry(last, x, row) for x in losses]
                    losses = [int(row[f"exit{e}"]) for e in entries]
                    first, last = first or row, row
                out.append((*k, row["block"], entries, chars, int(row["n"]), *[None] * len(_EDGES)))
                chars, n = chars + int(row["chars"]), n + int(row["n"])
            yield pd.DataFrame(out, columns=columns)
        if key is not None:
            yield pd.DataFrame([whole()], columns=columns)

    return fold


def _compose_spans(ids: list[str], max_overlap: int):
    """The entry and the length ahead of every span, from one row per span in order."""

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, prev, loss, chars = None, None, 0, 0
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                k = tuple(row[c] for c in ids)
                if k != key:
                    key, prev, loss, chars = k, None, 0, 0
                entry = 0
                if max_overlap and row["n"] > 0:
                    entry = _entry(prev, loss, row)
                    prev, loss = row, int(row[f"exit{entry}"])
                out.append((*k, row["span"], entry, chars))
                chars += int(row["before"])
            yield pd.DataFrame(out, columns=[*ids, "span", "entry", "ahead"])

    return compose


def assemble_chunks(
    df: DataFrame,
    *,
    id_col: str | list[str] = "doc_id",
    order_col: str = "chunk_index",
    text_col: str = "text",
    max_overlap: int = 2,
    **limits,
) -> DataFrame:
    """Chunks to documents: trimmed, blank chunks skipped, repeated sentences dropped."""
    return assemble(
        df,
        id_col=id_col,
        order_col=order_col,
        text_col=text_col,
        max_overlap=max_overlap,
        **limits,
    )


def assemble_pages(
    df: DataFrame,
    *,
    job_col: str = "job_id",
    page_col: str = "page_num",
    text_col: str = "source_text",
    skip_blank: bool = True,
    **limits,
) -> DataFrame:
    """Pages to jobs, in page order, texts untouched; blank pages are left out.

    With ``skip_blank=False`` only empty pages are left out (whitespace counts as text).
    """
    pages = df
    if skip_blank:
        pages = df.withColumn(
            text_col, F.when(trim_ws(text_col) != "", F.col(text_col)).otherwise("")
        )
    return assemble(
        pages,
        id_col=job_col,
        order_col=page_col,
        text_col=text_col,
        max_overlap=0,
        trim=False,
        **limits,
    )


def assemble_book(
    df: DataFrame,
    *,
    book_col: str = "book_id",
    chapter_col: str = "chapter_index",
    text_col: str = "output",
    **limits,
) -> DataFrame:
    """Chapters to books, in chapter order; chapters without text are left out."""
    chapters = df.withColumn(chapter_col, F.coalesce(F.col(chapter_col), F.lit(0)))
    return assemble(
        chapters,
        id_col=book_col,
        order_col=chapter_col,
        text_col=text_col,
        max_overlap=0,
        trim=False,
        **limits,
    )


def final_word_count(text_col: str = "text") -> Column:
    return word_count(text_col)
