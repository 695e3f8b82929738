"""Stage chains: chunk -> model -> parse -> enforce -> (smooth) -> assemble -> enforce.

The model is the caller's: a function from a request table to the same table with a
``raw`` column, or a table of responses made elsewhere.  Apart from the model every step
is a narrow projection.  One shuffle re-assembles documents and counts their chunks and
flags; the documents that failed are a small written table, which Spark broadcasts while
it is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import preview, trim_ws, word_count
from ..operators.assemble import assemble, assemble_chunks
from ..operators.chunk import blank_documents, chunk_documents
from ..operators.enforce import enforce, enforced_text, preserve_macrons
from ..operators.ledger import HASH, OUTPUT, text_hash, with_finished
from ..operators.responses import annotate_responses
from ..operators.rules import RuleBook
from ..session import cut_lineage, written

Model = Callable[[DataFrame], DataFrame] | DataFrame

INSTRUCTIONS = {
    "translator": "Translate the following text. Output only <translation> and <flags>.",
    "smoother": "Smooth the following passage. Output only <smoothed>.",
    "transliterator": "Transliterate the following text. Output only <transliteration>.",
}


#: Of a page: no other row has its key.
_ALONE = "__alone"


@dataclass
class FlowResult:
    documents: DataFrame
    chunks: DataFrame
    rejects: DataFrame
    #: By page: the pages this run finished, also those of failed jobs, as ledger rows.
    pages: DataFrame | None = None


def build_requests(
    chunks: DataFrame,
    stage: str,
    *,
    text_col: str = "text",
    instruction: str | None = None,
    label: str = "SOURCE",
) -> DataFrame:
    """Add ``stage`` and ``prompt`` to a chunk table."""
    order = instruction or INSTRUCTIONS[stage]
    if stage == "smoother":
        prompt = F.concat(F.lit(f"{order}\n\n"), F.col(text_col))
    else:
        prompt = F.concat(
            F.format_string(
                "Chunk %d of %d. ", F.col("chunk_index") + F.lit(1), F.col("chunk_count")
            ),
            F.lit(f"{order}\n\n{label}:\n"),
            F.col(text_col),
        )
    return chunks.withColumn("stage", F.lit(stage)).withColumn("prompt", prompt)


def batch_model(fn: Callable[[pd.Series], pd.Series]) -> Callable[[DataFrame], DataFrame]:
    """A model from a function over batches of prompts (runs in Arrow batches)."""

    def model(requests: DataFrame) -> DataFrame:
        schema = T.StructType([*requests.schema.fields, T.StructField("raw", T.StringType())])

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(raw=fn(pdf["prompt"]))

        return requests.mapInPandas(call, schema)

    return model


def apply_model(
    requests: DataFrame, model: Model, *, keys: list[str], materialise: bool
) -> DataFrame:
    """Responses for requests: call the model, or join a table of responses.

    Model calls are expensive and feed several outputs, so their result is written once
    to the checkpoint folder unless ``materialise`` is off.  A request may be answered
    more than once in a table; answers that differ count as none.
    """
    if isinstance(model, DataFrame):
        on = [*keys, "chunk_index", "stage"]
        # a chunk answered twice in different words has no answer; equal answers are one
        one = F.when(F.min("raw") == F.max("raw"), F.min("raw")).alias("raw")
        return requests.join(model.groupBy(*on).agg(one), on, "left")
    answered = model(requests)
    return cut_lineage(answered) if materialise else answered


def _stage(
    chunks: DataFrame,
    stage: str,
    model: Model,
    *,
    keys: list[str],
    text_col: str,
    lenient: bool | str,
    materialise: bool,
    cut: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Chunk rows with ``out``, ``out_flags`` and ``out_error`` of one model stage.

    What is written is the parsed answer, so that none of its readers parses it again.
    """
    keep = chunks.columns
    requests = build_requests(chunks, stage, text_col=text_col)
    answered = apply_model(requests, model, keys=keys, materialise=False)
    held = answered.select(*[F.col(c).alias(f"__{c}") for c in keep], "stage", "raw")
    parsed = annotate_responses(held, lenient=lenient, stages=[stage])
    rows = parsed.select(
        *[F.col(f"__{c}").alias(c) for c in keep],
        F.col("text").alias("out"),
        F.col("flags").alias("out_flags"),
        F.col("error").alias("out_error"),
    )
    return cut(rows) if materialise else rows


def _packed(df: DataFrame) -> DataFrame:
    """:func:`..session.written` in few bytes: pages are many, short and written more than once."""
    return written(df, compression="zstd")


def with_fallback(smoothed: Column, fallback: Column) -> tuple[Column, Column]:
    """(text, fell back): the previous text where the stage gave none."""
    return F.coalesce(smoothed, fallback), smoothed.isNull()


def macron_flag(restored: Column) -> Column:
    """The note a chunk gets when macrons were put back; null when none were."""
    s = F.when(restored == 1, F.lit("")).otherwise(F.lit("s"))
    return F.when(
        restored > 0,
        F.concat(
            F.lit("Smoother stripped "),
            restored.cast("string"),
            F.lit(" macron"),
            s,
            F.lit(" from verse transliteration"),
            s,
            F.lit(" — auto-restored from translator output."),
        ),
    )


def _rejects(df: DataFrame, keys: list[str], text_col: str, failed: DataFrame, what: str):
    empty = blank_documents(df, text_col).select(
        *keys, F.lit(f"No content to {what}").alias("error")
    )
    return empty.unionByName(failed)


def _failed(rows: DataFrame, keys: list[str], materialise: bool) -> DataFrame:
    """One failed chunk fails its document; the first failing chunk is reported."""
    failed = (
        rows.filter(F.col("out_error").isNotNull())
        .groupBy(*keys)
        .agg(F.min_by("out_error", "chunk_index").alias("error"))
    )
    return written(failed) if materialise else failed


def translate_flow(
    df: DataFrame,
    model: Model,
    book: RuleBook | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    profile: str = "full",
    guard_macrons: bool = True,
    enforce_fallback: bool = True,
    lenient: bool | str = False,
    materialise: bool = True,
    **chunking,
) -> FlowResult:
    """Translate documents; see :func:`secondary_flow` for the variant on assembled pages."""
    keys = [id_col]
    rules = book or RuleBook.default()
    options = {"keys": keys, "lenient": lenient, "materialise": materialise}
    chunks = chunk_documents(df, id_col=id_col, text_col=text_col, **chunking).drop("words")
    first = _stage(chunks, "translator", model, text_col="text", **options)
    failed = _failed(first, keys, materialise)
    good = first.filter(F.col("out_error").isNull()).join(failed, keys, "left_anti")
    translated = good.select(
        *keys,
        "chunk_index",
        "chunk_count",
        F.col("text").alias("original"),
        enforced_text("out", rules, profile).alias("translated"),
        F.col("out_flags").alias("flags"),
    )
    second = _stage(translated, "smoother", model, text_col="translated", **options)
    text, fell_back = with_fallback(F.col("out"), F.col("translated"))
    smoothed = second.withColumn("smoothed", text).withColumn("fallback", fell_back)
    if guard_macrons:
        smoothed = preserve_macrons(
            smoothed, "translated", "smoothed", text_col="smoothed", restored_col="restored"
        )
    else:
        smoothed = smoothed.withColumn("restored", F.lit(0))
    note = macron_flag(F.col("restored"))
    final = enforced_text("smoothed", rules, profile)
    if not enforce_fallback:
        final = F.when(F.col("fallback"), F.col("smoothed")).otherwise(final)
    done = smoothed.select(
        *keys,
        "chunk_index",
        "chunk_count",
        "original",
        final.alias("translation"),
        F.when(note.isNotNull(), F.array_append("flags", note))
        .otherwise(F.col("flags"))
        .alias("flags"),
        "fallback",
        "restored",
    )
    joined = assemble_chunks(
        done,
        id_col=id_col,
        text_col="translation",
        totals={
            "chunk_count": ("max", F.col("chunk_count")),
            "flags_count": ("sum", F.size("flags")),
        },
    )
    documents = enforce(joined, rules, profile, audit=True).select(
        *keys,
        "part",
        F.col("text").alias("output"),
        word_count("text").alias("output_word_count"),
        "corrections",
        "total_fixes",
        F.col("chunk_count").cast("int").alias("chunk_count"),
        "flags_count",
    )
    return FlowResult(documents, done, _rejects(df, keys, text_col, failed, "translate"))


def secondary_flow(df: DataFrame, model: Model, book: RuleBook | None = None, **options):
    """Translation of assembled pages: no macron guard, fallback text is kept as it is."""
    return translate_flow(
        df, model, book, guard_macrons=False, enforce_fallback=False, **options
    )


def transliterate_flow(
    df: DataFrame,
    model: Model,
    book: RuleBook | None = None,
    *,
    by: str = "document",
    id_col: str = "doc_id",
    page_col: str = "page_num",
    text_col: str = "text",
    profile: str = "full",
    lenient: bool | str | None = None,
    materialise: bool = True,
    finished: DataFrame | None = None,
    **chunking,
) -> FlowResult:
    """Transliterate documents, or pages that are joined to one document per job.

    By page, a page of one chunk is taken as it is; a failed page fails its job.  Pages
    that ``finished`` holds (see :mod:`..operators.ledger`) never reach the model: their
    stored output goes into the job's text as it is, and ``chunk_count`` counts the chunks
    of the other pages.  A page that is blank now but has a stored output keeps it.

    Pages are dealt out by their key once, to find those whose key occurs once; such a page
    of one chunk needs no assembly.  Only the others are shuffled to be put together.
    """
    rules = book or RuleBook.default()
    by_page = by == "page"
    if finished is not None and not by_page:
        raise ValueError("only pages can be resumed")
    keys = [id_col, page_col] if by_page else [id_col]
    piece, carried, todo = keys, keys, df
    if by_page:
        piece, carried = [*keys, HASH], [*keys, HASH, _ALONE]
        rows_of_key = F.count(F.lit(1)).over(W.partitionBy(*keys))
        df = with_finished(df, finished, keys, text_col=text_col).select(
            *keys,
            F.when(F.col(OUTPUT).isNull(), F.col(text_col)).alias(text_col),
            OUTPUT,
            (rows_of_key == 1).alias(_ALONE),
        )
        if finished is not None and materialise:  # read three times below
            df = _packed(df)
        todo = df.filter(F.col(OUTPUT).isNull()).withColumn(HASH, text_hash(F.col(text_col)))
    chunks = chunk_documents(todo, id_col=carried, text_col=text_col, **chunking).drop("words")
    answered = _stage(
        chunks,
        "transliterator",
        model,
        keys=keys,
        text_col="text",
        lenient=by_page if lenient is None else lenient,
        materialise=materialise,
        cut=_packed if by_page else cut_lineage,
    )
    broken = failed = _failed(answered, keys, materialise)
    good = answered.filter(F.col("out_error").isNull())
    enforced = enforced_text("out", rules, profile).alias("transliteration")

    def whole(chunks: DataFrame, ids: list[str]) -> DataFrame:
        return chunks.select(
            *ids, "chunk_index", "chunk_count", F.col("text").alias("original"), enforced
        )

    def joined_chunks(chunks: DataFrame) -> DataFrame:
        return assemble_chunks(
            whole(chunks.join(broken, keys, "left_anti"), piece),
            id_col=piece,
            text_col="transliteration",
            totals={"chunk_count": ("sum", F.lit(1))},
        )

    pages = None
    if by_page:
        failed = broken.groupBy(id_col).agg(F.min_by("error", page_col).alias("error"))
        done = whole(good, keys).join(failed, id_col, "left_anti")
        # the only chunk of the only page with its key: no other row can be joined to it or break it
        simple = F.col(_ALONE) & (F.col("chunk_count") == 1)
        joined = joined_chunks(good.filter(~simple)).select(
            *piece,
            F.when(F.col("pieces") > 1, enforced_text("text", rules, profile))
            .otherwise(F.col("text"))
            .alias(OUTPUT),
            "chunk_count",
        )
        fresh = (
            whole(good.filter(simple), piece)
            .select(
                *piece,
                F.coalesce("transliteration", F.lit("")).alias(OUTPUT),
                F.lit(1).cast("long").alias("chunk_count"),
            )
            .unionByName(joined)
        )
        if materialise:  # finished pages are an output of their own and feed the job text
            fresh = _packed(fresh)
        pages = fresh.drop("chunk_count")
        stored = df.filter(F.col(OUTPUT).isNotNull()).select(
            *keys, OUTPUT, F.lit(0).cast("long").alias("chunk_count")
        )
        joined = assemble(
            fresh.drop(HASH).unionByName(stored)
            .withColumnRenamed(OUTPUT, "text")
            .withColumn(page_col, F.col(page_col).cast("long"))
            .join(failed, id_col, "left_anti"),
            id_col=id_col,
            order_col=page_col,
            max_overlap=0,
            trim=False,
            totals={"chunk_count": ("sum", F.col("chunk_count"))},
        )
    else:
        done, joined = whole(good.join(broken, keys, "left_anti"), keys), joined_chunks(good)
    documents = enforce(joined, rules, profile, audit=True).select(
        id_col, "part", F.col("text").alias("output"), "chunk_count", "total_fixes"
    )
    if by_page:  # a job of blank pages alone is done, with an empty text
        has_text = (trim_ws(F.coalesce(text_col, F.lit(""))) != "") | F.col(OUTPUT).isNotNull()
        blank = df.groupBy(id_col).agg(F.max(has_text).alias("__some")).where(~F.col("__some"))
        types = {f.name: f.dataType for f in documents.schema.fields}
        none = {"part": F.lit(0), "output": F.lit(""), "chunk_count": F.lit(0), "total_fixes": F.lit(0)}
        documents = documents.unionByName(
            blank.select(id_col, *[c.cast(types[n]).alias(n) for n, c in none.items()])
        )
    rejected = failed if by_page else _rejects(df, keys, text_col, failed, "transliterate")
    return FlowResult(documents, done, rejected, pages)


def chunk_progress(chunks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Stored progress rows: index, 200 characters of source, 300 of translation, flags."""
    return chunks.select(
        id_col,
        F.col("chunk_index").alias("index"),
        preview("original", 200).alias("original"),
        preview("translation", 300).alias("translation"),
        "flags",
    )


def page_text_source(pages: DataFrame) -> DataFrame:
    """Pages that carry text, ready for :func:`transliterate_flow` by page."""
    return pages.filter(trim_ws("source_text") != "").withColumnRenamed("source_text", "text")
