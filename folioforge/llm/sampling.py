"""Bounded samples of labelled documents, the only rows that model fitting collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import staged


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def text_slice(text: Column, key: Column, chars: int) -> Column:
    """``text``, or of a longer one ``chars`` code points from a place drawn by ``key``."""
    room = F.length(text) - chars
    start = F.when(room > 0, F.pmod(F.xxhash64(key, F.lit(3)), room + 1)).otherwise(0)
    return F.substring(text, (start + 1).cast("int"), F.lit(chars))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_label: int, chars: int
) -> tuple[list[tuple[str, object]], dict[object, int]]:
    """About ``per_label`` (text, label) pairs of each label, never more than twice as
    many in all, and how many rows carry each label.

    ``labels`` holds doc_id and ``label``; rows with a null label or outside ``usable``
    never count. A document is drawn if the hash of its id falls under its label's rate,
    so drawing needs no shuffle by label, and a rerun draws the same. Only drawn texts
    are collected, at most ``chars`` code points each; an id with two labels keeps the
    larger one.
    """
    known = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).alias("label")
    )
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return [], {}
    rates = F.create_map(*[F.lit(x) for k, n in sorted(totals.items()) for x in (k, min(1.0, per_label / n))])
    drawn_by = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = staged(
        known.where(drawn_by < F.element_at(rates, F.col("label"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    rows = (
        docs.select("doc_id", "text")
        .join(drawn, "doc_id")
        .where(F.col("text").isNotNull())
        .select("doc_id", "label", text_slice(F.col("text"), F.col("doc_id"), chars).alias("text"))
        .limit(2 * per_label * len(totals))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [(r["text"], r["label"]) for r in rows], totals
