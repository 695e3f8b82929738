"""Corrections log, quality summaries and invariants of enforcement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, explode_indexed, let
from .enforce import enforced_text
from .rules import RuleBook

# Report categories in display order.
CATEGORY_ORDER = [
    "Terminology",
    "Forbidden Vocab",
    "Hedging",
    "Historical Names",
    "Place Names",
    "Date Format",
    "Punctuation",
    "Diacritics",
    "Other",
]

# Label fragments that decide the category.
_PLACES = [
    "province", "pipalana", "chanasad", "bamangaon", "dholiya", "dungara", "bhadarod",
    "chokshi", "saurashtra",
]
_NAMES = ["bhilalbhai", "narayanda", "naranda"]


def corrections_log(df: DataFrame, *, id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(ids, seq, from, to, rule, count): one row per rule that fired in a document."""
    rows = explode_indexed(df, "corrections", list(id_cols), "seq", "c", "n")
    return rows.select(*id_cols, "seq", *[F.col("c")[f].alias(f) for f in ("from", "to", "rule", "count")])


def categorise(rule: Column | str, strict_reference: bool = False) -> Column:
    """Category of a correction label.

    The diacritics label contains the word "forbidden"; it is tested first so that those
    corrections land in their own category.  ``strict_reference`` keeps the historic
    order, which files them under the forbidden vocabulary.
    """
    label = F.lower(F.coalesce(as_col(rule), F.lit("")))

    def has(*words: str) -> Column:
        return F.rlike(label, F.lit("|".join(words)))

    diacritics = (has("diacritics", "diacritical"), "Diacritics")
    tests = [(has("forbidden"), "Forbidden Vocab"), (has("hedging"), "Hedging")]
    tests = [*tests, diacritics] if strict_reference else [diacritics, *tests]
    tests += [
        (has("quotes", "dash"), "Punctuation"),
        (has("date"), "Date Format"),
        (has(*_PLACES), "Place Names"),
        (has(*_NAMES), "Historical Names"),
    ]
    out = F.when(*tests[0])
    for condition, name in tests[1:]:
        out = out.when(condition, name)
    return out.otherwise("Terminology")


def category_rank(category: Column | str) -> Column:
    order = F.array(*[F.lit(c) for c in CATEGORY_ORDER])
    return F.array_position(order, as_col(category)).cast("int")


def qa_summary(
    log: DataFrame, *, by: Sequence[str] = ("doc_id",), strict_reference: bool = False
) -> DataFrame:
    """Corrections per category; groups without corrections have no rows."""
    labelled = log.withColumn("category", categorise("rule", strict_reference))
    return (
        labelled.groupBy(*by, "category")
        .agg(F.sum("count").alias("fixes"), F.count(F.lit(1)).alias("entries"))
        .withColumn("category_rank", category_rank("category"))
    )


def top_rules(log: DataFrame, k: int = 10) -> DataFrame:
    """Corpus roll-up: the ``k`` rules with the most fixes."""
    totals = log.groupBy("rule").agg(
        F.sum("count").alias("fixes"), F.count(F.lit(1)).alias("documents")
    )
    return totals.orderBy(F.desc("fixes"), "rule").limit(k)


def idempotency_check(
    df: DataFrame, book: RuleBook | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents whose enforced text changes when it is enforced again.

    The pair comes out of an outer explode: a filter on the texts themselves would be pushed
    below the projection, where every text is enforced again for each mention.
    """

    def changed(once: Column) -> Column:
        pair = lambda twice: F.when(once != twice, F.struct(once.alias("once"), twice.alias("twice")))
        return let(enforced_text(once, book), pair)

    pairs = df.select(id_col, F.explode_outer(F.array(let(enforced_text(text_col, book), changed))).alias("__pair"))
    return pairs.filter(F.col("__pair").isNotNull()).select(id_col, "__pair.once", "__pair.twice")


def length_drift(before: Column | str, after: Column | str) -> Column:
    """Relative change of length; null for empty text."""
    a, b = F.length(as_col(before)), F.length(as_col(after))
    return F.when(a > 0, F.abs(b - a) / a)


def flags_count(chunks: Column | str) -> Column:
    """Flags over all chunks of a document."""
    return F.aggregate(
        as_col(chunks),
        F.lit(0),
        lambda acc, c: acc + F.greatest(F.coalesce(F.size(c["flags"]), F.lit(0)), F.lit(0)),
    )
