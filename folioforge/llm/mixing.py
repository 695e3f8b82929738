"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / weight`` from a hash of its id and
text, so a rerun or a lost executor draws the same keys. A source's target is met by
whole epochs first; the rest is filled with the documents of smallest key, up to the
document whose middle still lies within the rest.

The prefix sum is never taken over a whole source: keys fall into ordered buckets whose
totals are added up first, and only the bucket in which a source's budget ends is sorted.
Buckets are equal steps of the key's logarithm. A weight only shifts that logarithm, so
whatever the weights are, no bucket is expected to hold more than 1 of 4077 documents of a
source, and a source has some ten thousands of buckets at most.

Defined cases: null and empty texts have size 0 and are taken 0 words; a null source is a
source of its own and comes last; rows that repeat id and text share their key and their
fate; an empty table gives an empty result. Columns of the input named like a result
column give way to it; all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import n_words, staged, table
from folioforge.llm.registry import query

#: Weights of the sources in order of their names, repeating; share of all words that the
#: mix holds; most epochs of a source; seed; key buckets for each factor of e in the key.
WEIGHTS, SHARE, MOST, SEED, BUCKETS = (5, 2, 1), (3, 2), 2, 17, 1500
SYMBOLS = "#*$%&|<>!"


def text_weight(text: Column, size: Column) -> Column:
    """A document's quality weight in (0, 1]: fewer symbols per word weigh more."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(1.0) / (1.0 + symbols / F.greatest(size, F.lit(1)))


def measured(docs: DataFrame, seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """``docs`` plus ``size``, the exponential key and its tie-breaker."""
    identity = F.concat_ws(
        ":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))
    )
    # 52 bits of the hash, moved off 0 by half a step
    u = (F.conv(F.substring("mix_tie", 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    weight = text_weight(F.col("text"), F.col("size")) if weight is None else weight
    return (
        docs.withColumn("size", n_words(F.col("text")))
        .withColumn("mix_tie", F.md5(identity))
        .withColumn("mix_key", -F.log(u) / weight)
    )


def key_bucket(buckets: int) -> Column:
    """Number of the ordered bucket a key lies in."""
    return F.floor(F.log("mix_key") * buckets)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST
) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Targets follow the weights of the sources in order of their names. One that would
    pass ``most`` times its source's size stops there, and the others share the excess by
    weight. That is one water level: with the sources in order of size per weight, those
    before some place are full and the rest get the level times their weight.
    """
    if share[0] > most * share[1]:
        raise ValueError("the share asks for more epochs than any source may give")
    cycle = F.array(*[F.lit(w) for w in weights])
    named = sizes.withColumn(
        "n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", F.get(cycle, F.col("n") % len(weights)))
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")), "n")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * share[0] / share[1]
    full = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    level = (budget - full) / F.sum("weight").over(onward)
    leveled = named.withColumn("level", level).withColumn(
        "open", F.col("level") <= F.col("source_size") * most / F.col("weight")
    )
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(everything)
    opened = F.max(F.col("open").cast("int")).over(by_fill.rowsBetween(Window.unboundedPreceding, 0)) == 1
    target = F.when(opened, F.least(first * F.col("weight"), F.col("source_size") * F.lit(float(most))))
    return leveled.select(
        "source", "source_size", F.coalesce(target, F.col("source_size") * F.lit(float(most))).alias("target")
    )


def source_cuts(sized: DataFrame, buckets: int = BUCKETS, **targets) -> DataFrame:
    """Per source: source_size, target, epochs, and the last key (with its tie-breaker)
    that the fractional selection takes; a null key if it takes none.

    ``sized`` holds source, size, mix_key, mix_tie; it is read three times.
    """
    bucketed = sized.withColumn("bucket", key_bucket(buckets))
    totals = staged(bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    plan = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), **targets)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    plan = staged(plan)
    within = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("offset", F.coalesce(F.sum("words").over(within), F.lit(0)))
    ending = (
        before.join(plan, before["source"].eqNullSafe(plan["source"]))
        .where((F.col("rest") > 0) & (F.col("offset") <= F.col("rest")))
        .groupBy(before["source"])
        .agg(F.max(F.struct("bucket", "offset", "rest")).alias("last"))
        .select("source", "last.*")
    )
    # the bucket in which the budget ends, and the one before it for a cut at its very start
    ending = staged(ending)
    inside = (
        bucketed.join(
            ending.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "rest"),
            bucketed["source"].eqNullSafe(F.col("s")) & (bucketed["bucket"] == F.col("b")),
        )
        .select("source", "bucket", "offset", "rest", "size", "mix_key", "mix_tie")
    )
    by_key = Window.partitionBy("source", "bucket").orderBy("mix_key", "mix_tie")
    taken_to = F.col("offset") + F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        inside.withColumn("upto", taken_to)
        .where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("mix_key", "mix_tie")).alias("cut"))
    )
    last = ending.select(F.col("source").alias("e_source"), F.col("bucket").alias("cut_bucket"))
    return staged(
        plan.join(last, F.col("source").eqNullSafe(F.col("e_source")), "left")
        .join(cut.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source")), "left")
        .select(
            F.col("source").alias("cut_source"),
            "source_size",
            "target",
            "epochs",
            "cut_bucket",
            F.col("cut.mix_key").alias("cut_key"),
            F.col("cut.mix_tie").alias("cut_tie"),
        )
    )


def mix(sized: DataFrame, cuts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``sized`` (see :func:`measured`) plus source_size, target, copies and taken."""
    bucket = key_bucket(buckets)
    below = (bucket < F.col("cut_bucket")) | (
        (F.col("mix_key") < F.col("cut_key"))
        | ((F.col("mix_key") == F.col("cut_key")) & (F.col("mix_tie") <= F.col("cut_tie")))
    )
    copies = F.col("epochs") + F.coalesce(below, F.lit(False)).cast("long")
    clash = [c for c in ("source_size", "target", "copies", "taken") if c in sized.columns]
    return (
        sized.drop(*clash)
        .join(cuts, F.col("source").eqNullSafe(F.col("cut_source")))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("mix_key", "mix_tie", "cut_source", "epochs", "cut_bucket", "cut_key", "cut_tie")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as the mix takes it."""
    narrow = measured(docs.select("doc_id", "source", "text")).select("source", "size", "mix_key", "mix_tie")
    cuts = source_cuts(staged(narrow))
    own = [F.col(c).alias(f"in_{c}") for c in docs.columns]
    again = mix(measured(docs.select(*own, "doc_id", "source", "text")), cuts)
    return (
        again.where(F.col("copies") > 0)
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
        .select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
    )


MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)) AS tie,
             (length(text) - length(translate(text, '{SYMBOLS}', '')))::DOUBLE AS symbols FROM d),
x AS (SELECT doc_id, source, size, tie,
             -ln((('0x' || substr(tie, 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}.0::DOUBLE)
               / (1.0::DOUBLE / (1.0::DOUBLE + symbols / greatest(size, 1))) AS key FROM k),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
f AS (SELECT *, (sum(source_size) OVER () * {SHARE[0]} / {SHARE[1]}
                 - coalesce(sum(source_size * {MOST}) OVER (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY source_size / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT *, first_value(CASE WHEN level <= source_size * {MOST} / weight THEN level END IGNORE NULLS)
                OVER (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM f),
p AS (SELECT source, source_size::BIGINT AS source_size,
             least(water * weight, source_size * {MOST}) AS target FROM l),
e AS (SELECT x.*, p.source_size, p.target,
             CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size)::BIGINT ELSE 0 END AS epochs,
             sum(size) OVER (PARTITION BY x.source ORDER BY key, tie ROWS UNBOUNDED PRECEDING) AS upto
      FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, target - epochs * source_size AS rest FROM e),
z AS (SELECT *, max(CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN upto END) OVER (PARTITION BY source) AS cut FROM c)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN upto <= cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM z
"""


@query("op4_mixing", MIXING_SQL)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    sized = staged(measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return mix(sized, source_cuts(sized)).select("doc_id", "size", "source_size", "target", "taken")
