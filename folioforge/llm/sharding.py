"""Sharding by rendezvous hashing.

A record goes to the shard with the greatest score ``-weight / ln(u)``, where ``u`` is a
hash of the record's key and the shard's number. The key and the weights alone decide, so
a further shard takes records only into itself, a fair share of every other one.

Slots number the records of a shard from 0 without gaps. A shard is never numbered as a
whole: its records fall into sub-buckets that are numbered on their own, and the counts
of the earlier sub-buckets are added.

Defined cases: null and empty texts have no bytes and checksum 0; a null key is a key;
rows that repeat key and text go to one shard and get consecutive slots; an empty table
gives an empty result. Columns of the input named like a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import staged, table
from folioforge.llm.registry import query

SHARDS, EXTRA_BYTES, SUB_BUCKETS = 40, 16, 256
LAW = "key"


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard, from 0, that wins ``key``; equal scores go to the lower number."""

    def score(weight: Column, shard: Column) -> Column:
        # the upper 53 bits as a fraction inside (0, 1)
        u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + 0.5) / float(1 << 53)
        return F.struct((-weight / F.log(u)).alias("score"), (-shard).alias("shard"))

    scores = F.transform(F.array(*[F.lit(float(w)) for w in weights]), score)
    return (-F.array_max(scores)["shard"]).cast("int")


def placed(docs: DataFrame, weights: Sequence[float], grown_by: float = 1.0) -> DataFrame:
    """``docs`` plus size, text_crc32, law, shard and grown_shard (with one more shard of
    weight ``grown_by``)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(
        {
            "size": (F.octet_length(text) + EXTRA_BYTES).cast("long"),
            "text_crc32": F.crc32(text),
            "law": F.lit(LAW),
            "shard": rendezvous(F.col("doc_id"), weights),
            "grown_shard": rendezvous(F.col("doc_id"), [*weights, grown_by]),
        }
    )


def with_slots(records: DataFrame, sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """``records`` plus ``slot``; they are read twice, first for counts alone."""
    sub = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text_crc32", "size"), F.lit(sub_buckets))
    keyed = records.withColumn("shard_sub", sub)
    counts = keyed.groupBy("shard", "shard_sub").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("shard_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(
        counts.select(
            F.col("shard").alias("o_shard"),
            F.col("shard_sub").alias("o_sub"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("o_first"),
        )
    )
    inside = Window.partitionBy("shard", "shard_sub").orderBy("doc_id", "text_crc32", "size")
    return (
        keyed.withColumn("slot", (F.row_number().over(inside) - 1).cast("long"))
        .join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("shard_sub") == F.col("o_sub")))
        .withColumn("slot", F.col("slot") + F.col("o_first"))
        .drop("shard_sub", "o_shard", "o_sub", "o_first")
    )


RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """``docs`` plus size, text_crc32, law, shard, slot and grown_shard."""
    kept = [c for c in docs.columns if c not in RESULT]
    own = docs.select(*[F.col(c).alias(f"in_{c}") for c in kept], "doc_id", "text")
    return with_slots(placed(own, weights)).select(*[F.col(f"in_{c}").alias(c) for c in kept], *RESULT)


@query("op7_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39."""
    records = placed(table(spark, sf_dir, "documents").select("doc_id", "text"), (1.0,) * SHARDS)
    return with_slots(staged(records.drop("text"))).select("doc_id", *RESULT)
