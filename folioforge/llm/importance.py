"""Importance resampling towards a target distribution by bit-sliced aggregation.

Features are runs of words, hashed into buckets. A bucket's gain says by how much the
target holds it more often than the documents do. A document's weight is the mean gain of
its features: its bucket counts become bit planes (bit b of plane j is bit j of bucket
b's count), the gains become signed bit planes, and the sum of all products is the sum of
the powers of two of every pair of planes, times the set bits of their AND. A document is
drawn if its weight plus Gumbel noise from a hash of its id is among the highest.

Counts go through Spark once: every task adds up its rows' buckets and hands on one row a
bucket. What reaches the driver, and goes to the tasks as gains, is one number a bucket.

Defined cases: null and empty texts have no features and weight 0; a null id draws its
noise as the empty text; rows that repeat id and text have one score and take ranks that
follow each other; an empty target or an empty table counts as no features. Columns of the
input reach the result only if named in ``keep``, and give way to a result column of the
same name. Memory grows with the longest single text, not with the table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import CRC_TABLE_SQL, UPPER, by_bytes, crc32_sql, staged, table
from folioforge.llm.registry import query

#: Buckets, longest run of words, seed of the noise, share of the documents drawn (of those
#: with so many words).
BUCKETS, LONGEST_RUN, SEED, SHARE, LEAST_WORDS = 10_000, 1, 2024, (10, 100), 20
#: Words whose bucket a task remembers; documents whose planes a task holds at once; bytes of
#: text whose features it counts at once (a longer text is counted by itself).
REMEMBERED, PLANE_ROWS, COUNTED_BYTES = 500_000, 512, 1 << 20

_LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def hashed_features(texts: Sequence[bytes | None], longest: int, buckets: int, known: dict[bytes, int]):
    """Words, features, and (row, bucket, count) arrays in order of row and bucket."""
    n_words, n_features, rows, places, counts = [], [], [], [], []
    for row, text in enumerate(texts):
        found = (text or b"").translate(_LOWER_WORDS).split()
        runs = Counter(found)
        for length in range(2, longest + 1):
            runs.update(b" ".join(found[i : i + length]) for i in range(len(found) - length + 1))
        n_words.append(len(found))
        n_features.append(runs.total())
        rows.append(np.full(len(runs), row, dtype=np.int64))
        if len(known) > REMEMBERED:
            known.clear()
        for run in runs:
            place = known.get(run)
            if place is None:
                place = known[run] = zlib.crc32(run) % buckets
            places.append(place)
        counts.extend(runs.values())
    row = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    cell, inverse = np.unique(row * buckets + np.array(places, dtype=np.int64), return_inverse=True)
    total = np.zeros(len(cell), dtype=np.int64)
    np.add.at(total, inverse, np.array(counts, dtype=np.int64))
    return n_words, n_features, cell // buckets, cell % buckets, total


def with_features(
    docs: DataFrame, keep: Sequence[str] = (), longest: int = LONGEST_RUN, buckets: int = BUCKETS
) -> DataFrame:
    """(own, doc_id, n_words, n_features, buckets, counts) of every row; ``own`` holds ``keep``."""
    own = F.struct(*keep) if keep else F.struct(F.lit(None).cast("long").alias("none"))
    narrow = docs.select(own.alias("own"), F.col("doc_id"), F.col("text").cast("binary").alias("raw"))
    kept = [f for f in narrow.schema.fields if f.name != "raw"]
    schema = T.StructType([*kept]).add("n_words", "long").add("n_features", "long")
    ints = T.ArrayType(T.IntegerType())
    schema = schema.add("buckets", ints).add("counts", ints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for some in by_bytes(batch, "raw", COUNTED_BYTES):
                raw = some.column("raw").to_pylist()
                n_words, n_features, row, place, count = hashed_features(raw, longest, buckets, known)
                ends = pa.array(np.searchsorted(row, np.arange(len(raw) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (place, count)]
                columns = [some.column(f.name) for f in kept] + [pa.array(n_words), pa.array(n_features), *lists]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return narrow.mapInArrow(run, schema)


def bucket_totals(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    summed = featured.select("buckets", "counts").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in summed.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares, per bucket."""
    ratio = (target + 1.0) * (source.sum() + float(len(source))) / ((source + 1.0) * (target.sum() + float(len(target))))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _sliced(dense: np.ndarray) -> np.ndarray:
    """Rows of 0/1 bytes as rows of 64-bit words."""
    packed = np.packbits(dense, axis=-1)
    wide = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), dtype=np.uint8)
    wide[..., : packed.shape[-1]] = packed
    return wide.view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Two's complement bit planes of the gains, each with its power of two; the plane of
    the sign counts against the sum."""
    width = int(max(gain.max(initial=0), -1 - gain.min(initial=0), 0)).bit_length()
    planes = [(1 << k, _sliced((gain >> k & 1).astype(np.uint8))) for k in range(width)]
    return [*planes, (-(1 << width), _sliced((gain < 0).astype(np.uint8)))]


def sliced_sums(n_rows: int, row: np.ndarray, place: np.ndarray, count: np.ndarray, planes, buckets: int) -> np.ndarray:
    """Per row the sum of count times gain, by AND, popcount and powers of two alone."""
    out = np.zeros(n_rows, dtype=np.int64)
    for j in range(int(count.max(initial=0)).bit_length()):
        bit = (count >> j & 1).astype(bool)
        held, at = np.unique(row[bit], return_inverse=True)
        dense = np.zeros((len(held), buckets), dtype=np.uint8)
        dense[at, place[bit]] = 1
        plane = _sliced(dense)
        for power, gain in planes:
            out[held] += (power << j) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
    return out


def with_weights(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``featured`` with ``weight`` instead of buckets and counts."""
    planes, buckets = gain_planes(gain), len(gain)
    kept = [f for f in featured.schema.fields if f.name not in ("buckets", "counts")]
    schema = T.StructType([*kept]).add("weight", "long")

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(batch.column("buckets").value_lengths().to_numpy(zero_copy_only=False))])
        place = batch.column("buckets").flatten().to_numpy()
        count = batch.column("counts").flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        total = sliced_sums(batch.num_rows, row, place, count, planes, buckets)
        weight = total // np.maximum(batch.column("n_features").to_numpy(), 1)
        columns = [batch.column(f.name) for f in kept] + [pa.array(weight)]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PLANE_ROWS):
                yield weigh(batch.slice(at, PLANE_ROWS))

    return featured.mapInArrow(run, schema)


def noisy_score(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """``weight`` plus a thousandfold Gumbel noise that a hash of seed and id draws."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` plus ``rank``, null for rows that are not drawn.

    A score is a whole number of a few ten thousand possible values, so rows are counted
    per score, the counts are added up from the highest, and only rows of scores that
    may be drawn are sorted, each score by itself. ``scored`` is read four times.
    """
    able = scored.where(F.col("n_words") >= least_words)
    levels = able.groupBy("score").agg(F.count(F.lit(1)).alias("of_score"))
    highest = Window.orderBy(F.col("score").desc())
    levels = levels.select(
        F.col("score").alias("level"),
        (F.sum("of_score").over(highest) - F.col("of_score")).alias("above"),
        F.floor(
            F.sum("of_score").over(highest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            * share[0] / share[1]
        ).alias("drawn"),
    )
    levels = staged(levels.where(F.col("above") < F.col("drawn")))
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    place = F.col("above") + F.row_number().over(within)
    taken = able.join(levels, F.col("score") == F.col("level")).withColumn("place", place.cast("long"))
    taken = taken.withColumn("rank", F.when(F.col("place") <= F.col("drawn"), F.col("place")))
    rest = scored.join(levels, (F.col("score") == F.col("level")) & (F.col("n_words") >= least_words), "left_anti")
    names = scored.columns
    return taken.select(*names, "rank").unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    keep: Sequence[str] = (),
    longest: int = LONGEST_RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
    share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n_words, n_features, weight, score,
    rank and the columns ``keep``; rows with a rank are the sample drawn towards the texts
    of ``target``."""
    featured = staged(with_features(docs, keep, longest, buckets))
    wanted = with_features(target.select(F.lit(0).alias("doc_id"), "text"), (), longest, buckets)
    gain = gains(bucket_totals(wanted, buckets), bucket_totals(featured, buckets))
    weighted = with_weights(featured, gain)
    scored = staged(weighted.withColumn("score", noisy_score(F.col("weight"), F.col("doc_id"), seed)))
    out = ranked(scored, share, least_words)
    results = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return out.select(*results, *[F.col("own")[c].alias(c) for c in keep if c not in results])


_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE_SQL = rf"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
q AS (SELECT {_WORDS_SQL} AS w FROM benchmark),
f AS (SELECT r, unnest(w) AS x FROM d),
y AS (SELECT unnest(w) AS x FROM q),
h AS (SELECT x, {crc32_sql("x")} % {BUCKETS} AS b FROM (SELECT x FROM f UNION SELECT x FROM y), crc_table),
c AS (SELECT r, b, count(*) AS n FROM f JOIN h USING (x) GROUP BY r, b),
s AS (SELECT b, sum(n) AS s FROM c GROUP BY b),
t AS (SELECT b, count(*) AS t FROM y JOIN h USING (x) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS})::DOUBLE
                                / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM s LEFT JOIN t USING (b)),
m AS (SELECT r, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM c JOIN g USING (b) GROUP BY r),
x AS (SELECT doc_id, len(w)::BIGINT AS n_features,
             coalesce((total - ((total % m.n) + m.n) % m.n) // m.n, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN m USING (r)),
z AS (SELECT doc_id, n_features, weight,
             weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
             {SHARE[0]} * (count(*) FILTER (n_features >= {LEAST_WORDS}) OVER ()) // {SHARE[1]} AS drawn FROM z)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= drawn THEN place END::BIGINT AS rank
FROM p
"""


@query("op13_importance", IMPORTANCE_SQL)
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, resampled towards the benchmark."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
