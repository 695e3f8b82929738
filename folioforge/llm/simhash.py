"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A document's fingerprint has a bit set where more than half of its shingles' hashes have.
Two fingerprints link if they differ in at most ``RADIUS`` bits. Candidates come from
2^(RADIUS+1) - 1 tables: every bit position is given a vector of RADIUS + 1 bits, and the
table of a non-zero vector v masks the positions whose vector is orthogonal to v. At most
RADIUS differing positions always leave a v orthogonal to all of their vectors, so every
pair within the radius agrees in some table; this is a guarantee, not a chance.

Only distinct fingerprints enter the tables, so a group of exact copies is one row. The
rows of a bucket are compared by popcount and leave one link per member to the bucket's
components, never all pairs. A bucket of more than ``BUCKET`` fingerprints is not
gathered: its members are joined through the points within RADIUS / 2 of them. Members
that share such a point are within the radius of each other, and members within the
radius share one, so this is as exact.

Connected components come from alternating large-star and small-star steps; each step
writes a table, and only counts and checksums reach the driver.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts
of fewer words than a shingle are one shingle; every row of the input gets a row, so rows
that repeat an id stay; null ids never name a component unless there is no other. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import staged, table
from folioforge.llm.registry import query

SHINGLE, SEED, RADIUS, BUCKET = 4, 42, 4, 4096
BITS = 64


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - SHINGLE + 1)
    starts, stops = first[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 4096):
        part = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little")
        ones += part.reshape(-1, BITS).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(t) for t in batch], dtype=np.int64)

    return F.pandas_udf(run, "long")(F.coalesce(text, F.lit("")))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The masks of the tables, as signed numbers; a set bit is compared."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        bits = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(bits - (1 << BITS) if bits >> (BITS - 1) else bits)
    return masks


def _within(one: np.uint64, many: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(many ^ one) <= radius


def component_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member of its component) for the members that are not alone."""
    left, links = np.sort(members), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        found = [root]
        while found and len(left):
            near = _within(found.pop(), left, radius)
            if near.any():
                new = left[near]
                left = left[~near]
                links.extend((m, int(root)) for m in new.tolist())
                found.extend(new)
    return links


def _bucket_links(radius: int, limit: int):
    """Turns rows (tab, key, fp) sorted by (tab, key) into links (a, b, null), and the
    members of buckets beyond ``limit`` into rows (a, null, tab)."""

    def close(members: np.ndarray, out: list) -> None:
        if len(members) == 2:
            if int(members[0] ^ members[1]).bit_count() <= radius:
                out.append((int(members.max()), int(members.min()), None))
        elif len(members) > 2:
            out.extend((a, b, None) for a, b in component_links(members, radius))

    def batch(out: list) -> pa.RecordBatch:
        signed = lambda v: None if v is None else v - (1 << BITS) if v >> (BITS - 1) else v
        a, b, tab = zip(*out, strict=True)
        longs = lambda c: pa.array([signed(v) for v in c], pa.int64())
        return pa.RecordBatch.from_arrays([longs(a), longs(b), pa.array(tab, pa.int32())], names=["a", "b", "tab"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, spilled = None, np.zeros(0, dtype=np.uint64), False
        for rows in batches:
            if not rows.num_rows:
                continue
            out: list = []
            tabs, keys, fps = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("tab", "key", "fp"))
            fps = fps.view(np.uint64)
            edges = np.flatnonzero((tabs[1:] != tabs[:-1]) | (keys[1:] != keys[:-1])) + 1
            begins, stops = np.append(0, edges), np.append(edges, len(fps))
            # a fingerprint alone in its bucket has no links; the first and the last
            # bucket of a batch may go on in its neighbours
            some = stops - begins > 1
            some[[0, -1]] = True
            for s, e in zip(begins[some].tolist(), stops[some].tolist(), strict=True):
                here = (int(tabs[s]), int(keys[s]))
                if here != at:
                    if not spilled:
                        close(members, out)
                    at, members, spilled = here, fps[s:e], False
                elif spilled:
                    out.extend((m, None, at[0]) for m in fps[s:e].tolist())
                else:
                    members = np.concatenate([members, fps[s:e]])
                if not spilled and len(members) > limit:
                    out.extend((m, None, at[0]) for m in members.tolist())
                    members, spilled = members[:0], True
            if out:
                yield batch(out)
        out = []
        if not spilled:
            close(members, out)
        if out:
            yield batch(out)

    return run


def _ball_links(overflow: DataFrame, radius: int) -> DataFrame:
    """Links of members (a, tab) of buckets that are too large to gather, through the
    points within half the radius that differ in the bits their table leaves out."""
    if radius % 2:
        raise ValueError("large buckets need an even radius")
    rows = []
    for tab, mask in enumerate(covering_masks(radius)):
        moves = [0]
        for _ in range(radius // 2):
            moves += [m | 1 << i for m in moves for i in range(BITS) if not mask >> i & 1 and not m >> i]
        rows += [(tab, m - (1 << BITS) if m >> (BITS - 1) else m) for m in sorted(set(moves))]
    spark = overflow.sparkSession
    steps = spark.createDataFrame(pd.DataFrame(rows, columns=["s_tab", "move"])).select(
        F.col("s_tab").cast("int").alias("s_tab"), F.col("move").cast("long").alias("move")
    )
    points = staged(
        overflow.join(steps, F.col("tab") == F.col("s_tab")).select(
            "tab", F.col("a").bitwiseXOR(F.col("move")).alias("point"), "a"
        )
    )
    least = staged(points.groupBy("tab", "point").agg(F.min("a").alias("b")).toDF("l_tab", "l_point", "b"))
    same = (F.col("tab") == F.col("l_tab")) & (F.col("point") == F.col("l_point"))
    return points.join(least, same).where("a != b").select("a", "b").distinct()


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the radius: not
    every pair, but a path within the radius between the ends of each."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(tables).alias("t")).select("t.tab", "t.key", "fp")
    found = staged(
        rows.repartition("tab", "key")
        .sortWithinPartitions("tab", "key")
        .mapInArrow(_bucket_links(radius, bucket), "a long, b long, tab int")
    )
    links = found.where("b IS NOT NULL").select("a", "b")
    overflow = found.where("b IS NULL").select("a", "tab")
    if not overflow.isEmpty():
        links = links.unionByName(_ball_links(overflow, radius))
    return staged(links.distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the smallest node that
    is connected to it."""
    edges = links.where("a != b")
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a != b").distinct())
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"))
        joined = large.join(low, F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        edges = staged(small.where("a != b").distinct())
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        if seen == state:
            # a star forest: every node points at its root
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        state = seen


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id), one row per row of ``docs``: a hash of
    its text, its fingerprint, the fingerprint that stands for its component, and the
    smallest id in it."""
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    hashed = staged(docs.select("doc_id", key, fingerprint(F.col("text")).alias("fp")))
    distinct = staged(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    nodes = components(fingerprint_links(distinct.select("fp"), radius, bucket))
    rooted = staged(
        distinct.join(nodes, F.col("fp") == F.col("node"), "left").select(
            "fp", "first_doc", F.coalesce("root", "fp").alias("root")
        )
    )
    named = staged(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")).withColumnRenamed("root", "r"))
    of_fp = rooted.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("c_fp"), "root", "component_id")
    return hashed.join(staged(of_fp), F.col("fp") == F.col("c_fp")).drop("c_fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every near-duplicate group: one whose id names the group.
    Of rows that repeat that id and text one stays."""
    named = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = staged(
        named.groupBy("root", F.col("doc_id").alias("kept_id")).agg(F.min("text_key").alias("kept_key"))
    )
    own = docs.select(
        *[F.col(c).alias(f"in_{c}") for c in docs.columns],
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    repeats = Window.partitionBy("kept_id", "kept_key").orderBy("root")
    return (
        own.join(kept, same)
        .withColumn("nth", F.row_number().over(repeats))
        .where("nth = 1")
        .select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
    )


@query("op6_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
