"""Benchmark decontamination by spaced seeds.

A seed is a window of words hashed under a mask that ignores some of its positions, so a
substituted word at an ignored position does not spoil it. The seeds of all documents are
joined to those of the benchmark items; a hit names a document, an item and the offset
between them. How many hits an offset must have if the document holds the item there follows
from the masks and the item's length alone; at offsets with so many, the words of document
and item are laid side by side and compared one by one. A document holds an item if any stretch of it has enough equal
words, densely enough, or if enough of the whole item stands there; where in the item the
hits lie plays no part.

Defined cases: null and empty texts hold nothing; an item of fewer than ITEM_WORDS words
never matches; a document of fewer words than a seed compares never does; an item that a document holds twice gives
one row, with its best place; rows that repeat id and text give one result, rows that
share only the id give one each; a null id is an id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import NOT_ALNUM, UPPER, ascii_lower, staged, table, words
from folioforge.llm.registry import query

#: Masks (1: compared, 0: ignored): every choice of three words out of five neighbours. Where
#: 13 words of 18, or half of an item, are equal, three of five neighbours are.
MASKS = ("11100", "11010", "10110", "11001", "10101", "10011")
#: Equal words, and their share, of a stretch; share of an item; least words of an item.
STRETCH_WORDS, STRETCH_SHARE, ITEM_SHARE, ITEM_WORDS = 13, 0.7, 0.5, 9
#: Items from this length on need as many hits as the least of them.
LONG_ITEM = 100
#: Bits of the set that tells most documents without candidates before texts are shuffled. It
#: has this size at any scale; a crowded set only lets more documents through.
DOC_BITS = 1 << 21


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _tokens() -> Column:
    return words(ascii_lower(F.col("text")), NOT_ALNUM)


def seeds(tokens: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """All columns of ``tokens`` but the words ``w``, with (pos, seed) for every window
    and mask; ``pos`` is the window's first word. What a mask ignores may lie beyond the end."""
    span = len(masks[0])
    if any(len(m) != span for m in masks):
        raise ValueError("the masks must have one length")
    kept = [c for c in tokens.columns if c != "w"]
    shortest = min(m.rindex("1") for m in masks) + 1
    windows = tokens.where(F.size("w") >= shortest).select(
        *kept, "w", F.explode(F.sequence(F.lit(0), F.size("w") - shortest)).alias("pos")
    )
    hashes = [
        F.when(
            F.col("pos") + mask.rindex("1") < F.size("w"),
            F.xxhash64(F.lit(i), *[F.get("w", F.col("pos") + j) for j, bit in enumerate(mask) if bit == "1"]),
        )
        for i, mask in enumerate(masks)
    ]
    return windows.select(*kept, "pos", F.explode(F.array(*hashes)).alias("seed")).where(F.col("seed").isNotNull())


def least_hits(masks: Sequence[str], longest: int) -> list[list[int]]:
    """By length and number of equal words: the fewest hits that so many equal words can
    leave, wherever they stand. The cheapest way word by word; the last words are the state."""
    span, wanted = len(masks[0]), [int(m, 2) for m in masks]
    hits = [sum(window & m == m for m in wanted) for window in range(1 << span)]
    keep, never = (1 << span - 1) - 1, 1 << 30
    tail = [sum(hits[(last << j) & (2 * keep + 1)] for j in range(1, span)) for last in range(keep + 1)]
    ways = {0: [0]}  # last words -> cost by number of equal words
    out = []
    for n in range(longest + 1):
        out.append([min(cost[k] + tail[last] for last, cost in ways.items()) for k in range(n + 1)])
        longer: dict[int, list[int]] = {}
        for last, cost in ways.items():
            for bit in (0, 1):
                window = last << 1 | bit
                to = longer.setdefault(window & keep, [never] * (n + 2))
                for k, c in enumerate(cost):
                    to[k + bit] = min(to[k + bit], c + hits[window])
        ways = longer
    return out


@cache
def needed_hits(masks: tuple[str, ...] = MASKS) -> list[int]:
    """By item length: the fewest hits on one diagonal of a document that holds the item; the
    last entry is for all longer items. A stretch leaves as many whatever the item."""
    longest = int(STRETCH_WORDS / STRETCH_SHARE)
    least = least_hits(masks, 2 * LONG_ITEM)
    # more equal words never leave fewer hits
    stretch = min(least[n][STRETCH_WORDS] for n in range(STRETCH_WORDS, longest + 1))
    half = [least[n][-int(-ITEM_SHARE * n // 1)] for n in range(2 * LONG_ITEM + 1)]
    return [min(stretch, *half[n : n + 1]) for n in range(LONG_ITEM)] + [min(stretch, *half[LONG_ITEM:])]


def candidates(docs: DataFrame, items: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """(doc_id, text_key, found): per document the (item_id, offset, item_words) at which it
    has as many hits as it must have to hold the item."""
    of_docs = seeds(docs.select("doc_id", _text_key().alias("text_key"), _tokens().alias("w")), masks)
    long_items = items.select("item_id", _tokens().alias("w")).where(F.size("w") >= ITEM_WORDS)
    of_items = seeds(long_items.withColumn("item_words", F.size("w")), masks).select(
        "item_id", "item_words", F.col("pos").alias("item_pos"), F.col("seed").alias("item_seed")
    )
    needed = needed_hits(tuple(masks))
    enough = F.get(F.array(*map(F.lit, needed)), F.least(F.col("item_words"), F.lit(len(needed) - 1)))
    offset = (F.col("pos") - F.col("item_pos")).alias("offset")
    offsets = (
        of_docs.join(of_items, F.col("seed") == F.col("item_seed"))
        .groupBy("doc_id", "text_key", "item_id", offset, "item_words")
        .agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") >= enough)
    )
    return offsets.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("item_id", "offset", "item_words")).alias("found")
    )


def _dense(at: Column) -> Column:
    """Whether any stretch has enough equal words; ``at``: their places, ascending.

    A longer stretch falls into parts of ``STRETCH_WORDS`` to twice as many equal words, one
    of which is as dense as the whole, so no longer ones need a look.
    """
    def fits(i: Column) -> Column:
        most = F.least(F.lit(2 * STRETCH_WORDS), F.size(at) - i)
        length = lambda m: F.get(at, i + m - 1) - F.get(at, i) + 1
        return F.exists(F.sequence(F.lit(STRETCH_WORDS), most), lambda m: m >= STRETCH_SHARE * length(m))

    starts = F.sequence(F.lit(0), F.size(at) - STRETCH_WORDS)
    return F.when(F.size(at) >= STRETCH_WORDS, F.exists(starts, fits)).otherwise(F.lit(False))


def _doc_bit(doc_id: str, text_key: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_key), F.lit(DOC_BITS))


def _bit_set(found: DataFrame) -> Column:
    """The bits of ``c_id``, ``c_key`` as one array of ``DOC_BITS / 64`` longs."""
    bit = _doc_bit("c_id", "c_key")
    longs = found.groupBy(F.floor(bit / 64).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")
    )
    every = found.sparkSession.range(DOC_BITS // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    dense = every.unionByName(longs).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("at", "bits")))["bits"]).scalar()


def _maybe(bits: Column, doc_id: str, text_key: str) -> Column:
    """Whether the set may hold the document; never false if it does."""
    bit = _doc_bit(doc_id, text_key)
    word = F.get(bits, F.floor(bit / 64).cast("int"))
    return F.call_function("shiftrightunsigned", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def contaminated(docs: DataFrame, items: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """(doc_id, text_key, item_id, first_word, item_words, equal_words, overlap) for every
    document and item it holds: where the item begins in the document, how many words it
    has, how many of them stand at their place, and their share."""
    items = items.select("item_id", "text").dropDuplicates()
    found = staged(candidates(docs, items, masks)).select(
        F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "found"
    )
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))
    at = F.col("f.offset")
    start = F.greatest(at, F.lit(0))
    # only the words beside the item travel on, not the document
    beside = F.slice("w", start + 1, F.least(at, F.lit(0)) + F.col("f.item_words"))
    placed = (
        docs.select("doc_id", _text_key().alias("text_key"), "text")
        .where(_maybe(_bit_set(found), "doc_id", "text_key"))
        # places found grow with the documents, so they are never broadcast
        .join(found.hint("merge"), same)
        .select("doc_id", "text_key", _tokens().alias("w"), "found")
        # by itself, or the text would be split anew for every place found
        .select("doc_id", "text_key", "w", F.explode("found").alias("f"))
        .select("doc_id", "text_key", "f", beside.alias("w"))
    )
    of_items = items.select(F.col("item_id").alias("i_id"), _tokens().alias("iw"))
    equal = lambda i: (at + i >= 0) & F.coalesce(F.get("w", at + i - start) == F.get("iw", i), F.lit(False))
    aligned = placed.join(of_items, (F.col("f.item_id").eqNullSafe(F.col("i_id"))) & (F.size("iw") == F.col("f.item_words"))).select(
        "doc_id",
        "text_key",
        F.col("i_id").alias("item_id"),
        "f.offset",
        F.size("iw").alias("item_words"),
        # as a generated column, or every use below would compute it anew
        F.explode(F.array(F.filter(F.sequence(F.lit(0), F.size("iw") - 1), equal))).alias("places"),
    )
    counted = aligned.withColumn("equal_words", F.size("places"))
    return (
        counted.where((F.col("equal_words") >= ITEM_SHARE * F.col("item_words")) | _dense(F.col("places")))
        .groupBy("doc_id", "text_key", "item_id")
        .agg(F.max(F.struct("equal_words", -F.col("offset"), "item_words")).alias("best"))
        .select(
            "doc_id",
            "text_key",
            "item_id",
            (-F.col("best.col2")).cast("long").alias("first_word"),
            F.col("best.item_words").cast("long").alias("item_words"),
            F.col("best.equal_words").cast("long").alias("equal_words"),
            (F.col("best.equal_words") / F.col("best.item_words")).alias("overlap"),
        )
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    bad = staged(
        contaminated(docs.select("doc_id", "text"), items)
        .select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key"))
        .distinct()
    )
    own = [F.col(c).alias(f"in_{c}") for c in docs.columns]
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("text_key") == F.col("bad_key"))
    return (
        docs.select(*own, "doc_id", _text_key().alias("text_key"))
        .join(bad, same, "left_anti")
        .select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
    )


def _seed_sql(source: str, key: str) -> str:
    arms = [
        f"SELECT {key}, i, {n} AS mask, [{', '.join(f'w[i + {j}]' for j, bit in enumerate(mask) if bit == '1')}] AS seed "
        f"FROM {source} WHERE i + {mask.rindex('1')} <= len(w)"
        for n, mask in enumerate(MASKS)
    ]
    return " UNION ALL ".join(arms)


_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LAST = min(m.rindex("1") for m in MASKS)

# any offset with one equal seed is looked at, and any stretch of equal words counts
DECONTAM_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT DISTINCT doc_id, {_WORDS_SQL} AS w FROM documents)),
b AS (SELECT row_number() OVER () AS q, item_id, w FROM (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark)
      WHERE len(w) >= {ITEM_WORDS}),
dw AS (SELECT r, w, unnest(range(1, len(w) - {_LAST - 1})) AS i FROM d),
bw AS (SELECT q, w, unnest(range(1, len(w) - {_LAST - 1})) AS i FROM b),
ds AS ({_seed_sql("dw", "r")}),
bs AS ({_seed_sql("bw", "q")}),
o AS (SELECT DISTINCT r, q, ds.i - bs.i AS shift FROM ds JOIN bs USING (mask, seed)),
p AS (SELECT doc_id, r, item_id, shift, len(b.w) AS n,
             list_filter(range(1, len(b.w) + 1), lambda k: k + shift > 0 AND d.w[k + shift] = b.w[k]) AS eq
      FROM o JOIN d USING (r) JOIN b USING (q)),
e AS (SELECT *, len(eq) AS same, len(list_filter(range(1, len(eq) - {STRETCH_WORDS - 2}), lambda i:
             len(list_filter(range({STRETCH_WORDS}, len(eq) - i + 2), lambda m:
                 m >= {STRETCH_SHARE}::DOUBLE * (eq[i + m - 1] - eq[i] + 1))) > 0)) > 0 AS dense FROM p),
v AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY same DESC, shift, n DESC) AS best
      FROM e WHERE dense OR same >= {ITEM_SHARE} * n)
SELECT doc_id, item_id, shift::BIGINT AS first_word, n::BIGINT AS item_words, same::BIGINT AS equal_words,
       same / n AS overlap
FROM v WHERE best = 1
"""


@query("op8_decontamination", DECONTAM_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
