"""License scan by diagonal voting.

Every rolling k-gram of a document's words is joined to the k-grams of the license
templates. A hit at word ``pos`` of the document and ``tpos`` of the template votes for
the diagonal ``pos - tpos``. Diagonals of one template that lie within ``slack`` of each
other are merged to one span, which absorbs inserted and dropped words; a span counts if
it holds enough distinct k-grams of the template within a bounded stretch of words.

Defined cases: null and empty texts have no words and no spans. Rows that repeat both id
and text give one result, rows that share only the id give one each; a null id is an id.
Extra columns are ignored. A template with fewer than ``k`` words is refused.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import NOT_ALNUM, UPPER, ascii_lower, literal_table, table, words
from folioforge.llm.registry import query

# The phrases that decide the base labels.
BASE = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

#: Templates of the method's own, found also when words are added or missing.
OWN = {
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "cc by nc 4 0",
    "cc-by-sa": "cc by sa 4 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl": "gnu lesser general public license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl": "mozilla public license version 2 0",
}

K, SLACK, COVERAGE, STRETCH = 2, 3, 0.7, 1.5


def template_table(spark: SparkSession, templates: Mapping[str, str], k: int = K) -> DataFrame:
    """(label, n_grams, tpos, gram, gram_words): one row per k-gram of a template."""
    short = [label for label, text in templates.items() if len(text.split()) < k]
    if short:
        raise ValueError(f"templates shorter than {k} words: {short}")
    texts = literal_table(spark, ["label", "text"], sorted(templates.items()))
    w = words(ascii_lower(F.col("text")), NOT_ALNUM)
    return (
        texts.select("label", w.alias("w"))
        .select("label", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("tpos"))
        .select(
            F.col("label").alias("t_label"),
            (F.size("w") - (k - 1)).alias("t_grams"),
            "tpos",
            F.xxhash64(*[F.get("w", F.col("tpos") + i) for i in range(k)]).alias("t_hash"),
            *[F.get("w", F.col("tpos") + i).alias(f"t_w{i}") for i in range(k)],
        )
    )


def license_spans(
    docs: DataFrame,
    templates: Mapping[str, str],
    k: int = K,
    slack: int = SLACK,
    coverage: float = COVERAGE,
    stretch: float = STRETCH,
) -> DataFrame:
    """Spans per document: doc_id, text_hash, n_words, label, start, end (words from 0,
    end inclusive), coverage, verified, n_exact, first_exact, last_exact.

    ``n_exact`` counts the complete diagonals of the span, which are the places where the
    template stands word for word. A document without hits has one row with a null label.
    """
    w = F.col("w")
    shifted = [F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))).alias(f"w{i}") for i in range(k)]
    keys = ["doc_id", "text_hash", "n_words"]
    grams = (
        docs.select(
            "doc_id",
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"),
        )
        .select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.arrays_zip(*shifted).alias("z"))
        .select(*keys, F.posexplode_outer("z").alias("pos", "g"))
    )
    known = template_table(docs.sparkSession, templates, k)
    same = [F.xxhash64(*[F.col(f"g.w{i}") for i in range(k)]) == F.col("t_hash")]
    same += [F.col(f"g.w{i}") == F.col(f"t_w{i}") for i in range(k)]
    hits = (
        grams.join(known, same, "left")
        .where(F.col("t_label").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
        .select(*keys, "t_label", "t_grams", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos")
    )
    diagonals = hits.groupBy(*keys, "t_label", "t_grams", "diagonal").agg(F.collect_set("tpos").alias("voted"))
    order = Window.partitionBy("doc_id", "text_hash", "t_label").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    spans = (
        diagonals.withColumn("opens", F.when(gap <= slack, 0).otherwise(1))
        .withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("exact", F.when(F.size("voted") == F.col("t_grams"), F.col("diagonal")))
        .groupBy(*keys, "t_label", "t_grams", "span")
        .agg(
            F.min(F.col("diagonal") + F.array_min("voted")).cast("long").alias("start"),
            (F.max(F.col("diagonal") + F.array_max("voted")) + (k - 1)).cast("long").alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("votes"),
            F.count("exact").alias("n_exact"),
            F.min("exact").cast("long").alias("first_exact"),
            F.max("exact").cast("long").alias("last_exact"),
        )
    )
    part = F.col("votes") / F.col("t_grams")
    close = (F.col("end") - F.col("start") + 1) <= stretch * (F.col("t_grams") + k - 1)
    return spans.select(
        *keys,
        F.col("t_label").alias("label"),
        "start",
        "end",
        part.alias("coverage"),
        F.coalesce((F.col("n_exact") > 0) | ((part >= coverage) & close), F.lit(False)).alias("verified"),
        "n_exact",
        "first_exact",
        "last_exact",
    )


def document_licenses(spans: DataFrame, base: Mapping[str, str] = BASE) -> DataFrame:
    """One row per document: counts and word places of the base phrases, the labels of
    all verified spans, and the greatest coverage of a span as score."""
    is_base = F.col("label").isin(list(base)) & (F.col("n_exact") > 0)
    # a base label stands for its whole phrase; only the method's own labels are fuzzy
    counted = F.col("verified") & (~F.col("label").isin(list(base)) | (F.col("n_exact") > 0))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        spans.groupBy("doc_id", "text_hash", "n_words")
        .agg(
            F.coalesce(F.sum(F.when(is_base, F.col("n_exact"))), F.lit(0)).alias("n_base"),
            F.min(F.when(is_base, F.col("first_exact"))).alias("first_word"),
            F.max(F.when(is_base, F.col("last_exact"))).alias("last_word"),
            listed(F.when(is_base, F.col("label"))).alias("base_labels"),
            listed(F.when(counted, F.col("label"))).alias("labels"),
            F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        )
        .drop("text_hash")
    )


def _values(templates: Mapping[str, str]) -> str:
    return ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in sorted(templates.items()))


LICENSE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT * FROM (VALUES {_values(BASE | OWN)}) v(label, w)),
tg AS (SELECT label, len(w) - 1 AS grams, i - 1 AS tpos, w[i] AS a, w[i + 1] AS b
       FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
dg AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b
       FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
g AS (SELECT doc_id, label, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS voted
      FROM dg JOIN tg USING (a, b) GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, label ORDER BY diagonal)
                          <= {SLACK} THEN 0 ELSE 1 END AS opens FROM g),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS span,
             CASE WHEN len(voted) = grams THEN diagonal END AS exact FROM o),
s AS (SELECT doc_id, label, grams, span, min(diagonal + list_min(voted)) AS lo,
             max(diagonal + list_max(voted)) + 1 AS hi, len(list_distinct(flatten(list(voted)))) AS votes,
             count(exact) AS n_exact, min(exact) AS first_exact, max(exact) AS last_exact
      FROM n GROUP BY ALL),
v AS (SELECT *, label IN ({", ".join(f"'{x}'" for x in BASE)}) AS base, votes / grams AS cover,
             hi - lo + 1 <= {STRETCH} * (grams + 1) AS near FROM s)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words,
       coalesce(sum(n_exact) FILTER (base), 0)::BIGINT AS n_base,
       (min(first_exact) FILTER (base))::BIGINT AS first_word,
       (max(last_exact) FILTER (base))::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND n_exact > 0), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label)
                FILTER (n_exact > 0 OR NOT base AND cover >= {COVERAGE} AND near), '') AS labels,
       coalesce(max(cover), 0)::DOUBLE AS score
FROM d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op1_license_scan", LICENSE_SQL)
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    return document_licenses(license_spans(table(spark, sf_dir, "documents"), BASE | OWN))
