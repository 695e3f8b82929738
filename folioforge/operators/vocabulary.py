"""Vocabulary scans: advisory terms, protected terms and glossaries.

A given list of terms is counted by combined patterns inside each row, one narrow pass
with no shuffle; only roll-ups aggregate.  Glossaries are tables and are joined.  Terms whose occurrences could overlap (one
inside the other, or sharing words) go to different passes, so every term gets the same
count a pattern of its own would give.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_col, explode_indexed, extract_any, is_word_char, let
from ..session import written
from .rules import FORBIDDEN_VOCABULARY, PROTECTED_TERMS


def _may_overlap(a: str, b: str) -> bool:
    """Can whole-word occurrences of the two different phrases share a character?"""

    def starts_within(x: str, y: str) -> bool:
        for at in range(len(x)):
            if at and is_word_char(x[at - 1]):
                continue
            shared = min(len(x) - at, len(y))
            if x[at : at + shared] != y[:shared]:
                continue
            rest = x[at + shared : at + shared + 1] or y[shared : shared + 1]
            if not (rest and is_word_char(rest)):
                return True
        return False

    return starts_within(a, b) or starts_within(b, a)


def term_layers(terms: Sequence[str], ignore_case: bool = True) -> list[list[str]]:
    """Split terms into groups within which occurrences cannot overlap."""
    layers: list[list[str]] = []
    seen = {(t.lower() if ignore_case else t) for t in terms}
    singles = sorted(t for t in seen if re.fullmatch(r"\w+", t, re.ASCII))
    if singles:
        layers.append(singles)  # different single words never overlap
    first_layer_open = len(layers)
    for term in sorted(seen - set(singles), key=lambda t: (-len(t), t)):
        for layer in layers[first_layer_open:]:
            same_kind = is_word_char(term[0]) == is_word_char(layer[0][0])
            if same_kind and not any(_may_overlap(term, other) for other in layer):
                layer.append(term)
                break
        else:
            layers.append([term])
    return layers


def term_counts(text: Column | str, terms: Sequence[str], ignore_case: bool = True) -> Column:
    """``array<struct<term, count>>`` of the terms that occur, whole words only."""
    c = as_col(text)
    found = [
        extract_any(c, layer, ignore_case)
        for layer in term_layers(terms, ignore_case)
    ]
    hits = F.concat(*found) if len(found) > 1 else found[0]
    if ignore_case:
        hits = F.transform(hits, F.lower)

    def count(all_hits: Column) -> Column:
        # array_remove compares without a lambda per hit
        return F.transform(
            F.array_distinct(all_hits),
            lambda t: F.struct(
                t.alias("term"), (F.size(all_hits) - F.size(F.array_remove(all_hits, t))).alias("count")
            ),
        )

    return let(hits, count)


def term_hits(
    df: DataFrame,
    terms: Sequence[str],
    *,
    id_cols: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    ignore_case: bool = True,
) -> DataFrame:
    """(ids, term, count): one row per term that occurs in a document."""
    counted = df.select(*id_cols, term_counts(text_col, terms, ignore_case).alias("__terms"))
    rows = explode_indexed(counted, "__terms", list(id_cols), "i", "hit", "n")
    return rows.select(
        *id_cols, F.col("hit")["term"].alias("term"), F.col("hit")["count"].alias("count")
    )


def forbidden_vocab_scan(
    df: DataFrame, terms: Sequence[str] | None = None, **options
) -> DataFrame:
    """Advisory terms per document; the text is left as it is."""
    return term_hits(df, terms or FORBIDDEN_VOCABULARY, **options)


def protected_terms_check(
    df: DataFrame,
    before_col: str,
    after_col: str,
    terms: Sequence[str] | None = None,
    *,
    id_cols: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(ids, term, before, after): protected terms that became rarer."""
    names = terms or PROTECTED_TERMS
    counted = df.select(
        *id_cols,
        term_counts(before_col, names, ignore_case=False).alias("__before"),
        term_counts(after_col, names, ignore_case=False).alias("__after"),
    )
    lost = F.transform(
        "__before",
        lambda b: F.struct(
            b["term"].alias("term"),
            b["count"].alias("before"),
            F.coalesce(
                F.get(F.filter("__after", lambda a: a["term"] == b["term"]), F.lit(0))["count"],
                F.lit(0),
            ).alias("after"),
        ),
    )
    fewer = F.filter(lost, lambda x: x["after"] < x["before"])
    rows = explode_indexed(
        counted.select(*id_cols, fewer.alias("__lost")), "__lost", list(id_cols), "i", "x", "n"
    )
    return rows.select(*id_cols, *[F.col("x")[f].alias(f) for f in ("term", "before", "after")])


def parse_glossary(text: str) -> list[tuple[str, str, str, list[str]]]:
    """(category, term, definition, never_use) from ``--- CATEGORY ---`` / ``term: definition``."""
    rows, category = [], ""
    for line in text.splitlines():
        header = re.match(r"^---\s*(.+?)\s*---\s*$", line.strip())
        entry = re.match(r"^([^:]+): (.+)$", line.strip())
        if header:
            category = header.group(1)
        elif entry and category:
            banned = re.findall(r'NEVER (?:just )?"([^"]+)"', entry.group(2))
            rows.append((category, entry.group(1).strip(), entry.group(2).strip(), banned))
    return rows


def glossary_table(spark: SparkSession, text: str) -> DataFrame:
    """The user's glossary text as a table (category, term, definition, never_use)."""
    return spark.createDataFrame(
        parse_glossary(text),
        "category string, term string, definition string, never_use array<string>",
    )


#: In lower-cased text; Java is much faster with these than with classes spelled out.
_WORD, _NO_WORD = "\\w", "\\W"


def _term_parts(terms: DataFrame) -> DataFrame:
    """Distinct lower-cased terms, taken apart: ``core`` from the first word to the last,
    what stands before and after it, its words (0: none), and whether two occurrences can
    overlap, that is whether the term ends as it begins."""
    term = F.col("__term")
    core = F.regexp_extract(term, f"(?s){_WORD}(?:.*{_WORD})?", 0)
    word = F.rlike(term, F.lit(f"^{_WORD}+\\z"))
    begins_as_it_ends = F.exists(
        F.sequence(F.lit(1), F.length(term) - 1), lambda n: F.left(term, n) == F.right(term, n)
    )
    return (
        terms.select(F.lower("term").alias("__term"))
        .where("__term <> ''")
        .distinct()
        .select(
            "__term",
            core.alias("__core"),
            F.size(F.regexp_extract_all(term, F.lit(f"{_WORD}+"), 0)).alias("__n"),
            F.regexp_extract(term, f"(?s)^{_NO_WORD}*", 0).alias("__head"),
            F.regexp_extract(term, f"(?s){_NO_WORD}*$", 0).alias("__tail"),
            # a single word cannot: its occurrences are different words of the text
            (F.when(~word & (F.length(term) > 1), begins_as_it_ends).otherwise(False)).alias("__overlaps"),
        )
    )


def _word_grams(lengths: Sequence[int]) -> Column:
    """All runs of so many words of ``__words`` with the ``__gaps`` inside them, each with its
    first word's place and the gaps around it."""

    def of_length(n: int) -> Column:
        def gram(i: Column) -> Column:
            inside = [
                x for j in range(n) for x in ((F.get("__gaps", i + j),) if j else ()) + (F.get("__words", i + j),)
            ]
            return F.struct(
                F.concat(*inside).alias("gram"),
                i.alias("at"),
                F.get("__gaps", i).alias("before"),
                F.get("__gaps", i + n).alias("after"),
            )

        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__words") - n, F.lit(0))), lambda i: i + n <= F.size("__words"))
        return F.transform(places, gram)

    return F.concat(*[of_length(n) for n in lengths])


def _pieces(n: int) -> Column:
    """All pieces of ``n`` characters of ``__gap`` (one shorter piece if it has fewer)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("__gap") - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring("__gap", i, F.lit(n)))


def _relation_hits(
    df: DataFrame, terms: DataFrame, *, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """(ids, term, count) for terms that come as a table, whole words, whatever case.

    Every run of words as long as some term is joined to the terms' text from first word to
    last, so an occurrence is a row of the join: there is no pattern, and neither the text
    nor its words are shuffled as long as the terms are small enough for Spark to broadcast.
    The terms are written to the session's shared folder first.
    Signs before or after a term are compared with the gap there. A term of signs alone can
    only stand in a gap, and is joined to the gaps' own pieces. Only the different lengths
    of the terms come to the driver.
    """
    # written, so that the planner knows its size: else all runs of words are shuffled to the terms
    known = written(_term_parts(terms))
    # lengths in words, and of terms without one in characters
    signs = F.when(F.col("__n") == 0, F.length("__term")).alias("signs")
    lengths = known.select("__n", signs, "__overlaps").distinct().collect()
    words = sorted({r["__n"] for r in lengths if r["__n"]})
    signs = sorted({r["signs"] for r in lengths if not r["__n"]})
    overlaps = any(r["__overlaps"] for r in lengths if r["__n"])
    ids = [F.col(c).alias(f"__id{i}") for i, c in enumerate(id_cols)]
    own = [f"__id{i}" for i in range(len(id_cols))]
    low = F.lower(F.coalesce(text_col, F.lit("")))
    # a row is what is counted, whether or not its ids are repeated
    rows = df.select(F.monotonically_increasing_id().alias("__row"), *ids, low.alias("__low")).select(
        "__row",
        *own,
        F.regexp_extract_all("__low", F.lit(f"{_WORD}+"), 0).alias("__words"),
        F.split("__low", f"{_WORD}+").alias("__gaps"),
    )
    found = []
    if words:
        grams = rows.select("__row", *own, F.explode(_word_grams(words)).alias("g")).select("__row", *own, "g.*")
        here = (F.col("gram") == F.col("__core")) & F.col("before").endswith(F.col("__head"))
        hits = grams.join(known.where("__n > 0"), here & F.col("after").startswith(F.col("__tail")))
        place = F.struct("at", F.length("before").alias("gap"))
        # without a term that can overlap itself no list is gathered, and hits are added up as they come
        places = F.sort_array(F.collect_list(F.when(F.col("__overlaps"), place)))
        gathered = [places.alias("places")] if overlaps else []
        counted = hits.groupBy("__row", *own, "__term", "__n", "__head", "__tail").agg(
            F.count(F.lit(1)).alias("all"), *gathered
        )
        room = F.length("__head") + F.length("__tail")

        def apart(acc: Column, p: Column) -> Column:
            # from left to right, as a search would go on behind each occurrence
            free = acc["n"] == 0
            free = free | (p["at"] > acc["end"]) | ((p["at"] == acc["end"]) & (p["gap"] >= room))
            taken = F.struct((acc["n"] + 1).alias("n"), (p["at"] + F.col("__n")).alias("end"))
            return F.when(free, taken).otherwise(acc)

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        count = F.col("all")
        if overlaps:
            count = F.when(F.size("places") > 0, F.aggregate("places", start, apart)["n"]).otherwise(count)
        found.append(counted.select(*own, "__term", count.cast("int").alias("count")))
    if signs:
        pieces = F.array_distinct(F.concat(*[_pieces(n) for n in signs]))
        gaps = rows.select("__row", *own, F.explode("__gaps").alias("__gap")).where("__gap <> ''")
        of_gaps = gaps.select("__row", *own, "__gap", F.explode(pieces).alias("__piece"))
        times = (F.length("__gap") - F.length(F.replace("__gap", "__term", F.lit("")))) / F.length("__term")
        in_gaps = of_gaps.join(known.where("__n = 0"), F.col("__piece") == F.col("__term"))
        counted = in_gaps.groupBy("__row", *own, "__term").agg(F.sum(times).cast("int").alias("count"))
        found.append(counted.select(*own, "__term", "count"))
    if not found:
        found.append(rows.select(*own, F.lit("").alias("__term"), F.lit(0).alias("count")).where(F.lit(False)))
    named = [F.col(o).alias(c) for o, c in zip(own, id_cols, strict=True)]
    return reduce(DataFrame.unionByName, found).select(*named, F.col("__term").alias("term"), "count")


def glossary_hits(df: DataFrame, glossary: DataFrame, **options) -> DataFrame:
    """(ids, term, count, category): glossary terms per document, one row for every
    category that lists the term."""
    entries = written(glossary.select(F.lower("term").alias("__listed"), "category").distinct())
    hits = _relation_hits(df, glossary, **options)
    return hits.join(entries, F.col("term") == F.col("__listed")).drop("__listed")


def never_use_violations(df: DataFrame, glossary: DataFrame, **options) -> DataFrame:
    """(ids, banned, count, term): banned renderings per document, one row for every term
    that bans the rendering."""
    pairs = glossary.select("term", F.explode("never_use").alias("banned"))
    wanted = written(pairs.select(F.lower("banned").alias("__banned"), F.col("term").alias("__use")).distinct())
    hits = _relation_hits(df, pairs.select(F.col("banned").alias("term")), **options)
    return (
        hits.withColumnRenamed("term", "banned")
        .join(wanted, F.col("banned") == F.col("__banned"))
        .withColumn("term", F.col("__use"))
        .drop("__banned", "__use")
    )
