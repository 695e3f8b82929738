"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a bounded sample, and the rules are
ordered by rejections per cost. A document runs through them in that order until one
rejects it, and computes only the figures that the rules it meets ask for. The verdict is
the same in any order; the order decides what it costs.

Defined cases: null and empty texts have no words and fall to the rule on few words. On
an empty table the rules keep their given order. Rows are judged one by one, so repeated
rows and extra columns do not matter; a very long text needs memory in proportion.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE_CHARS, table
from folioforge.llm.registry import query
from folioforge.llm.sampling import labelled_sample

#: Bound of the sample on which rules are timed: documents, code points of each.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 20_000
SYMBOLS = "#*$%&|<>"
GRAM = 8

_FACTORS = np.random.default_rng(GRAM).integers(1, 1 << 63, GRAM, dtype=np.uint64) | np.uint64(1)


class Page:
    """A text and the figures rules ask for, each computed once and only on demand."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.raw.count(c.encode()) for c in SPACE_CHARS)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(c.encode()) for c in SYMBOLS)

    @cached_property
    def n_marks(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE_CHARS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: Sequence[bytes]) -> int:
    """How many words lie in a window of eight that the text holds twice or more."""
    n = len(words) - GRAM + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, count()), dtype=np.uint64, count=len(words))
    # equal windows have equal sums, so without equal sums nothing is repeated
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(_FACTORS):
        sums += mixed[i : i + n] * factor
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # exact: windows of 2, 4, 8 words are numbered by the numbers of their halves
    exact = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < GRAM:
        exact = np.unique(exact[:-width] * (exact.max() + 1) + exact[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    again = np.bincount(exact)[exact] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + GRAM, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` says of a page whether it falls."""

    name: str
    rejects: Callable[[Page], bool]


#: The rules, cheap or not, in the order they are given; the cascade finds its own.
RULES = (
    Rule("few_words", lambda p: p.n_words < 20),
    Rule("repeated_words", lambda p: 100 * p.n_repeat_words > 30 * p.n_words),
    Rule("symbols", lambda p: p.n_symbols > p.n_words),
    Rule("exclamations", lambda p: 2 * p.n_marks > p.n_words),
    Rule("repeated_lines", lambda p: 2 * p.n_dup_lines > len(p.lines)),
    Rule("word_length", lambda p: not 2 * p.n_words <= p.word_chars <= 20 * p.n_words),
)
BASE_RULES = {"few_words", "repeated_words"}


def cascade_order(sample: Sequence[str | None], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """``rules`` by rejections per second on ``sample``, each measured on fresh pages."""
    worth = {}
    for rule in rules:
        began, fallen = time.perf_counter(), 0
        for text in sample:
            fallen += rule.rejects(Page(text))
        worth[rule.name] = fallen / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda r: -worth[r.name])


def first_failed(page: Page, ordered: Sequence[Rule]) -> str | None:
    """Name of the first rule of the cascade that rejects the page; None if it is kept."""
    return next((r.name for r in ordered if r.rejects(page)), None)


def cascade_sample(docs: DataFrame) -> list[str]:
    """The bounded sample of ``docs`` on which the rules are measured."""
    marked = docs.select("doc_id", F.lit(0).alias("any"))
    return [t for t, _ in labelled_sample(docs, marked, "any", F.lit(True), SAMPLE_DOCS, SAMPLE_CHARS)[0]]


def judged(text: Column, ordered: Sequence[Rule]) -> Column:
    """Struct of kept and failed_rule by the cascade alone."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            failed = [first_failed(Page(t), ordered) for t in batch]
            yield pd.DataFrame({"kept": [f is None for f in failed], "failed_rule": pd.Series(failed, dtype=object)})

    return F.pandas_udf(run, "kept boolean, failed_rule string")(F.coalesce(text, F.lit("")))


def reported(text: Column, ordered: Sequence[Rule]) -> Column:
    """Struct of the figures, base_failed and kept; the cascade reuses the figures."""
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = [r for r in ordered if r.name in BASE_RULES]
    rest = [r for r in ordered if r.name not in BASE_RULES]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in [*figures, "base_failed", "kept"]}
            for text in batch:
                page = Page(text)
                for name in figures:
                    out[name].append(getattr(page, name))
                failed = first_failed(page, base) is not None
                out["base_failed"].append(failed)
                out["kept"].append(not failed and first_failed(page, rest) is None)
            yield pd.DataFrame(out)

    kinds = ", ".join([*(f"{name} long" for name in figures), "base_failed boolean", "kept boolean"])
    return F.pandas_udf(run, kinds)(F.coalesce(text, F.lit("")))


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram
      FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             coalesce(l.n, 0) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_marks
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= n_words AND 2 * n_marks <= n_words AND 2 * n_dup_lines <= n_lines
         AND word_chars BETWEEN 2 * n_words AND 20 * n_words AS kept
FROM b
"""


@query("op10_rules", RULES_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    ordered = cascade_order(cascade_sample(docs))
    return docs.select("doc_id", reported(F.col("text"), ordered).alias("r")).select("doc_id", "r.*")
