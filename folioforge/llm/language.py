"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams (one to three bytes of lower-case letters, with
blanks at the ends of words) in order. A document's own profile is compared to each
language's by the out-of-place distance: the sum, over the document's n-grams, of how far
apart their ranks are, or the greatest rank if the language's profile lacks them.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is
every text if no language could be learned. Equal distances go to the smaller name.
Rows are judged one by one, so repeated rows and extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table
from folioforge.llm.registry import query
from folioforge.llm.sampling import fold, labelled_sample

#: Bound of the sample the profiles come from: documents of each language, code points of each.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
LONGEST, PROFILE = 3, 400
FOLDS, HELD_OUT = 4, 2
NO_LANGUAGE = "und"

_ONLY_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numerals such as a half or a Roman six are none."""
    return any(map(str.isalpha, text))


@dataclass
class LanguageProfiles:
    languages: list[str]
    grams: np.ndarray  # sorted codes of all profiles
    ranks: np.ndarray  # languages x grams, PROFILE where a language lacks the gram


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text and their counts; a code packs the bytes."""
    kept = text.lower().encode("utf-8", "replace").translate(_ONLY_LETTERS).split()
    raw = np.frombuffer(b" " + b" ".join(kept) + b" ", dtype=np.uint8).astype(np.uint32)
    found, codes = [raw], raw
    for n in range(1, LONGEST):
        codes = (codes[:-1] << 8) | raw[n:]
        found.append(codes)
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent codes in order; equal counts by code."""
    key = (counts.astype(np.int64) << 32) | (0xFFFFFFFF - codes.astype(np.int64))
    if len(key) > PROFILE:
        key = np.partition(key, len(key) - PROFILE)[-PROFILE:]
    return (0xFFFFFFFF - (np.sort(key)[::-1] & 0xFFFFFFFF)).astype(np.uint32)


def fit_profiles(sample: list[tuple[str, str]]) -> LanguageProfiles | None:
    totals: dict[str, dict[int, int]] = {}
    for text, language in sample:
        if not has_letter(text):
            continue
        own = totals.setdefault(language, {})
        for code, n in zip(*(a.tolist() for a in gram_counts(text)), strict=True):
            own[code] = own.get(code, 0) + n
    if not totals:
        return None
    languages = sorted(totals)
    profiles = []
    for language in languages:
        own = totals[language]
        profiles.append(ranked(np.array(list(own), dtype=np.uint32), np.array(list(own.values()))))
    grams = np.unique(np.concatenate(profiles))
    ranks = np.full((len(languages), len(grams)), PROFILE, dtype=np.int64)
    for i, profile in enumerate(profiles):
        ranks[i, np.searchsorted(grams, profile)] = np.arange(len(profile))
    return LanguageProfiles(languages, grams, ranks)


def distances(text: str, profiles: LanguageProfiles) -> np.ndarray:
    """Out-of-place distance of a text to every language."""
    own = ranked(*gram_counts(text))
    at = np.minimum(np.searchsorted(profiles.grams, own), len(profiles.grams) - 1)
    known = profiles.grams[at] == own
    place = np.arange(len(own))
    gaps = np.abs(profiles.ranks[:, at] - place)
    lacking = ~known | (profiles.ranks[:, at] == PROFILE)
    return np.where(lacking, PROFILE, gaps).sum(1)


def language_of(text: Column, profiles: LanguageProfiles | None) -> Column:
    """Struct of lang_pred and score; the score is the runner-up's share of the two
    smallest distances, so 0.5 is a tie and 1 a perfect match."""
    if profiles is None:
        return F.struct(F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = [], []
            for text in batch:
                if text is None or not has_letter(text):
                    names.append(NO_LANGUAGE)
                    scores.append(0.0)
                    continue
                d = distances(text, profiles)
                best = int(d.argmin())
                rest = int(np.delete(d, best).min()) if len(d) > 1 else 1
                names.append(profiles.languages[best])
                scores.append(float(rest / (rest + d[best])) if rest + d[best] else 0.5)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(judge, "lang_pred string, score double")(text)


@query("op9_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    sample, _ = labelled_sample(docs, docs, "lang", ~held_out, SAMPLE_DOCS, SAMPLE_CHARS)
    judged = docs.select(
        "doc_id", held_out.alias("held_out"), language_of(F.col("text"), fit_profiles(sample)).alias("found")
    )
    return judged.select("doc_id", "held_out", "found.lang_pred", "found.score")
