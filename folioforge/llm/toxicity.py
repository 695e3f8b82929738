"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled text, both by zstandard's own
trainer: the ordinary one on windows of ordinary documents, the toxic one on the
stretches of toxic documents around the words by which those stand out. The toxic
dictionary lies before the same ordinary content, so that the two compressors differ in
nothing but toxic text. Every window of a document is compressed with both; a window that
the toxic dictionary makes shorter speaks for toxicity. How many bytes count as evidence,
alone and per window, is calibrated on labelled documents that the dictionaries have not
seen.

Defined cases: null and empty texts are one empty window and get the score of no
evidence; without labels of both kinds every score is 0.5 less a little, so that nothing
is predicted toxic. Rows are scored one by one, so repeated rows and extra columns do
not matter, and a very long text needs memory for its windows' differences only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import table
from folioforge.llm.registry import query
from folioforge.llm.sampling import fold, labelled_sample

#: Bound of the sample the model is fitted on: documents of each label, and code points of each.
SAMPLE_DOCS, SAMPLE_CHARS = 2500, 20_000
#: Windows of ordinary documents, evenly taken from all of the sample's, that the trainer gets.
ORDINARY_WINDOWS = 60_000
#: Bytes of a window, step between windows, bytes of the dictionaries' parts.
WINDOW, STEP, ORDINARY_BYTES, TOXIC_BYTES = 96, 72, 100_000, 2000
#: Bytes of a toxic stretch on both sides of its word; the trainer's segment and match length for
#: stretches so short. Chosen on training folds.
REACH, SEGMENT, MATCH = 2, 16, 8
#: A word marks toxic text if it has so many different neighbours in toxic documents (copies of
#: one passage have but one) and is in so many times more of them.
MARK_DOCS, MARK_RATIO = 4, 8
LEVELS = (1, 2, 4, 6)
FOLDS, HELD_OUT = 5, 0

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def _windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP)]


def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    how = zstandard.ZstdCompressionParameters(
        window_log=18,
        chain_log=18,
        hash_log=18,
        search_log=4,
        min_match=6,
        target_length=32,
        strategy=zstandard.STRATEGY_GREEDY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    made = []
    for content in (ordinary, toxic):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=how)
        made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=words))
    return made[0], made[1]


def _evidence(text: bytes, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """What the windows of a document say: the three largest savings, the mean, and how
    many windows, and which share of them, save some bytes or more."""
    windows = _windows(text)
    a, b = ordinary.compress, toxic.compress
    saved = np.fromiter((len(a(w)) - len(b(w)) for w in windows), dtype=np.float64, count=len(windows))
    most = np.zeros(3)
    top = np.sort(saved)[::-1][:3]
    most[: len(top)] = top
    over = saved[None, :] >= np.array(LEVELS)[:, None]
    counts = np.minimum(over.sum(1), 6)
    return np.concatenate([most, [saved.mean()], over.mean(1), counts, [np.log(len(windows))]])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: mean, scale, weights with the intercept last."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        w -= np.linalg.solve(hessian, z.T @ (weight * (p - y)) + w)
    return mean, scale, w


def _stretches(texts: list[bytes], marks: set[bytes]) -> list[bytes]:
    """Every place of a marked word, with a little of what stands around it."""
    return [
        text[max(0, m.start() - REACH) : m.end() + REACH]
        for text in texts
        for m in _WORD.finditer(text)
        if m.group() in marks
    ]


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary trained on ``samples``; of too few to train on, their text itself."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_toxicity(sample: list[tuple[str, int]], totals: dict[int, int]) -> ToxicityModel | None:
    """Dictionaries from seven tenths of the sample, calibration on the rest; ``totals``
    says how common the labels are, so that the score is a probability for real rows."""
    seen: dict[bytes, int] = {}
    for text, label in sample:
        seen.setdefault(_bytes(text), int(label))
    parts: dict[tuple[bool, int], list[bytes]] = {(f, y): [] for f in (True, False) for y in (0, 1)}
    turn = Counter()
    for text, label in seen.items():
        turn[label] += 1
        parts[turn[label] % 10 < 7, label].append(text)
    if not all(parts.values()):
        return None
    toxic, plain = parts[True, 1], parts[True, 0]
    in_toxic, in_plain = Counter(), Counter()
    for texts, seen_in in ((toxic, in_toxic), (plain, in_plain)):
        for text in texts:
            seen_in.update(set(_WORD.findall(text)))
    around: dict[bytes, set[tuple[bytes, bytes]]] = {}
    for text in toxic:
        found = _WORD.findall(text)
        for before, word, after in zip([b"", *found], found, [*found[1:], b""], strict=False):
            if in_toxic[word] >= min(MARK_DOCS, len(toxic)):
                around.setdefault(word, set()).add((before, after))
    marks = {
        w
        for w, c in around.items()
        if len(c) >= min(MARK_DOCS, len(toxic))
        and min(len(c), in_toxic[w]) / len(toxic) > MARK_RATIO * (in_plain[w] + 0.5) / len(plain)
    }
    windows = [w for text in plain for w in _windows(text)]
    windows = windows[:: max(1, len(windows) // ORDINARY_WINDOWS)]
    ordinary = _trained(windows, ORDINARY_BYTES) or b"        "
    both = _trained(_stretches(toxic, marks), TOXIC_BYTES, k=SEGMENT, d=MATCH) + ordinary
    a, b = _compressors(ordinary, both)
    rest = [(t, y) for y in (0, 1) for t in parts[False, y]]
    x = np.array([_evidence(t, a, b) for t, _ in rest])
    y = np.array([y for _, y in rest], dtype=float)
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    mean, scale, w = _logistic(x, y, weight * len(y) / weight.sum())
    return ToxicityModel(ordinary, both, mean, scale, w)


def toxicity_score(text: Column, model: ToxicityModel | None) -> Column:
    """Probability that ``text`` is toxic."""
    if model is None:
        return F.lit(0.49)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, b = _compressors(model.ordinary, model.toxic)
        for batch in batches:
            x = np.array([_evidence(_bytes(t), a, b) for t in batch]).reshape(len(batch), -1)
            z = ((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.pandas_udf(scores, "double")(F.coalesce(text, F.lit("")))


@query("op3_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = fit_toxicity(*labelled_sample(docs, labels, "toxic", ~held_out, SAMPLE_DOCS, SAMPLE_CHARS))
    return docs.select(
        "doc_id", held_out.alias("held_out"), toxicity_score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
