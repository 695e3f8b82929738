"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover it to its end. In a chunk
every byte becomes a learned vector, filters over eight bytes slide over it in steps of
four, and each filter keeps its largest response. A hidden layer over these maxima gives
the chunk a value; the mean, the largest and the smallest value of a document's chunks
are combined into one probability.

Defined cases: null and empty texts are one chunk of zero bytes; without labels of both
kinds every score is 1, so that nothing is rejected. Rows are scored one by one in blocks
of chunks, so repeated rows, extra columns and very long texts need nothing special.
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

#: Bound of the sample the network is fitted on: documents of each label, code points of each.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 4000
CHUNK, STEP, HOP = 512, 448, 4
WIDTH, FILTERS, HIDDEN = 6, 24, 16
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 6, 1200, 64, 0.004, 5
#: Chunks that are held in memory at a time.
BLOCK = 256
FOLDS, HELD_OUT, KEEP = 4, 2, 0.7


@dataclass
class QualityModel:
    bytes_: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # 2 * HOP * WIDTH x FILTERS
    shift: np.ndarray
    hidden: np.ndarray
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray
    calibration: np.ndarray | None = None


def chunks_of(text: str | None) -> np.ndarray:
    """The chunks of a text's UTF-8 bytes, the last one ending where the text ends."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    if len(raw) <= CHUNK:
        out = np.zeros((1, CHUNK), dtype=np.uint8)
        out[0, : len(raw)] = raw
        return out
    starts = np.append(np.arange(0, len(raw) - CHUNK, STEP), len(raw) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


def _responses(model: QualityModel, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded bytes (n, positions, HOP * WIDTH) and filter responses (n, positions - 1, FILTERS)."""
    x = model.bytes_[chunks].reshape(len(chunks), CHUNK // HOP, HOP * WIDTH)
    half = HOP * WIDTH
    both = x @ np.concatenate([model.filters[:half], model.filters[half:]], axis=1)
    return x, both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]


def chunk_values(model: QualityModel, chunks: np.ndarray) -> np.ndarray:
    values = []
    for at in range(0, len(chunks), BLOCK):
        _, r = _responses(model, chunks[at : at + BLOCK])
        pooled = np.maximum(r.max(1) + model.shift, 0)
        h = np.maximum(pooled @ model.hidden + model.hidden_shift, 0)
        values.append(h @ model.out + model.out_shift[0])
    return np.concatenate(values)


def _summary(values: np.ndarray) -> np.ndarray:
    return np.array([values.mean(), values.max(), values.min(), 1.0])


def document_summaries(model: QualityModel, texts: list[str | None]) -> np.ndarray:
    """Per document: mean, largest and smallest chunk value, and a one."""
    cut = [chunks_of(t) for t in texts]
    values = chunk_values(model, np.concatenate(cut))
    ends = np.cumsum([len(c) for c in cut])
    return np.array([_summary(v) for v in np.split(values, ends[:-1])])


def _start(rng: np.random.Generator) -> QualityModel:
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    zero = lambda n: np.zeros(n, dtype=np.float32)
    embed = rng.standard_normal((256, WIDTH)).astype(np.float32)
    embed[0] = 0
    return QualityModel(
        embed, draw(2 * HOP * WIDTH, FILTERS), zero(FILTERS), draw(FILTERS, HIDDEN), zero(HIDDEN), draw(HIDDEN), zero(1)
    )


_TRAINED = ("bytes_", "filters", "shift", "hidden", "hidden_shift", "out", "out_shift")


def _gradients(model: QualityModel, chunks: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss; only the position of a filter's largest
    response passes one on."""
    n, half = len(chunks), HOP * WIDTH
    x, r = _responses(model, chunks)
    at = r.argmax(1)
    pooled = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + model.shift
    on = pooled > 0
    p1 = pooled * on
    h = p1 @ model.hidden + model.hidden_shift
    h1 = np.maximum(h, 0)
    z = np.clip(h1 @ model.out + model.out_shift[0], -30, 30)
    dz = (weight * (1 / (1 + np.exp(-z)) - y) / n).astype(np.float32)
    dh = dz[:, None] * model.out * (h > 0)
    dp = (dh @ model.hidden.T) * on
    rows = np.arange(n)[:, None]
    seen = np.concatenate([x[rows, at], x[rows, at + 1]], axis=2)  # n, FILTERS, 2 * half
    dx = dp[:, :, None] * model.filters.T[None]
    places = (at * HOP)[:, :, None] + np.arange(2 * HOP)
    found = chunks[rows[:, :, None], places]
    d_bytes = np.zeros_like(model.bytes_)
    np.add.at(d_bytes, found.reshape(-1), dx.reshape(-1, WIDTH))
    return {
        "bytes_": d_bytes,
        "filters": np.einsum("nf,nfk->kf", dp, seen),
        "shift": dp.sum(0),
        "hidden": p1.T @ dh,
        "hidden_shift": dh.sum(0),
        "out": h1.T @ dz,
        "out_shift": dz.sum(keepdims=True),
    }


def fit_quality(sample: list[tuple[str, int]], totals: dict[int, int]) -> QualityModel | None:
    """Adam over chunks that carry their document's label, both labels weighing alike;
    then the document's probability is calibrated on documents kept aside."""
    texts = sorted({t: int(y) for t, y in sample}.items())
    aside = [(t, y) for i, (t, y) in enumerate(texts) if i % 5 == 0]
    used = [(chunks_of(t), y) for i, (t, y) in enumerate(texts) if i % 5]
    if len({y for _, y in used}) < 2 or len({y for _, y in aside}) < 2:
        return None
    chunks = np.concatenate([c for c, _ in used])
    y = np.concatenate([np.full(len(c), label, dtype=np.float32) for c, label in used])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(SEED)
    model = _start(rng)
    first = {k: np.zeros_like(getattr(model, k)) for k in _TRAINED}
    second = {k: np.zeros_like(getattr(model, k)) for k in _TRAINED}
    per_epoch = -(-len(chunks) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    step, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(chunks))
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            for k, g in _gradients(model, chunks[pick], y[pick], weight[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
                getattr(model, k)[...] -= (rate * move).astype(np.float32)
    x = document_summaries(model, [t for t, _ in aside])
    ya = np.array([y for _, y in aside], dtype=float)
    share = np.where(ya == 1, totals[1] / (ya == 1).sum(), totals[0] / (ya == 0).sum())
    share *= len(ya) / share.sum()
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        w -= np.linalg.solve(hessian, x.T @ (share * (p - ya)) + 0.1 * w)
    model.calibration = w
    return model


def quality_score(text: Column, model: QualityModel | None) -> Column:
    """Probability that ``text`` is of good quality."""
    if model is None:
        return F.lit(1.0)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            done = []
            for at in range(0, len(batch), 64):
                x = document_summaries(model, list(batch.iloc[at : at + 64]))
                done.append(1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30))))
            yield pd.Series(np.concatenate(done) if done else np.zeros(0))

    return F.pandas_udf(scores, "double")(F.coalesce(text, F.lit("")))


def quality_model(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """The network fitted on labelled rows of ``docs`` that are not held out."""
    usable = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return fit_quality(*labelled_sample(docs, labels, "quality", usable, SAMPLE_DOCS, SAMPLE_CHARS))


@query("op5_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        quality_score(F.col("text"), quality_model(docs, labels)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
