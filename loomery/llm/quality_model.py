"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators (present or not) of hashed byte 1- to 4-grams of the text and of bigrams over word shapes (does a
word repeat the one before, or the one before that). Every indicator is scaled by its log-count ratio between the two
classes, and a linear hinge-loss model is fitted on the scaled indicators by dual coordinate descent. The margin is
mapped to 0..1 by a logistic curve (Platt) fitted on cross-validated margins.

Training reads at most TRAIN_ROWS labelled rows, those with the smallest hash of their id, in one task; the fitted
weights, of fixed size, go to every task. Scoring reads every row whole and moves no data.

Defined cases: null and empty texts have no indicator and get the score of the bias alone; null labels are not used; of
repeated labels of a document each counts; with no labels, or one class, every score is the smoothed share of label 1; a
null doc_id is never held out and never used for training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import bytes_np as bn

DIM = 1 << 18
#: Labelled rows that the fit reads at most.
TRAIN_ROWS = 8000
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 8
#: The logistic curve is fitted on margins of rows that their fold's model has not seen.
FOLDS = 3
THRESHOLD = 0.3
_ORDERS = (1, 2, 3, 4)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5: such rows are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Features:
    """Distinct feature numbers of each text of a column."""

    def __init__(self):
        self.last = np.zeros(DIM, np.int64)

    def _distinct(self, f: np.ndarray) -> np.ndarray:
        at = np.arange(len(f))
        self.last[f] = at  # the last place wins, so each number keeps one place
        return f[self.last[f] == at]

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        shift = np.uint64(64 - 18)
        for a, b, data, offs in bn.chunks(column):
            code = np.zeros(len(data), np.uint64)
            grams = []
            with np.errstate(over="ignore"):
                for n in _ORDERS:
                    code = code[: len(data) - n + 1]
                    code = (code << np.uint64(8)) | data[n - 1 :] if len(data) >= n else code[:0]
                    grams.append((bn.mixed(code * np.uint64(8) + np.uint64(n)) >> shift).astype(np.int64))
            s, e, first = bn.word_spans(data, offs)
            h = bn.span_hash(bn.prefix_sums(data), s, e)
            shape = np.zeros(len(h), np.uint64)
            shape[1:] |= (h[1:] == h[:-1]).astype(np.uint64)
            shape[2:] |= (h[2:] == h[:-2]).astype(np.uint64) << np.uint64(1)
            shape[3:] |= (h[3:] == h[:-3]).astype(np.uint64) << np.uint64(2)
            pair = (bn.mixed(shape[:-1] * np.uint64(64) + shape[1:] * np.uint64(8) + np.uint64(7)) >> shift).astype(np.int64)
            for k in range(b - a):
                lo, hi = int(offs[k]), int(offs[k + 1])
                w0, w1 = int(first[k]) + 3, int(first[k + 1])  # shapes look three words back, within the text
                parts = [g[lo : max(lo, hi - n + 1)] for n, g in zip(_ORDERS, grams, strict=True)]
                parts.append(pair[w0 : max(w0, w1 - 1)])
                yield self._distinct(np.concatenate(parts))


def coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model on indicators times ``scale``."""
    w, bias = np.zeros(len(scale)), 0.0
    norms = np.array([scale[r] @ scale[r] + 1.0 for r in rows])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r]
            slope = y[i] * (w[r] @ x + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), COST)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-6:
            break
    return w * scale, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = margin.std() or 1.0
    m = margin / spread
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - target) * m).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p)
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return a / spread, b


def fit(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """The model as one vector: weights by feature, then bias, Platt's a and b."""
    y = np.where(label > 0, 1.0, -1.0)
    n1 = (y > 0).sum()
    out = np.zeros(DIM + 3)
    if n1 == 0 or n1 == len(y):
        share = (n1 + 1) / (len(y) + 2)
        out[DIM + 2] = np.log(share / (1 - share))
        return out
    margin = np.zeros(len(rows))
    fold = np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        train_, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len({*y[train_]}) < 2:
            train_ = np.arange(len(rows))
        w, bias = support_vectors([rows[i] for i in train_], y[train_])
        margin[test] = [w[rows[i]].sum() + bias for i in test]
    out[:DIM], out[DIM] = support_vectors(rows, y)
    out[DIM + 1], out[DIM + 2] = platt(margin, y)
    return out


def support_vectors(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by feature and bias: log-count ratios, then coordinate descent on the scaled indicators."""
    counts = np.full((2, DIM), SMOOTHING)
    for r, t in zip(rows, y, strict=True):
        counts[int(t > 0), r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return coordinate_descent(rows, y, ratio)


def _featured(b: pa.RecordBatch) -> pa.RecordBatch:
    packed = []
    for f in Features().of(b.column("text")):
        if len(f) > DIM // 32:  # a bitmap is smaller
            bits = np.zeros(DIM, np.uint8)
            bits[f] = 1
            packed.append(b"\1" + np.packbits(bits).tobytes())
        else:
            packed.append(b"\0" + f.astype("<i4").tobytes())
    columns = [b.column("doc_id"), b.column("y"), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "f"])


def _unpacked(data: bytes) -> np.ndarray:
    if data[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))
    return np.frombuffer(data, "<i4", offset=1).astype(np.int64)


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "y", "f"])
    order = np.random.default_rng(1).permutation(len(pdf))
    rows = [_unpacked(x) for x in pdf["f"]]
    model = fit([rows[i] for i in order], pdf["y"].to_numpy()[order])
    return pd.DataFrame({"model": [model.astype("<f8").tobytes()]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on at most ``rows`` labelled rows that are not held out."""
    usable = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    # at most `rows` rows, so their broadcast has a fixed bound
    sample = (
        usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "y")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _featured(b)

    featured = joined.mapInArrow(run, "doc_id long, y int, f binary")
    # a doc_id may be many rows: the bound is on rows
    featured = featured.orderBy(F.xxhash64("doc_id"), "y", "f").limit(rows).withColumn("one", F.lit(1))

    def fit_all(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fitted(pdf)

    got = featured.groupBy("one").applyInPandas(fit_all, "model binary").first()  # one vector of fixed size
    if got is None:
        return fit([], np.zeros(0))
    return np.frombuffer(got.model, "<f8")


def _scored(b: pa.RecordBatch, model: np.ndarray, features: Features) -> pa.RecordBatch:
    w, bias, a, c = model[:DIM], model[DIM], model[DIM + 1], model[DIM + 2]
    margin = np.array([w[f].sum() for f in features.of(b.column("text"))], np.float64) + bias
    score = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            yield _scored(b, sent.value, features)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
