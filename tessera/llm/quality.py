"""Quality scores by regularised quadratic discriminant analysis over transformed statistics of a document.

Each class has a mean and a covariance that is shrunk towards the pooled one and towards its own diagonal, factored
once (Cholesky). A document's score is the logistic of the difference of the two Gaussian log densities, computed from
the Mahalanobis norms of two triangular solves, plus the log odds of the classes; slope and offset are calibrated on
the training rows.

All labelled rows train: their counts, sums and products add up inside each partition, so that a few hundred numbers a
partition are summed and only two small matrices reach the driver. Labels, language, source and id are no inputs.

Defined cases: a null text is empty; empty texts get the score of all-zero statistics; a null id counts as held out;
repeated rows score alike, and repeated labels count as often as they occur; null labels don't train; without two
classes the share of label 1 (0.5 if none) is every score; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Shrinkage of a class covariance towards the pooled one, and of the result towards its diagonal; least variance.
TO_POOLED, TO_DIAGONAL, LEAST_VARIANCE = 0.1, 0.1, 1e-3
#: Bins of the histogram of log-density differences that calibrates the scores.
BINS = 512
#: Score from which a document is predicted to have label 1.
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "loud": b"!?", "odd": b"#$%&*@^~_=+<>\\/{}[]|`",
    "line": b"\n\r", "quote": b"\"'()-",
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _i] = 1
#: Words that end in a symbol other than sentence punctuation, and words without a letter.
_SYMBOL_ENDS = re.compile(rb"[!#$%&*+/<=>@\\^_`{|}~-](?=\s|\Z)")
_NO_LETTER = re.compile(rb"(?<!\S)[^A-Za-z\x80-\xff\s]+(?!\S)")

N_FEATURES = len(_CLASSES) + 12


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logs of counts, square roots of shares."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, n_words = max(len(raw), 1), max(len(words), 1)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / n
    counts = Counter(words)
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    top = max(counts.values(), default=0)
    lengths = list(map(len, words))
    mean_length = sum(lengths) / n_words
    spread = math.sqrt(max(sum(x * x for x in lengths) / n_words - mean_length**2, 0.0))
    entropy = -sum(c / n_words * math.log(c / n_words) for c in counts.values())
    return [
        *np.sqrt(shares).tolist(),
        math.log1p(len(raw)),
        math.log1p(len(words)),
        math.log1p(len(raw) / n_words),
        math.sqrt(len(counts) / n_words),
        math.sqrt(top / n_words),
        math.sqrt(repeats / n_words),
        entropy / math.log(n_words + 1) if words else 0.0,
        math.sqrt(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
        math.sqrt(len(_SYMBOL_ENDS.findall(raw)) / n_words),
        math.sqrt(len(_NO_LETTER.findall(raw)) / n_words),
        math.log1p(spread),
        math.log1p(len(raw) / max(len(lines), 1)),
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row (where ``row_col`` names a key of the rows) and features of every row, written to the shared folder: the texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                features = [statistics(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(features, pa.list_(pa.float64()))], ["doc_id", "row", "features"])

    row = F.lit(None).cast("long") if row_col is None else F.col(row_col).cast("long")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), row.alias("row")).mapInArrow(run, "doc_id long, row long, features array<double>")
    return materialise(rows, "features")


class Model:
    """Two Gaussians with cached Cholesky factors, or a constant."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        counts = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        total = sum(counts.values())
        self.constant, self.slope, self.offset = None, 0.1, 0.0
        if min(counts.values()) < 2:
            self.constant = counts[1] / total if total else 0.5
            return
        means = {k: moments[k][1] / counts[k] for k in (0, 1)}
        own = {k: moments[k][2] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)}
        pooled = sum(counts[k] * own[k] for k in (0, 1)) / total
        self.classes = []
        for k in (0, 1):
            s = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
            s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s))
            factor = np.linalg.cholesky(s + LEAST_VARIANCE * np.eye(len(s)))
            log_det = 2 * float(np.log(np.diag(factor)).sum())
            # The factor's inverse, computed once, turns each solve into a product.
            self.classes.append((means[k], np.linalg.inv(factor), math.log(counts[k] / total) - 0.5 * log_det))

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log-density differences, label 1 less label 0."""
        density = [c - 0.5 * np.square((x - mean) @ inverse.T).sum(axis=1) for mean, inverse, c in self.classes]
        return density[1] - density[0]

    def calibrate(self, centres: np.ndarray, counts: np.ndarray) -> None:
        """Densities of high dimension are over-confident: a logistic fit (Newton steps, smoothed targets) of slope and offset to ``counts[label, bin]``."""
        zeros, ones = counts.sum(axis=1)
        target = (np.array([1 / (zeros + 2), (ones + 1) / (ones + 2)])[:, None] * counts).sum(axis=0)
        scale = max(1.0, float(np.abs(centres[counts.sum(axis=0) > 0]).max()))
        z, weight, beta = np.stack([centres / scale, np.ones_like(centres)], axis=1), counts.sum(axis=0), np.zeros(2)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -60, 60)))
            gradient = z.T @ (target - weight * p)
            hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        if beta[0] > 0:
            self.slope, self.offset = beta[0] / scale, beta[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(x) + self.offset, -60, 60)))


def _bin(differences: np.ndarray) -> np.ndarray:
    """Bins that are even in the inverse hyperbolic sine, which reaches any size."""
    return np.clip((np.arcsinh(differences) / 20 + 0.5) * BINS, 0, BINS - 1).astype(np.int32)


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """The model of all rows of ``features`` that have a label: moments are summed per partition, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy().reshape(len(y), -1)
            x = np.hstack([np.ones((len(y), 1)), x])
            for k in (0, 1):
                own = x[y == k]
                sums[k] = sums.get(k, 0) + own.T @ own
        for k, s in sums.items():
            at = np.arange(s.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s.ravel())], ["label", "at", "s"])

    labelled = labels.where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("label"))
    training = materialise(features.join(labelled, "doc_id").select("features", "label"), "training")
    parts = training.mapInArrow(run, "label int, at int, s double")
    size = N_FEATURES + 1
    product = {k: np.zeros(size * size) for k in (0, 1)}
    for label, at, s in parts.groupBy("label", "at").agg(F.sum("s")).collect():  # 2 * size**2 numbers
        product[label][at] = s
    moments = {}
    for k, flat in product.items():
        m = flat.reshape(size, size)
        if m[0, 0]:
            moments[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    model = Model(moments)
    if model.constant is not None:
        return model

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy().reshape(len(y), -1)
            np.add.at(counts, (y, _bin(model.differences(x))), 1)
        label, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[label, at])], ["label", "at", "n"])

    counts = np.zeros((2, BINS))
    for label, at, n in training.mapInArrow(bins, "label int, at int, n double").groupBy("label", "at").agg(F.sum("n")).collect():  # 2 * BINS numbers
        counts[label, at] = n
    model.calibrate(np.sinh(((np.arange(BINS) + 0.5) / BINS - 0.5) * 20), counts)
    return model


def held_out(id_col: str = "doc_id"):
    """A fifth of all ids, by checksum; their labels never train."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, row (only with ``row_col``, a key of the rows), held_out, score, predicted."""
    features = feature_table(docs, row_col=row_col)
    model = fit(features.where(~held_out()), labels.where(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(x))], ["doc_id", "row", "score"])

    scored = features.mapInArrow(run, "doc_id long, row long, score double")
    return scored.select("doc_id", *([] if row_col is None else ["row"]), held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
