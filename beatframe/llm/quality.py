"""Quality: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from beatframe.llm import samples
from beatframe.llm.common import blocks_of, letters_of, mix, span_hashes, text_bytes

BITS = 18  # of an n-gram's place in the feature space
LIMIT = 3000  # labelled documents of each class that the model is fitted on, at most


def _classes() -> np.ndarray:
    """Small letters by themselves, capitals, digits and bytes from 128 on as one class each, other bytes by themselves."""
    table = np.arange(256, dtype=np.uint32)
    table[65:91], table[48:58], table[128:] = 65, 48, 128
    return table


_CLASS = _classes()
_PLACES = np.uint64((1 << BITS) - 1)


def features(data: bytes) -> np.ndarray:
    """Sorted distinct places of a whole text's n-grams: 2 to 4 characters, 1 and 2 words, and for runs of 2 to 5 words, which of
    them repeat the word before."""
    seen = np.zeros(1 << BITS, bool)
    for part in blocks_of(data):
        codes = _CLASS[np.frombuffer(part, np.uint8)]
        gram = codes
        for n in (2, 3, 4):
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * np.uint32(257) + codes[n - 1 :]
            seen[((gram * np.uint32(2654435761 + 2 * n)) >> np.uint32(32 - BITS)).astype(np.intp)] = True
        sums, starts, ends = letters_of(part)
        words = span_hashes(sums, starts, ends)
        seen[(words & _PLACES).astype(np.intp)] = True
        if len(words) > 1:
            seen[(mix(words[:-1] * np.uint64(3) + words[1:]) & _PLACES).astype(np.intp)] = True
            same = (words[1:] == words[:-1]).astype(np.uint64)
            run = same
            for n in (1, 2, 3, 4):
                if n > 1:
                    run = run[: len(same) - n + 1] * np.uint64(2) + same[n - 1 :]
                if len(run):
                    seen[(mix(np.unique(run) + np.uint64(1000 * n)) & _PLACES).astype(np.intp)] = True
    return np.flatnonzero(seen).astype(np.uint32)


@dataclass
class Model:
    weights: np.ndarray  # of each place, the log-count ratio already in it
    bias: float
    slope: float
    offset: float

    def score(self, places: np.ndarray) -> float:
        margin = (float(self.weights[places].sum()) / np.sqrt(max(1, len(places)))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """The naive Bayes part: log of the smoothed share of class 1's indicators at each place over that of class 0."""
    counts = np.full((2, 1 << BITS), smooth)
    for places, label in zip(rows, y, strict=True):
        counts[int(label > 0), places] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, passes: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge loss with a squared norm, by dual coordinate descent: each step solves for one row's dual variable exactly.

    y is -1 or 1, cost the upper bound of each row's dual variable. Returns weights and bias (the bias is regularised too)."""
    w, b = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            slack = y[i] * (float(w[at] @ v) + b) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                b += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, b


def platt(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps with a small penalty; never a falling curve."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(weight * (p - y) * margins).sum() + 0.01 * (a - 1), (weight * (p - y)).sum() + 0.001 * b])
        s = weight * p * (1 - p)
        h = np.array([[(s * margins * margins).sum() + 0.01, (s * margins).sum()], [(s * margins).sum(), s.sum() + 0.001]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return max(a, 0.05), b


def train(rows: list[np.ndarray], y: np.ndarray, totals: dict[int, int]) -> Model:
    """Fit on feature rows with labels 0 and 1; totals: how many labelled documents of each class there are, for the scores'
    base rate. Without rows of one class every score is the share of class 1, 0.5 without any."""
    n1, n0 = int((y > 0).sum()), int((y == 0).sum())
    if not n1 or not n0:
        p = 0.5 if not n1 + n0 else min(max(n1 / (n1 + n0), 0.01), 0.99)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(p / (1 - p))))
    share = {1: max(totals[1], n1) / n1, 0: max(totals[0], n0) / n0}
    apart = np.arange(len(rows)) % 5 == 4  # a fifth fits the curve
    if min((y[apart] > 0).sum(), (y[apart] == 0).sum()) < 5:
        apart[:] = False
    ratios = log_ratios([r for r, out in zip(rows, apart, strict=True) if not out], y[~apart])
    values = [ratios[r] / np.sqrt(max(1, len(r))) for r in rows]
    fit = np.flatnonzero(~apart)
    w, b = descend([rows[i] for i in fit], [values[i] for i in fit], np.where(y[fit] > 0, 1.0, -1.0), np.full(len(fit), 1.0))
    on = np.flatnonzero(apart) if apart.any() else fit
    margins = np.array([float(w[rows[i]] @ values[i]) + b for i in on])
    weight = np.where(y[on] > 0, share[1], share[0])
    slope, offset = platt(margins, (y[on] > 0).astype(float), weight / weight.mean())
    return Model(w * ratios, b, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = LIMIT) -> Model:
    """Fit on at most `limit` labelled documents of each class; their features, not their texts, come to the driver."""
    chosen = samples.sample(docs, labels, key, text, label, limit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x).tobytes() for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(2).cast(pa.int32())], names=["places", "y"])

    found = chosen.mapInArrow(run, "places binary, y int").toArrow()
    rows = [np.frombuffer(x.as_py(), np.uint32) for x in found.column("places")]
    y = np.array(found.column("y").to_pylist(), np.int64)
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes(), y[i]))  # the same for every partitioning
    order = np.random.default_rng(1).permutation(np.array(order, np.int64))
    return train([rows[i] for i in order], y[order], samples.class_counts(labels, key, label))


def score(docs: DataFrame, model: Model, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, score (0 to 1, higher: class 1 likelier) and predicted (1 if score >= 0.5, else 0) for each row, by its whole text.

    Null texts count as empty; an empty text has the score of a document without n-grams. Rows with nulls in keep, repeated rows and
    ties stay; an empty table gives an empty one; columns not in keep are left out, whatever their names."""
    keep = list(keep)
    rows = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, the same for every corpus

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = np.array([own.score(features(x)) for x in text_bytes(batch.column(len(keep)))], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made), pa.array((made >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run, schema)
