"""Quality classification with naive Bayes support vectors.

A text is the set of its n-grams: words, and runs of up to three word shapes
(case, ending, whether the word repeats the one before).  Each indicator is
scaled by the log-count ratio of its n-gram between the classes, and a linear
hinge-loss model is fitted on the scaled, normalised indicators by dual
coordinate descent.  A logistic curve fitted on rows held back from the
descent turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.samples import bounded, remainder
from factloom.llm.words import LOWER, SPACES, U, gram_hashes, mix, slices, spans, whole_grams, word_hashes

BITS = 18
#: Labelled rows that are fetched for fitting; whole texts.
SAMPLE = 6000
C = 1.0
PASSES = 20
CUT = 0.7

_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_MARK = np.zeros(256, np.int64)
_MARK[0x21:0x30] = _MARK[0x3A:0x41] = _MARK[0x5B:0x61] = _MARK[0x7B:0x7F] = 1


def _shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A small code of each word's looks, hashed."""
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    up, mark = total(_UPPER[buf]), total(_MARK[buf])
    caps, marks, size = up[ends] - up[starts], mark[ends] - mark[starts], ends - starts
    last = buf[ends - 1].astype(np.int64) * _MARK[buf[ends - 1]]
    again = np.zeros(len(words), np.int64)
    again[1:] = words[1:] == words[:-1]
    inner = first[:-1]
    again[inner[inner < len(words)]] = 0
    code = np.minimum(caps, 2) + 3 * np.minimum(marks, 4) + 15 * again + 30 * np.minimum(np.log2(size).astype(np.int64), 5) + 180 * last
    return mix(code.astype(U) + U(1))


def features(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of each text's n-grams, text by text, and each text's first (one more entry than texts)."""
    starts, ends, first = spans(buf, bounds, SPACES)
    words = word_hashes(LOWER[buf], starts, ends)
    looks = _shapes(buf, starts, ends, words, first)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    found = [(doc, mix(words + U(11)))]
    for n in (1, 2, 3):
        at = np.flatnonzero(whole_grams(first, n))
        found.append((doc[at], mix(gram_hashes(looks, n)[at] + U(n))))
    key = np.concatenate([d.astype(np.int64) << BITS | (h >> U(64 - BITS)).astype(np.int64) for d, h in found])
    key = np.unique(key)
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(bounds)))


@dataclass
class QualityModel:
    weight: np.ndarray  # model weight times log-count ratio
    square: np.ndarray  # squared log-count ratio, for the norm
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        idx, first = features(buf, bounds)
        out = np.full(len(bounds) - 1, float(self.bias))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            norm = np.add.reduceat(self.square[idx], first[full])
            out[full] += np.add.reduceat(self.weight[idx], first[full]) / np.sqrt(np.maximum(norm, 1e-12))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = [self.margins(buf, bounds) for _, _, buf, bounds in slices(texts)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def fit(texts: list[str], labels: list[int], seed: int = 5) -> QualityModel:
    """Learn from whole texts; every fifth is kept for the logistic curve."""
    size = 1 << BITS
    bags: list[np.ndarray] = []
    for _, _, buf, bounds in slices(pa.array(texts, pa.string())):
        idx, first = features(buf, bounds)
        bags += [idx[a:z] for a, z in zip(first[:-1], first[1:])]
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 0.0, 40.0 if len(y) and y[0] else -40.0 if len(y) else 0.0)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    count = [np.ones(size), np.ones(size)]
    for k in train:
        count[y[k]][bags[k]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[(count[0] == 1) & (count[1] == 1)] = 0.0
    x = [ratio[b] / max(1e-6, np.sqrt((ratio[b] ** 2).sum())) for b in bags]
    sign = 2.0 * y - 1
    # Both classes weigh the same in the hinge loss; the curve below restores their frequencies.
    cost = C * len(train) / 2 / np.where(sign > 0, (y[train] == 1).sum(), (y[train] == 0).sum())
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    q = np.array([v @ v + 1 for v in x])
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for k in rng.permutation(train):
            g = sign[k] * (w[bags[k]] @ x[k] + bias) - 1
            new = min(max(alpha[k] - g / q[k], 0.0), cost[k])
            d = (new - alpha[k]) * sign[k]
            if d:
                alpha[k] = new
                w[bags[k]] += d * x[k]
                bias += d
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    model = QualityModel(w * ratio, ratio**2, float(bias))
    at = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else train
    _curve(model, np.concatenate([model.margins(buf, bounds) for _, _, buf, bounds in slices(pa.array([texts[k] for k in at], pa.string()))]), y[at])
    return model


def _curve(model: QualityModel, z: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of the logistic curve by Newton steps, with softened labels."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, s = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (r * z).sum() + 1e-4 * a, r.sum()
        haa, hab, hbb = (s * z * z).sum() + 1e-3, (s * z).sum(), s.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if max(abs(da), abs(db)) < 1e-8:
            break
    model.slope, model.shift = float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most ``sample`` whole labelled texts that are not held out.

    Only as many documents as wanted are joined: the labels are thinned first, by the id's hash.
    Of several labels of one document the lowest counts.  Without labels, or without
    documents, the model knows nothing and scores every text alike.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(remainder("doc_id", 4) != 2).groupBy("doc_id").agg(F.min("label").alias("label"))
    n = known.count()
    spin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("long")
    some = known.where(spin < int(min(1.0, 1.2 * sample / max(1, n)) * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(remainder("doc_id", 4) != 2)
    got = bounded(texts.join(some, "doc_id"), "label", sample, by_label=False)
    return fit([r["text"] for r in got], [r["label"] for r in got])


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score in 0 to 1, predicted.

    Defined results: a null or empty text has no n-grams and gets the model's
    score for none; repeated rows are each scored; an empty input gives an
    empty result.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(predict, "doc_id long, score double, predicted int")
