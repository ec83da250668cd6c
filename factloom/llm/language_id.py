"""Language identification with averaged hashed subword embeddings.

A text's features are the byte n-grams of its words, hashed into one table of
embeddings; their mean goes through a linear softmax.  Embeddings and softmax
are learned together by stochastic gradient descent in numpy on a bounded
sample.  As embedding and softmax are linear, prediction adds up the rows of
their product, a table of a few MB whatever the input.

A fifth of the sample is held back to calibrate: a temperature that makes the
confidence a probability, and the confidence under which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.samples import bounded, remainder
from factloom.llm.words import LOWER, slices

ORDERS = (2, 3)
BITS = 15
DIM = 16
EPOCHS = 6
RATE = 0.5
#: Rows of each language that are fetched for fitting and calibrating; whole texts.
SAMPLE = 600
#: Share of accepted calibration rows that may be wrong; rejection begins above the lowest confidence that meets it.
ERROR = 0.005
#: No text of a learned language is rejected above this confidence.
CERTAIN = 0.6
UND = "und"

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def features(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of all texts, in order of texts, and each text's first n-gram (one more entry than texts).

    An n-gram lies within a word or reaches one byte beyond it at either end.
    """
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    wide = np.zeros(len(buf) + n + 1, np.uint8)
    wide[np.arange(len(buf)) + row + 1] = LOWER[buf]
    letter = _LETTER[wide]
    wide[~letter] = 0
    edge = bounds + np.arange(n + 1)
    b = wide.astype(np.uint32)
    parts = []
    for order in ORDERS:
        m = len(b) - order + 1
        if m <= 0:
            continue
        ok = letter[:m] | letter[order - 1 : order - 1 + m] if order == 2 else np.ones(m, bool)
        for k in range(1, order - 1):
            ok &= letter[k : k + m]
        h = np.full(m, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            h = (h ^ b[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        at = np.flatnonzero(ok)
        parts.append((at, (h[at] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)))
    # Texts in turn, and within a text order by order: sums over a text do not mind.
    firsts = [np.searchsorted(at, edge) for at, _ in parts]
    if len(parts) == 1:
        return parts[0][1].astype(np.int64), firsts[0]
    out = np.empty(sum(len(at) for at, _ in parts), np.int64)
    first = sum(firsts) if parts else np.zeros(n + 1, np.int64)
    shift = np.zeros(n, np.int64)
    for (at, idx), f in zip(parts, firsts):
        size = np.diff(f)
        out[np.arange(len(at)) - np.repeat(f[:-1], size) + np.repeat(first[:-1] + shift, size)] = idx
        shift += size
    return out, first


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # rows of the embedding table times the softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def logits(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        idx, first = features(buf, bounds)
        n = np.diff(first)
        out = np.tile(self.bias, (len(n), 1))
        full = np.flatnonzero(n)
        if len(full):
            out[full] += np.add.reduceat(self.table[idx], first[full], axis=0) / n[full, None]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and calibrated confidence of each text; ``und`` and 0 for those without a letter."""
        names: list[str] = []
        scores = []
        for lo, hi, buf, bounds in slices(texts):
            z = self.logits(buf, bounds) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best, top = p.argmax(axis=1), p.max(axis=1)
            has = _has_letter(buf, bounds)
            names += [self.labels[k] if ok else UND for k, ok in zip(best, has)]
            scores.append(np.where(has, top, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def _has_letter(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    low = LOWER[buf]
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
    has = count((low >= 0x61) & (low <= 0x7A)) > 0
    for k in np.flatnonzero(~has & (count(buf >= 0x80) > 0)):
        has[k] = any(map(str.isalpha, buf[bounds[k] : bounds[k + 1]].tobytes().decode()))
    return has


def fit(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    """Learn from whole texts; every fifth of them calibrates."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([UND], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    y = np.array([names.index(x) for x in labels])
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, buf, bounds in slices(pa.array(texts, pa.string())):
        idx, first = features(buf, bounds)
        for a, z in zip(first[:-1], first[1:]):
            u, c = np.unique(idx[a:z], return_counts=True)
            bags.append((u, c / max(1, z - a)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    late = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    train = np.flatnonzero(~late)
    total, step = EPOCHS * max(1, len(train)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(train):
            u, w = bags[k]
            rate = RATE * (1 - step / total)
            step += 1
            if not len(u):
                continue
            mean = w @ emb[u]
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[k]] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * g
            # The share of a text's single n-gram is tiny; scaled to the text's distinct ones, steps do not shrink with its length.
            emb[u] -= rate * min(len(u), 200) * w[:, None] * back[None, :]
    model = LanguageModel(names, (emb @ out).astype(np.float32), bias)
    if late.any():
        _calibrate(model, [texts[k] for k in np.flatnonzero(late)], y[late])
    return model


def _calibrate(model: LanguageModel, texts: list[str], y: np.ndarray) -> None:
    z = np.concatenate([model.logits(buf, bounds) for _, _, buf, bounds in slices(pa.array(texts, pa.string()))])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    s = z / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    top, wrong = p.max(axis=1), p.argmax(axis=1) != y
    order = np.argsort(-top)
    errors = np.cumsum(wrong[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(errors <= ERROR)
    last = int(fine[-1]) + 1 if len(fine) else 0
    model.reject = 0.0 if last == len(y) else min(CERTAIN, float(top[order[last]]) + 1e-9)


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Fit on at most ``sample`` whole texts a language, out of rows that are labelled and not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    got = bounded(rows.where("label is not null and text is not null").where(remainder("doc_id", 3) != 1), "label", sample, by_label=True)
    return fit([r["text"] for r in got], [r["label"] for r in got])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, rejected.

    Defined results: a null text, or one without a letter, is ``und`` with
    score 0 and rejected; repeated rows are each reported; an empty input
    gives an empty result.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = m.predict(b.column(1))
            gone = [x == UND or s < m.reject for x, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their columns."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = m.predict(b.column(at))
            yield b.filter(pa.array([x != UND and s >= m.reject for x, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
