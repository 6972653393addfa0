"""Quality scores by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, text_or_empty
from .shingles import batches_of, mixed
from .wordtable import WordTable, summed

#: Bounds of the training sample, which is drawn by hash of doc_id: trusted positives and unlabelled texts.
MOST_POSITIVE, MOST_UNLABELLED = 3_000, 6_000
#: Hashed words, numbers of a word, and numbers of a text's form.
BUCKETS, WORD_WIDTH, FORM = 1_024, 10, 13
STEPS, RATE, DECAY, SEED = 250, 0.02, 1e-3, 5
#: From this score on a text is predicted to be good.
THRESHOLD = 0.3

_SYMBOLS = frozenset("#*$%&|<>")
_PUNCTUATION = frozenset(string.punctuation) - _SYMBOLS


def _word_rows(words: list[str]) -> np.ndarray:
    out = np.empty((len(words), WORD_WIDTH), np.float32)
    for k, w in enumerate(words):
        n, letters = len(w), sum(map(str.isalpha, w))
        out[k] = (
            xxhash.xxh32_intdigest(w) % BUCKETS,
            n,
            sum(map(str.isupper, w)),
            letters,
            sum(map(str.isdigit, w)),
            sum(c in _SYMBOLS for c in w),
            sum(c in _PUNCTUATION for c in w),
            n <= 3,
            n > 12,
            letters == 0,
        )
    return out


class Featurizer:
    """Rows of BUCKETS + FORM numbers for whole texts: roots of the shares of hashed words, then the form of the text."""

    def __init__(self):
        self.table = WordTable(WORD_WIDTH, _word_rows)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._some(x, texts[k : k + len(x)]) for k, x in batches_of(texts, lower=False)] or [np.zeros((0, BUCKETS + FORM), np.float32)])

    def _some(self, lists: list[list[str]], texts: list[str]) -> np.ndarray:
        counts = np.array([len(x) for x in lists], np.int64)
        ids, owner = self.table.ids(lists), np.repeat(np.arange(len(lists)), counts)
        rows, n = self.table.rows[ids], np.maximum(counts, 1)[:, None]
        bag = np.bincount(owner * BUCKETS + rows[:, 0].astype(np.int64), minlength=len(lists) * BUCKETS).reshape(len(lists), BUCKETS)
        s = summed(rows[:, 1:], counts)
        chars = np.maximum(s[:, :1], 1)
        distinct = lambda key, own: np.bincount(np.unique((own.astype(np.uint64) << np.uint64(48)) | (key >> np.uint64(16))) >> np.uint64(48), minlength=len(lists))
        h = mixed(ids.astype(np.uint64) + np.uint64(1))
        inside = owner[2:] == owner[:-2]
        three = mixed((h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])[inside]
        windows = np.maximum(counts - 2, 1)
        lines = np.array([t.count("\n") + 1 for t in texts])
        form = np.column_stack(
            [
                s[:, 0] / n[:, 0] / 10,
                s[:, 1:6] / chars,
                s[:, 6:9] / n,
                distinct(h, owner) / n[:, 0],
                np.where(counts > 2, distinct(three, owner[2:][inside]) / windows, 1.0),
                np.log1p(counts) / 10,
                np.log1p(counts / lines) / 5,
            ]
        )
        return np.concatenate([np.sqrt(bag / n), form], axis=1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) * self.scale) @ self.weight + self.bias).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int) -> tuple[np.ndarray, float]:
    """Logistic loss, Adam. Without a prior: positives against unlabelled. With one: the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where its second term is below zero, the step goes up that term
    instead, so that it can't be driven down by overfitting.
    """
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        if prior is None:
            dp, du = (sp - 1) / len(p), su / len(u)
        else:
            negative = np.mean(-np.log1p(-su + 1e-9)) - prior * np.mean(-np.log1p(-sp + 1e-9))
            up, uu = sp / len(p), su / len(u)
            dp, du = (prior * (sp - 1) / len(p) - prior * up, uu) if negative >= 0 else (prior * up, -uu)
        g = np.append(p.T @ dp.astype(np.float32) + u.T @ du.astype(np.float32) + DECAY * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b)


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled texts, by the best bin: the least ratio of the shares of unlabelled and of
    positive texts above a score, over scores that many positives reach, on halves the scoring model hasn't seen."""
    w, b = _fit(p[::2], u[::2], None, STEPS // 2)
    sp, su = np.sort(p[1::2] @ w + b), np.sort(u[1::2] @ w + b)
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0.0, 0.7, 71))
    above = lambda s: (len(s) - np.searchsorted(s, cuts)) / len(s)
    qp, qu = above(sp), above(su)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((qu + slack * 0.5) / qp)
    return float(np.clip(qu[best] / qp[best], 0.05, 0.95))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS) -> Model:
    """Both sorted the same way each time give the same model. Both arrays are changed."""
    if not len(positive) or not len(unlabelled):
        width = BUCKETS + FORM
        return Model(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width, np.float32), 0.0, 0.5)
    parts, n = (positive, unlabelled), len(positive) + len(unlabelled)
    mean = (sum(x.sum(axis=0, dtype=np.float64) for x in parts) / n).astype(np.float32)
    form = [x[:, BUCKETS:].astype(np.float64) - mean[BUCKETS:] for x in parts]
    spread = np.sqrt(sum((x * x).sum(axis=0) for x in form) / n)
    scale = np.full(len(mean), 3.0, np.float32)
    scale[BUCKETS:] = 1 / np.maximum(spread, 1e-3)
    # in place: the driver holds the sample once
    for x in parts:
        x -= mean
        x *= scale
    p, u = parts
    prior = estimated_prior(p, u)
    return Model(mean, scale, *_fit(p, u, prior, steps), prior)


def fold(doc_id: str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", folds: int = 5, held: int = 0, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learn from trusted positives (label 1) and unlabelled texts of all folds but ``held``; label 0 is never read.

    Both are samples by hash of doc_id of about ``most_positive`` and ``most_unlabelled`` rows at most, the only bound
    here; their features, not their texts, come to the driver.
    """
    open_ = F.coalesce(fold("doc_id", folds) != held, F.lit(False))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    trusted = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter((F.col("label") == 1) & open_).select("doc_id").distinct()
    chosen = trusted.filter(lot < most_positive / max(1, trusted.count()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).filter(open_)
    share = most_unlabelled / max(1, rows.select("doc_id").count())
    other = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(1 << 30)) / float(1 << 30) < share
    # at most about most_positive rows, by the sampling above
    joined = rows.join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left")
    sample = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), other.alias("other")).filter("trusted OR other")

    def made(batches):
        make = Featurizer()
        for b in batches:
            x = make(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "trusted": b["trusted"], "other": b["other"], "x": [r.tobytes() for r in x]})

    found = sample.mapInPandas(released(made), "doc_id string, trusted boolean, other boolean, x binary").toArrow()
    flags = {c: np.array(found.column(c).to_pylist(), bool) for c in ("trusted", "other")}
    h = np.array([xxhash.xxh64_intdigest(str(d)) for d in found.column("doc_id").to_pylist()], np.uint64)
    chunks = [np.frombuffer(c.buffers()[2], np.float32, len(c) * (BUCKETS + FORM), int(np.frombuffer(c.buffers()[1], np.int32)[c.offset])) for c in found.column("x").chunks if len(c)]
    x = (np.concatenate(chunks) if chunks else np.zeros(0, np.float32)).reshape(len(h), BUCKETS + FORM)
    del found, chunks
    # rows of equal ids by what they hold, so that the order is the same each time
    order = np.lexsort((*x[:, ::-97].T, h))
    return train(*(x[order[flags[c][order]]] for c in ("trusted", "other")))


def _scores(model: Model, make: Featurizer, column: pa.Array) -> np.ndarray:
    """Texts become Python's a few at a time, so a worker holds a batch once."""
    found = [np.zeros(0)]
    for k in range(0, len(column), 512):
        texts = [t or "" for t in column.slice(k, 512).to_pylist()]
        found.append(model.score(make(texts)))
        found[-1][[not t or t.isspace() for t in texts]] = 0.0
    return np.concatenate(found)


def quality_scores(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (without ``text``) with score and predicted, in place of columns of these names.

    A score reads nothing but the whole text; texts without words (and nulls) score 0. Empty tables give empty results.
    """
    docs = docs.select(text, *[c for c in docs.columns if c.lower() not in (text.lower(), "score", "predicted")])
    schema = T.StructType(docs.schema.fields[1:]).add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        make = Featurizer()
        for b in batches:
            score = _scores(shared.value, make, b.column(text))
            kept = b.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept.schema.names, "score", "predicted"])

    return docs.mapInArrow(released(scored), schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(batches):
        make = Featurizer()
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, make, b.column(text)) >= threshold))

    return docs.mapInArrow(released(good), docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    held_out rows (crc32(doc_id as text) mod ``folds`` = ``held``) have no part in training. A null doc_id is in no fold
    and trains nothing. Repeated rows get equal scores. Without positives or texts to learn from, every score is 0.5.
    """
    model = fit_quality(docs, labels, text, doc_id, label, folds, held)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scores = quality_scores(rows, model, "text", threshold)
    return scores.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")
