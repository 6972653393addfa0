"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small_or_salted
from .quality_model import fold
from .shingles import arrow_bytes, runs

#: The training sample: about this many documents of each language by hash of doc_id and no more in all, WINDOWS runs of WINDOW
#: characters of each.
MOST_DOCS, MOST_SAMPLE, WINDOWS, WINDOW = 250, 20_000, 12, 64
HIDDEN, STEPS, BATCH, RATE, SEED = 8, 500, 128, 0.02, 11
#: The network runs over CHUNK bytes at a time, and starts CONTEXT bytes before (and, backwards, behind) them.
CHUNK, CONTEXT = 512, 24
#: What stands outside a text: the states stay as they are.
OUTSIDE = 256


def padded(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(u) for u in units], np.int64)
    x = np.zeros((len(units), int(n.max())), np.int64)
    inside = np.arange(x.shape[1]) < n[:, None]
    x[inside] = np.frombuffer(b"".join(units), np.uint8)
    return x, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _reversed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each row's first n places in reverse; the rest stays."""
    k = np.arange(x.shape[1])
    at = np.where(k < n[:, None], n[:, None] - 1 - k, k)
    return np.take_along_axis(x, at if x.ndim == 2 else at[:, :, None], axis=1)


@dataclass
class Network:
    """Two gated recurrent layers, one for each direction: a byte's row of ``e`` is what it adds to the update gate, the
    reset gate and the candidate; ``u`` is the recurrence. Each position's label comes from both states there."""

    e: np.ndarray  # 2 x 256 x 3H
    u: np.ndarray  # 2 x H x 3H
    v: np.ndarray  # 2H x labels
    c: np.ndarray  # labels
    labels: list[str]

    def states(self, x: np.ndarray, n: np.ndarray, keep: list | None = None) -> np.ndarray:
        """texts x positions x 2H states; ``keep`` gets what the way back needs."""
        h_dim = self.u.shape[1]
        both = np.stack([x, _reversed(x, n)])
        h = np.zeros((2, len(x), h_dim), np.float32)
        out = np.zeros((2, len(x), x.shape[1], h_dim), np.float32)
        for t in range(x.shape[1]):
            a = np.stack([self.e[d][both[d, :, t]] for d in (0, 1)])
            r_h = h @ self.u
            zr = _sigmoid(a[..., : 2 * h_dim] + r_h[..., : 2 * h_dim])
            z, r = zr[..., :h_dim], zr[..., h_dim:]
            new = np.tanh(a[..., 2 * h_dim :] + r * r_h[..., 2 * h_dim :])
            if keep is not None:
                keep.append((both[:, :, t], h, z, r, new, r_h[..., 2 * h_dim :]))
            h = new + z * (h - new)
            out[:, :, t] = h
        return np.concatenate([out[0], _reversed(out[1], n)], axis=2)

    def probabilities(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A probability of each label at every position."""
        y = self.states(x, n) @ self.v + self.c
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return y / y.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, n: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        keep: list = []
        s = self.states(x, n, keep)
        y = s @ self.v + self.c
        y = np.exp(y - y.max(axis=2, keepdims=True))
        p = y / y.sum(axis=2, keepdims=True)
        mask = (np.arange(x.shape[1]) < n[:, None]).astype(np.float32)
        rows = np.arange(len(x))
        loss = float(-(np.log(p[rows, :, target] + 1e-9) * mask).sum() / mask.sum())
        p[rows, :, target] -= 1
        d = (p * (mask / mask.sum())[:, :, None]).astype(np.float32)
        dv, dc = np.tensordot(s, d, ((0, 1), (0, 1))), d.sum(axis=(0, 1))
        h_dim = self.u.shape[1]
        ds = d @ self.v.T
        dh_out = np.stack([ds[:, :, :h_dim], _reversed(ds[:, :, h_dim:], n)])
        de, du, dh = np.zeros_like(self.e), np.zeros_like(self.u), np.zeros((2, len(x), h_dim), np.float32)
        d_all, bytes_all = [], []
        for t in range(x.shape[1] - 1, -1, -1):
            byte, h, z, r, new, r_new = keep[t]
            dh = dh + dh_out[:, :, t]
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * r_new * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_new], axis=2)
            d_rec = np.concatenate([d_z, d_r, d_new * r], axis=2)
            d_all.append(d_a)
            bytes_all.append(byte)
            du += h.transpose(0, 2, 1) @ d_rec
            dh = dh * z + d_rec @ self.u.transpose(0, 2, 1)
        d_rows, byte_rows = np.concatenate(d_all, axis=1), np.concatenate(bytes_all, axis=1)
        for k in (0, 1):
            order = np.argsort(byte_rows[k], kind="stable")
            b = byte_rows[k][order]
            first = np.flatnonzero(np.diff(b, prepend=-1))
            de[k][b[first]] = np.add.reduceat(d_rows[k][order], first, axis=0)
        return loss, [de, du, dv.astype(np.float32), dc.astype(np.float32)]


def train(units: list[bytes], targets: np.ndarray, labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> Network:
    """Adam over batches with as many units of each label; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    shape = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    net = Network(shape(2, 256, 3 * hidden), shape(2, hidden, 3 * hidden) * np.float32(2 / np.sqrt(hidden)), shape(2 * hidden, len(labels)), np.zeros(len(labels), np.float32), labels)
    by_label = [np.flatnonzero(targets == k) for k in range(len(labels))]
    each = max(1, batch // len(labels))
    params = [net.e, net.u, net.v, net.c]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, each) for x in by_label])
        x, n = padded([units[k] for k in pick])
        _, grads = net.gradients(x, n, targets[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * t / steps) * min(1.0, 1.0 / (norm + 1e-9)) if norm > 1 else RATE * (1 - 0.9 * t / steps)
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """A network's pass over texts of any length, many chunks of bytes at once; arrays hold a row for each unit of a state."""

    def __init__(self, net: Network):
        h = net.u.shape[1]
        # sigmoid(x) is half of 1 + tanh(x / 2): gates are halved here
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        outside = np.concatenate([np.full(h, 60.0), np.zeros(2 * h)]).astype(np.float32)
        self.e = [np.ascontiguousarray(np.concatenate([e, outside[None]]).T * half[:, None]) for e in net.e]
        self.u = [np.ascontiguousarray((u * half).T) for u in net.u]
        self.v, self.c = np.ascontiguousarray(net.v.T), net.c[:, None].astype(np.float32)
        self.hidden = h

    def _states(self, d: int, x: np.ndarray, out: np.ndarray) -> None:
        """States of direction ``d`` over the columns of ``x``, CONTEXT places and then as many as ``out`` has, which gets them."""
        h_dim, n = self.hidden, x.shape[1]
        h = np.zeros((h_dim, n), np.float32)
        a, rec = np.empty((3 * h_dim, n), np.float32), np.empty((3 * h_dim, n), np.float32)
        gates, new = a[: 2 * h_dim], a[2 * h_dim :]
        places = range(len(x)) if d == 0 else range(len(x) - 1, -1, -1)
        for k, t in enumerate(places):
            np.take(self.e[d], x[t], axis=1, out=a, mode="clip")
            np.matmul(self.u[d], h, out=rec)
            gates += rec[: 2 * h_dim]
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            rec[2 * h_dim :] *= gates[h_dim:]
            new += rec[2 * h_dim :]
            np.tanh(new, out=new)
            h -= new
            h *= gates[:h_dim]
            h += new
            if k >= CONTEXT:
                out[t - CONTEXT if d == 0 else t] = h

    def sums(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each row of bytes the sums of its positions' label probabilities."""
        size = np.diff(at)
        many = -(-size // CHUNK)
        row = np.repeat(np.arange(len(size)), many)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * CHUNK
        total = np.zeros((len(size), len(self.c)))
        if not len(row):
            return total
        length = np.minimum(size[row] - start, CHUNK)
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(order), 1024):
            some = order[k : k + 1024]
            n = int(length[some[0]])
            place = start[some] - CONTEXT + np.arange(n + 2 * CONTEXT)[:, None]
            inside = (place >= 0) & (place < size[row[some]])
            x = np.where(inside, data[np.where(inside, place + at[row[some]], at[0])], np.int64(OUTSIDE))
            states = np.empty((n, 2 * self.hidden, len(some)), np.float32)
            self._states(0, x[: n + CONTEXT], states[:, : self.hidden])
            self._states(1, x[CONTEXT:], states[:, self.hidden :])
            y = np.matmul(self.v, states) + self.c
            y -= y.max(axis=1, keepdims=True)
            np.exp(y, out=y)
            y /= y.sum(axis=1, keepdims=True)
            y *= (np.arange(n)[:, None] < length[some])[:, None, :]
            np.add.at(total, row[some], y.sum(axis=0).T)
        return total


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 4, held: int = 2, most_docs: int = MOST_DOCS, most_sample: int = MOST_SAMPLE) -> Network | None:
    """Learn from text and non-null lang of all folds but ``held``; None if there is nothing to learn from.

    The sample is about ``most_docs`` documents of each language, and ``most_sample`` in all, at most, by hash of doc_id, the
    only bound here; of each, WINDOWS runs of WINDOW characters, evenly spaced, come to the driver.
    """
    open_ = F.coalesce(fold(doc_id, folds) != held, F.lit(False))
    rows = docs.filter(open_ & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = min(most_docs, most_sample / max(1, counts.count()))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    step = F.greatest((F.length("text") - WINDOW) / (WINDOWS - 1), F.lit(0.0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: (k * step).cast("int") + 1))
    windows = F.transform(starts, lambda k: F.substring(F.col("text"), k, F.lit(WINDOW)))
    drawn = join_small_or_salted(rows, counts, "lang").filter(lot < each / F.col("n"))
    found = drawn.select("lang", windows.alias("windows")).toPandas()
    pairs = sorted((la, w.encode("utf-8", "replace")) for la, ws in zip(found["lang"], found["windows"], strict=True) for w in ws if w)
    if not pairs:
        return None
    labels = sorted({la for la, _ in pairs})
    return train([w for _, w in pairs], np.array([labels.index(la) for la, _ in pairs]), labels)


def identify_languages(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (without ``text``) with lang_pred and score, in place of columns of these names.

    The network reads the bytes of the whole text, words and what is between them, in both directions; a text of more than
    CHUNK bytes is read in chunks, each from CONTEXT bytes before it (behind it, backwards) on. Every position has label
    probabilities; the document's are their mean, the score is the largest. A text that is null or has no letter is ``und``
    with score 0, as is every text without a network.
    """
    docs = docs.select(text, *[c for c in docs.columns if c.lower() not in (text.lower(), "lang_pred", "score")])
    schema = T.StructType(docs.schema.fields[1:]).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def predicted(batches):
        model = shared.value
        reader = Reader(model) if model else None
        names = [*model.labels, "und"] if model else ["und"]
        for b in batches:
            texts = b.column(text).fill_null("")
            label, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if reader:
                data, at = arrow_bytes(texts, lower=False)
                for first, last in runs(at):
                    s = reader.sums(data, at[first : last + 1])
                    has = np.array([any(map(str.isalpha, t.as_py())) for t in texts.slice(first, last - first)])
                    p = s / np.maximum(np.diff(at[first : last + 1]), 1)[:, None]
                    label[first:last][has] = p.argmax(axis=1)[has]
                    score[first:last][has] = p.max(axis=1)[has]
            kept = b.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([names[x] for x in label.tolist()], pa.string()), pa.array(np.clip(score, 0, 1))], [*kept.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predicted, schema)


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    held_out rows (crc32(doc_id as text) mod ``folds`` = ``held``) have no part in training; a prediction reads nothing
    but the text. A null doc_id is in no fold and trains nothing, a null lang trains nothing. Repeated rows get equal
    results, empty tables empty ones. Other columns are ignored.
    """
    net = fit_languages(docs, text, lang, doc_id, folds, held)
    found = identify_languages(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), net)
    return found.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
