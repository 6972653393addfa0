"""Word shingles of whole texts as weighted features, and consistent samples of them, for many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
#: Words and texts handled at once; a feature keeps 52 of its 64 bits beside a text's place in a batch.
BATCH_WORDS, BATCH_TEXTS, FEATURE_BITS = 150_000, 4_096, 52
#: Bytes of text hashed at once: at most 2**12 rows of them, so that a row's number fits beside a feature.
RUN_BYTES, RUN_ROWS = 1 << 19, 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def words_of(text: str, lower: bool = True) -> list[str]:
    """``[^\\x20\\x09-\\x0D]+``, by default in lower case."""
    text = text.lower() if lower else text
    return text.split() if text.isascii() and not _ODD_SPACE.search(text) else _WORD.findall(text)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches_of(texts: list[str], lower: bool = True):
    """Yield (first, lists of words) for runs of texts of bounded size; a longer text is a run of its own."""
    some: list[list[str]] = []
    n = first = 0
    for k, t in enumerate(texts):
        w = words_of(t, lower)
        if some and (n + len(w) > BATCH_WORDS or len(some) >= BATCH_TEXTS):
            yield first, some
            some, n, first = [], 0, k
        some.append(w)
        n += len(w)
    if some:
        yield first, some


def arrow_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, in lower case, and where each row begins (and the last ends)."""
    texts = column.cast(pa.large_string())
    texts = pc.utf8_lower(texts) if lower else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def runs(at: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of at most ``most`` bytes together; a longer row is a run of its own."""
    first = 0
    while first < len(at) - 1:
        last = min(first + RUN_ROWS, max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1))
        yield first, last
        first = last


def hashed_spans(b: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, of all their bytes, eight at a time, and their lengths."""
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))
    h = mixed((eight[first] & _LOW_BYTES[np.minimum(length, 8)]) + length.astype(np.uint64) * _ODD)
    rest = np.flatnonzero(length > 8)
    k = 8
    while len(rest):
        left = np.minimum(length[rest] - k, 8)
        h[rest] = mixed(h[rest] * _ODD + (eight[first[rest] + k] & _LOW_BYTES[left]))
        k += 8
        rest = rest[length[rest] > k]
    return h


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of rows that lie one after another in ``data``, and each row's number of words."""
    b = data[at[0] : at[-1]]
    ends = at[1:] - at[0]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    word = (b != 32) & ((b - np.uint8(9)) > 4)
    cut = np.zeros(len(b) + 1, bool)
    cut[0] = True
    cut[ends] = True
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    closes[:-1] &= ~word[1:] | cut[1:-1]
    first = np.flatnonzero(begins)
    length = np.flatnonzero(closes) + 1 - first
    return hashed_spans(b, first, length), np.diff(np.searchsorted(first, np.concatenate([[0], ends])))


def node_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bytes for each row's sequence of words, as a row of two numbers: equal for equal sequences."""
    ends = np.cumsum(counts)
    place = (np.arange(len(flat)) - np.repeat(ends - counts, counts)).astype(np.uint64)
    out = np.zeros((len(counts), 2), np.uint64)
    has = counts > 0
    for k in (0, 1):
        part = mixed(flat + (place + np.uint64(k << 40)) * _ODD)
        if has.any():
            out[has, k] = np.add.reduceat(part, (ends - counts)[has])
        out[:, k] = mixed(out[:, k] + counts.astype(np.uint64) * _ODD)
    return out


def features(flat: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of rows of hashed words: row number, feature (sorted within a row), count.

    A row of fewer than ``size`` words has one shingle of them all, an empty one has none.
    """
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(flat)) - (ends - counts)[owner]
    short = counts < size
    total = np.zeros(len(flat), np.uint64)
    for k in range(size):
        total *= _ODD
        total[: len(flat) - k] += flat[k:]
    for row in np.flatnonzero(short & (counts > 0)).tolist():
        begin = ends[row] - counts[row]
        total[begin] = int.from_bytes(xxhash.xxh64_digest(flat[begin : ends[row]].tobytes()), "big")
    keep = (place + size <= counts[owner]) | (place == 0)
    key = np.sort((owner[keep].astype(np.uint64) << np.uint64(FEATURE_BITS)) | (mixed(total[keep]) >> np.uint64(64 - FEATURE_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), key & np.uint64((1 << FEATURE_BITS) - 1), tf


def features_of(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of a few texts at once."""
    return features(*word_hashes(*arrow_bytes(pa.array(texts, pa.string()))), size)


class Weigher:
    """Weights of features: their count times an inverse document frequency from a table by hash bucket."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def __call__(self, feature: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[bucket_of(feature, len(self.idf))]


def bucket_of(feature: np.ndarray, buckets: int) -> np.ndarray:
    return (feature & np.uint64(buckets - 1)).astype(np.int64)


#: Hash groups of an outline.
GROUPS = 128


def outlines(owner: np.ndarray, feature: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """For each text GROUPS bytes and a scale: what its features of each hash group weigh together, rounded up to steps of the scale."""
    group = ((feature >> np.uint64(FEATURE_BITS - 7)) & np.uint64(GROUPS - 1)).astype(np.int64)
    sums = np.bincount(owner * GROUPS + group, weights=weight, minlength=texts * GROUPS).reshape(texts, GROUPS)
    scale = np.maximum(sums.max(axis=1) / 254, 1e-30).astype(np.float32)
    steps = np.ceil(sums / scale[:, None] * (1 - 1e-6)).astype(np.uint8)
    return np.concatenate([steps, scale.view(np.uint8).reshape(texts, 4)], axis=1)


def unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest weights by group of outlines."""
    rows = np.frombuffer(b"".join(map(bytes, packed)), np.uint8).reshape(-1, GROUPS + 4)
    steps, scale = rows[:, :GROUPS].astype(np.float32), rows[:, GROUPS:].copy().view(np.float32)
    return np.maximum(steps - 1, 0) * scale, steps * scale * np.float32(1.0001)


def similarity_bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What the weighted Jaccard similarity of each text of a and each of b is at most: groups share no more than the lesser of their weights."""
    out = np.zeros((len(a[0]), len(b[0])), np.float32)
    for k in range(len(out)):
        out[k] = np.minimum(a[1][k], b[1]).sum(axis=1) / np.maximum(np.maximum(a[0][k], b[0]).sum(axis=1), 1e-30)
    return out


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    x = np.concatenate([[0.0], np.geomspace(1e-6, 40, 200_000)])
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


class ConsistentSampler:
    """Improved consistent weighted sampling: for each of ``n`` hashes one (feature, level) of each text, which two texts
    share with a probability equal to their weighted Jaccard similarity.

    r and c are Gamma(2, 1) and beta is uniform, drawn for each feature and hash from 16 bits each of two 32-bit mixes.
    """

    def __init__(self, n: int, seed: int = 1):
        odd = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        self.seeds = (odd.astype(np.uint32) | np.uint32(1)).reshape(n, 2)
        self.r = _gamma_quantiles(1 << 16).astype(np.float32)
        self.log_c = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)

    def __call__(self, owner: np.ndarray, feature: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """An array of texts x n samples as 64-bit values; 0 for texts without features."""
        out = np.zeros((texts, len(self.seeds)), np.uint64)
        if not len(owner):
            return out
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        has, many = owner[starts], np.diff(np.append(starts, len(owner)))
        log_w = np.log(weight).astype(np.float32)
        low, high = feature.astype(np.uint32), (feature >> np.uint64(20)).astype(np.uint32)
        for k, (s1, s2) in enumerate(self.seeds):
            h = (low ^ s2) * s1
            h ^= h >> np.uint32(15)
            h += high * s2
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x297A2D39)
            h ^= h >> np.uint32(15)
            g = (h ^ high) * s1
            g ^= g >> np.uint32(16)
            g *= np.uint32(0x7FEB352D)
            r = self.r[h >> np.uint32(16)]
            beta = (h & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2**-16)
            t = np.floor(log_w / r + beta)
            log_a = self.log_c[g >> np.uint32(16)] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(log_a, starts)
            at = np.flatnonzero(log_a <= np.repeat(least, many))
            chosen = np.zeros(texts, np.int64)
            chosen[owner[at[::-1]]] = at[::-1]
            pick = chosen[has]
            out[has, k] = mixed(feature[pick] * _ODD + t[pick].astype(np.int64).astype(np.uint64))
        return out


def weighted_jaccard(fa: np.ndarray, wa: np.ndarray, fb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of least over sum of greatest weights of two sorted feature lists; 0 if both are empty."""
    total = float(wa.sum() + wb.sum())
    if not total or not len(fa) or not len(fb):
        return 0.0
    at = np.minimum(np.searchsorted(fb, fa), len(fb) - 1)
    both = fb[at] == fa
    common = float(np.minimum(wa[both], wb[at[both]]).sum())
    return common / (total - common)
