import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import near_dedup
from gridloom.llm.components import connected
from gridloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from gridloom.llm.shingles import ConsistentSampler, arrow_bytes, features_of, node_keys, outlines, runs, similarity_bounds, unpacked, weighted_jaccard, word_hashes, words_of


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows, least=0.8):
    """Brute force: all pairs that share a shingle, exact weights, connected components; ids of rows with the same words are one."""
    s = [shingles(t) for _, t in rows]
    df = Counter(k for x in s for k in x)
    n = len(rows)
    w = [{k: c * (1 + 0.5 * min(1.0, math.log(n / df[k]) / math.log(64))) for k, c in x.items()} for x in s]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, x in enumerate(s):
        for k in x:
            by[k].append(i)
        if not x:
            by["none"].append(i)
    for a, b in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        keys = w[a].keys() | w[b].keys()
        top = sum(max(w[a].get(k, 0), w[b].get(k, 0)) for k in keys)
        if not top or sum(min(w[a].get(k, 0), w[b].get(k, 0)) for k in keys) >= least * top:
            parent[root(a)] = root(b)
    out = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        out[root(i)].append(doc_id)
    return out


def expected(rows):
    return sorted(((d, min(x for x in c if x is not None) if any(x is not None for x in c) else None, len(c)) for c in classes(rows).values() for d in c), key=repr)


def got(found):
    return sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in found), key=repr)


def test_equals_brute_force_on_documents(documents):
    found = near_duplicates(documents).collect()
    assert got(found) == expected([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert sum(r["kept"] for r in found) == len({r["class_id"] for r in found})


def test_odd_rows_and_stage(odd, none):
    found = near_duplicates(odd).collect()
    assert got(found) == expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in found)
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_chains_in_one_bucket_lose_no_link(spark, monkeypatch):
    """All rows share one bucket; a long chain of texts of which only neighbours are similar is still one class."""
    base = [f"x{k}" for k in range(400)]
    texts = [" ".join(base[12 * k : 12 * k + 150]) for k in range(14)] + [" ".join(f"z{k}q{j}" for j in range(60)) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_dedup._signatures

    def one_bucket(*args):
        return signed(*args).withColumn("bands", F.array(F.lit(1).cast("long")))

    monkeypatch.setattr(near_dedup, "_signatures", one_bucket)
    found = near_duplicates(docs, least=0.7).collect()
    want = sorted(((d, min(c), len(c)) for c in classes(list(enumerate(texts)), 0.7).values() for d in c), key=repr)
    assert got(found) == want and max(n for _, _, n in want) == 14


def test_components(spark):
    edges = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in [(1, 2), (2, 3), (9, 8), (3, 4), (7, 6), (6, 5), (5, 8)]], "node binary, hub binary")
    for one_task in (0, 100):
        assert {(r["node"][0], r["cls"][0]) for r in connected(edges, one_task).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5)}


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    f = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64))
    wa, wb = rng.uniform(0.5, 4, 300).astype(np.float32), rng.uniform(0.5, 4, 300).astype(np.float32)
    want = float(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    sample = ConsistentSampler(2000)
    a, b = (sample(np.zeros(300, np.int64), f, w, 1)[0] for w in (wa, wb))
    assert abs((a == b).mean() - want) < 0.04 and weighted_jaccard(f, wa, f, wb) == pytest.approx(want, rel=1e-5)
    assert weighted_jaccard(f[:0], wa[:0], f, wb) == 0.0


def test_outlines_bound_similarities_from_above():
    rng = np.random.default_rng(5)
    f = np.unique(rng.integers(0, 1 << 52, 400).astype(np.uint64))
    picks = [np.sort(rng.choice(len(f), rng.integers(1, 300), replace=False)) for _ in range(60)]
    weights = [rng.uniform(1, 3, len(p)).astype(np.float32) for p in picks]
    packed = [outlines(np.zeros(len(p), np.int64), f[p], w, 1)[0].tobytes() for p, w in zip(picks, weights, strict=True)]
    for i in range(59):
        bound = similarity_bounds(unpacked([packed[i]]), unpacked([packed[i + 1]]))[0, 0]
        assert bound >= weighted_jaccard(f[picks[i]], weights[i], f[picks[i + 1]], weights[i + 1]) - 1e-5
    assert 1 <= similarity_bounds(unpacked(packed[:1]), unpacked(packed[:1]))[0, 0] < 1.05


def test_features_count_shingles():
    owner, feature, tf = features_of(["a b c d e a b c d e", "", "one two", "A b c d e"])
    assert Counter(owner.tolist()) == {0: 5, 2: 1, 3: 1} and tf.tolist().count(2) == 1
    assert feature[owner == 3][0] in feature[owner == 0]


def test_words_and_their_hashes_are_those_of_the_texts():
    texts = ["a b", "  ", "é À b\x1cc  d", "x" * 100 + " yy", "", "a\tb\nc\rd\x0be\x0cf", "b a", "long-word-of-many-bytes B", "long-word-of-many-bytes\n\nb", "日本語 テキスト"] * 3
    data, at = arrow_bytes(pa.array(texts))
    hashes, keys = {}, {}
    for first, last in runs(at, 64):
        flat, counts = word_hashes(data, at[first : last + 1])
        assert counts.tolist() == [len(words_of(t)) for t in texts[first:last]]
        for w, h in zip([w for t in texts[first:last] for w in words_of(t)], flat.tolist(), strict=True):
            assert hashes.setdefault(w, h) == h
        for t, key in zip(texts[first:last], node_keys(flat, counts), strict=True):
            assert keys.setdefault(tuple(words_of(t)), key.tobytes()) == key.tobytes()
    assert len(set(hashes.values())) == len(hashes) and len(set(keys.values())) == len(keys)


def test_a_large_group_of_copies_that_do_not_all_link(spark, monkeypatch):
    """Copies with many edits each: many blocks, many outsiders; classes are those of brute force over what shares a bucket."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for at in rng.choice(len(words), int(rng.integers(0, 6)), replace=False):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_dedup._signatures
    monkeypatch.setattr(near_dedup, "_signatures", lambda *args: signed(*args).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "RUN", 40)
    want = sorted(((d, min(c), len(c)) for c in classes(list(enumerate(texts))).values() for d in c), key=repr)
    assert got(near_duplicates(docs).collect()) == want and len({c for _, c, _ in want}) > 1
