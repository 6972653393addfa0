import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language_id as li
from gridloom.llm import quality_model as qm
from gridloom.llm.language_id import fit_languages, identify_languages, language_id
from gridloom.llm.quality_model import Featurizer, fit_quality, keep_good, quality_classifier, quality_scores


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    units, target, h = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(2, 9, 12)], rng.integers(0, 3, 12), 5
    net = li.Network(*(rng.normal(0, 0.5, s) for s in [(2, 256, 3 * h), (2, h, 3 * h), (2 * h, 3), (3,)]), ["a", "b", "c"])
    x, n = li.padded(units)
    _, grads = net.gradients(x, n, target)
    for p, g in zip([net.e, net.u, net.v, net.c], grads, strict=True):
        at = tuple(np.argwhere(np.abs(g) > 1e-6)[0])
        old, eps = p[at], 1e-3
        p[at] = old + eps
        up = net.gradients(x, n, target)[0]
        p[at] = old - eps
        down = net.gradients(x, n, target)[0]
        p[at] = old
        assert (up - down) / 2 / eps == pytest.approx(float(g[at]), rel=0.02, abs=1e-5)


def test_both_directions_are_read():
    rng = np.random.default_rng(1)
    units = [bytes(u) for u in (rng.integers(97, 123, (3000, 6)).astype(np.uint8))]
    target = np.array([int(u[-1] % 2) for u in units])  # known at the first byte only from behind
    net = li.train(units, target, ["even", "odd"], hidden=8, steps=150, batch=128)
    x, n = li.padded(units[:300])
    assert (net.probabilities(x, n)[:, 0].argmax(axis=1) == target[:300]).mean() > 0.95


@pytest.fixture(scope="module")
def random_net():
    rng, h = np.random.default_rng(6), 4
    return li.Network(*(rng.normal(0, 0.7, s).astype(np.float32) for s in [(2, 256, 3 * h), (2, h, 3 * h), (2 * h, 3), (3,)]), ["a", "b", "c"])


def brute(net, text):
    """Byte by byte: the states of each chunk from CONTEXT bytes before it and behind it on."""
    sig, h = lambda x: 1 / (1 + np.exp(-x)), net.u.shape[1]

    def states(d, some):
        s, out = np.zeros(h), []
        for byte in some:
            a, r = net.e[d][byte].astype(float), s @ net.u[d]
            z, g = sig(a[:h] + r[:h]), sig(a[h : 2 * h] + r[h : 2 * h])
            new = np.tanh(a[2 * h :] + g * r[2 * h :])
            s = new + z * (s - new)
            out.append(s)
        return out

    b, total = text.encode(), np.zeros(len(net.labels))
    for k in range(0, len(b), li.CHUNK):
        low, end, high = max(0, k - li.CONTEXT), min(k + li.CHUNK, len(b)), min(len(b), k + li.CHUNK + li.CONTEXT)
        ahead, back = states(0, b[low:end])[k - low :], states(1, b[k:high][::-1])[::-1][: end - k]
        for f, g in zip(ahead, back, strict=True):
            y = np.exp(np.concatenate([f, g]) @ net.v + net.c)
            total += y / y.sum()
    return total


def test_reader_equals_a_byte_by_byte_pass(random_net):
    from gridloom.llm.shingles import arrow_bytes

    texts = ["", "a", "zwölf Boxkämpfer jagen", " ".join(f"w{k}" for k in range(400)), "x" * li.CHUNK, "y" * (2 * li.CHUNK + 1), "日本語"]
    data, at = arrow_bytes(li.pa.array(texts), lower=False)
    got = li.Reader(random_net).sums(data, at)
    assert np.allclose(got, [brute(random_net, t) for t in texts], rtol=1e-3, atol=1e-3)


def test_states_cross_words(random_net):
    from gridloom.llm.shingles import arrow_bytes

    words = "the quick brown fox jumps over".split()
    data, at = arrow_bytes(li.pa.array([" ".join(words), " ".join(words[::-1])]), lower=False)
    a, b = li.Reader(random_net).sums(data, at)
    assert np.abs(a - b).max() > 0.01


def test_query_equals_the_pass_over_each_text(more):
    docs = more[0].filter("doc_id < 40 AND length(text) < 5000")
    net = fit_languages(more[0])
    for r in identify_languages(docs.select("doc_id", "text", F.col("text").alias("t")), net).collect():
        if r["t"] and any(c.isalpha() for c in r["t"]):
            p = brute(net, r["t"]) / len(r["t"].encode())
            assert abs(p.max() - r["score"]) < 1e-3 and (r["lang_pred"] == net.labels[p.argmax()] or np.sort(p)[-2] > p.max() - 1e-3)


def test_ids_of_other_types(more):
    docs, labels = (x.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))) for x in more)
    assert quality_classifier(docs, labels).filter("predicted = 1").count() > 100


def test_languages_of_held_out_documents(more):
    docs, _ = more
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language_id(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(more, odd, none):
    net = fit_languages(more[0])
    rows = identify_languages(odd.select("doc_id", "text"), net).collect()
    by = [(r["lang_pred"], r["score"]) for r in rows]
    assert len(by) == odd.count() and by.count(("und", 0.0)) == 4
    assert identify_languages(none.select("doc_id", "text"), net).count() == 0
    assert fit_languages(none) is None and language_id(none).count() == 0
    mixed = language_id(odd).collect()
    assert len(mixed) == odd.count() and not any(r["held_out"] for r in mixed if r["doc_id"] is None)


def test_quality_of_held_out_documents(more):
    docs, labels = more
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_classifier(docs, labels).collect()
    held = [(r["score"], quality[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([p for _, q, p in held if q == 1]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_labels_of_the_held_fold_and_label_0_are_not_read(more):
    docs, labels = more
    docs = docs.filter("doc_id < 300")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    other = labels.filter(~((fold == 0) | (F.col("quality") == 0)))
    a, b = fit_quality(docs, labels), fit_quality(docs, other)
    assert np.array_equal(a.weight, b.weight) and a.prior == b.prior


def test_prior_is_near_the_share_of_positives():
    rng = np.random.default_rng(2)
    pos = lambda n: rng.normal(1.5, 1, (n, 3)).astype(np.float32)
    neg = lambda n: rng.normal(-1.5, 1, (n, 3)).astype(np.float32)
    u = np.concatenate([pos(1400), neg(600)])
    rng.shuffle(u)
    assert abs(qm.estimated_prior(pos(1500), u) - 0.7) < 0.08


def test_non_negative_risk_beats_plain_positive_against_unlabelled():
    rng = np.random.default_rng(4)
    x = lambda m, n: rng.normal(m, 1, (n, 3)).astype(np.float32)
    p, u = x(1, 1000), np.concatenate([x(1, 1600), x(-1, 400)])
    test = np.concatenate([x(1, 800), x(-1, 200)])
    truth = np.arange(1000) < 800
    right = lambda w, b: ((test @ w + b > 0) == truth).mean()
    assert right(*qm._fit(p, u, 0.8, 250)) > max(0.9, right(*qm._fit(p, u, None, 250)))


def test_odd_rows_and_stage(more, odd, none):
    model = fit_quality(*more)
    rows = quality_scores(odd, model).collect()
    assert len(rows) == odd.count() and sum(r["score"] == 0 for r in rows if r["n_chars"] in (None, 0, 4)) == 4 - 0
    kept = keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert quality_scores(none, model).count() == 0 and keep_good(none, model).count() == 0
    assert quality_classifier(none, more[1]).count() == 0
    empty = fit_quality(more[0], more[1].limit(0))
    assert empty.score(Featurizer()(["some text"])).tolist() == [0.5]
