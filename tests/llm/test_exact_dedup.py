import hashlib
import re

import numpy as np

from gridloom.llm import bloom
from gridloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def brute(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for norm, g in groups.items():
        best = min(g)
        for x in g:
            out.append((rows[x[3]][0], rows[best[3]][0], len(g), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force_on_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = exact_duplicates(odd).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == brute(rows)
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(v) == 1 for v in groups.values())


def test_equals_brute_force_on_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = exact_duplicates(documents)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()], key=repr) == brute(rows)


def test_stage_keeps_whole_rows_and_all_columns(odd):
    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    norms = [re.sub(r"\s", "", r["text"] or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({re.sub(r"\s", "", r["text"] or "") for r in odd.collect()})


def test_empty(none):
    assert exact_duplicates(none).count() == 0 and drop_exact_duplicates(none).count() == 0


def test_many_slices_and_a_full_filter_give_the_same(documents, monkeypatch):
    want = sorted(exact_duplicates(documents).collect())
    monkeypatch.setattr(bloom, "LEAST_BLOCK", 1 << 9)
    for least, most in ((1 << 10, 1 << 11), (8, 8)):
        monkeypatch.setattr(bloom, "LEAST_BITS", least)
        monkeypatch.setattr(bloom, "SLICE_BITS", most)
        monkeypatch.setattr(bloom, "BITS_A_ROW", 32 if most > 8 else 0)
        assert (bloom.Layout(200).slices > 1) == (most > 8)
        assert sorted(exact_duplicates(documents).collect()) == want


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.unhex(F.sha2((F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") - 19_000)).cast("string"), 256)).alias("sha"))
    layout = bloom.Layout(20_000)
    found = bloom.tested(rows, "sha", 0, bloom.slice_bits(bloom.marks(rows, "sha", layout, 2), 0, layout), layout).toPandas()
    again = found["sha"].map(bytes).duplicated(keep=False).to_numpy()
    hit = found["maybe"].to_numpy(bool)
    assert layout.slices == 1 and len(found) == 20_000 and hit[again].all() and hit[~again].mean() < 0.02


def test_positions_survive_packing():
    at = np.unique(np.random.default_rng(1).integers(0, 1 << 24, 5000))
    assert np.array_equal(bloom._unpacked(bloom._packed(at)), at) and len(bloom._unpacked(bloom._packed(at[:0]))) == 0
