import re
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from gridloom.llm import common, quality_model
from gridloom.llm.quality_model import fit_quality, quality_scores


def test_each_stage_acts_on_all_that_the_one_before_kept(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = {"documents": docs.collect()}
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at
        at = stage(spark, at, data)
        if k < 4:
            assert at.columns == docs.columns and at.dtypes == docs.dtypes
        at = at.cache()
        rows[name] = at.collect()
        assert rows[name]
        if name == "quality":
            good = {r["doc_id"] for r in quality_scores(before, fit_quality(before, labels)).collect() if r["predicted"]}
            assert {r["doc_id"] for r in rows[name]} == good and len(good) < len(rows["documents"])
        if name == "exact dedup":
            norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"])
            assert Counter(map(norm, rows[name])) == Counter(set(map(norm, rows["quality"])))
        if name == "near dedup":
            from tests.llm.test_near_dedup import classes

            kept = {r["doc_id"] for r in rows[name]}
            assert kept == {min(c) for c in classes([(r["doc_id"], r["text"]) for r in rows["exact dedup"]]).values()}
        if name == "mix":
            times = Counter(r["doc_id"] for r in rows[name])
            assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in rows["near dedup"]}
    tokens = Counter()
    for r in rows["pack"]:
        tokens[r["doc_id"]] += r["length"]
    times = Counter(r["doc_id"] for r in rows["mix"])
    full = {r["doc_id"]: r["doc_tokens"] for r in rows["pack"]}
    assert tokens == Counter({d: n * full[d] for d, n in times.items()})


def test_odd_rows_go_through_every_stage(spark, odd, none, data):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        assert docs.count() >= 0


def test_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len([q for q in __spark_entry__.queries() if re.match(r"op\d+_", q)]) == 10


def test_workers_get_small_batches_and_read_them_a_few_texts_at_a_time(spark, data):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for given, left in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            spark.conf.set(key, given)
            corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{data}/documents.parquet").limit(20), data)
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, was)
    seen = []

    class Model:
        def score(self, x):
            return np.ones(len(x))

    score = quality_model._scores(Model(), lambda texts: seen.append(len(texts)) or texts, pa.array(["a"] * 1_200 + [None, " ", "b"]))
    assert seen == [512, 512, 179] and score.tolist() == [1.0] * 1_200 + [0.0, 0.0, 1.0]


def test_a_task_gives_back_memory_when_its_batches_end(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "_release", lambda: freed.append(1))
    batches = common.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(batches) == 2 and not freed
    assert list(batches) == [4] and freed == [1]
