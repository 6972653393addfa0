import re
from collections import Counter

import pytest

from gridloom.llm.mixing import mix_to_weights, mixed_copies, source_targets


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if most * sizes[s] < level * w[s]}
        if not full:
            target |= {s: level * w[s] for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 50, None: 7}, {"a": 1000, "b": 1, "c": 1}, {"x": 5}, {f"s{k}": (k * 37) % 50 for k in range(30)}, {"a": 0, "b": 0}])
def test_targets_equal_repeated_resharing(spark, sizes):
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(water(sizes)) if sum(sizes.values()) else set(got.values()) == {0.0}


def check(rows, slack):
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert all(r["source_size"] == size[r["source"]] for r in rows)
    assert target == pytest.approx(water(dict(size)))
    for s in size:
        assert abs(taken[s] - target[s]) <= slack * size[s] + max([r["size"] for r in rows if r["source"] == s]) / 2 + 1


def test_documents_come_near_their_targets_and_reruns_agree(documents):
    rows = mix_to_weights(documents).collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in documents.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == words
    check(rows, 0)
    again = mix_to_weights(documents.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_deep_trees(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"))
    rows = mix_to_weights(docs, fan_in=8).collect()
    assert len(rows) == 3000
    check(rows, 0.001)


def test_every_probability_is_kept_on_average(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 3).cast("int")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    rows = [r for r in mix_to_weights(docs).collect() if r["source"] == "b"]
    due = rows[0]["target"] / rows[0]["source_size"]
    for size in (1, 2, 3):
        copies = [r["copies"] for r in rows if r["size"] == size]
        assert abs(sum(copies) / len(copies) - due) < 0.06


def test_odd_rows_and_stage(odd, none):
    rows = mix_to_weights(odd).collect()
    assert len(rows) == odd.count()
    check(rows, 0)
    mixed = mixed_copies(odd)
    assert mixed.columns == odd.columns
    want = Counter()
    for r in rows:
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixed.collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    assert mix_to_weights(none).count() == 0 and mixed_copies(none).count() == 0


def test_no_python_in_the_plan(documents):
    plan = mix_to_weights(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_many_equal_rows_are_spread_and_reruns_agree(spark):
    from gridloom.llm.mixing import _with_twins

    docs = spark.createDataFrame([(1, "a b c", "x")] * 20_000 + [(None, "d", "x")] * 3000 + [(k, f"w{k} v", "y") for k in range(2, 500)], "doc_id long, text string, source string")
    rows = mix_to_weights(docs.repartition(6)).collect()
    assert len(rows) == 23_498
    check(rows, 0)
    key = lambda r: (r["doc_id"] or -1, r["source"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mix_to_weights(docs.repartition(3)).collect()))
    slim = docs.selectExpr("monotonically_increasing_id() as row", "xxhash64(doc_id, text) as h", "spark_partition_id() as part")
    twins = _with_twins(slim.repartition(4).withColumn("part", slim["row"] % 4)).groupBy("h").agg({"twin": "max", "row": "count"}).collect()
    assert all(r["max(twin)"] == r["count(row)"] - 1 for r in twins)
