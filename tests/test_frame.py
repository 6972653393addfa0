import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions.ieee import ieee_div, ieee_ln
from gridloom.functions.infer import infer_types, vote
from gridloom.operators.frame import Frame
from gridloom.sources import files


def people(spark):
    return Frame.new(spark, {"id": [1, 2, 3, 4], "name": ["Alice", "Bob", "Charlie", "Diana"], "score": [85.5, 92.0, 78.5, 88.0], "active": [True, True, False, True]}, ["id"])


def test_shape_head_tail_filter_sort_drop(spark):
    f = people(spark)
    assert f.shape == (4, 4) and len(f.head(2)) == 2 and f.tail(1)["name"] == ["Diana"] and not f.is_empty()
    assert f.filter(F.col("active"))["id"] == [1, 2, 4]
    assert f.filter([True, False, False, True])["name"] == ["Alice", "Diana"]
    assert [r["id"] for r in f.sort_by("score", False).df.collect()] == [2, 4, 1, 3]
    assert f.drop(["score", "nothing"]).columns == ["id", "name", "active"]
    assert f.with_column("score", F.col("score") * 2).columns == f.columns
    assert f.with_values("extra", [10, 20, 30, 40])["extra"] == [10, 20, 30, 40]
    assert f.get_column("nothing") is None
    assert Frame.empty(spark, {"a": "int64", "b": "utf8"}).is_empty()


def test_errors(spark):
    f = people(spark)
    with pytest.raises(ValueError):
        f.select(["nothing"])
    with pytest.raises(ValueError):
        Frame(f.df).head(1)
    with pytest.raises(TypeError):
        f.compare("name", "gt", 1)
    with pytest.raises(ValueError):
        f.with_values("x", [1])
    with pytest.raises(ValueError):
        Frame.new(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(ValueError):
        f.join(f, "id", "sideways")


def test_join_renames_and_refuses_second_collision(spark):
    a = Frame.new(spark, {"id": ["1", "2", "3"], "name": ["A", "B", "C"]})
    b = Frame.new(spark, {"id": ["1", "2", "4"], "name": ["x", "y", "z"]})
    assert a.join(b, "id").columns == ["id", "name", "name_y"] and len(a.join(b, "id")) == 2
    assert len(a.join(b, "id", "outer")) == 4 and len(a.join(b, "id", "left")) == 3
    assert {r["id"] for r in a.join(b, "id", "right").df.collect()} == {"1", "2", "4"}
    c = Frame.new(spark, {"id": ["1"], "name": ["A"], "name_y": ["q"]})
    with pytest.raises(ValueError):
        c.join(b, "id")


def test_ieee(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0)], "n double, d double")
    got = [r[0] for r in rows.select(ieee_div(F.col("n"), F.col("d"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 1.5 and got[4] is None
    logs = [r[0] for r in spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double").select(ieee_ln(F.col("x"))).collect()]
    assert logs[0] == -math.inf and math.isnan(logs[1]) and logs[2] == 0.0


def test_nan_is_left_out_of_extremes_and_comparisons(spark):
    f = Frame(spark.createDataFrame([("a", math.nan), ("a", 2.0), ("b", math.nan)], "k string, v double"))
    low = {r["k"]: r["v"] for r in f.groupby("k").min().collect()}
    assert low == {"a": 2.0, "b": math.inf}
    assert len(f.compare("v", "gt", 0)) == 1


def test_describe_uses_floor_ranks(spark):
    d = {r["column"]: r for r in Frame.new(spark, {"x": [1.0, 2.0, 3.0, 4.0], "n": [10, 20, 30, 40], "t": list("abcd")}).describe().collect()}
    assert (d["x"]["25%"], d["x"]["50%"], d["x"]["75%"]) == (2.0, 3.0, 4.0) and d["n"]["75%"] == 40.0
    assert math.isnan(d["t"]["mean"]) and d["x"]["std"] == pytest.approx(1.1180339887)


def test_window_without_partitions_equals_one_window(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    w = Frame(df, "i").window(7)
    got = w.over("r", lambda x: x.rolling_sum("v"), block_rows=50).orderBy("i").toPandas()
    want = got["v"].rolling(7).sum()
    assert np.allclose(got["r"][6:], want[6:]) and got["r"][:6].isna().all()
    lead = w.over("r", lambda x: x.lead("v", 3), reach=3, block_rows=50).orderBy("i").toPandas()
    assert (lead["r"][:-3].to_numpy() == lead["v"][3:].to_numpy()).all() and lead["r"][-3:].isna().all()


def test_shift_fills_and_long_periods(spark):
    f = people(spark)
    w = f.window(1)
    row = f.df.select(w.lag("name", 9).alias("n"), w.lag("id", 9).alias("i"), w.lag("active", 9).alias("a"), w.lag("score", 9).alias("s")).first()
    assert (row["n"], row["i"], row["a"]) == ("", 0, False) and math.isnan(row["s"])


def test_pct_change_of_zero(spark):
    f = Frame.new(spark, {"i": [0, 1, 2], "v": [0.0, 1.0, 3.0]}, ["i"])
    got = [r[0] for r in f.df.select("i", f.window(1).pct_change("v").alias("p")).orderBy("i").select("p").collect()]
    assert math.isnan(got[0]) and got[1] == math.inf and got[2] == 2.0


def test_samples_and_folds(spark):
    f = Frame(spark.range(100).toDF("i"), "i")
    assert len(f.sample(30, seed=1)) == 30 and len(f.sample(300)) == 100 and len(f.sample(300, replace=True)) == 300
    parts = f.cv_split(3)
    assert [len(t) for _, t in parts] == [33, 33, 34] and parts[0][1]["i"] == list(range(33))
    assert [len(t) for _, t in Frame(spark.range(2).toDF("i"), "i").cv_split(3)] == [0, 0, 2]


def test_vote():
    assert vote({"int": 8, "float": 0, "bool": 0}, 10) == "bigint" and vote({"int": 7, "float": 0, "bool": 0}, 10) == "string"
    assert vote({"int": 4, "float": 4, "bool": 0}, 10) == "double" and vote({"int": 0, "float": 0, "bool": 8}, 10) == "boolean"
    assert vote({"int": 0, "float": 0, "bool": 0}, 0) == "string"


def test_inference_rules(spark):
    df = spark.createDataFrame([("1", " 2 ", "yes", "1d"), ("0", "2.5", "N", "2d"), ("1", "", "true", "3d"), ("1", "4", "f", "4d"), ("0", "5", "no", "5d")], "a string, b string, c string, d string")
    assert infer_types(df) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"}


def test_csv_strays_by_reader(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b\n1,x\n2,y\n3.5,z\n4,\n5,w\n6,w\n")
    assert dict(files.read_csv(spark, str(p)).dtypes)["a"] == "string"
    got = files.read_csv_map(spark, str(p))
    assert dict(got.dtypes)["a"] == "bigint" and sorted(r["a"] for r in got.collect()) == [0, 1, 2, 4, 5, 6]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 92.0, "a"), (2, math.nan, "b"), (3, 1.5, None)], "i long, f double, s string").coalesce(1)
    files.write_csv(df, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*")))
    assert "1,92,a" in text
    files.write_jsonl(df, str(tmp_path / "l"))
    lines = [json.loads(x) for p in (tmp_path / "l").glob("part*") for x in p.read_text().splitlines()]
    assert lines[1]["f"] is None and lines[2]["s"] is None
    files.write_json(df, str(tmp_path / "j.json"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j.json").glob("part*")))[0] == {"i": 1, "f": 92.0, "s": "a"}
    files.write_json(df.limit(0), str(tmp_path / "none.json"))
    assert all(p.read_text() == "" or json.loads(p.read_text()) == [] for p in (tmp_path / "none.json").glob("part*"))
    files.write_ipc(df, str(tmp_path / "x.arrow"))
    assert files.read_ipc(spark, str(tmp_path / "x.arrow")).count() == 3
    assert files.from_arrow(spark, pa.record_batch({"a": [1, 2]})).count() == 2
    with pytest.raises(TypeError):
        files.series_to_numpy(df, "s")


def test_frames_are_compared_and_shown(spark):
    f = Frame.from_pandas(spark, pd.DataFrame({"i": range(20), "s": list("ab" * 10)}), "i")
    assert f == f.clone() and not f.equals(f.head(3)) and not f.equals(f.select(["i"]))
    assert not f.equals(Frame(f.df.withColumn("i", 19 - f.df["i"]), "i")) and Frame(f.df.unionByName(f.df)) != Frame(f.df)
    assert "20 x 2" in repr(f) and "..." in repr(f) and "19" in repr(f) and "..." not in repr(f.head(3))
    assert f.column_length("s") == 20


def test_samples_have_all_rows_they_should(spark):
    f = Frame(spark.range(10_000))
    for n in (0, 1, 50, 9_999, 10_000, 20_000):
        ids = [r[0] for r in f.sample(n, seed=5).df.collect()]
        assert len(ids) == len(set(ids)) == min(n, 10_000)
    ids = [r[0] for r in f.sample(5_000, seed=6).df.collect()]
    assert abs(sum(ids) / 5_000 - 5_000) < 200


def test_jsonl_nested_and_missing(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"b": 1, "a": "x"}\n\n{"b": 2, "c": {"d": 1}}\n')
    df = files.read_jsonl(spark, str(p))
    assert df.columns == ["a", "b", "c"] and dict(df.dtypes)["b"] == "bigint"
    assert sorted(r["a"] for r in df.collect()) == ["", "x"]


def test_plans_push_down_and_stay_in_the_jvm(spark, data):
    df = Frame(spark.read.parquet(f"{data}/lineitem.parquet")).compare("l_quantity", "gt", 10).groupby("l_returnflag").agg(("l_quantity", "sum"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "Python" not in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_stream_equals_batch(spark, data, tmp_path):
    from gridloom.streaming import counts

    source = spark.read.parquet(f"{data}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = counts.to_memory(counts.tumbling_counts(stream, "ts", "1 hour", ["event_type"], "value"), "tumbled", "complete")
    q.awaitTermination(120)
    batch = counts.tumbling_counts_batch(source, "ts", "1 hour", ["event_type"], "value")
    assert spark.table("tumbled").count() == batch.count()
