"""The queries of the frame and array operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.ieee import round_scaled
from gridloom.functions.infer import infer_types
from gridloom.operators import linalg
from gridloom.operators.frame import Frame
from gridloom.operators.ndarray import NDArray, arange, broadcast_shapes, broadcastable, ones, unravel, zeros
from gridloom.plans.storage import staged_path
from gridloom.sources import files
from gridloom.sources.files import read_csv
from gridloom.streaming import counts as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(s, d) -> Frame:
    return Frame(table(s, d, "orders"), "o_orderkey")


def lineitem(s, d) -> Frame:
    return Frame(table(s, d, "lineitem"))


def events(s, d) -> Frame:
    return Frame(table(s, d, "events"), "event_id")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums of doubles differ in their last digits between engines; both sides round, and -0.0 becomes 0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# ---- the flagship, projections, filters, order ------------------------------------------------------------------


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem WHERE l_quantity > 10 GROUP BY 1 ORDER BY 1")
def flagship(s, d):
    g = lineitem(s, d).compare("l_quantity", "gt", 10).groupby("l_returnflag").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_price"))
    return rounded(g, 2, "sum_qty", "sum_price").orderBy("l_returnflag")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_select(s, d):
    return orders(s, d).select(["o_orderkey", "o_custkey", "o_totalprice"]).df


@query("SELECT o_orderstatus FROM orders")
def get_column(s, d):
    return orders(s, d).get_column("o_orderstatus")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_cols(s, d):
    return orders(s, d).drop(["o_orderdate", "o_orderpriority", "no_such"]).df


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, o_orderpriority, o_orderkey + 1 AS next_key FROM orders")
def with_column_replace(s, d):
    return orders(s, d).with_column("o_totalprice", F.col("o_totalprice") * 2).with_column("next_key", F.col("o_orderkey") + 1).df


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_cols FROM orders")
def shape(s, d):
    return orders(s, d).shape_frame()


for _op, _sign in (("gt", ">"), ("lt", "<"), ("eq", "=")):
    query(f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity {_sign} 25", f"filter_{_op}")(lambda s, d, op=_op: lineitem(s, d).compare("l_quantity", op, 25.0).select(["l_orderkey", "l_partkey", "l_quantity"]).df)


@query("SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def filter_text(s, d):
    return orders(s, d).filter("o_totalprice > 1000 AND o_orderstatus = 'F'").df


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0")
def filter_mask(s, d):
    return Frame(table(s, d, "nation"), "n_nationkey").select(["n_nationkey", "n_name"]).filter([k % 3 == 0 for k in range(25)]).df


@query("SELECT o_orderkey, o_totalprice, o_totalprice > 50000 AS big FROM orders WHERE o_totalprice > 50000")
def filter_bool_column(s, d):
    return orders(s, d).select(["o_orderkey", "o_totalprice"]).with_column("big", F.col("o_totalprice") > 50000).filter(F.col("big")).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def sort_asc(s, d):
    return orders(s, d).select(["o_orderkey", "o_totalprice"]).sort_by("o_totalprice").df


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey")
def sort_desc(s, d):
    return orders(s, d).select(["o_orderkey", "o_orderpriority"]).sort_by("o_orderpriority", False).df


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 7")
def head(s, d):
    return orders(s, d).head(7).df


@query("SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 7) ORDER BY o_orderkey")
def tail(s, d):
    return orders(s, d).tail(7).df


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100", "slice")
def slice_(s, d):
    return orders(s, d).slice(100, 20).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(s, d):
    return orders(s, d).select(["o_orderkey", "o_totalprice"]).top_k("o_totalprice", 10).df


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1")
def frame_sql(s, d):
    return orders(s, d).sql("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean_price FROM {frame} GROUP BY 1")


# ---- groups and aggregates --------------------------------------------------------------------------------------

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_INT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1")
def group_count(s, d):
    return lineitem(s, d).groupby_count("l_returnflag")


@query("SELECT l_returnflag, " + ", ".join([f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _INT] + [f"round(sum({c}), 2) AS {c}" for c in _NUM]) + " FROM lineitem GROUP BY 1")
def group_sum(s, d):
    return rounded(lineitem(s, d).groupby("l_returnflag").sum(), 2, *_NUM)


@query("SELECT l_returnflag, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _INT + _NUM) + " FROM lineitem GROUP BY 1")
def group_mean(s, d):
    return rounded(lineitem(s, d).groupby("l_returnflag").mean(), 4, *_INT, *_NUM)


@query("SELECT l_returnflag, " + ", ".join(f"round(stddev_pop({c}), 4) AS {c}" for c in _INT + _NUM) + " FROM lineitem GROUP BY 1")
def group_std(s, d):
    return rounded(lineitem(s, d).groupby("l_returnflag").std(), 4, *_INT, *_NUM)


for _f in ("min", "max"):
    query("SELECT l_returnflag, " + ", ".join(f"{_f}({c}) AS {c}" for c in _INT + _NUM) + " FROM lineitem GROUP BY 1", f"group_{_f}")(lambda s, d, f=_f: getattr(lineitem(s, d).groupby("l_returnflag"), f)())


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, CAST(count(l_tax) AS BIGINT) AS l_tax_count FROM lineitem GROUP BY 1, 2")
def group_multi(s, d):
    return rounded(lineitem(s, d).groupby("l_returnflag", "l_linestatus").agg(("l_quantity", "sum"), ("l_tax", "count")), 2, "l_quantity_sum")


@query("SELECT event_type, round(max(value) - min(value), 6) AS value FROM events GROUP BY 1")
def group_custom_agg(s, d):
    return rounded(events(s, d).select(["event_type", "value"]).groupby("event_type").apply(_value_range), 6, "value")


def _value_range(v: pd.Series) -> float:
    return float(v.max() - v.min())


_EVENT = ["event_id", "ts", "user_id", "value", "props"]
for _f, _agg in (("first", "arg_min"), ("last", "arg_max")):
    query("SELECT event_type, " + ", ".join(f"{_agg}({c}, event_id) AS {c}" for c in _EVENT) + " FROM events GROUP BY 1", f"group_{_f}")(lambda s, d, f=_f: getattr(events(s, d).groupby("event_type"), f)())


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS size FROM events GROUP BY 1")
def group_size(s, d):
    sizes = events(s, d).groupby("event_type").size()
    return s.createDataFrame(sorted(sizes.items()), "event_type string, size long")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def get_group(s, d):
    found = events(s, d).select(["event_id", "event_type", "user_id", "value"]).groupby("event_type").get_group("click")
    return found.drop(["event_type"]).df if found else table(s, d, "events").select("event_id", "user_id", "value").limit(0)


for _f in ("sum", "min", "max"):
    query(f"SELECT round(CAST({_f}(o_totalprice) AS DOUBLE), 2) AS {_f} FROM orders", f"agg_{_f}")(lambda s, d, f=_f: rounded(orders(s, d).aggregate("o_totalprice", f), 2, f))


def _describe_sql(columns: list[str], source: str) -> str:
    one = "SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, {q}, CAST(max({c}) AS DOUBLE) AS max FROM {t}"
    q = ", ".join('CAST(list_sort(list({c}))[CAST(floor(count({c}) * ' + str(p) + ') AS BIGINT) + 1] AS DOUBLE) AS "' + str(int(p * 100)) + '%"' for p in (0.25, 0.5, 0.75))
    return " UNION ALL ".join(one.replace("{q}", q).format(c=c, t=source) for c in columns)


@query(_describe_sql(["c_custkey", "c_nationkey", "c_acctbal"], "customer"))
def describe(s, d):
    found = Frame(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")).describe()
    return rounded(found, 4, "mean", "std")


# ---- joins ------------------------------------------------------------------------------------------------------


def _sides(s, d) -> tuple[Frame, Frame]:
    left = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", F.col("o_totalprice").alias("amount"))
    right = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_partkey", F.col("l_extendedprice").alias("amount"))
    return Frame(left), Frame(right)


_O = "(SELECT o_orderkey AS key, o_custkey, o_totalprice AS amount FROM orders) o"
_L = "(SELECT l_orderkey AS key, l_partkey, l_extendedprice AS amount FROM lineitem) l"
query("SELECT o.key, o_custkey, o.amount, l_partkey, l.amount AS amount_y FROM " + f"{_O} JOIN {_L} ON o.key = l.key", "join_suffix")(lambda s, d: (lambda o, i: o.join(i, "key").df)(*_sides(s, d)))
query("SELECT o.key, o_custkey, o.amount, l_partkey, l.amount AS amount_y FROM " + f"{_O} LEFT JOIN {_L} ON o.key = l.key", "join_left")(lambda s, d: (lambda o, i: o.join(i, "key", "left").df)(*_sides(s, d)))
query("SELECT l.key, l_partkey, l.amount, o_custkey, o.amount AS amount_y FROM " + f"{_L} LEFT JOIN {_O} ON o.key = l.key", "join_right")(lambda s, d: (lambda o, i: o.join(i, "key", "right").df)(*_sides(s, d)))
query("SELECT coalesce(o.key, l.key) AS key, o_custkey, o.amount, l_partkey, l.amount AS amount_y FROM " + f"{_O} FULL JOIN {_L} ON o.key = l.key", "join_outer")(lambda s, d: (lambda o, i: o.join(i, "key", "outer").df)(*_sides(s, d)))


@query("SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(s, d):
    left = Frame(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"))
    return left.join(Frame(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")), "c_custkey").df


# ---- windows ----------------------------------------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY event_id"
for _f, _agg in (("sum", "sum"), ("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")):
    _frame = f"({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    query(f"SELECT event_id, CASE WHEN count(*) OVER {_frame} = 5 THEN round({_agg}(value) OVER {_frame}, 4) END AS r FROM events", f"rolling_{_f}")(
        lambda s, d, f=_f: rounded((lambda w: w.over("r", lambda x: getattr(x, f"rolling_{f}")("value")).select("event_id", "r"))(events(s, d).window(5).partition_by("user_id").fill_incomplete(None)), 4, "r")
    )


@query("SELECT event_id, CASE WHEN count(*) OVER w = 30 THEN round(avg(value) OVER w, 4) END AS r FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def rolling_mean_global(s, d):
    return rounded(events(s, d).window(30).fill_incomplete(None).over("r", lambda w: w.rolling_mean("value"), block_rows=4096).select("event_id", "r"), 4, "r")


@query(f"SELECT event_id, CASE WHEN count(*) OVER w = 3 THEN round(list_sum(list_transform(list(value) OVER w, lambda x: x * x)), 4) END AS r FROM events WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_apply(s, d):
    w = events(s, d).window(3).partition_by("user_id").fill_incomplete(None)
    return rounded(w.over("r", lambda x: x.rolling_apply("value", lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v * v))).select("event_id", "r"), 4, "r")


for _f in ("lag", "lead"):
    query(f"SELECT event_id, {_f}(event_type, 2, '') OVER w AS type_, {_f}(user_id, 2, 0) OVER w AS user_ FROM events WINDOW w AS ({_W})", _f)(
        lambda s, d, f=_f: (lambda w: w.df.select("event_id", getattr(w, f)("event_type", 2).alias("type_"), getattr(w, f)("user_id", 2).alias("user_")))(events(s, d).window(1).partition_by("user_id"))
    )


@query(f"SELECT event_id, round((value - lag(value) OVER w) / lag(value) OVER w, 6) AS r FROM events WINDOW w AS ({_W})")
def pct_change(s, d):
    w = events(s, d).window(1).partition_by("user_id")
    # both engines have the same quotients to the last bit, so they are rounded as the SQL rounds; null only where a value is missing
    known = F.lag("value").over(W.partitionBy("user_id").orderBy("event_id")).isNotNull() & F.col("value").isNotNull()
    return w.over("q", lambda x: F.when(known, x.pct_change("value"))).select("event_id", (round_scaled(F.col("q"), 6) + F.lit(0.0)).alias("r"))


_EWM = f"SELECT event_id, round(list_reduce(list(value) OVER ({_W} ROWS UNBOUNDED PRECEDING), lambda x, y: 0.3 * y + 0.7 * x), 6) AS r FROM events"


@query(_EWM)
def ewm(s, d):
    return rounded(events(s, d).window(1).partition_by("user_id").over("r", lambda x: x.ewm("value", 0.3)).select("event_id", "r"), 6, "r")


@query(_EWM)
def ewm_long(s, d):
    return rounded(events(s, d).select(["event_id", "user_id", "value"]).window(1).partition_by("user_id").ewm_long("value", 0.3, "r").select("event_id", "r"), 6, "r")


# ---- reshaping and samples --------------------------------------------------------------------------------------

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
for _f, _agg in (("sum", "sum"), ("mean", "avg"), ("count", "count"), ("min", "min"), ("max", "max")):
    _cell = "CAST(coalesce({a}(o_totalprice) FILTER (o_orderpriority = '{p}'), 0) AS BIGINT)" if _f == "count" else "round(coalesce({a}(o_totalprice) FILTER (o_orderpriority = '{p}'), 0), 2)"
    query("SELECT o_orderstatus, " + ", ".join(_cell.format(a=_agg, p=p) + f' AS "{p}"' for p in _PRIORITIES) + " FROM orders GROUP BY 1", f"pivot_{_f}")(
        lambda s, d, f=_f: (lambda p: p if f == "count" else rounded(p, 2, *_PRIORITIES))(orders(s, d).pivot_table("o_orderstatus", "o_orderpriority", "o_totalprice", f, _PRIORITIES))
    )


@query(" UNION ALL ".join(f"SELECT l_orderkey, '{c}' AS variable, {c} AS value FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def melt(s, d):
    return lineitem(s, d).melt(["l_orderkey"], ["l_quantity", "l_discount", "l_tax"])


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS name, CAST({c} AS VARCHAR) AS text FROM orders" for c in ("o_custkey", "o_orderstatus")))
def melt_mixed(s, d):
    return orders(s, d).melt(["o_orderkey"], ["o_custkey", "o_orderstatus"], "name", "text")


def _drawn(s, d, n: int, replace: bool) -> DataFrame:
    """What any right sample has in common: its rows, those that are whole rows of the table, how often one may come."""
    rows = events(s, d).sample(n, replace, seed=3).df
    often = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*rows.columns)).alias("row"), F.min(F.struct(*rows.columns)).alias("least"))
    found = often.join(table(s, d, "events").select("event_id", F.struct(*rows.columns).alias("own")), "event_id", "left")
    known = F.sum(F.when((F.col("row") == F.col("own")) & (F.col("least") == F.col("own")), F.col("n")).otherwise(0))
    return found.agg(F.sum("n").alias("rows"), known.alias("known"), (F.max("n") > 1).alias("repeats"))


@query("SELECT CAST(least(500, count(*)) AS BIGINT) AS rows, CAST(least(500, count(*)) AS BIGINT) AS known, false AS repeats FROM events")
def sample_n(s, d):
    return _drawn(s, d, 500, False)


# 1500 draws of a large table may well be of 1500 rows; one draw more than the table has rows repeats one for certain
@query("SELECT CAST(1500 AS BIGINT) AS rows, CAST(1500 AS BIGINT) AS known, true AS repeats FROM events HAVING count(*) > 0")
def sample_replace(s, d):
    rows = events(s, d).select(["event_id"])
    often = rows.sample(len(rows) + 1, True, seed=3).df.groupBy("event_id").count()
    return _drawn(s, d, 1500, True).drop("repeats").filter("rows > 0").crossJoin(often.agg((F.max("count") > 1).alias("repeats")))


@query("SELECT event_id, CAST(least((row_number() OVER (ORDER BY event_id) - 1) // ((SELECT count(*) FROM events) // 3), 2) AS INTEGER) AS fold FROM events")
def cv_split(s, d):
    return events(s, d).folds(3).select("event_id", "fold")


@query("SELECT fold, n - CASE WHEN fold < 2 THEN n // 3 ELSE n - 2 * (n // 3) END AS train, CASE WHEN fold < 2 THEN n // 3 ELSE n - 2 * (n // 3) END AS test FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM events), (VALUES (0), (1), (2)) AS v(fold)")
def cv_split_shuffled(s, d):
    rows = events(s, d).folds(3, shuffle=True, seed=3)
    n = rows.count()
    return rows.groupBy("fold").agg((n - F.count(F.lit(1))).alias("train"), F.count(F.lit(1)).alias("test"))


# ---- sources and sinks ------------------------------------------------------------------------------------------

_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
_BOTH = "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"


def _through(write, read, name):
    def run(s, d):
        path = staged_path(s, name)
        write(table(s, d, "nation"), path)
        return read(s, path)

    return run


query(_NATION, "csv_roundtrip")(_through(files.write_csv, files.read_csv, "csv"))
query(_NATION, "csv_map_roundtrip")(_through(files.write_csv, files.read_csv_map, "csvmap"))
query("SELECT CAST(n_nationkey AS BIGINT) AS column_0, n_name AS column_1, CAST(n_regionkey AS BIGINT) AS column_2 FROM nation", "csv_options")(
    _through(lambda df, p: files.write_csv(df, p, files.CsvWriteOptions("|", False, 2)), lambda s, p: files.read_csv(s, p, files.CsvReadOptions("|", False)), "csvo")
)
query(_NATION, "jsonl_roundtrip")(_through(files.write_jsonl, files.read_jsonl, "jsonl"))
query("SELECT n_nationkey, n_name, n_regionkey FROM nation", "parquet_roundtrip")(_through(files.write_parquet, files.read_parquet, "parquet"))


@query("SELECT 'o_orderkey' AS name, 'bigint' AS type UNION ALL SELECT 'o_totalprice', 'double' UNION ALL SELECT 'o_orderstatus', 'string' UNION ALL SELECT 'is_open', 'boolean'")
def csv_infer(s, d):
    df = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no").alias("is_open"))
    found = infer_types(df.select(*[F.col(c).cast("string") for c in df.columns]))
    return s.createDataFrame(list(found.items()), "name string, type string")


@query(_BOTH)
def arrow_roundtrip(s, d):
    return files.from_arrow(s, files.to_arrow(table(s, d, "region"))).select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@query("SELECT CAST(c_acctbal AS DOUBLE) AS bal FROM customer")
def numpy_roundtrip(s, d):
    return files.from_numpy(s, files.series_to_numpy(table(s, d, "customer"), "c_acctbal"), "bal")


@query("SELECT * FROM (VALUES (1::BIGINT, 'Alice', 85.5::DOUBLE, true), (2, 'Bob', 92.0, true), (3, 'Charlie', 78.5, false), (4, 'Diana', 88.0, true)) AS v(id, name, score, active)")
def from_literals(s, d):
    return Frame.new(s, {"id": [1, 2, 3, 4], "name": ["Alice", "Bob", "Charlie", "Diana"], "score": [85.5, 92.0, 78.5, 88.0], "active": [True, True, False, True]}).df


# ---- arrays -----------------------------------------------------------------------------------------------------


def matrix(s, d) -> NDArray:
    """Embeddings as a matrix, a row a vector."""
    df = table(s, d, "embeddings")
    return NDArray.from_rows(df, "vec_id", "embedding", df.agg(F.max("vec_id") + 1).first()[0], 64)


_E = "(SELECT vec_id AS i, unnest(generate_series(0, 63)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_ROWMEAN = "(SELECT i AS mi, avg(v) AS m FROM " + _E + " GROUP BY 1)"


def flat(a: NDArray, digits: int = 6) -> DataFrame:
    return rounded(a.df, digits, "value")


for _name, _sql in {"exp": "exp(v)", "sin": "sin(v)", "cos": "cos(v)", "sqrt": "CASE WHEN v >= 0 THEN sqrt(v) END", "ln": "CASE WHEN v > 0 THEN ln(v) END"}.items():
    query(f"SELECT i * 64 + j AS idx, round({_sql}, 6) + 0 AS value FROM {_E}", f"arr_{_name}")(
        lambda s, d, f=_name: rounded(getattr(matrix(s, d), f)().df.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))), 6, "value")
    )
query(f"SELECT i * 64 + j AS idx, round(pow(v, 2), 6) + 0 AS value FROM {_E}", "arr_pow")(lambda s, d: flat(matrix(s, d).pow(2)))
query(f"SELECT i * 64 + j AS idx, round(((v + 2) * 3 - 1) / 4, 6) + 0 AS value FROM {_E}", "arr_scalar")(lambda s, d: flat(((matrix(s, d) + 2) * 3 - 1) / 4))
for _name, _sign in (("add", "+"), ("sub", "-"), ("mul", "*")):
    query(f"SELECT i * 64 + j AS idx, round(v {_sign} m, 6) + 0 AS value FROM {_E} JOIN {_ROWMEAN} ON i = mi", f"arr_{_name}")(
        lambda s, d, f=_name: flat((lambda a: getattr(a, f"{f}_broadcast")(a.mean_axis(1).reshape([a.shape[0], 1])))(matrix(s, d)))
    )
query(f"SELECT i * 64 + j AS idx, round(v / (m * m + 1), 6) + 0 AS value FROM {_E} JOIN {_ROWMEAN} ON i = mi", "arr_div")(
    lambda s, d: flat((lambda a: a / (a.mean_axis(1).reshape([a.shape[0], 1]).pow(2) + 1))(matrix(s, d)))
)
query(f"SELECT round(sum(v), 4) AS sum, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM {_E}", "arr_reductions")(
    lambda s, d: (lambda a: s.createDataFrame([(a.sum(), a.mean(), a.min(), a.max())], "sum double, mean double, min double, max double").select(F.round("sum", 4).alias("sum"), *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")]))(matrix(s, d))
)
query(f"SELECT j AS idx, round(sum(v), 4) + 0 AS value FROM {_E} GROUP BY 1", "arr_sum_axis")(lambda s, d: flat(matrix(s, d).sum_axis(0), 4))
query(f"SELECT i AS idx, round(avg(v), 6) + 0 AS value FROM {_E} GROUP BY 1", "arr_mean_axis")(lambda s, d: flat(matrix(s, d).mean_axis(1)))
query(f"SELECT j * (SELECT max(vec_id) + 1 FROM embeddings) + i AS idx, round(v, 6) + 0 AS value FROM {_E}", "arr_transpose")(lambda s, d: flat(matrix(s, d).transpose()))
query(f"SELECT i * 64 + j AS idx, round(v, 6) + 0 AS value FROM {_E}", "arr_reshape")(lambda s, d: flat((lambda a: a.reshape([a.size // 32, 32]))(matrix(s, d))))
query("SELECT range AS idx, CAST(0.5 * range AS DOUBLE) AS value FROM range(40)", "arr_arange")(lambda s, d: NDArray.arange(s, 0, 20, 0.5).df)
query("SELECT range AS idx, 0.0::DOUBLE + 1.0 + 7.5 AS value FROM range(12)", "arr_fill")(lambda s, d: (NDArray.zeros(s, [3, 4]) + NDArray.ones(s, [3, 4]) + NDArray.full(s, [4], 7.5)).df.withColumn("value", F.col("value")))
query(f"SELECT round(sum(v * v), 4) AS value FROM {_E}", "dot")(lambda s, d: flat((lambda a: linalg.dot(a.reshape([a.size]), a.reshape([a.size])))(matrix(s, d)), 4).select("value"))
query(f"SELECT i AS idx, round(sum(v * j), 4) + 0 AS value FROM {_E} GROUP BY 1", "matvec")(lambda s, d: flat(linalg.dot(matrix(s, d), NDArray.arange(s, 0, 64)), 4))
query(f"SELECT j AS idx, round(sum(v), 4) + 0 AS value FROM {_E} GROUP BY 1", "vecmat")(lambda s, d: flat((lambda a: linalg.dot(NDArray.ones(s, [a.shape[0]]), a))(matrix(s, d)), 4))
_GRAM = f"(SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM {_E} a JOIN {_E} b ON a.i = b.i GROUP BY 1, 2)"


def gram(s, d) -> NDArray:
    a = matrix(s, d)
    return linalg.matmul(a.transpose(), a)


query(f"SELECT i * 64 + j AS idx, round(v, 4) + 0 AS value FROM {_GRAM}", "matmul_gram")(lambda s, d: flat(gram(s, d), 4))
query(f"SELECT i * 64 + j AS idx, round(v, 4) + 0 AS value FROM {_GRAM}", "matmul_blocked")(lambda s, d: flat((lambda a: linalg.matmul_blocked(a.transpose(), a, 64))(matrix(s, d)), 4))


def one(s, kind: str, *values) -> DataFrame:
    return s.createDataFrame([values], kind)


query(f"SELECT round(sum(v), 4) AS value FROM {_GRAM} WHERE i = j", "trace")(lambda s, d: rounded(one(s, "value double", linalg.trace(gram(s, d))), 4, "value"))
query(f"SELECT round(sqrt(sum(v * v)), 4) AS value FROM {_E}", "norm")(lambda s, d: rounded(one(s, "value double", linalg.norm(matrix(s, d))), 4, "value"))
query("SELECT true AS gram, false AS other FROM region LIMIT 1", "is_symmetric")(lambda s, d: one(s, "gram boolean, other boolean", linalg.is_symmetric(gram(s, d), 1e-9), linalg.is_symmetric(NDArray.from_values(s, [[1, 2], [3, 4]]))))


@query("SELECT true AS rebuilds, true AS orthogonal, true AS r_positive FROM region LIMIT 1")
def qr_check(s, d):
    a = gram(s, d)
    q, r = linalg.qr(a)
    m, qn, rn = a.to_numpy(), q.to_numpy(), r.to_numpy()
    return one(s, "rebuilds boolean, orthogonal boolean, r_positive boolean", bool(np.allclose(qn @ rn, m, atol=1e-8 * np.abs(m).max())), linalg.is_orthogonal(q, 1e-8), bool((np.diag(rn) >= 0).all()))


@query("SELECT true AS solves, true AS singular_is_none FROM region LIMIT 1")
def solve_residual(s, d):
    a, b = gram(s, d), NDArray.arange(s, 0, 64)
    x = linalg.solve(a, b)
    m, ax = b.to_numpy(), linalg.dot(a, x).to_numpy()
    return one(s, "solves boolean, singular_is_none boolean", bool(np.allclose(ax, m, atol=1e-6)), linalg.solve(NDArray.from_values(s, [[1, 2], [2, 4]]), NDArray.from_values(s, [1, 2])) is None)


@query("SELECT true AS rebuilds, true AS complex_is_none FROM region LIMIT 1")
def eig_check(s, d):
    a = gram(s, d)
    values, vectors = (x.to_numpy() for x in linalg.eig(a))
    m = a.to_numpy()
    ok = np.allclose(m @ vectors, vectors * values, atol=1e-8 * np.abs(m).max()) and (np.diff(values) <= 1e-9).all()
    return one(s, "rebuilds boolean, complex_is_none boolean", bool(ok), linalg.eig(NDArray.from_values(s, [[0, -1], [1, 0]])) is None)


@query("SELECT true AS rebuilds FROM region LIMIT 1")
def svd_check(s, d):
    a = matrix(s, d)
    u, v, vt = (x.to_numpy() for x in linalg.svd(a))
    return one(s, "rebuilds boolean", bool(np.allclose((u * v) @ vt, a.to_numpy(), atol=1e-7)))


query("SELECT -2.0::DOUBLE AS det2, 6.0::DOUBLE AS det3 FROM region LIMIT 1", "det")(lambda s, d: rounded(one(s, "det2 double, det3 double", linalg.det(NDArray.from_values(s, [[1, 2], [3, 4]])), linalg.det(NDArray.from_values(s, [[1, 0, 0], [0, 2, 0], [0, 0, 3]]))), 6, "det2", "det3"))
query("SELECT * FROM (VALUES (0::BIGINT, -2.0::DOUBLE), (1, 1.0), (2, 1.5), (3, -0.5)) AS v(idx, value)", "inv")(lambda s, d: flat(linalg.inv(NDArray.from_values(s, [[1, 2], [3, 4]]))))
query("SELECT CAST(64 AS BIGINT) AS gram, CAST(1 AS BIGINT) AS line FROM region LIMIT 1", "rank")(lambda s, d: one(s, "gram long, line long", linalg.rank(gram(s, d)), linalg.rank(NDArray.from_values(s, [[1, 2], [2, 4]]))))
query("SELECT true AS turn, false AS other FROM region LIMIT 1", "is_orthogonal")(lambda s, d: one(s, "turn boolean, other boolean", linalg.is_orthogonal(NDArray.from_values(s, [[0, -1], [1, 0]])), linalg.is_orthogonal(NDArray.from_values(s, [[1, 2], [3, 4]]))))
query(
    f"SELECT a.i * 62 + a.j AS idx, round(sum(e.v * k.w), 4) + 0 AS value FROM {_E} e JOIN (VALUES (0,0,1),(0,1,2),(0,2,1),(1,0,0),(1,1,0),(1,2,0),(2,0,-1),(2,1,-2),(2,2,-1)) AS k(di, dj, w) ON true JOIN (SELECT DISTINCT i, j FROM {_E} WHERE j < 62 AND i < (SELECT max(vec_id) - 1 FROM embeddings)) a ON e.i = a.i + k.di AND e.j = a.j + k.dj GROUP BY 1",
    "conv2d",
)(lambda s, d: flat(linalg.conv2d(matrix(s, d), NDArray.from_values(s, [[1, 2, 1], [0, 0, 0], [-1, -2, -1]])), 4))


# ---- the same operators where queries above don't show them ------------------------------------------------------

query("SELECT n_nationkey, n_name, n_regionkey FROM nation", "ipc_roundtrip")(_through(files.write_ipc, files.read_ipc, "ipc"))
query(_NATION, "json_array")(_through(files.write_json, files.read_json, "json"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def csv_orders(s, d):
    path = staged_path(s, "csv")
    files.write_csv(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return files.read_csv(s, path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def parquet_orders(s, d):
    path = staged_path(s, "parquet")
    files.write_parquet(table(s, d, "orders"), path)
    return files.read_parquet(s, path)


@query("SELECT CAST(1 AS BIGINT) AS id, 0.5::DOUBLE AS x, true AS b, 'a' AS t WHERE false")
def empty(s, d):
    return Frame.empty(s, {"id": "int64", "x": "float64", "b": "bool", "t": "utf8"}).df


@query("SELECT count(c_acctbal) AS n FROM customer")
def column_length(s, d):
    return one(s, "n long", Frame(table(s, d, "customer")).column_length("c_acctbal"))


@query("SELECT count(*) = (SELECT count(*) FROM (SELECT * FROM nation UNION SELECT * FROM nation)) AS itself, false AS shorter, false AS other FROM nation")
def frame_equals(s, d):
    f = Frame(table(s, d, "nation"), "n_nationkey")
    return one(s, "itself boolean, shorter boolean, other boolean", f.equals(f.clone()), f.equals(f.head(3)), f.equals(Frame(table(s, d, "region"))))


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1) AS idx, c_acctbal AS value FROM customer")
def arr_from_vec(s, d):
    return NDArray.from_values(s, Frame(table(s, d, "customer"), "c_custkey")["c_acctbal"]).df


_VECTORS = "(SELECT max(vec_id) + 1 FROM embeddings)"


@query(f"SELECT 'ndim' AS name, 3::BIGINT AS value UNION ALL SELECT 'size', {_VECTORS} * 64 UNION ALL SELECT 'len', {_VECTORS} * 64 UNION ALL SELECT 'stride0', 64 UNION ALL SELECT 'stride1', 8 UNION ALL SELECT 'stride2', 1 UNION ALL SELECT 'ravel', 7 * 64 + 3 * 8 + 5 UNION ALL SELECT 'unravel0', 473 // 64 UNION ALL SELECT 'unravel1', 473 % 64 // 8 UNION ALL SELECT 'unravel2', 473 % 8")
def arr_layout(s, d):
    a = matrix(s, d)
    a = a.reshape([a.shape[0], 8, 8])
    rows = [("ndim", a.ndim), ("size", a.size), ("len", len(a)), ("ravel", a.ravel_index([7, 3, 5]))]
    rows += [(f"stride{k}", n) for k, n in enumerate(a.strides)] + [(f"unravel{k}", n) for k, n in enumerate(unravel(473, a.shape))]
    return s.createDataFrame(rows, "name string, value long")


@query(f"SELECT round(max(v) FILTER (i = 7 AND j = 29), 6) AS cell2, round(max(v) FILTER (i = 7 AND j = 29), 6) AS cell3, round(max(v) FILTER (i = 2 AND j = 63), 6) AS got, 2.5::DOUBLE AS put, true AS outside FROM {_E}")
def arr_elements(s, d):
    a = matrix(s, d)
    b = a.reshape([a.shape[0], 8, 8])
    row = a[7, 29], b[7, 3, 5], a.get([2, 63]), a.set([2, 63], 2.5).get([2, 63]), a.get([a.shape[0], 0]) is None
    return rounded(one(s, "cell2 double, cell3 double, got double, put double, outside boolean", *row), 6, "cell2", "cell3", "got")


query(f"SELECT i * 64 + j AS idx, round(v + 2 * v, 6) + 0 AS value FROM {_E}", "arr_same_shape")(lambda s, d: flat((lambda a: a + a * 2)(matrix(s, d))))
query("SELECT * FROM (VALUES ('2x3,3', true, '2x3'), ('4x1,5', true, '4x5'), ('2x3,2', false, ''), ('1,7x1x2', true, '7x1x2')) AS v(shapes, fits, result)", "arr_shapes")(
    lambda s, d: s.createDataFrame([(",".join("x".join(map(str, x)) for x in (a, b)), broadcastable(a, b), "x".join(map(str, broadcast_shapes(a, b) or ()))) for a, b in (((2, 3), (3,)), ((4, 1), (5,)), ((2, 3), (2,)), ((1,), (7, 1, 2)))], "shapes string, fits boolean, result string")
)
query("SELECT range AS idx, CAST(range AS DOUBLE) AS value FROM range(3) UNION ALL SELECT 3, 1.0 UNION ALL SELECT 4, 0.0 UNION ALL SELECT 5, 25.0", "module_functions")(
    lambda s, d: arange(s, 0, 3).df.unionByName(ones(s, [1]).df.withColumn("idx", F.lit(3).cast("long"))).unionByName(zeros(s, [1]).df.withColumn("idx", F.lit(4).cast("long"))).unionByName(one(s, "idx long, value double", 5, float(_read_nation(s, d).count())))
)


def _read_nation(s, d) -> DataFrame:
    path = staged_path(s, "csv")
    files.write_csv(table(s, d, "nation"), path)
    return read_csv(s, path)


def tall(s) -> NDArray:
    """20,000 x 4 of rank 3: the last column is the sum of the first two."""
    i = F.floor(F.col("id") / 4)
    a, b, c = F.sin(i + 1), F.cos(i * 3 + 2), F.sin(i * i * 0.01)
    value = F.when(F.col("id") % 4 == 0, a).when(F.col("id") % 4 == 1, b).when(F.col("id") % 4 == 2, c).otherwise(a + b)
    return NDArray(s.range(80_000).select(F.col("id").alias("idx"), value.alias("value")), [20_000, 4])


@query("SELECT CAST(3 AS BIGINT) AS rank, true AS qr_rebuilds, true AS orthogonal, true AS svd_rebuilds, true AS dependent_is_none, true AS least_squares FROM region LIMIT 1")
def tall_factors(s, d):
    a = tall(s)
    m = a.to_numpy()
    q, r = (x.to_numpy() for x in linalg.qr(a))
    u, v, vt = (x.to_numpy() for x in linalg.svd(a))
    own = np.abs(q).sum(axis=0) > 0
    thin = NDArray(a.df.filter("idx % 4 < 3").select((F.floor(F.col("idx") / 4) * 3 + F.col("idx") % 4).cast("long").alias("idx"), "value"), [20_000, 3])
    b = NDArray.arange(s, 0, 20_000)
    x = linalg.solve(thin, b).to_numpy()
    want = np.linalg.lstsq(m[:, :3], b.to_numpy(), rcond=None)[0]
    near = lambda a, b: bool(np.allclose(a, b, atol=1e-9, rtol=1e-9))
    row = linalg.rank(a), near(q @ r, m), near(q.T @ q, np.diag(own.astype(float))) and int(own.sum()) == 3, near((u * v) @ vt, m), linalg.solve(a, b) is None, bool(np.allclose(x, want, rtol=1e-6))
    return one(s, "rank long, qr_rebuilds boolean, orthogonal boolean, svd_rebuilds boolean, dependent_is_none boolean, least_squares boolean", *row)


# ---- streaming (an extension) -----------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    return rounded(streaming.tumbling_counts_batch(table(s, d, "events"), "ts", "1 hour", ["event_type"], "value"), 2, "value")
