"""Windows without partitions give the same results in blocks as in one run."""

import math

import pytest

from gridloom.operators.rolling import RowWindow


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(i, None if i % 41 == 7 or i < 2 else math.sin(i * i)) for i in range(500)]
    return spark.createDataFrame(rows, "i long, v double").repartition(5).cache()


def columns(df, name):
    rows = sorted(df.collect(), key=lambda r: r["i"])
    assert [r["i"] for r in rows] == list(range(500))
    return [r["v"] for r in rows], [r[name] for r in rows]


@pytest.mark.parametrize("shift,k", [("lag", 7), ("lead", 7), ("lag", 60), ("lead", -5)])
def test_shifts_reach_as_far_as_they_say(numbers, shift, k):
    v, got = columns(RowWindow(numbers, 1, order=["i"]).over("r", lambda w: getattr(w, shift)("v", k), block_rows=50), "r")
    d = -k if shift == "lag" else k
    want = [v[i + d] if 0 <= i + d < 500 else math.nan for i in range(500)]
    assert [repr(x) for x in got] == [repr(x) for x in want]


def test_ewm_is_refused_in_blocks(numbers):
    with pytest.raises(ValueError, match="ewm_long"):
        RowWindow(numbers, 1, order=["i"]).over("r", lambda w: w.ewm("v", 0.3))


@pytest.mark.parametrize("alpha", [0.3, 0.001])
def test_ewm_long_without_partitions(numbers, alpha):
    v, got = columns(RowWindow(numbers, 1).order_by("i").ewm_long("v", alpha, "r", block_rows=50), "r")
    want, e = [], None
    for x in v:
        if x is not None:
            e = x if e is None else alpha * x + (1 - alpha) * e
        want.append(e)
    assert got[:2] == [None, None] and got[2:] == pytest.approx(want[2:], rel=1e-12)
