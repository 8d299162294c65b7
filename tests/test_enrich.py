import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators.enrich import Caller, enrich


def table(spark, values, partitions=1):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string").coalesce(partitions)


def test_a_hanging_call_fails_its_rows_only(spark):
    """Two rows hang for an hour; all others have results, in order, within seconds."""

    def call(texts):
        if any("hang" in t for t in texts):
            time.sleep(3600)
        return [t.upper() for t in texts]

    values = [f"row {i}" for i in range(40)]
    values[11], values[30], values[5] = "hang a", "hang b", None
    began = time.monotonic()
    rows = enrich(table(spark, values), call, "t", "r", attempts=1, seconds=0.4, size=16, window=3).collect()
    assert time.monotonic() - began < 30
    assert [r["i"] for r in rows] == list(range(40))
    assert {r["i"] for r in rows if r["status"] == "FAILED"} == {11, 30}
    assert all(r["error"] == "took more than 0.4 s" and r["r"] is None for r in rows if r["i"] in (11, 30))
    assert rows[5]["r"] is None and rows[5]["status"] == "SUCCESS" and rows[12]["r"] == "ROW 12"


def test_a_failed_batch_is_halved():
    """One bad row among 64 costs a few calls, not one for each row."""
    sizes = []

    def call(values):
        sizes.append(len(values))
        if 40 in values:
            raise ValueError("bad")
        return values

    got = Caller(call, 1, None, 0.0).results(list(range(64)))
    assert got == [(i, None) if i != 40 else (None, "bad") for i in range(64)]
    assert sizes == [64, 32, 32, 16, 8, 8, 4, 2, 1, 1, 2, 4, 16] and len(sizes) == 13


def test_attempts_and_lengths():
    seen = []

    def flaky(values):
        seen.append(len(values))
        if len(seen) == 1:
            raise ConnectionError
        return values

    assert Caller(flaky, 2, None, 0.0).results([1, 2]) == [(1, None), (2, None)]
    assert Caller(lambda v: v[:1], 1, None, 0.0).results(["a", "b"]) == [("a", None), ("b", None)]
    assert Caller(lambda v: v * 2, 1, None, 0.0).results(["a"]) == [(None, "1 values sent, 2 came back")]
    assert Caller(lambda v: [["x"]], 1, None, 0.0).results([["a", "b"]]) == [(None, "2 lines sent, 1 came back")]

    def leave(values):
        raise KeyError

    assert Caller(leave, 3, 5.0, 0.0).results([1]) == [(None, "KeyError")]


def test_calls_overlap_and_keep_order(spark):
    def slow(texts):
        time.sleep(0.3 if "0" in texts else 0.1)
        return [t + "!" for t in texts]

    df = table(spark, [str(i) for i in range(12)])
    enrich(df, slow, "t", "r", size=2, window=6).collect()
    began = time.monotonic()
    assert [r["r"] for r in enrich(df, slow, "t", "r", size=2, window=6).collect()] == [f"{i}!" for i in range(12)]
    assert time.monotonic() - began < 2


def test_lists_blanks_and_own_values(spark):
    df = table(spark, ["a\nb", " ", None, "x"]).withColumn("t", F.split("t", "\n"))

    def call(lists):
        if any(x == ["x"] for x in lists):
            raise ValueError("no x")
        return [[y * 2 for y in x] for x in lists]

    rows = enrich(df, call, "t", "r", kind="array<string>", on_error="pass_through").collect()
    assert [(r["r"], r["status"], r["error"]) for r in rows] == [(["aa", "bb"], "SUCCESS", None), ([" "], "SUCCESS", None), (None, "SUCCESS", None), (["x"], "FAILED", "no x")]
    assert enrich(df.limit(0), call, "t", "r", kind="array<string>").count() == 0
    for wrong in ({"attempts": 0}, {"size": 0}, {"window": 0}, {"on_error": "x"}):
        with pytest.raises(ValueError):
            enrich(df, call, "t", "r", **wrong)
