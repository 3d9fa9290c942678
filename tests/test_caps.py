"""Byte caps against a plain running sum, and what their plans exchange."""

import random

import pytest
from pyspark.sql import functions as F

from guardframe.operators import caps
from guardframe.operators.tokens import empty_vault, output_plan


def plain(rows, most):
    out, total = [], 0
    for r in rows:
        total += sum(len(str(c).encode()) for c in r if c is not None)
        if total > most:
            return out, True
        out.append(r)
    return out, False


def rows_of(kind, n=900):
    rng = random.Random(kind)
    if kind == "late bytes":  # the mean says little of the first rows
        return [(i, None if i < 800 else "x" * 500) for i in range(n)]
    if kind == "early bytes":
        return [(i, "y" * 400 if i < 10 else None) for i in range(n)]
    return [(i, rng.choice([None, "", "é" * rng.randint(0, 30), "z" * rng.randint(0, 9)])) for i in range(n)]


@pytest.mark.parametrize("kind", ["late bytes", "early bytes", "mixed"])
@pytest.mark.parametrize("top", [1 << 18, 70])
@pytest.mark.parametrize("most", [1, 40, 2000, 10_000_000])
def test_the_longest_prefix_in_bytes(spark, monkeypatch, kind, top, most):
    monkeypatch.setattr(caps, "TOP_ROWS", top)
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    got = caps.cap_payload(df, ["k"], most).orderBy("k").collect()
    want, cut = plain(rows, most)
    assert [(r.k, r.v) for r in got] == want and {r.truncated for r in got} <= {cut}


def test_no_row_past_the_cut_off_is_exchanged(spark, capsys):
    df = spark.range(100_000).select("id", F.lit("some bytes").alias("v"))
    seen = []
    keep = caps.durable
    caps.durable = lambda d: seen.append(d) or keep(d)
    try:
        assert caps.cap_payload(df, ["id"], 1000).count() == 84
    finally:
        caps.durable = keep
    assert len(seen) == 1
    seen[0].explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject(limit=" in plan and "Exchange" not in plan


def test_all_rows_of_a_result(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(300)], "k int, v string")
    out, new = caps.cap_result(output_plan(df, {"v": "t.v"}), ["k"], empty_vault(spark), "c", rows=0, most=0)
    got = out.orderBy("k").collect()
    assert [r.k for r in got] == list(range(300)) and not any(r.truncated for r in got)
    assert [r.v for r in got] == [f"tok_c_0_{i % 7}" for i in range(300)] and new.count() == 7
