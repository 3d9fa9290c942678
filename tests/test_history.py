"""Histories of snapshots against a plain walk from version to version."""

import random

import pytest

from guardframe import scratch
from guardframe.sources import policy
from guardframe.sources.policy import snapshot_history


def walk(rows):
    """(first version, first key, key, field, from, to) by following each row of the last version and those that end before."""
    by = {}
    for v, k, f, i in rows:
        by.setdefault(v, {})[k] = (f, i)
    low, high = min(by), max(by)
    root, spans = {}, {}
    for v in range(low, high + 1):
        now, last = by.get(v, {}), by.get(v - 1, {}) if v > low else {}
        fresh, gone = [k for k in now if k not in last], [k for k in last if k not in now]
        for k, (f, i) in now.items():
            up = k if k in last else None
            if up is None and v > low and sum(now[x][1] == i for x in fresh) == 1:
                same = [g for g in gone if last[g][1] == i]
                up = same[0] if len(same) == 1 else None
            root[v, k] = root[v - 1, up] if up is not None else (v, k)
            spans.setdefault(root[v, k], []).append((v, k, f))
    out = []
    for (v0, k0), states in spans.items():
        at = 0
        for n in range(1, len(states) + 1):
            if n == len(states) or states[n][1:] != states[at][1:]:
                end = states[n - 1][0]
                out.append((v0, k0, states[at][1], states[at][2], states[at][0], end + 1 if end < high else None))
                at = n
    return sorted(out, key=str)


@pytest.mark.parametrize("versions", [1, 2, 5, 9])
def test_histories(spark, versions):
    rng = random.Random(versions)
    rows = []
    for v in range(3, 3 + versions):
        if v == 6:
            continue  # a version without rows
        for e in range(30):
            if rng.random() < 0.8:
                rows.append((v, f"k{e}" + ("x" * ((v + e) // 3 % 2)), rng.choice([None, "a", "a"]), None if e == 1 else e % 25))
    df = spark.createDataFrame(rows, "version int, k string, f string, i int")
    got = snapshot_history(df, "version", "k", ["f"], ["i"]).select("first_version", "first_key", "k", "f", "from_version", "to_version").collect()
    assert sorted(map(tuple, got), key=str) == walk(rows)


def test_no_snapshots(spark):
    assert snapshot_history(spark.createDataFrame([], "version int, k string, f string, i int"), "version", "k", ["f"], ["i"]).count() == 0


def test_snapshots_are_not_broadcast(spark, monkeypatch):
    plans = []

    def durable(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint()

    scratch.shared_folder(spark)
    monkeypatch.setattr(policy, "durable", durable)
    rows = spark.createDataFrame([(v, f"k{k}", 1.0, k) for v in range(3) for k in range(4)], "version long, k string, f double, i int")
    durable(policy.snapshot_history(rows, "version", "k", ["f"], ["i"]))
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)
