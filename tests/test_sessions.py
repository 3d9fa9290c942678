"""Sessions against a plain fold, with users of most events and with long runs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from guardframe.operators.sessions import sessionize


def plain(rows, idle, life):
    times, out = defaultdict(list), []
    for u, t in rows:
        if u is not None and t is not None:
            times[u].append(t)
    for u, ts in times.items():
        k, now = 0, None
        for t in sorted(ts):
            if now and t - now[1] <= idle * 10**6 and t - now[0] <= life * 10**6:
                now = (now[0], t, now[2] + 1)
                continue
            if now:
                out.append((u, k, *now))
            k, now = k + 1, (t, t, 1)
        out.append((u, k, *now))
    return sorted(out)


def logs(seed, n, spread):
    """A third of all events are one user's, without a pause; others come and go."""
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(n):
        at += rng.choice([0, 1, 1_000_000, 59_999_999, rng.randrange(spread)])
        rows.append((7, at))
    for _ in range(2 * n):
        rows.append((rng.randrange(20), rng.randrange(at + 1)))
    return rows + [(None, 5), (3, None), (40, -5_000_000), (40, -4_999_999), (40, 0)]


@pytest.mark.parametrize(("idle", "life"), [(1200, 28800), (60, 60), (60, 600), (600, 60), (60, 61), (0, 5), (3600, 7200)])
def test_sessions_are_those_of_a_fold(spark, idle, life):
    rows = logs(idle + life, 700, 90_000_000)
    df = spark.createDataFrame(rows, "u int, t long").select("u", F.timestamp_micros("t").alias("ts"), F.lit(1).alias("session"), F.lit(2).alias("block"))
    got = sessionize(df, "u", "ts", idle, life).select("u", "session", F.unix_micros("started"), F.unix_micros("ended"), "n").collect()
    assert sorted(map(tuple, got)) == plain(rows, idle, life)


def test_no_events(spark):
    assert sessionize(spark.createDataFrame([], "user_id int, ts timestamp")).count() == 0


def test_one_user_with_all_events_is_spread(spark):
    """No stage of the plan deals rows by user before they are added up by block."""
    df = spark.range(200_000).select(F.lit(1).alias("user_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    out = sessionize(df)
    got = out.orderBy("session").collect()
    assert sum(r.n for r in got) == 200_000 and len(got) == -(-200_000 // (28800 // 7 + 1))
