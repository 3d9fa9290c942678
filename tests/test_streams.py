from datetime import datetime, timedelta
from random import Random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guardframe.operators.sessions import evict_oldest_idle, sessionize
from guardframe.streaming import streams


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fold(times, idle=1200, life=28800):
    out = []
    for t in sorted(times):
        if out and (t - out[-1][1]).total_seconds() <= idle and (t - out[-1][0]).total_seconds() <= life:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


@pytest.fixture(scope="module")
def events(spark):
    start = datetime(2024, 1, 1)
    # a user that never rests, one with gaps at and over the limit, repeated times
    rows = [(1, start + timedelta(minutes=15 * k)) for k in range(120)]
    rows += [(2, start + timedelta(minutes=m)) for m in (0, 20, 41, 41, 60)] + [(2, None), (None, start)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp")


def test_sessions_are_those_of_a_fold(events):
    by = {}
    for r in events.where("user_id is not null and ts is not null").collect():
        by.setdefault(r.user_id, []).append(r.ts)
    want = sorted((u, *s) for u, ts in by.items() for s in fold(ts))
    got = sorted((r.user_id, r.started, r.ended, r.n) for r in sessionize(events).collect())
    assert got == want
    assert sessionize(events.limit(0)).count() == 0


def test_long_runs_may_be_cut_into_any_batches(spark):
    start = datetime(2024, 1, 1)
    rows = [(u, start + timedelta(minutes=m * k)) for u, m, n in ((1, 15, 200), (2, 7, 500), (3, 20, 25), (4, 19, 26), (5, 20, 26)) for k in range(n)]
    rows += [(1, t + timedelta(days=9)) for u, t in rows if u == 1] + rows[:40]
    by = {}
    for u, t in rows:
        by.setdefault(u, []).append(t)
    want = sorted((u, *s) for u, ts in by.items() for s in fold(ts))
    events = spark.createDataFrame(rows, "user_id long, ts timestamp")
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted((r.user_id, r.started, r.ended, r.n) for r in sessionize(events).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_stream_of_sessions_equals_the_batch(spark, events, tmp_path):
    good = events.where("user_id is not null and ts is not null")
    # a late closing event moves the watermark past every session
    last = spark.createDataFrame([(9, datetime(2024, 2, 1))], "user_id long, ts timestamp")
    good.coalesce(1).write.parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = streams.sessions_stream(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.user_id, r.started, r.ended, r.n) for r in spark.table("closed").collect()}
    batch = sessionize(good).select("user_id", F.unix_micros("started").alias("a"), F.unix_micros("ended").alias("b"), "n")
    assert got == {tuple(r) for r in batch.collect()}


def test_tokens_agree_over_batches(spark, tmp_path):
    schema = "id int, s string"
    at = {k: str(tmp_path / k) for k in ("vault", "out", "state")}
    for k, rows in enumerate([[(1, "b"), (2, "a")], [(3, "b"), (4, "c"), (5, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.tokenize_stream(stream, {"s": "t.s"}, at["vault"], at["out"], at["state"], "c").awaitTermination()
    got = {r.id: r.s for r in spark.read.parquet(at["out"]).collect()}
    assert got == {1: "tok_c_0_1", 2: "tok_c_0_0", 3: "tok_c_0_1", 4: "tok_c_0_2", 5: None}
    assert streams.stream_vault(spark, at["vault"]).count() == 3


def test_evictions_equal_the_batch_at_each_trigger(spark, rocks, tmp_path):
    start = datetime(2024, 1, 1)
    # a hot group, a null group, times that tie, fall back and are missing, repeated rows, a group under the cap
    rows = [(1, (k * 37) % 101, start + timedelta(minutes=(k * 53) % 60)) for k in range(90)]
    rows += [(None, k, start + timedelta(minutes=k % 2)) for k in range(7)] + [(2, k, None) for k in range(5)] + [(2, 9, start)] * 2 + [(3, 1, start)]
    schema = "user long, session long, started timestamp"
    seen, given = [], []
    source = str(tmp_path / "in")

    def keep_rows(batch, batch_id):
        seen.extend(tuple(r) for r in batch.collect())

    for k in range(3):
        given += rows[k::3]
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        found = streams.evictions_stream(stream.withColumn("extra", F.lit(0)), 3, ["user"], salts=4)
        found.writeStream.foreachBatch(keep_rows).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        batch = evict_oldest_idle(spark.createDataFrame(given, schema), 3, ["user"]).where("evicted")
        want = batch.select("user", "session", F.unix_micros("started")).collect()
        order = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(seen, key=order) == sorted(map(tuple, want), key=order)


def test_evictions_call_python_for_buckets_not_for_groups(spark, rocks, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(g, 3 * g + k, start + timedelta(minutes=(k * 7 + g) % 5)) for g in range(400) for k in range(3)]
    schema = "user long, session long, started timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = streams.evictions_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, ["user"], buckets=8)
    out = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    q = out.trigger(availableNow=True).start()
    q.awaitTermination()
    assert [0 < state.numRowsTotal <= 8 for state in q.lastProgress.stateOperators] == [True]
    batch = evict_oldest_idle(spark.createDataFrame(rows, schema), 2, ["user"]).where("evicted")
    want = batch.select("user", "session", F.unix_micros("started")).collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want))


class Held:
    """A state that only its test sees."""

    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, value: setattr(self, "value", value)
    getValueState = lambda self, name, schema: self


@pytest.mark.parametrize("fold, pack", [(1, 1), (7, 3), (40, 10), (1000, 1000)])
def test_long_lists_of_a_bucket_are_folded_in_pieces(monkeypatch, fold, pack):
    """Rows that come in pieces, lists that are cut, and pieces of a hot group: each row once, and the latest stay."""
    monkeypatch.setattr(streams, "FOLD", fold)
    monkeypatch.setattr(streams, "PACK", pack)
    random, keep, rows, out = Random(5), 3, [], []
    state = streams._Newest(keep)
    state.init(Held())
    names = ["home", "group", "started", "session"]
    for trigger in range(3):
        fresh = [(g % 4, f"g{g}", random.randrange(30), random.randrange(10**6)) for g in [1] * 60 + [random.randrange(12) for _ in range(40)]]
        rows += fresh
        packed = []
        for bucket in range(2):
            mine = [r for r in fresh if r[3] % 2 == bucket]
            batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in mine[k : k + 9]], pa.schema(list(zip(names, (pa.int32(), pa.string(), pa.int64(), pa.int64()))))) for k in range(0, len(mine), 9)]
            packed += [b.to_pandas() for b in streams._deal(keep)((pa.scalar(bucket),), iter(batches))]
        assert all(len(c) <= pack for p in packed for c in p["group"])
        # no more than keep rows of a group and trigger come on from a bucket
        assert sum(list(c).count("g1") for p in packed for e, c in zip(p["evicted"], p["group"]) if not e) <= 2 * keep
        for part in state.handleInputRows((0,), iter(packed), None):
            out += [r for lists in part.itertuples(index=False) for r in zip(*map(list, lists))]
        stay = [s for g in {r[1] for r in rows} for s in sorted((r[1:] for r in rows if r[1] == g), key=lambda r: r[1:])[-keep:]]
        assert sorted(zip(*state.held.value)) == sorted(stay)
        assert sorted(out + stay) == sorted(r[1:] for r in rows)
