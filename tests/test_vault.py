"""The vault's layouts, admission, streams over several batches, and as-of joins."""

import random

import pytest
from pyspark.sql import functions as F

from guardframe.operators import tokens as T
from guardframe.operators.asof import as_of, generation_scope
from guardframe.streaming import streams


def entries(spark, n, start=0, conn="c", gen=0):
    return spark.createDataFrame([(conn, gen, start + k, "t.s", f"value {start + k}", "string") for k in range(n)], T.VAULT)


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_lookups_read_one_slot_and_count_nothing(spark, tmp_path, capsys):
    v = T.Vault(spark, str(tmp_path / "v"))
    assert v.size("c", 0) == 0 and v.entries().count() == 0 and v.commits() == []
    v.append(entries(spark, 300))
    v.append(entries(spark, 200, 300))
    v.append(entries(spark, 50, 0, "other_conn", 3))
    assert (v.size("c", 0), v.size("other_conn", 3), v.size("c", 1)) == (500, 50, 0)
    assert v.bytes("c", 0) == sum(len(f"value {k}") for k in range(500))
    for _ in range(2):
        one = v.lookup("c", 0, 417)
        assert [r.value for r in one.collect()] == ["value 417"]
        out = plan(one, capsys)
        assert "(slot#" in out and f"= {417 % v.slots})" in out and "PartitionFilters: [isnotnull(conn" in out
        wanted = spark.createDataFrame([("t.s", "value 3"), ("t.s", "value 499"), ("t.s", "none")], "col_id string, value string")
        known = v.known(wanted, "c", 0)
        assert {"value 3", "value 499"} <= {r.value for r in known.collect()} and 0 < known.count() < 100
        assert "slot#" in plan(known, capsys).split("PartitionFilters")[1].split("\n")[0]
        assert sorted(r.idx for r in v.entries().where("conn = 'c'").collect()) == list(range(500))
        v.compact()
    v.append(entries(spark, 5, 500))
    assert v.size("c", 0) == 505 and v.entries("by_value").count() == 555 and v.lookup("other_conn", 3, 49).count() == 1


def test_an_append_that_is_not_committed_is_not_seen(spark, tmp_path):
    v = T.Vault(spark, str(tmp_path / "v"))
    v.append(entries(spark, 10), 0)
    v._write(entries(spark, 7, 10), "version=1")  # the writer was lost before its commit
    assert v.entries().count() == 10 and v.size("c", 0) == 10
    v.append(entries(spark, 4, 10), 1)
    v.append(entries(spark, 4, 10), 1)
    assert v.entries().count() == 14 and v.size("c", 0) == 14 and v.bytes("c", 0) == sum(len(f"value {k}") for k in range(14))
    assert v.size("c", 0, before=1) == 10


@pytest.mark.parametrize("strategy", ["deterministic", "randomized"])
@pytest.mark.parametrize(("cap", "used"), [(0, 0), (9, 0), (30, 11), (10_000, 0)])
def test_what_would_exceed_the_cap_is_refused(spark, strategy, cap, used):
    rows = [(k, None if k % 7 == 0 else f"v{k % 5}" * (1 + k % 3)) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, s string").coalesce(1)
    out, new = T.tokenize(df, {"s": "t.s"}, T.empty_vault(spark), "c", strategy=strategy, cap=cap, used=used)
    asked = [s for _, s in rows if s is not None]
    asked = sorted(set(asked)) if strategy == "deterministic" else asked
    room, admitted = cap - used, []
    for s in asked:
        room -= len(s)
        if room < 0:
            break
        admitted.append(s)
    assert [r.value for r in new.orderBy("idx").collect()] == admitted
    got = out.orderBy("id").collect()
    assert all(r.refused == (r.s is None and s is not None) for r, (_, s) in zip(got, rows))
    assert sum(r.s is not None for r in got) == (len(admitted) if strategy == "randomized" else sum(s in admitted for _, s in rows))


def test_a_stream_reads_what_its_batch_needs_and_retries_alike(spark, tmp_path, monkeypatch):
    source, at = tmp_path / "in", {k: str(tmp_path / k) for k in ("vault", "out", "state")}
    for k in range(4):
        spark.createDataFrame([(10 * k + j, f"v{(3 * k + j) % 9}") for j in range(6)] + [(10 * k + 9, None)], "id long, s string").coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("id long, s string").option("maxFilesPerTrigger", 1).parquet(str(source))
    append, calls = T.Vault.append, []

    def lost(self, new, version=None):
        calls.append(version)
        if len(calls) == 3:
            self._write(new, f"version={version}")
            raise RuntimeError("lost")
        append(self, new, version)

    monkeypatch.setattr(T.Vault, "append", lost)
    with pytest.raises(Exception, match="lost"):
        streams.tokenize_stream(stream(), {"s": "t.s"}, at["vault"], at["out"], at["state"], "c", compact_every=2).awaitTermination()
    streams.tokenize_stream(stream(), {"s": "t.s"}, at["vault"], at["out"], at["state"], "c", compact_every=2).awaitTermination()
    assert calls == [0, 1, 2, 2, 3]
    vault = streams.stream_vault(spark, at["vault"])
    assert sorted(r.idx for r in vault.collect()) == list(range(9))
    back = T.detokenize(spark.read.parquet(at["out"]).select("id", "s"), "s", vault)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, spark.read.parquet(str(source)).collect()), key=str)


def plain_as_of(left, right):
    out = []
    for i, k, t in left:
        past = [(b, v) for a, b, v in right if None not in (k, t, a, b) and a == k and b <= t]
        when = max((b for b, _ in past), default=None)
        out.append((i, max((v for b, v in past if b == when and v is not None), default=None)))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 100, 10**9])
def test_as_of(spark, block):
    rng = random.Random(block)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    left = [(i, key(), rng.choice([None, rng.randrange(-50, 300)]) if i % 9 == 0 else rng.randrange(-50, 300)) for i in range(300)]
    right = [(key(), rng.randrange(0, 250), rng.choice([None, 1, 2, 3, 4])) for _ in range(60)] + [(1, None, 9)]
    a = spark.createDataFrame(left, "i int, k int, t long")
    got = as_of(a, spark.createDataFrame(right, "k int, t long, v int"), "k", "t", "v", block)
    assert sorted((r.i, r.v) for r in got.collect()) == plain_as_of(left, right)


def test_generations(spark):
    log = spark.createDataFrame([("a", 10, 0), ("a", 20, 1), ("b", 30, 1)], "session string, at long, gen long")  # b resumes a
    asked = spark.createDataFrame(
        [("a", 5, "tok_c_0_1"), ("a", 10, "tok_c_0_1"), ("a", 25, "tok_c_0_1"), ("a", 25, "tok_c_1_1"), ("b", 31, "tok_c_1_1"), ("b", 31, "tok_c_1"), ("z", 31, "tok_c_0_1")],
        "session string, at long, token string",
    )
    got = {(r.session, r.at, r.token, r.current, r.error) for r in generation_scope(asked, log, 8).collect()}
    assert got == set(
        [
            ("a", 5, "tok_c_0_1", None, "no_session"), ("a", 10, "tok_c_0_1", 0, None), ("a", 25, "tok_c_0_1", 1, "stale_generation"), ("a", 25, "tok_c_1_1", 1, None),
            ("b", 31, "tok_c_1_1", 1, None), ("b", 31, "tok_c_1", 1, "bad_format"), ("z", 31, "tok_c_0_1", None, "no_session"),
        ]
    )
