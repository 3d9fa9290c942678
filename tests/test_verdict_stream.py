"""Verdicts on a stream equal those of the whole log, however its facts are dealt to batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from guardframe.operators import audit as A
from guardframe.sources.policy import normalize_column_rules, normalize_function_rules
from guardframe.streaming import verdicts
from guardframe.streaming.verdicts import TABLES, as_facts, as_tables, verdict_stream
from tests.test_audit import CASES, facts

FACT = "query_id long, ts timestamp, kind string, expected long, body string"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rules(spark):
    paths = lambda *p: spark.createDataFrame(p, "conn string, path string")
    return (
        normalize_column_rules(paths(("here", "people.mail"))), spark.createDataFrame([("count",)], "name string"),
        normalize_function_rules(paths(("here", "f"))),
    )


@pytest.fixture(scope="module")
def log(spark):
    """Tables of the audit's cases, and their facts as rows of Python."""
    rows = [[], [], [], []]
    for k, (case, _, _) in enumerate(CASES.values()):
        for table, more in zip(rows, facts(spark, k, **case)):
            table += more
    tables = [spark.createDataFrame(r, s) for r, s in zip(rows, TABLES.values())]
    timed = [t.withColumn("ts", F.lit(START)) for t in tables]
    counts = timed[0].select("query_id", "ts")
    for t in timed[1:]:
        counts = counts.union(t.select("query_id", "ts"))
    counts = counts.groupBy("query_id", "ts").agg(F.count("*").alias("expected"))
    return tables, [tuple(r) for r in as_facts(counts, *timed).collect()]


class Feed:
    """A folder that a stream reads, its output, and the batches that have run."""

    def __init__(self, spark, folder, rules, wait):
        self.spark, self.folder, self.rules, self.wait = spark, str(folder), rules, wait

    def send(self, rows):
        self.spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(FACT).parquet(f"{self.folder}/in")
        verdict_stream(stream, *self.rules, f"{self.folder}/out", f"{self.folder}/state", "here", self.wait).awaitTermination()

    def read(self, table):
        return self.spark.read.parquet(f"{self.folder}/out/{table}")

    def verdicts(self):
        return sorted((r.query_id, r.code) for r in self.read("verdicts").collect())


def test_facts_come_back_as_tables(spark, log):
    tables, rows = log
    for given, got in zip(tables, as_tables(spark.createDataFrame(rows, FACT))):
        assert got.schema.simpleString() == given.schema.simpleString()
        assert got.exceptAll(given).count() == given.exceptAll(got).count() == 0


def test_verdicts_equal_the_batch_however_facts_are_dealt(spark, log, rules, tmp_path):
    tables, rows = log
    feed = Feed(spark, tmp_path, rules, "1 hour")
    want = A.first_verdict(tables[0], A.all_violations(*tables, *rules, conn="here", order=True))
    want = sorted((r.query_id, r.code) for r in want.collect())
    # two thirds first, some of them twice; every query with a fact in the rest stays open
    first, rest = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    feed.send(first + first[:50])
    open_ids = {r[0] for r in rest}
    assert feed.verdicts() == [v for v in want if v[0] not in open_ids]
    feed.send(rest)
    assert feed.verdicts() == want
    assert feed.read("apart").count() == 0
    assert {r.kind for r in feed.read("waiting").where("batch = 1").collect()} == {"closed", "clock"}


def test_late_facts_are_kept_apart_and_missing_ones_end_a_query(spark, log, rules, tmp_path):
    _, rows = log
    some = lambda q, minutes: [(r[0], START + timedelta(minutes=minutes), *r[2:]) for r in rows if r[0] == q]
    feed = Feed(spark, tmp_path, rules, "1 hour")
    whole, lacking, late = some(0, 0), some(1, 0), some(2, 100)
    feed.send(whole + lacking[1:])
    assert [q for q, _ in feed.verdicts()] == [0]
    # 0 again, a fact with no id, and a query whose time moves the clock
    feed.send(whole[:2] + [(None, START, "blocks", None, "{}")] + late)
    assert [(q, c == "INCOMPLETE") for q, c in feed.verdicts()] == [(0, False), (1, True), (2, False)]
    assert sorted(str(r.query_id) for r in feed.read("apart").collect()) == ["0", "0", "None"]
    # the last fact of 1 is too late; 3 is older than the clock allows; 4 has no facts and needs none
    feed.send(lacking[:1] + some(3, 30) + [(4, START + timedelta(minutes=300), "queries", 0, None)])
    assert [(q, c) for q, c in feed.verdicts() if q > 2] == [(4, "OK")]
    assert feed.read("apart").where("batch = 2").count() == 1 + len(some(3, 30))
    # ids of queries over two hours before the clock are no longer kept
    assert {r.query_id for r in feed.read("waiting").where("batch = 2 and kind = 'closed'").collect()} == {4}


def test_facts_are_kept_packed_and_dealt_to_bounded_parts(spark, log, rules, tmp_path, monkeypatch):
    """Only the clock is a checkpoint of rows; parts follow from the facts, and nothing of a batch is left but its tables."""
    tables, rows = log
    kept, durable = [], verdicts.durable
    monkeypatch.setattr(verdicts, "durable", lambda df: kept.append(df.count()) or durable(df))
    monkeypatch.setattr(verdicts, "FACTS", 100)
    feed = Feed(spark, tmp_path, rules, "1 hour")
    feed.send(rows + rows[:50])
    want = A.first_verdict(tables[0], A.all_violations(*tables, *rules, conn="here", order=True))
    assert feed.verdicts() == sorted((r.query_id, r.code) for r in want.collect())
    assert kept == [1] and not (tmp_path / "out/scratch/batch=0").exists()


def test_a_fact_is_parsed_once(spark, log):
    """However many of its fields are asked for, before they are read and after."""
    blocks = as_tables(spark.createDataFrame(log[1], FACT))[0]
    asked = blocks.where("has_star or has_distinct or limit_value < 0").select("query_id", F.coalesce("scope", "status"))
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_nodes_are_sorted_once_for_all_windows(spark, log, rules):
    found = A.all_violations(*log[0], *rules, conn="here", order=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "Sort [" in line and "clause" in line]) == 1
