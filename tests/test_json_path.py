"""Steps into JSON, ids of requests, and latency sketches."""

import random

import pytest
from pyspark.sql import functions as F

from guardframe.functions.json_path import json_get, json_get_text, json_path, json_path_text
from guardframe.operators import requests as R
from guardframe.operators.guard import Guard, GuardError
from guardframe.sources.policy import normalize_column_rules

J = """{"a":{"b":["x",{"c":null}],"it's":1},"n":1.5,"0":"zero","s":"q\\"t"}"""


@pytest.mark.parametrize(
    ("use", "want"),
    [
        (lambda j: json_get(j, "a"), '{"b":["x",{"c":null}],"it\'s":1}'), (lambda j: json_get_text(j, "a"), '{"b":["x",{"c":null}],"it\'s":1}'),
        (lambda j: json_get(j, "s"), '"q\\"t"'), (lambda j: json_get_text(j, "s"), 'q"t'), (lambda j: json_get_text(j, "n"), "1.5"),
        (lambda j: json_path(j, ["a", "b", "0"]), '"x"'), (lambda j: json_path_text(j, ["a", "b", "-2"]), "x"), (lambda j: json_path_text(j, ["a", "it's"]), "1"),
        (lambda j: json_path_text(j, ["0"]), "zero"), (lambda j: json_get(j, 0), None), (lambda j: json_path(j, ["a", "b", "1", "c"]), "null"), (lambda j: json_path_text(j, ["a", "b", "1", "c"]), None),
        (lambda j: json_path_text(j, ["a", "b", "7"]), None), (lambda j: json_path_text(j, ["n", "x"]), None), (lambda j: json_get_text(j, "none"), None),
    ],
)
def test_steps(spark, use, want):
    df = spark.createDataFrame([(1, J), (2, "{broken"), (3, None)], "id int, j string")
    assert [r.v for r in df.select("id", use(F.col("j")).alias("v")).orderBy("id").collect()] == [want, None, None]


def test_a_sensitive_json_column_is_not_stepped_into(spark):
    people = spark.createDataFrame([(1, '{"ssn":"1"}', '{"x":2}')], "id int, profile string, open string")
    g = Guard(spark, normalize_column_rules(spark.createDataFrame([("c", "private.people.profile")], "conn string, path string")), conn="c")
    frame = g.table(people, "people", "p", "private")
    for use in (json_get, json_get_text):
        with pytest.raises(GuardError) as e:
            frame.select(use(F.col("p.profile"), "ssn").alias("ssn"))
        assert e.value.code == "SENSITIVE_SELECT_EXPR"
    with pytest.raises(GuardError):
        frame.where(json_path_text(F.col("profile"), ["ssn"]) == "1")
    assert frame.select(json_get_text(F.col("p.open"), "x").alias("x")).to_df().first().x == "2"


def test_the_kind_of_an_id_is_its_own(spark):
    form = '{"jsonrpc":"2.0","id":%s,"method":"tools/call","params":{"name":"run_sql_query","arguments":{"connectionName":"c","query":"q","id":"inner"}}}'
    ids = ["7", '"7"', "-1", "4294967295", "4294967296", "1.5", "null", "[1]", '"x"']
    df = spark.createDataFrame([(k, form % i) for k, i in enumerate(ids)], "k int, json string")
    got = [(r.id_kind, r.error) for r in R.parse_request_log(df).orderBy("k").collect()]
    kinds = ["u32", "string", None, "u32", None, None, None, None, "string"]
    assert got == [(k, None if k else R.INVALID) for k in kinds]


def test_sketches_merge_within_their_bound(spark):
    rng = random.Random(4)
    values = [rng.random() ** 3 for _ in range(40_000)]
    rows = [(k % 48, "big", v) for k, v in enumerate(values)] + [(k, "small", float(k)) for k in range(24)] + [(1, "small", None)]
    df = spark.createDataFrame(rows, "hour int, tool string, latency double").withColumn("ts", F.timestamp_seconds(F.col("hour") * 3600 + 5))
    got = {r.tool: r for r in R.latency_quantiles(R.latency_sketches(df, ("tool",), k=200), ("tool",), "48 hours", probs=(0.5, 0.95, 0.999)).collect()}
    assert got["small"][2:] == (24, 11.0, 22.0, 23.0)  # exact
    values.sort()
    for p, v in zip((0.5, 0.95, 0.999), got["big"][3:]):
        rank = sum(x <= v for x in values) / len(values)
        assert abs(rank - p) < 0.03
    assert got["big"].n == 40_000


def test_quantiles_are_exact_at_any_number(spark):
    rows = spark.range(20_000).selectExpr("timestamp_seconds(id % 48 * 3600) ts", "'a' tool", "double((id * 7919) % 10007) latency")
    values = sorted(r.latency for r in rows.collect())
    got = R.exact_quantiles(R.latency_counts(rows, ("tool",)), ("tool",), "48 hours", probs=(0.5, 0.95, 0.99)).first()
    assert got[2:] == (20_000, *(values[n * 200 - 1] for n in (50, 95, 99)))
