import pytest
from pyspark.sql import functions as F

from guardframe.operators import caps, tokens as T


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("tok_my_conn_0_7", ("my_conn", 0, 7)), ("tok_a_4294967295_4294967295", ("a", 4294967295, 4294967295)), ("tok_a_4294967296_1", None),
        ("tok_a_1", None), ("tok__1_1", None), ("nope_a_1_1", None), ("tok_a_x_1", None), ("tok_a_1_", None), ("tok_a_1_1\n", None), ("tok_a\n_1_1", None), ("", None), (None, None),
        ("tok_" + "c" * 31 + "_1_1", ("c" * 31, 1, 1)), ("tok_" + "c" * 32 + "_1_1", None),
    ],
)
def test_parse(spark, token, want):
    df = spark.createDataFrame([(token,)], "t string")
    got = df.select(T.parse_token(F.col("t")).alias("p")).first().p
    assert (tuple(got) if got else None) == want


def test_tokens_round_trip_and_grow(spark):
    df = spark.createDataFrame([(1, "x", 2.5), (2, "y", None), (3, "x", 2.5), (4, None, 1.0)], "id int, s string, d double")
    ids = {"s": "t.s", "d": "t.d"}
    out, vault = T.tokenize(df, ids, T.empty_vault(spark), "c")
    back = T.detokenize(T.detokenize(out, "s", vault), "d", vault, "double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert out.where("s like '%x%' and s not like 'tok%'").count() == 0
    more = spark.createDataFrame([(5, "y", 1.0), (6, "z", 2.5)], df.schema)
    out2, fresh = T.tokenize(more, ids, vault, "c")
    assert [(r.idx, r.col_id, r.value) for r in fresh.collect()] == [(4, "t.s", "z")]
    assert out2.where("id = 5").first().s == out.where("id = 2").first().s


def test_randomized_gives_each_cell_its_own(spark):
    df = spark.createDataFrame([(i, "same") for i in range(50)] + [(50, None)], "id int, s string")
    out, vault = T.tokenize(df, {"s": "t.s"}, T.empty_vault(spark), "c", strategy="randomized")
    assert out.select("s").distinct().count() == 51 and vault.count() == 50
    assert sorted(r.idx for r in vault.collect()) == list(range(50))


def test_scopes(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    _, vault = T.tokenize(df, {"s": "t.s"}, T.empty_vault(spark), "c")
    assert T.filter_by_tokens(df, "s", "t.s", ["tok_c_0_0"], vault, "c").collect()[0].s == "a"
    assert T.filter_by_tokens(df, "s", "x.t.s", ["tok_c_0_0"], vault, "c").count() == 0
    assert T.filter_by_tokens(df, "s", "t.s", ["tok_c_1_0", "tok_d_0_0"], vault, "c").count() == 0
    with pytest.raises(ValueError):
        T.filter_by_tokens(df, "s", "t.s", ["tok_c_0_0"] * 11, vault, "c")


def test_vault_table(spark, tmp_path):
    v = T.Vault(spark, str(tmp_path / "vault"))
    _, new = T.tokenize(spark.createDataFrame([("a",), ("b",)], "s string"), {"s": "t.s"}, T.empty_vault(spark), "c")
    v.append(new)
    assert v.size("c", 0) == 2 and v.lookup("c", 0, 1).first().value == "b" and v.size("c", 1) == 0


def test_payload_cap_is_a_prefix(spark):
    df = spark.createDataFrame([(1, "12345", None), (2, "67890", "x")], "id int, a string, b string")
    got = caps.cap_payload(df, ["id"], 5, ["a", "b"]).collect()
    assert [(r.id, r.truncated) for r in got] == [(1, True)]
    assert [r.truncated for r in caps.cap_payload(df, ["id"], 11, ["a", "b"]).collect()] == [False, False]
    assert caps.cap_payload(df.limit(0), ["id"], 5).count() == 0
