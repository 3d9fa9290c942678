"""Token and cap operators over the star schema, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from guardframe.operators import caps, tokens as T
from guardframe.operators.asof import generation_scope
from guardframe.scratch import durable, shared_folder

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark, sf_dir):
    """Customers with names as tokens, and the vault that it makes."""
    df = read(spark, sf_dir, "customer")
    out, vault = T.tokenize(df, {"c_name": "customer.c_name"}, T.empty_vault(spark), "tpch")
    return df, out, durable(vault)


_DICT = "names AS (SELECT c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS idx FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL))"


@query("SELECT c_custkey, 'tok_tpch_0_' || (dense_rank() OVER (ORDER BY c_name) - 1) AS c_name FROM customer")
def t1_tokenize_deterministic(spark, sf_dir):
    return _names(spark, sf_dir)[1].select("c_custkey", "c_name")


@query("""WITH v AS (SELECT DISTINCT 'customer.c_mktsegment' AS col_id, c_mktsegment AS value FROM customer UNION ALL SELECT DISTINCT 'customer.c_name', c_name FROM customer),
n AS (SELECT *, row_number() OVER (ORDER BY col_id, value) - 1 AS idx FROM v)
SELECT c_custkey, 'tok_tpch_0_' || a.idx AS c_name, 'tok_tpch_0_' || b.idx AS c_mktsegment FROM customer JOIN n a ON a.col_id = 'customer.c_name' AND a.value = c_name
JOIN n b ON b.col_id = 'customer.c_mktsegment' AND b.value = c_mktsegment""")
def t1_two_columns(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    ids = {"c_name": "customer.c_name", "c_mktsegment": "customer.c_mktsegment"}
    return T.tokenize(df, ids, T.empty_vault(spark), "tpch")[0].select("c_custkey", "c_name", "c_mktsegment")


@query("""WITH d AS (SELECT DISTINCT l_shipdate::DATE AS v FROM lineitem), n AS (SELECT v, row_number() OVER (ORDER BY v::VARCHAR) - 1 AS idx FROM d)
SELECT l_orderkey, l_linenumber, 'tok_tpch_0_' || idx AS ship FROM lineitem JOIN n ON l_shipdate::DATE = v""")
def t1_tokenize_lineitem(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship"))
    return T.tokenize(df, {"ship": "lineitem.l_shipdate"}, T.empty_vault(spark), "tpch")[0]


@query("SELECT count(*) AS cells, count(*) AS tokens, 0 AS least, count(*) - 1 AS most FROM customer")
def t2_tokenize_randomized(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out, _ = T.tokenize(df, {"c_mktsegment": "customer.c_mktsegment"}, T.empty_vault(spark), "tpch", strategy="randomized")
    idx = T.parse_token(F.col("c_mktsegment"))["idx"]
    return out.agg(F.count("*").alias("cells"), F.countDistinct("c_mktsegment").alias("tokens"), F.min(idx).cast("int").alias("least"), F.max(idx).alias("most"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS v FROM customer),
n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx FROM (SELECT DISTINCT v FROM s WHERE v IS NOT NULL))
SELECT c_custkey, 'tok_tpch_0_' || idx AS v FROM s LEFT JOIN n USING (v)""")
def t3_nulls_stay(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("v"))
    return T.tokenize(df, {"v": "customer.c_name"}, T.empty_vault(spark), "tpch")[0]


@query("SELECT o_orderkey, 'tok_my_conn_' || (o_custkey % 5) || '_' || o_orderkey AS token FROM orders")
def t4_format_token(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return df.select("o_orderkey", T.format_token("my_conn", F.col("o_custkey") % 5, F.col("o_orderkey")).alias("token"))


_TOKENS = """CASE WHEN o_orderkey % 7 = 0 THEN 'tok_a' WHEN o_orderkey % 7 = 1 THEN 'tok_c_1_99999999999' WHEN o_orderkey % 7 = 2 THEN 'x_c_1_2'
  ELSE 'tok_my_conn_' || (o_custkey % 5) || '_' || o_orderkey END"""


@query(f"""WITH t AS (SELECT o_orderkey, {_TOKENS} AS token FROM orders), p AS (SELECT *, regexp_matches(token, '^tok_.+_[0-9]{{1,10}}_[0-9]{{1,10}}$') AS ok FROM t)
SELECT o_orderkey, CASE WHEN ok THEN regexp_extract(token, '^tok_(.+)_([0-9]+)_([0-9]+)$', 1) END AS conn,
CASE WHEN ok THEN regexp_extract(token, '^tok_(.+)_([0-9]+)_([0-9]+)$', 2)::BIGINT END AS gen, CASE WHEN ok THEN regexp_extract(token, '^tok_(.+)_([0-9]+)_([0-9]+)$', 3)::BIGINT END AS idx FROM p""")
def t5_parse_token(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TOKENS).alias("token"))
    return t.select("o_orderkey", T.parse_token(F.col("token")).alias("t")).select("o_orderkey", "t.*")


@query(f"WITH {_DICT} SELECT 'tpch' AS conn, 0 AS gen, idx, 'customer.c_name' AS col_id, c_name AS value, 'string' AS source_type FROM names")
def t6_vault(spark, sf_dir):
    return _names(spark, sf_dir)[2]


@query(f"WITH {_DICT} SELECT idx, 'customer.c_name' AS col_id, c_name AS value FROM names WHERE idx % 64 = 7 UNION ALL SELECT max(idx) + 1 + count(*), 'next', NULL FROM names")
def t6_vault_layout(spark, sf_dir):
    """One slot of a vault that came in two appends and was compacted, and its next free index plus its length."""
    vault = T.Vault(spark, f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}")
    entries = _names(spark, sf_dir)[2]
    vault.append(entries.where("idx % 2 = 0"))
    vault.append(entries.where("idx % 2 = 1"))
    vault.compact()
    slot = vault.entries().where("conn = 'tpch' and gen = 0 and slot = 7").select("idx", "col_id", "value")
    length = vault.size("tpch", 0)
    return slot.union(entries.agg((F.count("*") + length).alias("idx"), F.lit("next"), F.lit(None).cast("string")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 99 AS idx FROM orders")
def t7_dense_index(spark, sf_dir):
    from guardframe.scratch import dense_index

    return dense_index(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "idx")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def t8_detokenize(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    out, vault = T.tokenize(df, {"c_name": "customer.c_name", "c_acctbal": "customer.c_acctbal"}, T.empty_vault(spark), "tpch")
    vault = durable(vault)
    return T.detokenize(T.detokenize(out, "c_name", vault), "c_acctbal", vault, "double")


_REQ = """SELECT o_custkey AS request_id, o_orderkey AS pos, CASE o_orderkey % 6 WHEN 0 THEN 'tok' WHEN 1 THEN 'tok_other_0_1' WHEN 2 THEN 'tok_tpch_3_1' WHEN 3 THEN 'tok_tpch_0_4000000000'
  ELSE 'tok_tpch_0_' || (o_orderkey % 10) END AS token FROM orders"""
_ERR = f"""WITH r AS ({_REQ}), {_DICT}, j AS (SELECT r.*, count(*) OVER (PARTITION BY request_id) AS n FROM r)
SELECT request_id, pos, token, CASE WHEN n > 10 THEN 'token_count' WHEN token = 'tok' THEN 'bad_format' WHEN token LIKE 'tok_other%' THEN 'other_connection' WHEN token LIKE 'tok_tpch_3%' THEN 'stale_generation'
WHEN token = 'tok_tpch_0_4000000000' THEN 'unknown_index' END AS error FROM j"""


def _validated(spark, sf_dir):
    requests = read(spark, sf_dir, "orders").select(F.expr("o_custkey request_id"), F.expr("o_orderkey pos"), F.expr(_REQ.split("AS pos, ")[1].split(" AS token")[0]).alias("token"))
    return T.validate_tokens(requests, "tpch", 0, _names(spark, sf_dir)[2])


@query(_ERR)
def t9_validate_tokens(spark, sf_dir):
    return _validated(spark, sf_dir).drop("col_id")


@query(f"SELECT request_id, pos, error IS NULL AND pos % 2 = 0 AS matches FROM ({_ERR})")
def t10_check_token_scope(spark, sf_dir):
    wanted = F.when(F.col("pos") % 2 == 0, "customer.c_name").otherwise("main.customer.c_name")
    return T.check_token_scope(_validated(spark, sf_dir).withColumn("wanted_col_id", wanted)).select("request_id", "pos", "matches")


def _tokens_of(vault, values):
    rows = vault.where(F.col("value").isin(values)).orderBy("idx").select(T.format_token("tpch", F.lit(0), F.col("idx")).alias("t"))
    return [r.t for r in rows.limit(T.MAX_TOKENS).collect()]


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name = (SELECT min(c_name) FROM customer JOIN orders ON o_custkey = c_custkey)")
def t11_filter_by_token_eq(spark, sf_dir):
    df, _, vault = _names(spark, sf_dir)
    orders = read(spark, sf_dir, "orders")
    least = df.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.min("c_name")).first()[0]
    few = T.filter_by_tokens(df, "c_name", "customer.c_name", _tokens_of(vault, [least]), vault, "tpch")
    return orders.join(few, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_custkey")


_THREE = "SELECT DISTINCT c_name FROM customer ORDER BY c_name LIMIT 3"


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_name IN ({_THREE})")
def t12_filter_by_token_in(spark, sf_dir):
    df, _, vault = _names(spark, sf_dir)
    three = [r.c_name for r in df.select("c_name").distinct().orderBy("c_name").limit(3).collect()]
    return T.filter_by_tokens(df, "c_name", "customer.c_name", _tokens_of(vault, three), vault, "tpch").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_name IN ({_THREE}) AND c_mktsegment = (SELECT min(c_mktsegment) FROM customer WHERE c_name IN ({_THREE}))")
def t13_filter_by_tokens_multi(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    ids = {"c_name": "customer.c_name", "c_mktsegment": "customer.c_mktsegment"}
    vault = durable(T.tokenize(df, ids, T.empty_vault(spark), "tpch")[1])
    three = [r.c_name for r in df.select("c_name").distinct().orderBy("c_name").limit(3).collect()]
    few = T.filter_by_tokens(df, "c_name", ids["c_name"], _tokens_of(vault, three), vault, "tpch")
    segment = few.agg(F.min("c_mktsegment")).first()[0]
    return T.filter_by_tokens(few, "c_mktsegment", ids["c_mktsegment"], _tokens_of(vault, [segment]), vault, "tpch").select("c_custkey", "c_name")


@query("SELECT count(*) AS n, sum(CASE WHEN s_name IS NULL THEN 0 ELSE 1 END)::BIGINT AS tokens, sum(s_nationkey)::BIGINT AS plain, 'supplier.s_name' AS col_id FROM supplier")
def t14_t15_plan_and_mask(spark, sf_dir):
    df = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("who"), "s_nationkey")
    planned = T.output_plan(df, {"who": "supplier.s_name"})
    out, _ = T.mask_output(planned, T.empty_vault(spark), "tpch")
    col_id = F.lit(planned.schema["who"].metadata["col_id"])
    return out.agg(F.count("*").alias("n"), F.sum(F.col("who").startswith("tok_tpch_0_").cast("long")).alias("tokens"), F.sum("s_nationkey").alias("plain")).withColumn("col_id", col_id)


@query(f"""WITH {_DICT}, v AS (SELECT idx, strlen(c_name) AS b, sum(strlen(c_name)) OVER (ORDER BY idx) AS run FROM names)
SELECT 'tpch' AS conn, 0 AS gen, sum(b)::BIGINT AS bytes, min(CASE WHEN run > 5000 THEN idx END) AS first_over, sum(b) > 5000 AS over FROM v""")
def t16_vault_quota(spark, sf_dir):
    return T.vault_quota(_names(spark, sf_dir)[2], 5000)


@query(f"""WITH {_DICT}, v AS (SELECT idx, c_name, sum(strlen(c_name)) OVER (ORDER BY idx) AS run FROM names)
SELECT c_custkey, CASE WHEN 600 + run <= 5000 THEN 'tok_tpch_0_' || idx END AS c_name, 600 + run > 5000 AS refused FROM customer JOIN v USING (c_name)""")
def t16_enforced_quota(spark, sf_dir):
    """Names as tokens in a session that has 600 of 5,000 bytes in use: what would exceed them is refused."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return T.tokenize(df, {"c_name": "customer.c_name"}, T.empty_vault(spark), "tpch", cap=5000, used=600)[0]


@query("""WITH g AS (SELECT user_id AS session, ts AS at, max(event_id) AS gen FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
r AS (SELECT event_id, user_id AS session, ts AS at, event_id - event_id % 4 AS g FROM events WHERE event_type <> 'purchase'),
j AS (SELECT r.*, g.gen FROM r ASOF LEFT JOIN g ON r.session = g.session AND r.at >= g.at)
SELECT event_id, gen AS current, CASE WHEN gen IS NULL THEN 'no_session' WHEN gen <> g THEN 'stale_generation' END AS error FROM j""")
def t18_generation_scope(spark, sf_dir):
    """Events as requests: a purchase begins a generation of its user, other events carry tokens of a generation near by."""
    events = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    generations = events.where("event_type = 'purchase'").select("session", "at", F.col("event_id").alias("gen"))
    token = T.format_token("ev", F.col("event_id") - F.col("event_id") % 4, F.lit(1))
    requests = events.where("event_type <> 'purchase'").select("event_id", "session", "at", token.alias("token"))
    return generation_scope(requests, generations).select("event_id", "current", "error")


@query("SELECT o_orderkey, o_orderdate, o_orderkey IS NULL OR (SELECT count(*) FROM orders) > 200 AS truncated FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200")
def r1_cap_rows(spark, sf_dir):
    return caps.cap_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


_R2 = """WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, sum(strlen(o_orderkey::VARCHAR) + coalesce(strlen(o_orderstatus), 0) + coalesce(strlen(o_orderpriority), 0)) OVER (ORDER BY o_orderkey) AS run FROM orders)
SELECT o_orderkey, o_orderstatus, o_orderpriority, (SELECT max(run) FROM r) > 65536 AS truncated FROM r WHERE run <= 65536"""


@query(_R2)
def r2_cap_payload(spark, sf_dir):
    return caps.cap_payload(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


_R3 = """WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 200), d AS (SELECT c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS idx FROM (SELECT DISTINCT c_name FROM f)),
m AS (SELECT c_custkey, 'tok_tpch_0_' || idx AS c_name FROM f JOIN d USING (c_name)), r AS (SELECT *, sum(strlen(c_custkey::VARCHAR) + strlen(c_name)) OVER (ORDER BY c_custkey) AS run FROM m)
SELECT c_custkey, c_name, (SELECT max(run) FROM r) > 1500 OR (SELECT count(*) FROM customer) > 200 AS truncated FROM r WHERE run <= 1500"""


@query(_R3)
def r3_cap_result(spark, sf_dir):
    planned = T.output_plan(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": "customer.c_name"})
    return caps.cap_result(planned, ["c_custkey"], T.empty_vault(spark), "tpch", 200, 1500)[0]


@query("""WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer), r AS (SELECT * FROM c ORDER BY c_custkey LIMIT 200)
SELECT '{"exec_ms":0,"columns":[{"name":"c_custkey","kind":"plaintext","type":"bigint"},{"name":"c_name","kind":"plaintext","type":"string"},{"name":"c_mktsegment","kind":"plaintext","type":"string"}],"rows":['
 || string_agg('["' || c_custkey || '","' || c_name || '",' || coalesce('"' || c_mktsegment || '"', 'null') || ']', ',' ORDER BY c_custkey) || '],"rowcount":' || count(*) || ',"resultTruncated":' || ((SELECT count(*) FROM c) > 200)::VARCHAR || '}' AS json FROM r""")
def r5_result_envelope(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return caps.result_envelope(caps.cap_rows(df, ["c_custkey"]), ["c_custkey"])
