"""Policy operators over rules that are derived from the star schema, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from guardframe.scratch import shared_folder
from guardframe.sources import policy as P
from guardframe.plans.token_queries import read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Paths of one to four parts, some empty, in mixed case; a connection for every segment. Both engines read this.
_SEGMENTS = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"
_CONN = f"element_at(array({_SEGMENTS[1:-1]}), cast(o_custkey % 5 + 1 as int)) conn"
_PATHS = """SELECT c_mktsegment AS conn, CASE c_custkey % 6 WHEN 0 THEN 'T' || (c_nationkey % 3) || '.Col' || (c_custkey % 4) WHEN 1 THEN 's' || (c_custkey % 3) || '.t' || (c_nationkey % 3) || '.COL' || (c_custkey % 4)
  WHEN 2 THEN 'S2.t1.col' || (c_custkey % 5) WHEN 3 THEN 'f' || (c_custkey % 7) WHEN 4 THEN 'a..b' ELSE 'a.b.c.d' END AS path FROM customer"""
_RULES = """SELECT conn, s[len(s) - 1] AS "table", s[len(s)] AS col, list_sort(coalesce(list(DISTINCT s[1]) FILTER (len(s) = 3), [])) AS schemas, bool_or(len(s) = 2) AS is_global
FROM (SELECT conn, string_split(lower(path), '.') AS s FROM paths) WHERE len(s) IN (2, 3) AND NOT list_contains(s, '') GROUP BY ALL"""
_FRULES = """SELECT conn, s[len(s)] AS name, list_sort(coalesce(list(DISTINCT s[1]) FILTER (len(s) = 2), [])) AS schemas, bool_or(len(s) = 1) AS is_global
FROM (SELECT conn, string_split(lower(path), '.') AS s FROM paths) WHERE len(s) IN (1, 2) AND NOT list_contains(s, '') GROUP BY ALL"""


def _paths(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.expr("c_mktsegment conn"), F.expr(_PATHS.split("AS conn, ")[1].split(" AS path")[0]).alias("path"))


@query("WITH p AS (" + _PATHS + "), c AS (SELECT conn, count(*) AS n FROM p GROUP BY conn) SELECT conn, 5000::BIGINT AS statement_timeout_ms, CASE WHEN n % 2 = 0 THEN n ELSE 200 END::BIGINT AS max_rows, CASE WHEN n % 3 = 0 THEN n * 1024 ELSE 2048 END::BIGINT AS max_payload_bytes, n % 5 <> 0 AS read_only, 'pseudonymize' AS mode, CASE WHEN n % 7 < 4 THEN 'deterministic' ELSE 'randomized' END AS strategy FROM c")
def p4_effective_policy(spark, sf_dir):
    n = _paths(spark, sf_dir).groupBy("conn").agg(F.count("*").alias("n"))
    kind = P._POLICY
    own = """named_struct('readOnly', if(n % 5 = 0, 'no unsafe', null), 'statementTimeoutMs', null, 'maxRows', if(n % 2 = 0, n, null), 'maxPayloadKiloBytes', if(n % 3 = 0, n, null), 'columnPolicy', named_struct('mode', null, 'strategy', if(n % 7 < 4, 'deterministic', null)))"""
    whole = "named_struct('readOnly', null, 'statementTimeoutMs', null, 'maxRows', null, 'maxPayloadKiloBytes', 2, 'columnPolicy', null)"
    return P.effective_policy(n.select("conn", F.expr(own).cast(kind).alias("own"), F.expr(whole).cast(kind).alias("global")))


@query(f"WITH paths AS ({_PATHS}) {_RULES}")
def p2_normalize_column_rules(spark, sf_dir):
    return P.normalize_column_rules(_paths(spark, sf_dir))


@query(f"WITH paths AS ({_PATHS}) {_FRULES}")
def p3_normalize_function_rules(spark, sf_dir):
    return P.normalize_function_rules(_paths(spark, sf_dir))


_COLUMNS = f"SELECT o_orderkey, {_SEGMENTS}[o_custkey % 5 + 1] AS conn, CASE WHEN o_orderkey % 3 > 0 THEN 'S' || (o_custkey % 4) END AS \"schema\", 't' || (o_orderkey % 4) AS \"table\", 'col' || (o_custkey % 6) AS \"column\" FROM orders"


@query(f"""WITH paths AS ({_PATHS}), r AS ({_RULES}), c AS ({_COLUMNS})
SELECT c.*, is_global IS NOT NULL AND coalesce(is_global OR "schema" IS NULL OR list_contains(schemas, lower("schema")), false) AS sensitive, lower(concat_ws('.', "schema", c."table", "column")) AS col_id
FROM c LEFT JOIN r ON r.conn = c.conn AND r."table" = c."table" AND r.col = c."column" """)
def p6_classify_columns(spark, sf_dir):
    rules = P.normalize_column_rules(_paths(spark, sf_dir))
    columns = read(spark, sf_dir, "orders").selectExpr("o_orderkey", _CONN, "if(o_orderkey % 3 > 0, concat('S', o_custkey % 4), null) schema", "concat('t', o_orderkey % 4) table", "concat('col', o_custkey % 6) column")
    return P.classify_columns(columns, rules)


@query(f"""WITH paths AS (SELECT * FROM ({_PATHS}) WHERE path NOT LIKE '%.%.%'), r AS ({_FRULES}),
c AS (SELECT o_orderkey, {_SEGMENTS}[o_custkey % 5 + 1] AS conn, CASE WHEN o_orderkey % 3 > 0 THEN 'T' || (o_custkey % 4) END AS "schema", CASE o_orderkey % 3 WHEN 0 THEN 'F' || (o_custkey % 9) WHEN 1 THEN 'col' || (o_custkey % 5) ELSE o_orderpriority END AS name FROM orders)
SELECT c.*, lower(c.name) = '1-urgent' OR coalesce(is_global OR list_contains(schemas, lower("schema")), false) AS safe FROM c LEFT JOIN r ON r.conn = c.conn AND r.name = lower(c.name)""")
def p8_classify_functions(spark, sf_dir):
    rules = P.normalize_function_rules(_paths(spark, sf_dir).where("path not like '%.%.%'"))
    calls = read(spark, sf_dir, "orders").selectExpr("o_orderkey", _CONN, "if(o_orderkey % 3 > 0, concat('T', o_custkey % 4), null) schema", "case o_orderkey % 3 when 0 then concat('F', o_custkey % 9) when 1 then concat('col', o_custkey % 5) else o_orderpriority end name")
    builtin = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_orderpriority name").distinct()
    return P.classify_functions(calls, builtin, rules)


@query("""WITH v AS (SELECT * FROM (SELECT 'c_custkey' AS "column", 'bigint' AS "type" UNION ALL SELECT 'c_name', 'string' UNION ALL SELECT 'c_nationkey', 'int' UNION ALL SELECT 'c_acctbal', 'double' UNION ALL SELECT 'c_mktsegment', 'string'))
SELECT "column", "type", true AS nullable, "column" LIKE 'c_a%' OR "column" LIKE 'c_m%' AS sensitive FROM v""")
def p7_describe_table(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    rules = spark.createDataFrame([("tpch", "Customer.C_acctbal"), ("tpch", "customer.c_mktsegment")], "conn string, path string")
    return P.describe_table(customer, P.normalize_column_rules(rules), "customer")


@query("""SELECT c_name AS role, NOT (c_custkey % 11 = 0 OR c_custkey % 13 = 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS is_safe FROM customer""")
def p9_audit_read_only_roles(spark, sf_dir):
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    roles = customer.selectExpr("c_name role", "c_custkey % 11 = 0 super", "c_custkey % 13 = 0 createdb", "false createrole", "cast(null as boolean) replication", "false bypassrls")
    grants = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr("c_name role", "if(o_orderstatus = 'F', 'delete', 'select') privilege", "if(o_orderpriority = '1-URGENT', 'table', 'view') kind")
    return P.audit_read_only_roles(roles, grants)


_SNAPSHOTS = """new AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN c_name || '-new' ELSE c_name END AS k, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS f, c_nationkey AS i, c_custkey % 90 AS j FROM customer WHERE c_custkey % 11 <> 1),
old AS (SELECT c_name AS k, c_acctbal AS f, c_nationkey AS i, c_custkey % 90 AS j FROM customer WHERE c_custkey % 13 <> 1)"""


@query(f"""WITH {_SNAPSHOTS}, m AS (SELECT n.k AS nk, n.f AS nf, n.i AS ni, n.j AS nj, o.k AS ok, o.f AS of_, o.i AS oi, o.j AS oj FROM new n FULL JOIN old o ON n.k = o.k),
nw AS (SELECT nk, ni, nj, count(*) OVER (PARTITION BY ni, nj) AS c FROM m WHERE ok IS NULL), gn AS (SELECT ok, oi, oj, count(*) OVER (PARTITION BY oi, oj) AS c FROM m WHERE nk IS NULL),
pr AS (SELECT nk, ok FROM nw JOIN gn ON ni = oi AND nj = oj AND nw.c = 1 AND gn.c = 1)
SELECT nk AS key, CASE WHEN nf = of_ AND ni = oi AND nj = oj THEN 'KEEP' ELSE 'CHANGED' END AS action, ok AS old_key FROM m WHERE nk IS NOT NULL AND ok IS NOT NULL
UNION ALL SELECT nk, 'RENAME', ok FROM pr UNION ALL SELECT nk, 'NEW', NULL FROM nw WHERE nk NOT IN (SELECT nk FROM pr) UNION ALL SELECT NULL, 'REMOVED', ok FROM gn WHERE ok NOT IN (SELECT ok FROM pr)""")
def p10_snapshot_diff(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    new = c.where("c_custkey % 11 <> 1").selectExpr("if(c_custkey % 7 = 0, concat(c_name, '-new'), c_name) k", "c_acctbal + if(c_custkey % 5 = 0, 1, 0) f", "c_nationkey i", "c_custkey % 90 j")
    old = c.where("c_custkey % 13 <> 1").selectExpr("c_name k", "c_acctbal f", "c_nationkey i", "c_custkey % 90 j")
    return P.snapshot_diff_with_rename(new, old, "k", ["f", "i", "j"], ["i", "j"])


_VERSIONS = """SELECT s AS version, c_name || '-' || CASE WHEN s + c_custkey % 7 >= 4 THEN 'b' ELSE 'a' END AS k, c_acctbal + CASE WHEN c_custkey % 5 = s THEN 1 ELSE 0 END AS f, c_nationkey AS i, c_custkey % 90 AS j"""


@query(f"""WITH RECURSIVE snap AS ({_VERSIONS} FROM customer, (SELECT unnest([0, 1, 2, 3, 4]) AS s) WHERE (c_custkey + 3 * s) % 11 <> 1),
prev AS (SELECT version + 1 AS version, k, i, j FROM snap WHERE version < 4),
fresh AS (SELECT n.*, count(*) OVER (PARTITION BY version, i, j) AS c FROM snap n ANTI JOIN prev USING (version, k) WHERE version > 0),
gone AS (SELECT o.*, count(*) OVER (PARTITION BY version, i, j) AS c FROM prev o ANTI JOIN snap USING (version, k)),
ptr AS (SELECT version, k, k AS up FROM snap JOIN prev USING (version, k) UNION ALL SELECT f.version, f.k, g.k FROM fresh f JOIN gone g ON f.version = g.version AND f.i = g.i AND f.j = g.j AND f.c = 1 AND g.c = 1),
ent AS (SELECT version, k, version AS v0, k AS k0 FROM snap ANTI JOIN ptr USING (version, k) UNION ALL SELECT p.version, p.k, e.v0, e.k0 FROM ent e JOIN ptr p ON p.version = e.version + 1 AND p.up = e.k),
h AS (SELECT ent.*, f, lag(ent.k) OVER w IS DISTINCT FROM ent.k OR lag(f) OVER w IS DISTINCT FROM f AS new FROM ent JOIN snap USING (version, k) WINDOW w AS (PARTITION BY v0, k0 ORDER BY version)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY v0, k0 ORDER BY version) AS span FROM h)
SELECT v0::BIGINT AS first_version, k0 AS first_key, k, any_value(f) AS f, min(version)::BIGINT AS from_version, CASE WHEN max(version) < 4 THEN max(version) + 1 END::BIGINT AS to_version FROM g GROUP BY v0, k0, span, k""")
def p10_snapshot_history(spark, sf_dir):
    """Five snapshots of customers that come, go, change and are renamed."""
    c = read(spark, sf_dir, "customer").withColumn("s", F.explode(F.array(*map(F.lit, range(5))))).where("(c_custkey + 3 * s) % 11 <> 1")
    c = c.selectExpr(*(x.strip() for x in _VERSIONS.removeprefix("SELECT ").split(", ")))
    return P.snapshot_history(c, "version", "k", ["f"], ["i", "j"])


@query("SELECT c_name AS path, '$.databases[' || i || ']' AS json_path, rule, v AS value FROM customer, (SELECT 0 AS i, 'port' AS rule UNION ALL SELECT 1, 'strategy' UNION ALL SELECT 1, 'path') r, (SELECT 1) x, LATERAL (SELECT CASE rule WHEN 'port' THEN (c_custkey * 1000)::VARCHAR WHEN 'strategy' THEN c_name ELSE c_name || '.' END AS v) y WHERE rule <> 'port' OR c_custkey * 1000 > 65535")
def p5_audit_policy_config(spark, sf_dir):
    config = """concat('{"version":"1.0","databases":[{"type":"postgres","connectionName":"a","port":', c_custkey * 1000, '},{"type":"postgres","connectionName":"b","safetyPolicy":{"columnPolicy":{"strategy":"', c_name, '"}},"sensitiveColumns":["t.c","', c_name, '."]}]}')"""
    return P.audit_policy_config(read(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.expr(config).alias("json")))


@query("SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_nationkey = 3")
def p11_table_source(spark, sf_dir):
    return P.table_source(spark, f"{sf_dir}/customer.parquet", "c").where("c.c_nationkey = 3").select("c.c_custkey", "c.c_name")


_FILE = """concat('{"version":"1.0","databases":[{"type":"postgres","connectionName":"', c_name, '","port":', 1000 + c_custkey % 60000, ',"safetyPolicy":{"maxRows":', 1 + c_custkey % 500, '},"sensitiveColumns":["t', c_nationkey, '.Col"]}]}')"""


@query("SELECT c_name AS conn, 'postgres' AS type, (1000 + c_custkey % 60000)::INTEGER AS port, (1 + c_custkey % 500)::BIGINT AS max_rows, 't' || c_nationkey AS \"table\", 'col' AS col FROM customer")
def p1_load_policy(spark, sf_dir):
    """A file of configurations, one for each customer, written and loaded."""
    folder = f"{shared_folder(spark)}/policies-{uuid.uuid4().hex}"
    read(spark, sf_dir, "customer").select(F.expr(_FILE).alias("value")).write.text(folder)
    found = P.load_policy(spark, folder, lines=True)
    rules = found.column_rules.select("conn", "table", "col")
    return found.connections.select("conn", "type", F.col("port").cast("int").alias("port"), "max_rows").join(rules, "conn")
