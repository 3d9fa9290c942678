"""Audit rules over a query log that is derived from the orders, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from guardframe.operators import audit as A
from guardframe.plans.token_queries import read
from guardframe.scratch import shared_folder
from guardframe.sources.policy import normalize_column_rules, normalize_function_rules
from guardframe.streaming.verdicts import as_facts, verdict_stream

#: Queries of a part of the log.
QUERIES = 20_000

Q: dict = {}
SQL: dict[str, str] = {}

# The log: each order stands for a query whose form follows from its keys. Both engines
# read this text; LIST( is either engine's array.
_BLOCKS = """SELECT k AS query_id, 0 AS block_id, CAST(NULL AS INT) AS parent_block_id, 'main' AS scope, k % 17 = 0 AS has_star, k % 7 = 0 AS has_distinct, k % 13 = 0 AS has_offset,
  CASE k % 4 WHEN 0 THEN -1 WHEN 1 THEN 500 ELSE 100 END AS limit_value, CASE WHEN k % 101 = 0 THEN 'parse_fail' WHEN k % 97 = 0 THEN 'unsupported' ELSE 'ok' END AS status FROM o
UNION ALL SELECT k, 1, 0, 'nested', k % 19 = 0, false, false, CASE WHEN k % 3 = 0 THEN -1 ELSE 50 END, 'ok' FROM o WHERE k % 5 = 0
UNION ALL SELECT k, 2, 0, 'nested', k % 25 = 0, k % 10 = 0, false, -1, 'ok' FROM o WHERE k % 15 = 0
UNION ALL SELECT k, 3, 0, 'nested', false, k % 4 = 1, k % 4 = 2, 20, 'ok' FROM o WHERE k % 33 = 0"""
_RANGES = """SELECT k AS query_id, 0 AS block_id, 0 AS pos, 'base' AS kind, CASE WHEN c % 3 = 0 THEN 'private' END AS SCHEMA_, 't' || (c % 4) AS TABLE_, CASE WHEN k % 23 = 0 THEN '' ELSE 'a' END AS alias, CAST(NULL AS STRING) AS join_kind FROM o
UNION ALL SELECT k, 0, 1, 'base', CAST(NULL AS STRING), 'u' || (c % 3), 'b', CASE WHEN k % 6 = 0 THEN 'left' ELSE 'inner' END FROM o WHERE k % 2 = 0
UNION ALL SELECT k, 0, 2, 'derived', CAST(NULL AS STRING), CAST(NULL AS STRING), 'd', 'inner' FROM o WHERE k % 5 = 0
UNION ALL SELECT k, 1, 0, 'base', CAST(NULL AS STRING), 't' || (c % 4), 'x', CAST(NULL AS STRING) FROM o WHERE k % 5 = 0
UNION ALL SELECT k, 2, 0, 'base', CAST(NULL AS STRING), 't9', CASE WHEN k % 45 = 0 THEN '' ELSE 'y' END, CAST(NULL AS STRING) FROM o WHERE k % 15 = 0
UNION ALL SELECT k, 3, 0, 'base', CAST(NULL AS STRING), 't8', 'z', CAST(NULL AS STRING) FROM o WHERE k % 33 = 0"""


def _node(where, block, clause, item, node, path, kind, qualifier="NULL", column="NULL", schema="NULL", name="NULL", param="NULL", nested="NULL"):
    text = lambda x: f"CAST({x} AS STRING)"
    fields = {
        "query_id": "k", "block_id": block, "clause": f"'{clause}'", "item": item, "node_id": node, "path": f"CAST(LIST({path}) AS INTS)", "kind": kind, "qualifier": text(qualifier),
        "COLUMN_": text(column), "func_schema": text(schema), "func_name": text(name), "param_index": f"CAST({param} AS INT)", "nested_block_id": f"CAST({nested} AS INT)",
    }
    return where, fields


_NODE_FORMS = (
    [
        _node("true", 0, "select", 0, 1, "", "'column'", "'a'", "'col' || (c % 5)"),
        _node("k % 3 = 0", 0, "select", 1, 2, "", "'call'", schema="CASE WHEN k % 2 = 0 THEN 's1' END", name="'f' || (c % 6)"),
        _node("k % 3 = 0", 0, "select", 1, 3, "2", "'column'", "'b'", "'col' || (k % 4)"),
        _node("true", 0, "where", 0, 10, "", "CASE WHEN k % 10 = 3 THEN 'in' ELSE '=' END"),
        _node("true", 0, "where", 0, 11, "10", "CASE WHEN k % 43 = 0 THEN 'cast' ELSE 'column' END", "'a'", "'col' || (c % 5)"),
        _node("k % 43 = 0", 0, "where", 0, 12, "10, 11", "'column'", "'a'", "'col' || (c % 5)"),
        _node("true", 0, "where", 0, 13, "10", "CASE WHEN k % 2 = 0 THEN 'param' ELSE 'literal' END", param="CASE WHEN k % 2 = 0 THEN 1 + k % 3 END"),
        _node("k % 10 = 3", 0, "where", 0, 14, "10", "CASE k % 3 WHEN 0 THEN 'literal' WHEN 1 THEN 'param' ELSE 'column' END", "CASE WHEN k % 3 = 2 THEN 'a' END", "'col1'", param="CASE WHEN k % 3 = 1 THEN 2 END"),
        _node("k % 8 = 0", 0, "where", 1, 20, "", "'or'"),
        _node("k % 8 = 0", 0, "where", 1, 21, "20", "'like'"),
        _node("k % 8 = 0", 0, "where", 1, 22, "20, 21", "'column'", "'a'", "'note'"),
        _node("k % 24 = 0", 0, "where", 1, 23, "20", "'param'", param="1"),
        _node("k % 2 = 0", 0, "on", 1, 30, "", "CASE WHEN k % 14 = 0 THEN '<' WHEN k % 22 = 0 THEN 'literal' ELSE '=' END"),
        _node("k % 2 = 0", 0, "on", 1, 31, "30", "'column'", "'a'", "'id'"),
        _node("k % 2 = 0", 0, "on", 1, 32, "30", "CASE WHEN k % 18 = 0 THEN 'call' ELSE 'column' END", "'b'", "'col' || (c % 5)", name="CASE WHEN k % 18 = 0 THEN 'f2' END"),
        _node("k % 9 = 0", 0, "order", 0, 40, "", "'column'", "'a'", "'col' || (c % 5)"),
        _node("k % 12 = 0", 0, "group", 0, 41, "", "'column'", "CASE WHEN k % 24 = 0 THEN 'zz' ELSE 't' || (c % 4) END", "'col1'"),
        _node("k % 5 = 0", 1, "select", 0, 50, "", "'column'", "'x'", "'col1'"),
        _node("k % 89 = 0", 0, "select", 2, 60, "", "'unsupported'"),
        _node("k % 29 = 0", 0, "select", 3, 70, "", "'param'", param="1"),
        _node("k % 31 = 0", 0, "where", 2, 80, "", "'call'", name="'f1'"),
        _node("k % 31 = 0", 0, "where", 2, 81, "80", "CASE WHEN k % 62 = 0 THEN 'param' ELSE 'column' END", "'a'", "'col' || (c % 5)", param="CASE WHEN k % 62 = 0 THEN 2 END"),
        _node("k % 37 = 0", 0, "where", 3, 85, "", "'not null'"),
        _node("k % 37 = 0", 0, "where", 3, 86, "85", "'column'", "'a'", "'note'"),
        _node("k % 7 = 2", 0, "where", 4, 90, "", "'and'"),
        _node("k % 7 = 2", 0, "where", 4, 91, "90", "'='"),
        _node("k % 7 = 2", 0, "where", 4, 92, "90, 91", "'param'", param="2"),
        _node("k % 7 = 2", 0, "where", 4, 93, "90, 91", "'column'", "'a'", "'col' || (c % 5)"),
        _node("k % 15 = 0", 0, "where", 5, 100, "", "'='"),
        _node("k % 15 = 0", 0, "where", 5, 101, "100", "'column'", "'a'", "'id'"),
        _node("k % 15 = 0", 0, "where", 5, 102, "100", "'subquery'", nested="2"),
        _node("k % 33 = 0", 0, "where", 6, 110, "", "'subquery'", nested="3"),
        _node("k % 33 = 0", 3, "select", 0, 120, "", "'column'", "CASE WHEN k % 66 = 0 THEN 'z' ELSE 'a' END", "'id'"),
        _node("k % 15 = 0", 2, "select", 0, 130, "", "'window'", name="'f' || (c % 6)"),
    ]
)
_NODES = "\nUNION ALL ".join(f"SELECT {', '.join(f'{e} AS {n}' for n, e in fields.items())} FROM o WHERE {where}" for where, fields in _NODE_FORMS)
_PARAMS = """SELECT k AS query_id, 1 AS idx, CASE WHEN c % 2 = 0 THEN 't' || (c % 4) || '.col' || (c % 5) ELSE 'private.t0.col0' END AS col_id FROM o WHERE k % 2 = 0
UNION ALL SELECT k, 2, CASE WHEN c % 7 = 0 THEN '' ELSE 't' || (c % 4) || '.col' || (c % 5) END FROM o WHERE k % 10 = 0 OR k % 7 = 2"""
#: Rules, as paths of columns and functions, and the built-in function.
_COLUMN_PATHS = ("t1.col1", "t2.col3", "private.t0.col0", "u1.col2", "t3.col1", "private.t3.col4")
_FUNCTION_PATHS, _BUILTIN = ("f2", "s1.f3"), "f4"


def _spark_text(sql: str) -> str:
    for a, b in (("LIST(", "array("), ("INTS", "array<int>"), ("SCHEMA_", "`schema`"), ("TABLE_", "`table`"), ("COLUMN_", "`column`")):
        sql = sql.replace(a, b)
    return sql


def _facts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_custkey c")
    # dealt by query first, so that facts need not be; parts hold so many queries at any size of the log
    o = o.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-o.count() // QUERIES)), "k")
    blocks, ranges, params = (spark.sql(_spark_text(text).replace("FROM o", "FROM {o}"), o=o) for text in (_BLOCKS, _RANGES, _PARAMS))
    # all nodes of a query from one row, in one scan
    made = [f"if({where}, named_struct({', '.join(f"'{n}', {e}" for n, e in fields.items() if n != "query_id")}), null)" for where, fields in _NODE_FORMS]
    nodes = o.selectExpr("k AS query_id", _spark_text(f"inline(filter(array({', '.join(made)}), n -> n is not null))").replace("'`column`'", "'column'", 1).replace("'`column`',", "'column',"))
    return [blocks, ranges, nodes, params]


def _rules(spark):
    rows = lambda paths: spark.createDataFrame([("tpch", p) for p in paths], "conn string, path string")
    return normalize_column_rules(rows(_COLUMN_PATHS)), spark.createDataFrame([(_BUILTIN,)], "name string"), normalize_function_rules(rows(_FUNCTION_PATHS))


def a27_all_violations(spark, sf_dir):
    return A.all_violations(*_facts(spark, sf_dir), *_rules(spark), conn="tpch")


def a26_first_verdict(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return A.first_verdict(facts[0], A.all_violations(*facts, *_rules(spark), conn="tpch", order=True))


def a26_verdict_stream(spark, sf_dir):
    """First verdicts by a stream over the facts: two thirds of each query's come first, the rest when the stream is started again."""
    at = f"{shared_folder(spark)}/verdicts-{uuid.uuid4().hex}"
    facts = _facts(spark, sf_dir)
    times = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    # facts stay as they are dealt; a part of times is as large as the queries of a part
    timed = [f.join(times.hint("shuffle_hash"), "query_id") for f in facts]
    no_counts = times.withColumn("expected", F.lit(0)).limit(0)
    made = as_facts(no_counts, *timed)
    made.withColumn("later", F.pmod(F.xxhash64("body"), F.lit(3)) == 0).write.partitionBy("later").parquet(f"{at}/all")
    # counted from what is written, so facts are made once; a count has no body
    schema = made.schema
    counts = spark.read.parquet(f"{at}/all").groupBy("query_id", "ts").agg(F.count("*").alias("expected"))
    as_facts(counts, *[t.limit(0) for t in timed]).withColumn("later", F.pmod(F.xxhash64("body"), F.lit(3)) == 0).write.mode("append").partitionBy("later").parquet(f"{at}/all")
    for part in ("false", "true"):
        spark.read.parquet(f"{at}/all/later={part}").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        verdict_stream(stream, *_rules(spark), f"{at}/out", f"{at}/state", "tpch", "4000 days").awaitTermination()
    return spark.read.parquet(f"{at}/out/verdicts").select("query_id", "code")


def a28_audit_summary(spark, sf_dir):
    log = read(spark, sf_dir, "orders").selectExpr("o_orderkey query_id", "o_orderpriority conn", "year(o_orderdate) day")
    return A.audit_summary(log, a26_first_verdict(spark, sf_dir))


def a4_extract_touches(spark, sf_dir):
    blocks, ranges, nodes, _ = _facts(spark, sf_dir)
    touches = A.extract_touches(blocks, ranges, nodes, _rules(spark)[0], "tpch")
    return touches.select("query_id", "block_id", "node_id", "scope", "kind", "by_name", "col_id", "sensitive")


def a8_sensitive_mode(spark, sf_dir):
    blocks, ranges, nodes, _ = _facts(spark, sf_dir)
    return A.sensitive_mode(A.extract_touches(blocks, ranges, nodes, _rules(spark)[0]))


def _duck_text(sql: str) -> str:
    for a, b in (("LIST(", "list_value("), ("INTS", "INTEGER[]"), ("SCHEMA_", '"schema"'), ("TABLE_", '"table"'), ("COLUMN_", '"column"')):
        sql = sql.replace(a, b)
    return sql


def _rule_rows(paths):
    parts = [p.split(".") for p in paths]
    return ", ".join(f"({'NULL' if len(p) == 2 else repr(p[0])}, '{p[-2]}', '{p[-1]}')" for p in parts)


_KEYS = "query_id, block_id, clause, item"
_CTES = _duck_text(f"""WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey AS c, * FROM orders), blocks AS ({_BLOCKS}), ranges AS ({_RANGES}), nodes AS ({_NODES}), params AS ({_PARAMS}),
rules(s, t, c) AS (VALUES {_rule_rows(_COLUMN_PATHS)}),
words AS (SELECT query_id, block_id, pos, kind, TABLE_, SCHEMA_, alias AS word, false AS by_name FROM ranges WHERE alias <> '' UNION ALL SELECT query_id, block_id, pos, kind, TABLE_, SCHEMA_, TABLE_, true FROM ranges WHERE TABLE_ IS NOT NULL),
best AS (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY query_id, block_id, word ORDER BY by_name, pos) = 1),
touches AS (SELECT n.query_id, n.block_id, n.clause, n.item, n.node_id, n.path, b.scope, coalesce(w.kind, 'unknown') AS kind, coalesce(w.by_name, false) AS by_name,
  CASE WHEN w.kind = 'base' THEN concat_ws('.', w.SCHEMA_, w.TABLE_, n.COLUMN_) END AS col_id,
  coalesce(w.kind = 'base', false) AND EXISTS (SELECT 1 FROM rules r WHERE r.t = w.TABLE_ AND r.c = n.COLUMN_ AND (r.s IS NULL OR w.SCHEMA_ IS NULL OR r.s = w.SCHEMA_)) AS sensitive
  FROM nodes n JOIN blocks b USING (query_id, block_id) LEFT JOIN best w ON w.query_id = n.query_id AND w.block_id = n.block_id AND w.word = n.qualifier WHERE n.kind = 'column'),
mode AS (SELECT DISTINCT query_id FROM touches WHERE sensitive)""").replace("STRING", "VARCHAR")

# The rules as they are stated: what may stand where, clause by clause. A predicate is a node with nothing but AND
# above it; a term has nothing but AND, OR and NOT above it. `at` sorts as a reader of the query meets the faults.
_RULE_SQL = """
chain AS (SELECT n.query_id, n.block_id, n.clause, n.item, n.node_id, list(p.kind ORDER BY p.node_id) AS above, list(p.node_id ORDER BY p.node_id) FILTER (p.kind NOT IN ('and', 'or', 'not')) AS solid
  FROM nodes n JOIN nodes p USING (query_id, block_id, clause, item) WHERE list_contains(n.path, p.node_id) GROUP BY ALL),
inside AS (SELECT DISTINCT query_id, block_id, clause, item, unnest(list_append(path, node_id)) AS node_id FROM touches WHERE sensitive),
node AS (SELECT n.query_id, n.block_id, n.clause, n.item, n.node_id, n.path, n.kind, n.param_index, n.nested_block_id, n.func_schema, n.func_name, n.path[-1] AS up,
  len(list_filter(coalesce(c.above, []), lambda x: x <> 'and')) = 0 AS predicate, len(list_filter(coalesce(c.above, []), lambda x: x NOT IN ('and', 'or', 'not'))) = 0 AS term,
  c.solid[1] AS outer_id, i.node_id IS NOT NULL AS holds, coalesce(t.sensitive, false) AS sensitive, t.col_id
  FROM nodes n LEFT JOIN chain c USING (query_id, block_id, clause, item, node_id) LEFT JOIN inside i USING (query_id, block_id, clause, item, node_id) LEFT JOIN touches t USING (query_id, block_id, clause, item, node_id)),
pair AS (SELECT a.*, b.node_id AS other_id, b.kind AS other_kind, b.holds AS other_holds, b.sensitive AS other_sensitive, b.col_id AS other_col, p.kind AS op, p.predicate AS op_predicate, p.term AS op_term,
  min(least(a.node_id, b.node_id)) OVER (PARTITION BY a.query_id, a.block_id, a.clause, a.item, a.up) AS head
  FROM node a JOIN node b ON a.query_id = b.query_id AND a.block_id = b.block_id AND a.clause = b.clause AND a.item = b.item AND a.up = b.up AND a.node_id <> b.node_id
  JOIN node p ON p.query_id = a.query_id AND p.block_id = a.block_id AND p.clause = a.clause AND p.item = a.item AND p.node_id = a.up),
operand AS (SELECT n.*, p.kind AS op, p.predicate AS op_predicate FROM node n JOIN node p ON p.query_id = n.query_id AND p.block_id = n.block_id AND p.clause = n.clause AND p.item = n.item AND p.node_id = n.up),
bound AS (SELECT query_id, block_id, item, up, node_id, param_index, other_col AS col_id FROM pair
  WHERE clause = 'where' AND kind = 'param' AND op_predicate AND other_sensitive AND (op = '=' OR op = 'in' AND other_id = head)),
place AS (SELECT query_id, block_id, CAST([] AS INTEGER[]) AS t, CAST([] AS INTEGER[]) AS a, CAST([] AS INTEGER[]) AS b FROM blocks WHERE parent_block_id IS NULL
  UNION ALL SELECT c.query_id, c.block_id,
    place.t || CASE WHEN l.clause IS NULL THEN [0, c.block_id] ELSE [CASE l.clause WHEN 'on' THEN 1 WHEN 'select' THEN 2 WHEN 'where' THEN 3 WHEN 'group' THEN 4 WHEN 'having' THEN 5 ELSE 6 END, l.item, l.node_id] END,
    place.a || CASE WHEN l.clause IS NULL THEN [7, c.block_id] WHEN l.clause = 'where' THEN [2, 2, l.item, l.node_id] ELSE [CASE l.clause WHEN 'select' THEN 1 WHEN 'group' THEN 3 WHEN 'having' THEN 4 WHEN 'order' THEN 5 ELSE 6 END, l.item, 2, l.node_id] END,
    CASE WHEN place.b IS NULL THEN NULL WHEN l.clause IS NULL THEN list_concat(place.b, [7, c.block_id]) WHEN l.clause = 'where' AND l.predicate THEN list_concat(place.b, [2, l.item, l.node_id])
      WHEN l.clause IN ('select', 'group', 'having', 'order') THEN list_concat(place.b, [CASE l.clause WHEN 'select' THEN 3 WHEN 'group' THEN 4 WHEN 'having' THEN 5 ELSE 6 END, l.item, 1, l.node_id]) END
  FROM place JOIN blocks c ON c.query_id = place.query_id AND c.parent_block_id = place.block_id LEFT JOIN node l ON l.query_id = c.query_id AND l.nested_block_id = c.block_id),
always AS (
  SELECT query_id, 'PARSE_FAIL' AS rule, [0, 0] AS met FROM blocks WHERE status = 'parse_fail'
  UNION ALL SELECT query_id, 'UNSUPPORTED_QUERY', [0, 1] FROM blocks WHERE status = 'unsupported'
  UNION ALL SELECT query_id, 'STAR', [0, 2] FROM blocks WHERE has_star AND parent_block_id IS NULL
  UNION ALL SELECT query_id, 'UNSUPPORTED_EXPR', [0, 3] FROM nodes WHERE kind = 'unsupported'
  UNION ALL SELECT query_id, rule, list_concat([1], p.t, [CASE clause WHEN 'on' THEN 1 WHEN 'select' THEN 2 WHEN 'where' THEN 3 WHEN 'group' THEN 4 WHEN 'having' THEN 5 ELSE 6 END, item, node_id])
    FROM (SELECT *, 'NO_COLUMN_ALIAS' AS rule FROM touches WHERE kind = 'unknown' UNION ALL SELECT *, 'ANALYZE_FAIL' FROM touches WHERE by_name UNION ALL SELECT *, 'SENSITIVE_OUTSIDE_MAIN' FROM touches WHERE sensitive AND scope <> 'main') x JOIN place p USING (query_id, block_id)
  UNION ALL SELECT query_id, 'STAR_NESTED', list_concat([2], p.a, [0, 0]) FROM blocks JOIN place p USING (query_id, block_id) WHERE has_star AND parent_block_id IS NOT NULL
  UNION ALL SELECT query_id, 'NO_TABLE_ALIAS', list_concat([2], p.a, [0, 1, pos]) FROM ranges JOIN place p USING (query_id, block_id) WHERE alias = ''
  UNION ALL SELECT query_id, rule, list_concat([2], p.a, CASE clause WHEN 'where' THEN [2, step, item, node_id] ELSE [CASE clause WHEN 'select' THEN 1 WHEN 'group' THEN 3 WHEN 'having' THEN 4 WHEN 'order' THEN 5 ELSE 6 END, item, step, node_id] END)
    FROM (SELECT query_id, block_id, clause, item, node_id, 'FUNC_UNSAFE' AS rule, 0 AS step FROM nodes WHERE kind IN ('call', 'window') AND NOT (func_name IN ('f4', 'f2') OR coalesce(func_name = 'f3' AND func_schema = 's1', false))
      UNION ALL SELECT query_id, block_id, clause, item, node_id, 'PARAM_OUTSIDE_WHERE', 1 FROM node n WHERE kind = 'param' AND (clause <> 'where' OR term OR
        (SELECT m.kind FROM nodes m WHERE m.query_id = n.query_id AND m.block_id = n.block_id AND m.clause = n.clause AND m.item = n.item AND m.node_id = n.outer_id) IN ('call', 'cast', 'case', 'window'))
      UNION ALL SELECT query_id, block_id, clause, item, node_id, 'PARAM_NON_SENSITIVE', 1 FROM pair WHERE clause = 'where' AND kind = 'param' AND op_term AND NOT other_holds AND (op = '=' OR op = 'in' AND other_id = head)) x JOIN place p USING (query_id, block_id)
  UNION ALL SELECT query_id, 'PARAM_UNUSED', [4, idx] FROM params p WHERE NOT EXISTS (SELECT 1 FROM bound g WHERE g.query_id = p.query_id AND g.param_index = p.idx)),
later AS (
  SELECT query_id, block_id, 'DISTINCT_SENSITIVE' AS rule, [0, 1] AS here FROM blocks WHERE has_distinct
  UNION ALL SELECT query_id, block_id, 'OFFSET_SENSITIVE', [0, 2] FROM blocks WHERE has_offset
  UNION ALL SELECT query_id, block_id, 'LIMIT_REQUIRED', [0, 3] FROM blocks WHERE limit_value < 0
  UNION ALL SELECT query_id, block_id, 'LIMIT_EXCEEDS', [0, 3] FROM blocks WHERE limit_value > 200
  UNION ALL SELECT query_id, block_id, 'JOIN_NOT_INNER', [1, pos, 0] FROM ranges WHERE join_kind <> 'inner'
  UNION ALL SELECT query_id, block_id, 'JOIN_ON_INVALID', [1, item, 1, node_id, 0] FROM node WHERE clause = 'on' AND predicate AND kind NOT IN ('and', '=')
  UNION ALL SELECT query_id, block_id, 'JOIN_ON_INVALID', [1, item, 1, up, 0] FROM operand WHERE clause = 'on' AND op_predicate AND op = '=' AND kind NOT IN ('column', 'literal')
  UNION ALL SELECT query_id, block_id, 'JOIN_ON_SENSITIVE', [1, item, 1, coalesce(up, node_id), 1] FROM node WHERE clause = 'on' AND sensitive
  UNION ALL SELECT query_id, block_id, CASE WHEN kind IN ('or', 'not') THEN 'WHERE_NOT_CONJ' ELSE 'SENSITIVE_CMP' END, [2, item, node_id, CASE WHEN kind IN ('or', 'not') THEN 0 ELSE node_id END] FROM node WHERE clause = 'where' AND predicate AND kind NOT IN ('and', '=', 'in', 'subquery')
  UNION ALL SELECT query_id, block_id, 'SENSITIVE_CMP', [2, item, up, node_id] FROM pair WHERE clause = 'where' AND op_predicate AND sensitive AND other_kind <> 'param' AND (op = '=' OR op = 'in' AND node_id = head)
  UNION ALL SELECT query_id, block_id, 'SENSITIVE_CMP', [2, item, up, node_id] FROM pair WHERE clause = 'where' AND op_predicate AND op = 'in' AND node_id <> head AND holds
  UNION ALL SELECT query_id, block_id, 'SENSITIVE_LOC', [2, item, up, node_id] FROM pair WHERE clause = 'where' AND op_predicate AND (op = '=' OR op = 'in' AND node_id = head) AND holds AND kind <> 'column'
  UNION ALL SELECT g.query_id, block_id, CASE WHEN p.col_id = '' THEN 'PARAM_NO_SCOPE' ELSE 'PARAM_SCOPE_MISMATCH' END, [2, item, up, node_id]
    FROM bound g JOIN params p ON p.query_id = g.query_id AND p.idx = g.param_index WHERE p.col_id <> g.col_id
  UNION ALL SELECT query_id, block_id, 'PARAM_IDX_RANGE', [2, item, up, node_id] FROM bound g WHERE NOT EXISTS (SELECT 1 FROM params p WHERE p.query_id = g.query_id AND p.idx = g.param_index)
  UNION ALL SELECT query_id, block_id, 'SENSITIVE_SELECT_EXPR', [3, item, 0, node_id, 0] FROM node WHERE clause = 'select' AND sensitive AND up IS NOT NULL
  UNION ALL SELECT query_id, block_id, 'SENSITIVE_LOC', [CASE clause WHEN 'group' THEN 4 WHEN 'having' THEN 5 ELSE 6 END, item, 0, coalesce(up, node_id), node_id] FROM node WHERE clause IN ('group', 'having', 'order') AND sensitive),
faults AS (SELECT query_id, rule, met FROM always UNION ALL SELECT query_id, rule, list_concat([3], p.b, here) FROM later JOIN place p USING (query_id, block_id) WHERE p.b IS NOT NULL AND query_id IN (SELECT query_id FROM mode)),
violations AS (SELECT query_id, rule, CASE rule WHEN 'UNSUPPORTED_EXPR' THEN 'UNSUPPORTED_QUERY' WHEN 'STAR_NESTED' THEN 'STAR' WHEN 'PARAM_NO_SCOPE' THEN 'ANALYZE_FAIL' ELSE rule END AS code, min(met) AS met FROM faults GROUP BY ALL),
verdicts AS (SELECT b.query_id, coalesce(arg_min(v.code, (v.met, v.rule)), 'OK') AS code FROM (SELECT DISTINCT query_id FROM blocks) b LEFT JOIN violations v USING (query_id) GROUP BY b.query_id)"""

for _f, _sql in (
    (a4_extract_touches, f"{_CTES} SELECT query_id, block_id, node_id, scope, kind, by_name, col_id, sensitive FROM touches"),
    (a8_sensitive_mode, f"{_CTES} SELECT query_id FROM mode"),
    (a26_first_verdict, f"{_CTES},{_RULE_SQL} SELECT * FROM verdicts"),
    (a26_verdict_stream, f"{_CTES},{_RULE_SQL} SELECT * FROM verdicts"),
    (a27_all_violations, f"{_CTES},{_RULE_SQL} SELECT query_id, rule, code FROM violations"),
    (a28_audit_summary, f"{_CTES},{_RULE_SQL} SELECT o_orderpriority AS conn, code, year(o_orderdate)::INTEGER AS day, count(*) AS n FROM o JOIN verdicts ON k = query_id GROUP BY CUBE (1, 2, 3)"),
):
    Q[_f.__name__], SQL[_f.__name__] = _f, _sql

#: The rules of the inventory that are one filter each.
_NUMBERS = {
    "PARSE_FAIL": "a1", "UNSUPPORTED_EXPR": "a2", "STAR": "a3", "NO_COLUMN_ALIAS": "a5", "NO_TABLE_ALIAS": "a6", "ANALYZE_FAIL": "a7", "SENSITIVE_OUTSIDE_MAIN": "a9",
    "FUNC_UNSAFE": "a10", "PARAM_OUTSIDE_WHERE": "a11", "PARAM_NON_SENSITIVE": "a12", "DISTINCT_SENSITIVE": "a13", "OFFSET_SENSITIVE": "a14", "LIMIT_REQUIRED": "a15",
    "LIMIT_EXCEEDS": "a16", "JOIN_NOT_INNER": "a17", "JOIN_ON_INVALID": "a18", "JOIN_ON_SENSITIVE": "a19", "WHERE_NOT_CONJ": "a20", "SENSITIVE_CMP": "a21",
    "SENSITIVE_SELECT_EXPR": "a22", "SENSITIVE_LOC": "a23", "PARAM_IDX_RANGE": "a24_index", "PARAM_SCOPE_MISMATCH": "a24_scope", "PARAM_NO_SCOPE": "a24_metadata", "PARAM_UNUSED": "a25",
}


def _one(rule):
    return lambda spark, sf_dir: A.all_violations(*_facts(spark, sf_dir), *_rules(spark), rules=[rule], conn="tpch").select("query_id")


for _rule, _n in _NUMBERS.items():
    _name = f"{_n}_{_rule.lower()}"
    Q[_name], SQL[_name] = _one(_rule), f"{_CTES},{_RULE_SQL} SELECT query_id FROM violations WHERE rule = '{_rule}'"
