"""Each rule on a query that breaks it and on one that does not, written down by hand as facts."""

import pytest

from pyspark.sql import DataFrame

from guardframe.operators import audit as A
from guardframe.sources.policy import normalize_column_rules, normalize_function_rules

BLOCKS = "query_id long, block_id int, parent_block_id int, scope string, has_star boolean, has_distinct boolean, has_offset boolean, limit_value int, status string"
RANGES = "query_id long, block_id int, pos int, kind string, schema string, table string, alias string, join_kind string"
NODES = "query_id long, block_id int, clause string, item int, node_id int, path array<int>, kind string, qualifier string, column string, func_schema string, func_name string, param_index int, nested_block_id int"
PARAMS = "query_id long, idx int, col_id string"

col = lambda name, q="p": ("column", q, name)
MAIL, TOWN, ID = col("mail"), col("town"), col("id")
LIT, CALL = ("literal",), lambda f, *a: ("call", f, *a)
par = lambda n: ("param", n)
EQ, IN, AND, OR, NOT = (lambda *a, k=k: (k, *a) for k in ("=", "in", "and", "or", "not"))


def nodes_of(query, block, clause, item, tree, start):
    """Rows of an expression's nodes, numbered in reading order; a list as the last entry of a call says the block that it holds."""
    rows, number = [], [start]

    def visit(x, path):
        me = number[0]
        number[0] += 1
        kind, rest = x[0], x[1:]
        q = c = f = p = nested = None
        if kind == "column":
            q, c, rest = rest[0], rest[1], ()
        elif kind == "param":
            p, rest = rest[0], ()
        elif kind in ("call", "window"):
            f, rest = rest[0], rest[1:]
        elif kind == "subquery":
            nested, rest = rest[0], ()
        rows.append((query, block, clause, item, me, path, kind, q, c, None, f, p, nested))
        for child in rest:
            visit(child, [*path, me])

    visit(tree, [])
    return rows


def facts(spark, query, select=(MAIL,), where=None, on=None, join="inner", group=(), order=(), limit=10, distinct=False, offset=False, star=False, status="ok", params=(), nested=(), alias="p"):
    """One query over people p and, if joined, orders o; nested blocks as (id, where clause or None for FROM, limit)."""
    blocks = [(query, 0, None, "main", star, distinct, offset, limit, status)]
    ranges = [(query, 0, 0, "base", None, "people", alias, None)]
    nodes, n = [], 1
    if on is not None:
        ranges.append((query, 0, 1, "base", None, "orders", "o", join))
    for clause, items in (("select", select), ("where", [where] if where else []), ("group", group), ("order", order), ("on", [on] if on else [])):
        for k, tree in enumerate(items):
            nodes += nodes_of(query, 0, clause, 1 if clause == "on" else k, tree, n)
            n += 20
    for block, lim, tree in nested:
        blocks.append((query, block, 0, "nested", False, False, False, lim, "ok"))
        ranges.append((query, block, 0, "base", None, "people", "n", None))
        nodes += nodes_of(query, block, "select", 0, tree, n)
        n += 20
    return blocks, ranges, nodes, [(query, i + 1, c) for i, c in enumerate(params)]


M = "people.mail"
CASES = {
    # what passes
    "OK plain": (dict(select=[TOWN], where=OR(EQ(TOWN, LIT), ("like", TOWN, LIT)), limit=-1, distinct=True, offset=True), set(), "OK"),
    "OK token": (dict(where=AND(EQ(MAIL, par(1)), EQ(ID, LIT)), params=[M]), set(), "OK"),
    "OK token first": (dict(where=EQ(par(1), MAIL), params=[M]), set(), "OK"),
    "OK list": (dict(where=IN(MAIL, par(1), par(2)), params=[M, M]), set(), "OK"),
    "OK plain list": (dict(where=IN(ID, LIT, LIT)), set(), "OK"),
    "OK on": (dict(on=AND(EQ(ID, col("pid", "o")), EQ(col("kind", "o"), LIT))), set(), "OK"),
    "OK call in a comparison": (dict(select=[TOWN], where=EQ(CALL("f", TOWN), LIT)), set(), "OK"),
    # one fault each
    "list of literals": (dict(where=IN(MAIL, LIT, LIT)), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "mixed list": (dict(where=IN(MAIL, par(1), LIT), params=[M]), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "column in a list": (dict(where=IN(ID, LIT, MAIL)), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "wrapped column in a list": (dict(where=IN(ID, CALL("f", MAIL))), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "bare call": (dict(where=CALL("f", TOWN)), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "bare column": (dict(where=ID), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "plain like": (dict(where=AND(EQ(ID, LIT), ("like", TOWN, LIT))), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "literal": (dict(where=EQ(MAIL, LIT)), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "two columns": (dict(where=EQ(MAIL, TOWN)), {"SENSITIVE_CMP"}, "SENSITIVE_CMP"),
    "or": (dict(where=OR(EQ(ID, LIT), EQ(TOWN, LIT))), {"WHERE_NOT_CONJ"}, "WHERE_NOT_CONJ"),
    "not": (dict(where=AND(EQ(ID, LIT), NOT(EQ(TOWN, LIT)))), {"WHERE_NOT_CONJ"}, "WHERE_NOT_CONJ"),
    "wrapped": (dict(where=EQ(("cast", MAIL), LIT)), {"SENSITIVE_LOC"}, "SENSITIVE_LOC"),
    "wrapped head of a list": (dict(where=IN(CALL("f", MAIL), LIT)), {"SENSITIVE_LOC"}, "SENSITIVE_LOC"),
    "group": (dict(select=[TOWN], group=[MAIL]), {"SENSITIVE_LOC"}, "SENSITIVE_LOC"),
    "order": (dict(order=[MAIL]), {"SENSITIVE_LOC"}, "SENSITIVE_LOC"),
    "select": (dict(select=[CALL("f", MAIL)]), {"SENSITIVE_SELECT_EXPR"}, "SENSITIVE_SELECT_EXPR"),
    "window": (dict(select=[TOWN, ("window", "f", MAIL)]), {"SENSITIVE_SELECT_EXPR"}, "SENSITIVE_SELECT_EXPR"),
    "on less": (dict(on=("<", ID, col("pid", "o"))), {"JOIN_ON_INVALID"}, "JOIN_ON_INVALID"),
    "on column": (dict(on=col("flag", "o")), {"JOIN_ON_INVALID"}, "JOIN_ON_INVALID"),
    "on literal": (dict(on=LIT), {"JOIN_ON_INVALID"}, "JOIN_ON_INVALID"),
    "on call": (dict(on=EQ(CALL("f", TOWN), col("pid", "o"))), {"JOIN_ON_INVALID"}, "JOIN_ON_INVALID"),
    "on mail": (dict(on=EQ(MAIL, col("pid", "o"))), {"JOIN_ON_SENSITIVE"}, "JOIN_ON_SENSITIVE"),
    "left": (dict(on=EQ(ID, col("pid", "o")), join="left"), {"JOIN_NOT_INNER"}, "JOIN_NOT_INNER"),
    "no limit": (dict(limit=-1), {"LIMIT_REQUIRED"}, "LIMIT_REQUIRED"),
    "high limit": (dict(limit=201), {"LIMIT_EXCEEDS"}, "LIMIT_EXCEEDS"),
    "no limit inside": (dict(nested=[(1, -1, col("id", "n"))]), {"LIMIT_REQUIRED"}, "LIMIT_REQUIRED"),
    "no limit in a compared value": (dict(where=EQ(ID, ("subquery", 1)), nested=[(1, -1, col("id", "n"))]), set(), "OK"),
    "no limit in a predicate": (dict(where=("subquery", 1), nested=[(1, -1, col("id", "n"))]), {"LIMIT_REQUIRED"}, "LIMIT_REQUIRED"),
    "mail inside": (dict(select=[TOWN], where=EQ(ID, ("subquery", 1)), nested=[(1, 5, col("mail", "n"))]), {"SENSITIVE_OUTSIDE_MAIN"}, "SENSITIVE_OUTSIDE_MAIN"),
    "no parameters": (dict(where=EQ(MAIL, par(1))), {"PARAM_IDX_RANGE"}, "PARAM_IDX_RANGE"),
    "index zero": (dict(where=EQ(MAIL, par(0)), params=[M]), {"PARAM_IDX_RANGE", "PARAM_UNUSED"}, "PARAM_IDX_RANGE"),
    "other scope": (dict(where=EQ(MAIL, par(1)), params=["x.people.mail"]), {"PARAM_SCOPE_MISMATCH"}, "PARAM_SCOPE_MISMATCH"),
    "no scope": (dict(where=EQ(MAIL, par(1)), params=[""]), {"PARAM_NO_SCOPE"}, "ANALYZE_FAIL"),
    "null scope": (dict(where=IN(MAIL, par(1)), params=[None]), {"PARAM_NO_SCOPE"}, "ANALYZE_FAIL"),
    "unused": (dict(where=EQ(MAIL, par(1)), params=[M, M]), {"PARAM_UNUSED"}, "PARAM_UNUSED"),
    "plain parameter": (dict(select=[TOWN], where=EQ(TOWN, par(1))), {"PARAM_NON_SENSITIVE"}, "PARAM_NON_SENSITIVE"),
    "plain parameter under or": (dict(select=[TOWN], where=OR(EQ(TOWN, par(1)), EQ(ID, LIT))), {"PARAM_NON_SENSITIVE"}, "PARAM_NON_SENSITIVE"),
    "dangling parameter": (dict(select=[TOWN], where=AND(EQ(ID, LIT), par(1))), {"PARAM_OUTSIDE_WHERE"}, "PARAM_OUTSIDE_WHERE"),
    "parameter in a call": (dict(select=[TOWN], where=CALL("f", par(1))), {"PARAM_OUTSIDE_WHERE"}, "PARAM_OUTSIDE_WHERE"),
    "selected parameter": (dict(select=[par(1)]), {"PARAM_OUTSIDE_WHERE"}, "PARAM_OUTSIDE_WHERE"),
    "unsafe": (dict(select=[CALL("bad", TOWN)]), {"FUNC_UNSAFE"}, "FUNC_UNSAFE"),
    "unknown": (dict(select=[col("x", "zz")]), {"NO_COLUMN_ALIAS"}, "NO_COLUMN_ALIAS"),
    "by name": (dict(select=[col("town", "people")]), {"ANALYZE_FAIL"}, "ANALYZE_FAIL"),
    # the order of several
    "join before where": (dict(where=EQ(MAIL, LIT), on=("<", ID, col("pid", "o"))), {"SENSITIVE_CMP", "JOIN_ON_INVALID"}, "JOIN_ON_INVALID"),
    "where before select": (dict(select=[CALL("f", MAIL)], where=OR(EQ(ID, LIT), ID)), {"SENSITIVE_SELECT_EXPR", "WHERE_NOT_CONJ"}, "WHERE_NOT_CONJ"),
    "first conjunct first": (dict(where=AND(EQ(MAIL, LIT), OR(ID, ID))), {"SENSITIVE_CMP", "WHERE_NOT_CONJ"}, "SENSITIVE_CMP"),
    "first conjunct first, turned": (dict(where=AND(OR(ID, ID), EQ(MAIL, LIT))), {"SENSITIVE_CMP", "WHERE_NOT_CONJ"}, "WHERE_NOT_CONJ"),
    "touches in order": (dict(select=[col("x", "zz"), col("town", "people")]), {"NO_COLUMN_ALIAS", "ANALYZE_FAIL"}, "NO_COLUMN_ALIAS"),
    "touches in order, turned": (dict(select=[col("town", "people"), col("x", "zz")]), {"NO_COLUMN_ALIAS", "ANALYZE_FAIL"}, "ANALYZE_FAIL"),
    "function before parameter": (dict(select=[CALL("bad", TOWN), par(1)]), {"FUNC_UNSAFE", "PARAM_OUTSIDE_WHERE"}, "FUNC_UNSAFE"),
    "parameter before a later function": (dict(select=[par(1), CALL("bad", TOWN)]), {"FUNC_UNSAFE", "PARAM_OUTSIDE_WHERE"}, "PARAM_OUTSIDE_WHERE"),
    "inner block before the outer's later clause": (dict(select=[("subquery", 1)], where=CALL("bad", TOWN), nested=[(1, 5, CALL("bad", col("id", "zz")))]), {"NO_COLUMN_ALIAS", "FUNC_UNSAFE"}, "NO_COLUMN_ALIAS"),
    "operand before its neighbour": (dict(on=EQ(MAIL, CALL("f", TOWN))), {"JOIN_ON_INVALID", "JOIN_ON_SENSITIVE"}, "JOIN_ON_INVALID"),
    "star first": (dict(star=True, limit=-1, select=[MAIL]), {"STAR", "LIMIT_REQUIRED"}, "STAR"),
    "distinct before limit": (dict(distinct=True, limit=-1), {"DISTINCT_SENSITIVE", "LIMIT_REQUIRED"}, "DISTINCT_SENSITIVE"),
    "parse": (dict(status="parse_fail", select=[TOWN]), {"PARSE_FAIL"}, "PARSE_FAIL"),
    "alias": (dict(alias="", select=[LIT], limit=-1), {"NO_TABLE_ALIAS"}, "NO_TABLE_ALIAS"),
}


@pytest.fixture(scope="module")
def found(spark):
    tables = [[], [], [], []]
    for k, (case, _, _) in enumerate(CASES.values()):
        for table, rows in zip(tables, facts(spark, k, **case)):
            table += rows
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(tables, (BLOCKS, RANGES, NODES, PARAMS))]
    paths = lambda *p: spark.createDataFrame(p, "conn string, path string")
    # the rules of another connection mark nothing here
    columns = normalize_column_rules(paths(("here", "people.mail"), ("there", "people.town"), ("there", "people.mail")))
    functions = normalize_function_rules(paths(("here", "f"), ("there", "bad")))
    builtin = spark.createDataFrame([("count",)], "name string")
    violations = A.all_violations(*frames, columns, builtin, functions, conn="here", order=True).cache()
    rules = {}
    for r in violations.collect():
        rules.setdefault(r.query_id, set()).add(r.rule)
    verdicts = {r.query_id: r.code for r in A.first_verdict(frames[0], violations).collect()}
    return rules, verdicts


@pytest.mark.parametrize(("k", "name"), list(enumerate(CASES)))
def test_rules(found, k, name):
    _, rules, code = CASES[name]
    assert (found[0].get(k, set()), found[1][k]) == (rules, code)


def test_facts_are_neither_broadcast_nor_kept(spark, monkeypatch):
    """However small the facts are thought to be, they meet by query; nothing is written on the way."""
    monkeypatch.setattr(DataFrame, "checkpoint", None)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(facts(spark, 0, **next(iter(CASES.values()))[0]), (BLOCKS, RANGES, NODES, PARAMS))]
    paths = lambda *p: spark.createDataFrame(p, "conn string, path string")
    rules = normalize_column_rules(paths(("here", "people.mail"))), spark.createDataFrame([("count",)], "name string"), normalize_function_rules(paths(("here", "f")))
    plan = A.all_violations(*frames, *rules, conn="here", order=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [query_id" in plan
    assert not any("query_id" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)


def test_nodes_are_not_sent_by_name(spark):
    """Rules go to the nodes: few names are in all of a log, so a join by name would exchange every node and send the commonest to one task."""
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(facts(spark, 0, **next(iter(CASES.values()))[0]), (BLOCKS, RANGES, NODES, PARAMS))]
    paths = lambda *p: spark.createDataFrame(p, "conn string, path string")
    rules = normalize_column_rules(paths(("here", "people.mail"))), spark.createDataFrame([("count",)], "name string"), normalize_function_rules(paths(("here", "f")))
    plan = A.all_violations(*frames, *rules, conn="here", order=True)._jdf.queryExecution().executedPlan().toString()
    by_name = [line for line in plan.splitlines() if "lower(" in line and ("SortMergeJoin" in line or "Exchange hash" in line)]
    assert not by_name
