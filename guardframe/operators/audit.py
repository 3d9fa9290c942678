"""Policy audit of query logs, set by set.

Input is facts about logged queries, whatever produced them:

- blocks(query_id, block_id, parent_block_id, scope, has_star, has_distinct, has_offset, limit_value, status)
- ranges(query_id, block_id, pos, kind, schema, table, alias, join_kind)
- nodes(query_id, block_id, clause, item, node_id, path, kind, qualifier, column, func_schema,
  func_name, param_index, nested_block_id); path lists a node's ancestors from the top;
  a join's ON has the place of its right side as item, and several items of WHERE are AND
- params(query_id, idx, col_id)

Every rule is a condition on a row of them, so a log of any length is one Spark job. Work is keyed by query
alone, of which no log has a hot one: nodes are exchanged once, and not at all where they come dealt by query, as the
rules of a policy are sent to them; of the other facts, and of what is found, lists of a query meet, which its text bounds.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from guardframe.sources.policy import classify_columns, classify_functions

#: Fixed value: the most rows of a result with a sensitive column.
SENSITIVE_LIMIT = 200
#: Rules whose code is that of another.
SAME_CODE = {"UNSUPPORTED_EXPR": "UNSUPPORTED_QUERY", "STAR_NESTED": "STAR", "PARAM_NO_SCOPE": "ANALYZE_FAIL"}
#: Rules by the facts that they are read from; those of the second group hold only for queries in sensitive mode.
BLOCK_RULES = ("PARSE_FAIL", "UNSUPPORTED_QUERY", "STAR", "STAR_NESTED"), ("DISTINCT_SENSITIVE", "OFFSET_SENSITIVE", "LIMIT_REQUIRED", "LIMIT_EXCEEDS")
RANGE_RULES = ("NO_TABLE_ALIAS",), ("JOIN_NOT_INNER",)
NODE_RULES = (
    ("UNSUPPORTED_EXPR", "NO_COLUMN_ALIAS", "ANALYZE_FAIL", "SENSITIVE_OUTSIDE_MAIN", "FUNC_UNSAFE", "PARAM_OUTSIDE_WHERE", "PARAM_NON_SENSITIVE"),
    ("JOIN_ON_INVALID", "JOIN_ON_SENSITIVE", "WHERE_NOT_CONJ", "SENSITIVE_CMP", "SENSITIVE_SELECT_EXPR", "SENSITIVE_LOC"),
)
PARAM_RULES = ("PARAM_UNUSED",), ("PARAM_IDX_RANGE", "PARAM_NO_SCOPE", "PARAM_SCOPE_MISMATCH")
ALL_RULES = tuple(r for group in (BLOCK_RULES, RANGE_RULES, NODE_RULES, PARAM_RULES) for part in group for r in part)

#: Where a clause comes in each of the passes over a block; other blocks in FROM come first of all in the first, last in the others.
TOUCH = {"on": 1, "select": 2, "where": 3, "group": 4, "having": 5, "order": 6}
PASS_A = {"select": 1, "where": 2, "group": 3, "having": 4, "order": 5, "on": 6}
PASS_B = {"on": 1, "where": 2, "select": 3, "group": 4, "having": 5, "order": 6}
FROM_FIRST, FROM_LAST = 0, 7


def _ints(*parts) -> Column:
    return F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("int") for p in parts])


def _rank(ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("clause"))


def resolve(blocks: DataFrame, ranges: DataFrame, nodes: DataFrame, rules: DataFrame, conn: str | None = None) -> DataFrame:
    """nodes with the scope of their block and, for columns, what they touch: touch (base, derived or unknown), by_name, col_id, sensitive.

    Only the ranges of the owning block count. An alias wins over a table's own name.
    """
    word = lambda w, by_name: F.struct(F.lit(by_name).alias("by_name"), "pos", "block_id", F.col(w).alias("word"), "kind", F.col("schema"), F.col("table"))
    words = F.array_compact(F.array(F.when(F.col("alias") != "", word("alias", False)), F.when(F.col("table").isNotNull(), word("table", True))))
    scope = F.struct("block_id", "scope")
    named = ranges.select("query_id", words.alias("words"))
    about = named.withColumn("scope", F.lit(None).cast("struct<block_id:int,scope:string>")).unionByName(blocks.select("query_id", F.lit(None).cast(named.schema["words"].dataType).alias("words"), scope.alias("scope")))
    about = about.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("_words"), F.collect_list("scope").alias("_scopes"))
    about = about.select("*", F.col("_scopes.block_id").alias("_ids"), F.transform("_words", lambda x: F.struct(x.block_id.alias("block_id"), x.word.alias("word"))).alias("_keys"))
    column = F.col("kind") == "column"
    # a table of queries would not fit the driver, however small it is thought to be; a place in a list is compiled, a filter
    # of one is not
    found = nodes.join(about.hint("merge"), "query_id").where(F.array_contains("_ids", F.col("block_id"))).withColumns({
        "_scope": F.get("_scopes", F.array_position("_ids", F.col("block_id")) - 1),
        "r": F.get("_words", F.array_position("_keys", F.struct("block_id", F.col("qualifier").alias("word"))) - 1),
    })
    found = found.select(
        *nodes.columns, F.when(column, F.coalesce("r.kind", F.lit("unknown"))).alias("touch"), F.col("r.schema").alias("schema"),
        F.col("r.table").alias("table"), F.when(column, F.coalesce("r.by_name", F.lit(False))).alias("by_name"), F.col("_scope.scope").alias("scope"),
    )
    # names repeat without end in a log: a join by name would send all nodes, the commonest name's to one task
    marked = classify_columns(found, rules, conn, in_place=True)
    base = column & (F.col("touch") == "base")
    return marked.withColumns({"sensitive": F.coalesce(base & F.col("sensitive"), F.lit(False)), "col_id": F.when(base, F.col("col_id"))})


def extract_touches(blocks: DataFrame, ranges: DataFrame, nodes: DataFrame, rules: DataFrame, conn: str | None = None) -> DataFrame:
    """Every use of a column: where it is, base, derived or unknown (kind), by alias or by table name, its id, and whether it is sensitive."""
    found = resolve(blocks, ranges, nodes.where("kind = 'column'"), rules, conn)
    return found.drop("kind", "param_index", "func_schema", "func_name", "nested_block_id").withColumnRenamed("touch", "kind")


def sensitive_mode(touches: DataFrame) -> DataFrame:
    """(query_id): queries that touch a sensitive base column."""
    return touches.where("sensitive").select("query_id").distinct()


def related(resolved: DataFrame) -> DataFrame:
    """Each node with what is known of its parent, its first sibling (beside) and its parent's first child (lead), null where there is none.

    Ids of nodes rise in reading order. up is the parent's id; holds: a sensitive column is
    in the node or under it; top: only AND is above it; free: only AND, OR and NOT are. root
    is the kind of the first node on the way down that is none of these; others: whether all
    children of the parent but the first are parameters. What is above a node is read from
    its path and from two lists of its expression; siblings meet in a window over the
    children of one node, which needs no other exchange than that by expression. All of it
    is columns, not structs: rules over many fields of structs are compiled to code that is
    too long to be run well.
    """
    key = ["query_id", "block_id", "clause", "item"]
    fields = ("node_id", "kind", "touch", "by_name", "scope", "sensitive", "col_id", "param_index", "safe", "nested_block_id")
    rows = resolved.withColumn("up", F.try_element_at("path", F.lit(-1)))
    # the order is that of the window over siblings, so rows are sorted once
    whole = W.partitionBy(*key).orderBy("up", "node_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    above = F.collect_list(F.when(F.col("sensitive"), F.concat("path", F.array("node_id")))).over(whole)
    # windows over all of an expression's rows give its lists once; a grouping would make them twice
    rows = rows.withColumns({"k": F.collect_list(F.struct("node_id", "kind")).over(whole), "s": above})
    rows = rows.select(*key, "up", *fields, "path", F.map_from_entries("k").alias("k"), F.flatten("s").alias("s"))
    rows = rows.withColumn("kinds", F.transform("path", lambda p: F.element_at("k", p)))
    up, kinds, inner = F.col("up"), F.col("kinds"), F.col("up").isNotNull()
    outer = F.slice(kinds, 1, F.greatest(F.size(kinds) - 1, F.lit(0)))
    without = lambda a, *kinds: reduce(F.array_remove, kinds, a)
    holds = lambda n: F.array_contains("s", n)
    top = lambda a: F.size(without(a, "and")) == 0
    free = lambda a: F.size(without(a, "and", "or", "not")) == 0
    root = F.try_element_at(without(F.concat(kinds, F.array("kind")), "and", "or", "not"), F.lit(1))
    parent = {"kind": F.try_element_at(kinds, F.lit(-1)), "holds": holds(up), "top": top(outer), "free": free(outer)}
    parent = [F.when(inner, c).alias(f"parent_{n}") for n, c in parent.items()]
    rows = rows.select(*key, "up", *fields, holds(F.col("node_id")).alias("holds"), top(kinds).alias("top"), root.alias("root"), *parent)
    told = ("node_id", "kind", "sensitive", "col_id", "holds")
    w = W.partitionBy(*key, "up").orderBy("node_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"one": F.first(F.struct(*told)).over(w), "two": F.nth_value(F.struct(*told), 2).over(w), "plain": F.count_if(F.col("kind") != "param").over(w)})
    leads = F.col("one.node_id") == F.col("node_id")
    return rows.select(
        *key, "up", *fields, "holds", "top", "root", *[f"parent_{n}" for n in ("kind", "holds", "top", "free")],
        *[F.when(inner, F.when(leads, F.col(f"two.{n}")).otherwise(F.col(f"one.{n}"))).alias(f"beside_{n}") for n in told],
        *[F.when(inner, F.col(f"one.{n}")).alias(f"lead_{n}") for n in told],
        (~inner | (F.col("plain") == (F.col("one.kind") != "param").cast("long"))).alias("others"),
    )


def block_places(blocks: Column, links: Column) -> Column:
    """A map from the blocks of a query to t, a and b: where each pass comes to a block, as lists that sort in that order; b is null if the last pass leaves it out.

    links(block_id, clause, item, node_id, top) say which expression holds a block; others
    stand in FROM or WITH. A block's id is above that of its parent.
    """
    rank = lambda ranks, c: F.element_at(F.create_map(*[F.lit(v) for pair in ranks.items() for v in pair]), c)

    def step(places, x):
        up = F.element_at(places, x.parent_block_id)
        loose = x.clause.isNull()
        at = lambda p, here: F.when(x.parent_block_id.isNull(), _ints()).otherwise(F.concat(p, here))
        where = x.clause == "where"
        t = at(up.t, F.when(loose, _ints(FROM_FIRST, x.block_id)).otherwise(_ints(rank(TOUCH, x.clause), x.item, x.node_id)))
        a = at(up.a, F.when(loose, _ints(FROM_LAST, x.block_id)).when(where, _ints(PASS_A["where"], 2, x.item, x.node_id)).otherwise(_ints(rank(PASS_A, x.clause), x.item, 2, x.node_id)))
        place = F.when(loose, _ints(FROM_LAST, x.block_id)).when(where & x.top, _ints(PASS_B["where"], x.item, x.node_id))
        place = place.when(~where & (x.clause != "on"), _ints(rank(PASS_B, x.clause), x.item, 1, x.node_id))
        return F.map_concat(places, F.create_map(x.block_id, F.struct(t.alias("t"), a.alias("a"), at(up.b, place).alias("b"))))

    start = F.expr("cast(map() as map<int, struct<t: array<int>, a: array<int>, b: array<int>>>)")
    link = lambda b: F.try_element_at(F.filter(links, lambda l: l.block_id == b.block_id), F.lit(1))
    held = F.transform(F.array_sort(blocks), lambda b: F.struct(b.block_id.alias("block_id"), b.parent_block_id.alias("parent_block_id"), *[link(b)[f].alias(f) for f in ("clause", "item", "node_id", "top")]))
    return F.aggregate(held, start, step)


def _node_rules() -> list[tuple[str, str, Column, Column]]:
    """(rule, pass, where it comes in the pass over its block, condition) over related()."""
    clause, item, kind, node, top, holds, sensitive = (F.col(c) for c in ("clause", "item", "kind", "node_id", "top", "holds", "sensitive"))
    parent_kind, parent_top, lead_holds = F.col("parent_kind"), F.col("parent_top"), F.col("lead_holds")
    up, is_eq, is_in = F.coalesce("up", node), parent_kind == "=", parent_kind == "in"
    leads = F.col("lead_node_id") == node
    where, on = clause == "where", clause == "on"
    param = kind == "param"
    touch = _ints(_rank(TOUCH), item, node)
    pass_a = lambda n: F.when(where, _ints(PASS_A["where"], n, item, node)).otherwise(_ints(_rank(PASS_A), item, n, node))
    pass_b = lambda anchor, n: F.when(on, _ints(PASS_B["on"], item, 1, anchor, n)).when(where, _ints(PASS_B["where"], item, anchor, n)).otherwise(_ints(_rank(PASS_B), item, 0, anchor, n))
    operand = where & parent_top & (is_eq | (is_in & leads))
    return [
        ("UNSUPPORTED_EXPR", "0", _ints(3), kind == "unsupported"),
        ("NO_COLUMN_ALIAS", "t", touch, F.col("touch") == "unknown"),
        ("ANALYZE_FAIL", "t", touch, F.col("by_name")),
        ("SENSITIVE_OUTSIDE_MAIN", "t", touch, sensitive & (F.col("scope") != "main")),
        ("FUNC_UNSAFE", "a", pass_a(0), kind.isin("call", "window") & ~F.col("safe")),
        ("PARAM_OUTSIDE_WHERE", "a", pass_a(1), param & (~where | F.col("root").isin("param", "call", "cast", "case", "window"))),
        ("PARAM_NON_SENSITIVE", "a", pass_a(1), param & where & F.col("parent_free") & ((is_eq & ~F.coalesce(F.col("beside_holds"), F.lit(False))) | (is_in & ~leads & ~lead_holds))),
        ("JOIN_ON_INVALID", "b", pass_b(F.when(top, node).otherwise(up), 0), on & ((top & ~kind.isin("and", "=")) | (parent_top & is_eq & ~kind.isin("column", "literal")))),
        ("JOIN_ON_SENSITIVE", "b", pass_b(up, 1), on & sensitive),
        ("WHERE_NOT_CONJ", "b", pass_b(node, 0), where & top & kind.isin("or", "not")),
        ("SENSITIVE_CMP", "b", pass_b(F.when(top, node).otherwise(up), node), where & (
            (top & ~kind.isin("and", "or", "not", "=", "in", "subquery"))
            | (parent_top & ((is_eq & sensitive & (F.col("beside_kind") != "param")) | (is_in & leads & sensitive & ~F.col("others")) | (is_in & ~leads & holds))))),
        ("SENSITIVE_SELECT_EXPR", "b", pass_b(node, 0), (clause == "select") & sensitive & (F.col("up").isNotNull())),
        ("SENSITIVE_LOC", "b", pass_b(up, node), (operand & holds & (kind != "column")) | (clause.isin("group", "having", "order") & sensitive)),
    ]


def all_violations(
    blocks: DataFrame, ranges: DataFrame, nodes: DataFrame, params: DataFrame, column_rules: DataFrame, builtin: DataFrame, function_rules: DataFrame,
    rules: Collection[str] = ALL_RULES, conn: str | None = None, order: bool = False,
) -> DataFrame:
    """(query_id, rule, code) for every rule that a query breaks, once each; only the rules asked for.

    order adds `at`, a list by which violations of a query sort in the order in which they
    are met: the form of the text, uses of columns, then the pass over all queries, then
    that over those in sensitive mode, and parameters that were not used. conn picks the
    rules of one connection. One pass over each of the facts tables gives the rules of it.
    """
    any_of = lambda group: bool(set(rules) & {r for part in group for r in part})
    modal = [r for group in (BLOCK_RULES, RANGE_RULES, NODE_RULES, PARAM_RULES) for r in group[1]]
    need_mode = bool(set(rules) & set(modal))
    placed = need_mode or order
    hit = lambda rule, step, at, block="block_id": F.struct((F.lit(block) if isinstance(block, int) else F.col(block) if isinstance(block, str) else block).cast("int").alias("block_id"), F.lit(rule).alias("rule"), F.lit(step).alias("step"), at.alias("here"))
    hits_type = "array<struct<block_id:int,rule:string,step:string,here:array<int>>>"
    parts = []

    none = F.expr(f"cast(array() as {hits_type})")

    def add(df: DataFrame, found: list[tuple[str, str, Column, Column]], **more: Column) -> None:
        """Rows with a list of what they break of found, and more; rows that have nothing of it are left out."""
        found = [f for f in found if f[0] in rules]
        rows = df.where(reduce(lambda a, b: a | b, [test for *_, test in found] + [c.isNotNull() for c in more.values()]))
        # a concatenation is compiled in pieces, an array of all in one that is too long to be run well
        hits = F.concat(none, *[F.when(test, F.array(hit(rule, step, at)).cast(hits_type)).otherwise(none) for rule, step, at, test in found])
        parts.append(rows.select("query_id", hits.alias("hits"), *[c.alias(n) for n, c in more.items()]))

    scalar = lambda rule, step, at, test: (rule, step, _ints(*at), F.expr(test))
    block_rules = [
        scalar("PARSE_FAIL", "0", (0,), "status = 'parse_fail'"),
        scalar("UNSUPPORTED_QUERY", "0", (1,), "status = 'unsupported'"),
        scalar("STAR", "0", (2,), "has_star and parent_block_id is null"),
        scalar("STAR_NESTED", "a", (0, 0), "has_star and parent_block_id is not null"),
        scalar("DISTINCT_SENSITIVE", "b", (0, 1), "has_distinct"),
        scalar("OFFSET_SENSITIVE", "b", (0, 2), "has_offset"),
        scalar("LIMIT_REQUIRED", "b", (0, 3), "limit_value < 0"),
        scalar("LIMIT_EXCEEDS", "b", (0, 3), f"limit_value > {SENSITIVE_LIMIT}"),
    ]
    if placed or any_of(BLOCK_RULES):
        known = F.col("query_id").isNotNull()
        add(blocks, block_rules, **({"blocks": F.when(known, F.struct("block_id", "parent_block_id"))} if placed else {}))
    if any_of(RANGE_RULES):
        add(ranges, [
            ("NO_TABLE_ALIAS", "a", _ints(0, 1, F.col("pos")), F.col("alias") == ""),
            ("JOIN_NOT_INNER", "b", _ints(PASS_B["on"], F.col("pos"), 0), F.col("join_kind").isNotNull() & (F.col("join_kind") != "inner")),
        ])
    if placed or any_of(NODE_RULES) or any_of(PARAM_RULES):
        resolved = resolve(blocks, ranges, nodes, column_rules, conn)
        calls = classify_functions(resolved.withColumns({"schema": F.col("func_schema"), "name": F.col("func_name")}), builtin, function_rules, conn, in_place=True)
        lists = {}
        if placed:
            lists["links"] = F.when(F.col("nested_block_id").isNotNull(), F.struct(F.col("nested_block_id").alias("block_id"), "clause", "item", "node_id", "top"))
        if need_mode:
            lists["sensitive"] = F.when(F.col("sensitive"), F.lit(True))
        if any_of(PARAM_RULES):
            direct = "kind = 'param' and clause = 'where' and parent_top and (parent_kind = '=' and beside_sensitive or parent_kind = 'in' and lead_node_id <> node_id and lead_sensitive)"
            wanted = F.when(F.col("parent_kind") == "=", F.col("beside_col_id")).otherwise(F.col("lead_col_id"))
            here = _ints(PASS_B["where"], F.col("item"), F.col("up"), F.col("node_id"))
            lists["bound"] = F.when(F.expr(direct), F.struct("block_id", F.col("param_index").alias("idx"), wanted.alias("wanted"), here.alias("here")))
        add(related(calls), _node_rules(), **lists)
    if any_of(PARAM_RULES):
        add(params, [], given=F.struct("idx", "col_id"))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    joined = {c: (F.flatten(F.collect_list(c)) if c == "hits" else F.collect_list(c)).alias(c) for c in out.columns if c not in ("query_id", "sensitive")}
    if need_mode:
        joined["in_mode"] = (F.count_if("sensitive") > 0).alias("in_mode")
    out = out.groupBy("query_id").agg(*joined.values())
    found = [F.col("hits")]
    if any_of(PARAM_RULES):
        same = lambda b: F.filter("given", lambda g: g.idx == b.idx)
        empty = lambda g: F.coalesce(g.col_id, F.lit("")) == ""
        tests = {
            "PARAM_IDX_RANGE": lambda b: (F.size(same(b)) == 0) | (b.idx < 1),
            "PARAM_NO_SCOPE": lambda b: F.exists(same(b), empty),
            "PARAM_SCOPE_MISMATCH": lambda b: F.exists(same(b), lambda g: ~empty(g) & (g.col_id != b.wanted)),
        }
        asked = [r for r in tests if r in rules]
        if asked:
            found.append(F.flatten(F.transform("bound", lambda b: F.array_compact(F.array(*[F.when(tests[r](b), hit(r, "b", b.here, b.block_id)) for r in asked])))))
        if "PARAM_UNUSED" in rules:
            unused = F.filter("given", lambda g: ~F.coalesce(F.exists("bound", lambda b: b.idx == g.idx), F.lit(False)))
            found.append(F.transform(unused, lambda g: hit("PARAM_UNUSED", "z", _ints(g.idx), 0)))
    every = F.concat(*[f.cast(hits_type) for f in found])
    if placed:
        out = out.withColumn("places", block_places(F.col("blocks"), F.col("links")))
    kept = [c for c, use in (("in_mode", need_mode), ("places", placed)) if use]
    out = out.select("query_id", *kept, F.explode(every).alias("v")).select("query_id", *kept, "v.*")
    if need_mode:
        out = out.where(F.col("in_mode") | ~F.col("rule").isin(*modal))
    if placed:
        out = out.withColumn("p", F.try_element_at("places", F.col("block_id"))).select("query_id", "rule", "step", "here", "p.*").where("step <> 'b' or b is not null")
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in SAME_CODE.items() for v in pair]), F.col("rule")), F.col("rule")).alias("code")
    if not order:
        return out.select("query_id", "rule", code).distinct()
    at = F.when(F.col("step") == "0", F.concat(_ints(0), "here")).when(F.col("step") == "t", F.concat(_ints(1), "t", "here"))
    at = at.when(F.col("step") == "a", F.concat(_ints(2), "a", "here")).when(F.col("step") == "b", F.concat(_ints(3), "b", "here"))
    at = at.otherwise(F.concat(_ints(4), "here"))
    return out.select("query_id", "rule", code, at.alias("at")).groupBy("query_id", "rule", "code").agg(F.min("at").alias("at"))


def first_violation(violations: DataFrame) -> DataFrame:
    """(query_id, code): the violation that is met first, by `at`."""
    return violations.groupBy("query_id").agg(F.min_by("code", F.struct("at", "rule")).alias("code"))


def first_verdict(blocks: DataFrame, violations: DataFrame) -> DataFrame:
    """(query_id, code): the violation that is met first, by `at`; OK where there is none."""
    return blocks.select("query_id").distinct().join(first_violation(violations).hint("merge"), "query_id", "left").select("query_id", F.coalesce("code", F.lit("OK")).alias("code"))


def audit_summary(log: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queries by connection, code and day of log(query_id, conn, day), with all subtotals."""
    return log.join(verdicts.hint("merge"), "query_id").cube("conn", "code", "day").agg(F.count("*").alias("n"))
