"""One query for each accepted form, through the guard, with its SQL."""

import pandas as pd
from pyspark.sql import Window as W, functions as F

from guardframe.functions.json_path import json_get, json_get_text, json_path, json_path_text
from guardframe.operators.guard import Guard
from guardframe.plans.token_queries import read
from guardframe.scratch import dense_index
from guardframe.sources.policy import normalize_column_rules

Q: dict = {}
SQL: dict[str, str] = {}


#: Columns that are sensitive in every form that says nothing else; none of these forms uses one, so each result is as if they were not there.
RULES = ("customer.c_acctbal", "supplier.s_acctbal", "part.p_retailprice", "orders.o_orderpriority", "lineitem.l_tax", "events.value", "nation.n_name")


def form(sql: str, rules: tuple[str, ...] = RULES):
    """A query of a guard and a table reader: f(t) -> GuardedFrame, t(name, alias) a guarded table."""

    def add(f):
        def run(spark, sf_dir):
            g = Guard(spark, normalize_column_rules(spark.createDataFrame([("tpch", r) for r in rules], "conn string, path string")))
            return f(lambda name, alias=None: g.table(read(spark, sf_dir, name), name, alias)).to_df()

        run.__name__ = f.__name__
        Q[f.__name__], SQL[f.__name__] = run, sql
        return f

    return add


def minimum_slice(spark, sf_dir):
    """Customers of one market segment, names as tokens."""
    customer = read(spark, sf_dir, "customer")
    rules = normalize_column_rules(spark.createDataFrame([("tpch", "customer.c_name")], "conn string, path string"))
    g = Guard(spark, rules)
    picked = g.table(customer, "customer", "c").where("c_mktsegment = 'BUILDING'").order_by("c_custkey")
    return picked.select("c.c_custkey", "c.c_name").limit(200).to_df()


Q["minimum_slice"] = minimum_slice
SQL["minimum_slice"] = """WITH c AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 200)
SELECT c_custkey, 'tok_tpch_0_' || (dense_rank() OVER (ORDER BY c_name) - 1) AS c_name FROM c"""


def q16_sensitive_join(spark, sf_dir):
    """Two tables with columns of one name: each has its own id, one of them only under this connection."""
    customer = read(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment note")
    supplier = read(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_name name", "s_nationkey note")
    paths = [("tpch", "customer.name"), ("tpch", "supplier.name"), ("other", "customer.note"), ("other", "supplier.name")]
    g = Guard(spark, normalize_column_rules(spark.createDataFrame(paths, "conn string, path string")))
    both = g.table(customer, "customer", "c").join(g.table(supplier, "supplier", "s"), F.col("c.id") == F.col("s.id"))
    return both.select("c.id", ("c.name", "customer"), ("s.name", "supplier"), "c.note").order_by("id").limit(200).to_df()


Q["q16_sensitive_join"] = q16_sensitive_join
SQL["q16_sensitive_join"] = """WITH j AS (SELECT c_custkey AS id, c_name, s_name, c_mktsegment AS note FROM customer JOIN supplier ON c_custkey = s_suppkey ORDER BY id LIMIT 200),
v AS (SELECT col_id, value, row_number() OVER (ORDER BY col_id, value) - 1 AS idx FROM (SELECT 'customer.name' AS col_id, c_name AS value FROM j UNION SELECT 'supplier.name', s_name FROM j) WHERE value IS NOT NULL)
SELECT j.id, 'tok_tpch_0_' || a.idx AS customer, 'tok_tpch_0_' || b.idx AS supplier, note FROM j LEFT JOIN v a ON a.col_id = 'customer.name' AND a.value = c_name LEFT JOIN v b ON b.col_id = 'supplier.name' AND b.value = s_name"""


@form("SELECT c_custkey AS id, c_name, c_acctbal * 2 AS twice FROM customer", ("customer.c_mktsegment",))
def q1_projection(t):
    return t("customer").select(("c_custkey", "id"), "c_name", (F.col("c_acctbal") * 2).alias("twice"))


@form("SELECT o.o_orderstatus AS o_orderstatus, o_orderkey FROM orders o")
def q2_column_reference(t):
    return t("orders", "o").select("o.o_orderstatus", "o_orderkey")


@form("SELECT c_custkey, NULL::INTEGER AS nothing, true AS yes, 9000000000::BIGINT AS big, 1.5::DOUBLE AS half, 'x' AS word FROM customer")
def q3_literals(t):
    return t("customer").select("c_custkey", F.lit(None).cast("int").alias("nothing"), F.lit(True).alias("yes"), F.lit(9000000000).alias("big"), F.lit(1.5).alias("half"), F.lit("x").alias("word"))


@form("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def q4_filter(t):
    return t("orders").where(F.col("o_totalprice") > 100000).select("o_orderkey")


@form("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 30 AND p_size <> 20 AND p_retailprice < 1500 AND p_partkey > 7 AND p_brand = (SELECT min(p_brand) FROM part)", ("part.p_name",))
def q5_comparisons(t):
    p = t("part")
    least = t("part").agg(F.min("p_brand")).scalar()
    return p.where((F.col("p_size") >= 10) & (F.col("p_size") <= 30) & (F.col("p_size") != 20) & (F.col("p_retailprice") < 1500) & (F.col("p_partkey") > 7) & (F.col("p_brand") == least)).select("p_partkey")


@form("SELECT p_partkey FROM part WHERE p_type LIKE '%STEEL%' AND p_name NOT LIKE '%1%'")
def q6_like(t):
    return t("part").where(F.col("p_type").like("%STEEL%") & ~F.col("p_name").like("%1%")).select("p_partkey")


@form("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')", ("orders.o_totalprice",))
def q7_in_list(t):
    return t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F")).select("o_orderkey")


@form("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.02 AND 0.05")
def q8_between(t):
    return t("lineitem").where(F.col("l_quantity").between(10, 20) & ~F.col("l_discount").between(0.02, 0.05)).select("l_orderkey", "l_linenumber")


_LEFT = "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@form(f"SELECT count(*) FILTER (quality IS NULL) AS without, count(*) FILTER (quality IS NOT NULL) AS labelled FROM ({_LEFT})")
def q9_is_null(t):
    both = t("documents", "d").join(t("labels", "l"), F.col("d.doc_id") == F.col("l.doc_id"), "left")
    return both.agg(F.count_if(F.col("quality").isNull()).alias("without"), F.count_if(F.col("quality").isNotNull()).alias("labelled"))


@form("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice < 5000) AND NOT (o_custkey % 2 = 0)")
def q10_and_or_not(t):
    return t("orders").where(((F.col("o_orderstatus") == "O") | (F.col("o_totalprice") < 5000)) & ~(F.col("o_custkey") % 2 == 0)).select("o_orderkey")


@form("SELECT vec_id, list_contains([1, 3, 5], label) AS is_any, len([x for x in embedding if NOT x < 10]) = 0 AS is_all FROM embeddings")
def q11_any_all(t):
    return t("embeddings").select("vec_id", F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(5)), F.col("label")).alias("is_any"), F.forall("embedding", lambda x: x < 10).alias("is_all"))


@form("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def q12_case(t):
    band = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 50000, "mid").otherwise("low")
    code = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    return t("orders").select("o_orderkey", band.alias("band"), code.alias("code"))


@form("SELECT o_orderkey, o_orderkey::VARCHAR::BIGINT AS back, o_orderdate::DATE AS day, floor(o_totalprice)::BIGINT AS whole FROM orders")
def q13_cast(t):
    return t("orders").select("o_orderkey", F.col("o_orderkey").cast("string").cast("long").alias("back"), F.col("o_orderdate").cast("date").alias("day"), F.floor("o_totalprice").cast("long").alias("whole"))


@form("SELECT event_id, (props::JSON ->> 'k') AS k FROM events")
def q14_json_access(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_NESTED = """'{"props":' || props || ',"list":[' || event_id || ',"' || event_type || '",null,{"0":true}]}'"""


@form(f"""WITH e AS (SELECT event_id, ({_NESTED})::JSON AS j FROM events)
SELECT event_id, replace((json_extract(j, '$.props'))::VARCHAR, ' ', '') AS one, json_extract_string(j, '$.list[1]') AS two, json_extract(j, '$.props.k')::VARCHAR AS three, json_extract_string(j, '$.list[3].0') AS four,
json_extract_string(j, '$.list[0]') AS five, NULL::VARCHAR AS six, NULL::VARCHAR AS seven FROM e""")
def q14_json_operators(t):
    """->, ->>, #> and #>> with keys and places, and two steps to what is not there."""
    j = F.expr(_NESTED)
    items = json_get(j, "list")
    return t("events").select(
        "event_id", json_get(j, "props").alias("one"), json_get_text(items, 1).alias("two"), json_path(j, ["props", "k"]).alias("three"), json_path_text(j, ["list", "3", "0"]).alias("four"),
        json_get_text(items, -4).alias("five"), json_get_text(items, 2).alias("six"), json_path_text(j, ["list", "9", "x"]).alias("seven"),
    )


@form("SELECT c_custkey, upper(c_mktsegment) AS seg, length(c_name) AS n, abs(c_acctbal) AS a FROM customer", ("customer.c_nationkey",))
def q15_function_call(t):
    return t("customer").select("c_custkey", F.upper("c_mktsegment").alias("seg"), F.length("c_name").cast("long").alias("n"), F.abs("c_acctbal").alias("a"))


@form("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_nationkey < 5")
def q16_inner_join(t):
    return t("orders").join(t("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") < 5)).select("o_orderkey", "c_name")


@form("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def q17_left_join(t):
    return t("customer").join(t("orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "P"), "left").select("c_custkey", "o_orderkey")


@form("SELECT quality, d.doc_id AS doc_id FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
def q18_right_join(t):
    return t("labels", "l").join(t("documents", "d"), F.col("d.doc_id") == F.col("l.doc_id"), "right").select("quality", ("d.doc_id", "doc_id"))


@form("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
def q19_full_join(t):
    return t("supplier").join(t("customer"), (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey")), "full").select("s_suppkey", "c_custkey")


@form("SELECT r_name, s_suppkey FROM region CROSS JOIN supplier")
def q20_cross_join(t):
    return t("region").cross_join(t("supplier")).select("r_name", "s_suppkey")


@form("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def q21_in_select(t):
    return t("customer").semi_join(t("orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@form("SELECT c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e12) OR c_nationkey > 5")
def q22_exists(t):
    there = t("orders").where("o_totalprice > 1e12").agg(F.count("*") > 0).scalar()
    return t("customer").where(there | (F.col("c_nationkey") > 5)).select("c_name")


@form("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q23_not_in(t):
    return t("customer").not_in("c_custkey", t("orders"), "o_custkey").select("c_custkey")


@form("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1)")
def q23_not_exists(t):
    return t("documents", "d").anti_join(t("labels", "l").where("toxic = 1"), F.col("d.doc_id") == F.col("l.doc_id")).select("doc_id")


@form("SELECT c_custkey, c_acctbal - (SELECT avg(c_acctbal) FROM customer) > 0 AS above FROM customer", ("customer.c_mktsegment",))
def q24_scalar_subquery(t):
    mean = t("customer").agg(F.avg("c_acctbal")).scalar()
    return t("customer").select("c_custkey", (F.col("c_acctbal") - mean > 0).alias("above"))


@form("SELECT x.k, x.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) x WHERE x.n > 12")
def q25_derived_table(t):
    return t("orders").group_by(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).alias("x").where("x.n > 12").select("x.k", "x.n")


@form("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000) SELECT a.o_orderkey, b.o_orderkey AS other FROM big a JOIN big b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
def q26_cte(t):
    big = t("orders").where("o_totalprice > 150000")
    return big.alias("a").join(big.alias("b"), (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))).select("a.o_orderkey", ("b.o_orderkey", "other"))


@form("SELECT n_name, v.word FROM nation JOIN (VALUES (0, 'zero'), (1, 'one')) v(id, word) ON n_regionkey = v.id", ("nation.n_nationkey",))
def q27_values(t):
    n = t("nation")
    return n.join(n.guard.values([(0, "zero"), (1, "one")], "id int, word string", "v"), F.col("n_regionkey") == F.col("v.id")).select("n_name", "v.word")


@form("SELECT o_orderpriority, year(o_orderdate)::INTEGER AS y, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY o_orderpriority, year(o_orderdate)", ("orders.o_orderkey",))
def q28_group_by(t):
    return t("orders").group_by("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"))


@form("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def q29_having(t):
    return t("orders").group_by("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@form("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY l_returnflag")
def q30_distinct_aggregates(t):
    return t("lineitem").group_by("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("numbers"))


@form("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS nth, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three FROM orders")
def q31_window(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).alias("nth"), F.count("*").over(w.rowsBetween(-2, 0)).alias("last_three"))


@form("SELECT DISTINCT p_brand, p_size FROM part")
def q32_distinct(t):
    return t("part").select("p_brand", "p_size").distinct()


@form("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def q32_distinct_on(t):
    return t("orders").distinct_on(["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


def q33_order_by(spark, sf_dir):
    """Every row in order, nulls last, with its place: numbered by range partitions, so no task sees all rows."""
    g = Guard(spark)
    docs, labels = (g.table(read(spark, sf_dir, name), name, alias) for name, alias in (("documents", "d"), ("labels", "l")))
    both = docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(("d.doc_id", "doc_id"), "quality")
    ordered = both.order_by("quality", "doc_id").to_df()
    return dense_index(ordered, [F.col("quality").asc_nulls_last(), F.col("doc_id").asc()], 1, "place").select("place", "doc_id")


Q["q33_order_by"] = q33_order_by
SQL["q33_order_by"] = f"SELECT row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id) AS place, doc_id FROM ({_LEFT})"


@form("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def q34_limit_offset(t):
    return t("orders").order_by(F.desc("o_totalprice"), F.asc("o_orderkey")).offset(5).limit(10).select("o_orderkey", "o_totalprice")


def q36_user_function(spark, sf_dir):
    """A registered vectorized function, admitted by name."""

    @F.pandas_udf("double")
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    spark.udf.register("net_price", net)
    g = Guard(spark)
    lines = g.table(read(spark, sf_dir, "lineitem"), "lineitem", "l")
    return lines.select("l_orderkey", "l_linenumber", F.expr("cast(floor(net_price(l_extendedprice, l_discount)) as bigint)").alias("net")).to_df()


Q["q36_user_function"] = q36_user_function
SQL["q36_user_function"] = "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount))::BIGINT AS net FROM lineitem"


@form("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    lines = t("lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return lines.group_by("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
