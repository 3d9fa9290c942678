"""The allowed functions over table columns, by kind, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from guardframe.functions.allowed import ALLOWED, call
from guardframe.plans.token_queries import read
from guardframe.sources.policy import classify_functions, normalize_function_rules

Q: dict = {}
SQL: dict[str, str] = {}


def over(table: str, key: str, sql: dict[str, str], tail: str = ""):
    """A query of named columns over a table; f() gives {name: Column}, sql their expressions in DuckDB."""

    def add(f):
        def run(spark, sf_dir):
            return read(spark, sf_dir, table).select(key, *[c.alias(n) for n, c in f().items()])

        Q[f.__name__] = run
        SQL[f.__name__] = f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {table} {tail}"
        return f

    return add


def _r(x):
    return F.round(x, 6)


_X = "(c_acctbal / 20000)"


@over("customer", "c_custkey", {
    "abs_": "round(abs(c_acctbal), 6)", "acosd_": f"round(degrees(acos({_X})), 6)", "asind_": f"round(degrees(asin({_X})), 6)", "atand_": f"round(degrees(atan({_X})), 6)",
    "acosh_": f"round(acosh(2 + {_X}), 6)", "asinh_": f"round(asinh({_X}), 6)", "atanh_": f"round(atanh({_X}), 6)", "atan2d_": f"round(degrees(atan2({_X}, 0.5)), 6)", "cbrt_": "round(cbrt(abs(c_acctbal)), 6)",
    "ceil_": "ceil(c_acctbal)::BIGINT", "floor_": "floor(c_acctbal)::BIGINT", "cosd_": "round(cos(radians(c_custkey)), 6)", "sind_": "round(sin(radians(c_custkey)), 6)", "tand_": "round(tan(radians(c_custkey % 60)), 6)",
    "cosh_": f"round(cosh({_X}), 6)", "sinh_": f"round(sinh({_X}), 6)", "tanh_": f"round(tanh({_X}), 6)", "exp_": f"round(exp({_X}), 6)", "ln_": "round(ln(c_custkey + 1), 6)", "log_": "round(log10(c_custkey + 1), 6)",
    "log2_": "round(ln(c_custkey + 1) / ln(2), 6)", "gcd_": "gcd(c_custkey, c_nationkey)::BIGINT", "lcm_": "lcm(c_custkey, c_nationkey)::BIGINT", "greatest_": "greatest(c_custkey, 700)", "least_": "least(c_custkey, 700)",
    "div_": "(c_custkey // 7)::BIGINT", "mod_": "c_custkey % 7", "power_": "power(c_nationkey, 2)::DOUBLE", "sqrt_": "round(sqrt(c_custkey), 6)", "sign_": "sign(c_acctbal)::DOUBLE", "trunc_": "trunc(c_acctbal)::BIGINT",
    "round_even_": "round_even(c_custkey / 2.0, 0)::DOUBLE",
})
def fn_math():
    b, k, n, x = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal") / 20000
    return {
        "abs_": _r(call("abs", b)), "acosd_": _r(call("acosd", x)), "asind_": _r(call("asind", x)), "atand_": _r(call("atand", x)), "acosh_": _r(call("acosh", x + 2)), "asinh_": _r(call("asinh", x)),
        "atanh_": _r(call("atanh", x)), "atan2d_": _r(call("atan2d", x, F.lit(0.5))), "cbrt_": _r(call("cbrt", F.abs(b))), "ceil_": call("ceil", b), "floor_": call("floor", b), "cosd_": _r(call("cosd", k)),
        "sind_": _r(call("sind", k)), "tand_": _r(call("tand", k % 60)), "cosh_": _r(call("cosh", x)), "sinh_": _r(call("sinh", x)), "tanh_": _r(call("tanh", x)), "exp_": _r(call("exp", x)), "ln_": _r(call("ln", k + 1)),
        "log_": _r(call("log", k + 1)), "log2_": _r(call("log", F.lit(2.0), k + 1)), "gcd_": call("gcd", k, n), "lcm_": call("lcm", k, n.cast("long")), "greatest_": call("greatest", k, F.lit(700)), "least_": call("least", k, F.lit(700)),
        "div_": call("div", k, F.lit(7)), "mod_": call("mod", k, F.lit(7)), "power_": call("power", n, F.lit(2)), "sqrt_": _r(call("sqrt", k)), "sign_": call("sign", b), "trunc_": call("trunc", b), "round_even_": call("round", k / 2),
    }


@over("part", "p_partkey", {
    "ascii_": "ascii(p_brand)", "bits": "bit_length(p_name)", "octets": "octet_length(encode(p_name))", "chars": "length(p_name)", "trimmed": "trim(p_brand, 'B')", "concat_": "concat(p_brand, NULL, '-', p_size)", "ws": "concat_ws('/', p_brand, p_type)",
    "hex_": "lower(hex(p_brand))", "initcap_": "upper(p_type[1]) || lower(p_type[2:])", "left_": "left(p_name, 3)", "left_but": "left(p_name, -2)", "right_": "right(p_name, 3)", "right_but": "right(p_name, -2)", "lpad_": "lpad(p_size::VARCHAR, 5, '0')", "rpad_": "rpad(p_brand, 12, '.')",
    "pos": "instr(p_name, 'r')", "rep": "repeat(p_brand, 2)", "replaced": "replace(p_type, 'A', 'x')", "rev": "reverse(p_name)", "part_": "split_part(p_name, ' ', 1)", "parts": "string_split(p_name, ' ')", "sub": "substring(p_name, 2, 3)", "hexed": "lower(to_hex(p_size))",
    "first_vowel": "regexp_replace(p_type, '[AEIOU]', '*')", "all_vowels": "regexp_replace(p_type, '[AEIOU]', '*', 'g')", "ilike_": "p_type ILIKE '%steel%'", "over_": "'Xx' || substring(p_brand, 3)", "chr_": "chr(65 + p_size % 26)", "split_": "regexp_split_to_array(p_name, '[aeiou]')",
    "byte0": "ascii(p_brand)", "bit0": "ascii(p_brand) % 2", "byte_set": "'a' || substring(p_brand, 2)", "bit_set": "chr(ascii(p_brand) | 1) || substring(p_brand, 2)", "plain": "translate(p_brand, 'é', 'e')", "fmt": "p_brand || ' is \"' || p_type || '\"'", "match_": "CASE WHEN regexp_matches(p_name, '[0-9]+') THEN [regexp_extract(p_name, '[0-9]+')] END",
})
def fn_string():
    b, n, t, s = F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.col("p_size")
    raw = F.encode("p_brand", "utf-8")
    return {
        "ascii_": call("ascii", b), "bits": call("bit_length", n), "octets": call("octet_length", n), "chars": call("char_length", n), "trimmed": call("btrim", b, F.lit("B")), "concat_": call("concat", b, F.lit(None).cast("string"), F.lit("-"), s.cast("string")), "ws": call("concat_ws", "/", b, t),
        "hex_": call("encode", raw, "hex"), "initcap_": F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2)))), "left_": call("left", n, F.lit(3)), "left_but": call("left", n, F.lit(-2)), "right_": call("right", n, F.lit(3)), "right_but": call("right", n, F.lit(-2)), "lpad_": call("lpad", s.cast("string"), 5, "0"), "rpad_": call("rpad", b, 12, "."),
        "pos": call("strpos", n, F.lit("r")), "rep": call("repeat", b, 2), "replaced": call("replace", t, F.lit("A"), F.lit("x")), "rev": call("reverse", n), "part_": call("split_part", n, " ", 1), "parts": call("string_to_array", n, " "), "sub": call("substring", n, 2, 3), "hexed": call("to_hex", s),
        "first_vowel": call("regexp_replace", t, "[AEIOU]", "*"), "all_vowels": call("regexp_replace", t, "[AEIOU]", "*", "g"), "ilike_": call("ilike", t, F.lit("%steel%")), "over_": call("overlay", b, F.lit("Xx"), 1, 2), "chr_": call("chr", (s % 26 + 65).cast("long")), "split_": call("regexp_split_to_array", n, "[aeiou]"),
        "byte0": call("get_byte", raw, 0), "bit0": call("get_bit", raw, 0), "byte_set": call("set_byte", raw, 0, 97).cast("string"), "bit_set": call("set_bit", raw, 0, 1).cast("string"), "plain": call("to_ascii", b), "fmt": call("format", "%s is %I", b, t), "match_": call("regexp_match", n, "[0-9]+"),
    }


@over("orders", "o_orderkey", {
    "y": "year(o_orderdate)::INTEGER", "dow": "dayofweek(o_orderdate)::INTEGER + 1", "month_": "epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP)", "made": "make_date(year(o_orderdate), month(o_orderdate), 1)", "time_": "strftime(o_orderdate, '%H:%M:%S')",
    "char_": "strftime(o_orderdate, '%Y-%m-%d')", "date_": "strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::DATE", "stamp": "epoch_us(make_timestamp(o_orderkey::BIGINT * 1000000))", "back": "epoch_us(o_orderdate)", "number_": "(o_orderkey % 100)::DECIMAL(18, 0)::BIGINT",
    "zone": "epoch_us(timezone('Asia/Tokyo', o_orderdate::TIMESTAMP AT TIME ZONE 'UTC'))",
})
def fn_datetime():
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    parts = [F.year(d), F.month(d), F.dayofmonth(d), F.hour(d), F.minute(d), F.second(d)]
    return {
        "y": call("extract", "year", d), "dow": call("date_part", F.lit("dow"), d), "month_": micros(call("date_trunc", "month", d)), "made": call("make_date", F.year(d), F.month(d), F.lit(1)), "time_": call("make_time", *parts[3:]),
        "char_": call("to_char", d, "YYYY-MM-DD"), "date_": call("to_date", F.date_format(d, "yyyy-MM-dd")), "stamp": micros(call("to_timestamp", k)), "back": micros(call("make_timestamptz", *parts[:5], F.second(d) + F.date_format(d, "SSSSSS").cast("decimal(8,0)") / F.lit(1000000).cast("decimal(8,0)"))), "number_": call("to_number", (k % 100).cast("string"), "99").cast("long"),
        "zone": micros(call("timezone", "Asia/Tokyo", d.cast("timestamp_ntz"))),
    }


def fn_aggregate(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    v, k = F.col("o_totalprice"), F.col("o_custkey")
    return o.groupBy("o_orderstatus").agg(
        F.sort_array(call("array_agg", k % 5)).alias("agg"), F.round(call("avg", v), 4).alias("mean"), call("count", v).alias("n"), call("max", v).alias("most"), call("min", v).alias("least"), F.round(call("sum", v), 2).alias("total"),
        *[F.round(call(f, v) / 1000, 4).alias(f) for f in ("stddev", "stddev_pop", "stddev_samp")], *[F.round(call(f, v) / 1e9, 6).alias(f) for f in ("var_pop", "var_samp", "variance")],
        F.length(call("string_agg", F.col("o_orderpriority"), F.lit(","))).alias("joined"), F.json_array_length(call("json_agg", k)).alias("listed"),
    )


Q["fn_aggregate"] = fn_aggregate
SQL["fn_aggregate"] = """SELECT o_orderstatus, list_sort(list(o_custkey % 5)) AS agg, round(avg(o_totalprice), 4) AS mean, count(*) AS n, max(o_totalprice) AS most, min(o_totalprice) AS least, round(sum(o_totalprice), 2) AS total,
round(stddev(o_totalprice) / 1000, 4) AS stddev, round(stddev_pop(o_totalprice) / 1000, 4) AS stddev_pop, round(stddev_samp(o_totalprice) / 1000, 4) AS stddev_samp, round(var_pop(o_totalprice) / 1e9, 6) AS var_pop, round(var_samp(o_totalprice) / 1e9, 6) AS var_samp,
round(variance(o_totalprice) / 1e9, 6) AS variance, length(string_agg(o_orderpriority, ',')) AS joined, count(*) AS listed FROM orders GROUP BY o_orderstatus"""


_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@over("orders", "o_orderkey", {
    "cume": f"round(cume_dist() OVER {_W}, 6)", "dense": f"dense_rank() OVER {_W}::INTEGER", "first_": f"first_value(o_orderkey) OVER {_W}", "lag_": f"lag(o_orderkey) OVER {_W}", "last_": "last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "lead_": f"lead(o_orderkey, 2) OVER {_W}", "second": f"nth_value(o_orderkey, 2) OVER {_W}", "third": f"ntile(3) OVER {_W}::INTEGER", "pct": f"round(percent_rank() OVER {_W}, 6)", "rank_": f"rank() OVER {_W}::INTEGER", "row_": f"row_number() OVER {_W}::INTEGER",
})
def fn_window():
    w, k = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), F.col("o_orderkey")
    return {
        "cume": _r(call("cume_dist").over(w)), "dense": call("dense_rank").over(w), "first_": call("first_value", k).over(w), "lag_": call("lag", k).over(w), "last_": call("last_value", k).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "lead_": call("lead", k, 2).over(w), "second": call("nth_value", k, 2).over(w), "third": call("ntile", 3).over(w), "pct": _r(call("percent_rank").over(w)), "rank_": call("rank").over(w), "row_": call("row_number").over(w),
    }


_A = "[label, label + 1, label]"


@over("embeddings", "vec_id", {
    "appended": f"list_append({_A}, 9)", "cat": f"list_concat({_A}, [7])", "dims": "'[1:3]'", "filled": "[label, label]", "n": "len(embedding)::INTEGER", "lower_": "1", "depth": "1", "at": f"list_position({_A}, label + 1)::INTEGER", "none_": "NULL::INTEGER",
    "places": "[1, 3]", "pre": f"list_prepend(0, {_A})", "removed": "[label + 1]", "swapped": "[5, label + 1, 5]", "json_": "'[' || label || ',' || (label + 1) || ',' || label || ']'", "text_": "label || '-' || (label + 1) || '-' || label", "card": "3",
})
def fn_array():
    x = F.col("label")
    a = F.array(x, x + 1, x)
    return {
        "appended": call("array_append", a, F.lit(9)), "cat": call("array_cat", a, F.array(F.lit(7))), "dims": call("array_dims", a), "filled": call("array_fill", x, 2), "n": call("array_length", F.col("embedding")), "lower_": call("array_lower", a), "depth": call("array_ndims", a, 1),
        "at": call("array_position", a, x + 1), "none_": call("array_position", a, x + 5), "places": call("array_positions", a, x), "pre": call("array_prepend", a, F.lit(0)), "removed": call("array_remove", a, x), "swapped": call("array_replace", a, x, F.lit(5)),
        "json_": call("array_to_json", a), "text_": call("array_to_string", a.cast("array<string>"), "-"), "card": call("cardinality", a),
    }


_J = "('{\"a\":{\"b\":[1,' || event_id || ']},\"t\":\"' || event_type || '\",\"z\":null}')"


@over("events", "event_id", {
    "n": "2", "arr": "'[' || event_id || ',\"' || event_type || '\"]'", "obj": "'{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}'", "path_": "event_id::VARCHAR", "made": "'{\"' || event_type || '\":\"v\"}'", "kind": "'object'", "kind_b": "'array'", "kind_t": "'string'",
    "deleted": "'{\"a\":{\"b\":[1,' || event_id || ']},\"z\":null}'", "cut": "'{\"a\":{\"b\":[' || event_id || ']},\"t\":\"' || event_type || '\",\"z\":null}'", "ins": "'{\"a\":{\"b\":[9,1,' || event_id || ']},\"t\":\"' || event_type || '\",\"z\":null}'", "put": "'{\"a\":{\"b\":[1,' || event_id || ']},\"t\":7,\"z\":null}'",
    "bare": "'{\"a\":{\"b\":[1,' || event_id || ']},\"t\":\"' || event_type || '\"}'", "row_": "'{\"event_id\":' || event_id || '}'",
})
def fn_json():
    k, t = F.col("event_id"), F.col("event_type")
    j = F.concat(F.lit('{"a":{"b":[1,'), k.cast("string"), F.lit(']},"t":"'), t, F.lit('","z":null}'))
    b = call("jsonb_extract_path", j, "a", "b")
    return {
        "n": call("jsonb_array_length", b), "arr": call("json_build_array", k, t), "obj": call("json_build_object", F.lit("id"), k, F.lit("t"), t), "path_": call("json_extract_path", j, "a", "b", "1"), "made": call("json_object", F.array(t), F.array(F.lit("v"))), "kind": call("json_typeof", j), "kind_b": call("json_typeof", b),
        "kind_t": call("json_typeof", F.concat(F.lit('"'), t, F.lit('"'))), "deleted": call("jsonb_delete", j, "t"), "cut": call("jsonb_delete_path", j, ["a", "b", "0"]), "ins": call("jsonb_insert", j, ["a", "b", "0"], F.lit("9")), "put": call("jsonb_set", j, ["t"], F.lit("7")),
        "bare": call("jsonb_strip_nulls", j), "row_": call("row_to_json", F.struct("event_id")),
    }


def fn_json_rows(spark, sf_dir):
    """Functions that give rows: elements, keys and pairs of the events' JSON."""
    e = read(spark, sf_dir, "events")
    j = F.concat(F.lit('{"k":"'), F.col("event_type"), F.lit('"}'))
    two = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(',"x"]'))
    out = e.select("event_id", F.lit("keys").alias("what"), call("jsonb_object_keys", j).alias("v"))
    out = out.union(e.select("event_id", F.lit("text"), call("json_array_elements_text", two)))
    out = out.union(e.select("event_id", F.lit("element"), call("json_array_elements", two)).toDF("event_id", "what", "v").withColumn("v", F.to_json("v")))
    pairs = e.select("event_id", call("json_each_text", j))
    pair = e.select("event_id", call("json_each", j)).select("event_id", F.lit("each"), F.concat("key", F.to_json("value")))
    return out.union(pairs.select("event_id", F.lit("each_text"), F.concat("key", "value"))).union(pair).union(
        e.select("event_id", F.lit("split"), call("regexp_split_to_table", F.col("event_type"), "[aeiou]"))
    ).union(e.select("event_id", F.lit("vowel"), call("regexp_matches", F.col("event_type"), "[aeiou]", "g"))).union(e.select("event_id", F.lit("unnest"), call("unnest", F.array(F.col("event_type")))))


Q["fn_json_rows"] = fn_json_rows
SQL["fn_json_rows"] = """WITH e AS (SELECT * FROM events)
SELECT event_id, 'keys' AS what, 'k' AS v FROM e UNION ALL SELECT event_id, 'text', unnest([event_id::VARCHAR, 'x']) FROM e UNION ALL SELECT event_id, 'element', unnest([event_id::VARCHAR, '"x"']) FROM e
UNION ALL SELECT event_id, 'each_text', 'k' || event_type FROM e UNION ALL SELECT event_id, 'each', 'k"' || event_type || '"' FROM e UNION ALL SELECT event_id, 'split', unnest(regexp_split_to_array(event_type, '[aeiou]')) FROM e
UNION ALL SELECT event_id, 'vowel', unnest(regexp_extract_all(event_type, '[aeiou]')) FROM e UNION ALL SELECT event_id, 'unnest', event_type FROM e"""


@over("lineitem", "l_orderkey, l_linenumber".split(", ")[0], {
    "num": "l_linenumber", "empty_": "l_quantity >= 25", "lo_inc": "true", "hi_inc": "false", "lo_inf": "l_linenumber = 7", "hi_inf": "false", "merged": "least(l_quantity, 10)", "w": "round(abs(l_quantity - 25), 6)", "h": "round(abs(l_tax - 1), 6)",
    "box": "round(abs(l_quantity - 25) * abs(l_tax - 1), 6)", "circle": "round(pi() * l_quantity * l_quantity, 4)", "dia": "2 * l_quantity", "rad": "l_quantity", "cx": "round((l_quantity + 25) / 2, 6)", "tri": "round(l_quantity * l_quantity / 2, 4)", "pts": "3", "nil": "'00000000-0000-0000-0000-000000000000'", "uuids": "36",
})
def fn_range_geometry_uuid():
    q, t = F.col("l_quantity"), F.col("l_tax")
    r = F.struct(F.when(F.col("l_linenumber") != 7, q).alias("lo"), F.lit(25.0).alias("hi"), F.lit(True).alias("lo_inc"), F.lit(False).alias("hi_inc"))
    full = F.struct(q.alias("lo"), F.lit(25.0).alias("hi"), F.lit(True).alias("lo_inc"), F.lit(False).alias("hi_inc"))
    ten = F.struct(F.lit(10.0).alias("lo"), F.lit(12.0).alias("hi"), F.lit(True).alias("lo_inc"), F.lit(False).alias("hi_inc"))
    box = F.struct(q.alias("x1"), t.alias("y1"), F.lit(25.0).alias("x2"), F.lit(1.0).alias("y2"))
    circle = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), q.alias("r"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    triangle = F.array(point(F.lit(0.0), F.lit(0.0)), point(q, F.lit(0.0)), point(F.lit(0.0), q))
    return {
        "num": F.col("l_linenumber"), "empty_": call("isempty", full), "lo_inc": call("lower_inc", r), "hi_inc": call("upper_inc", r), "lo_inf": call("lower_inf", r), "hi_inf": call("upper_inf", r), "merged": call("range_merge", full, ten)["lo"], "w": _r(call("width", box)), "h": _r(call("height", box)),
        "box": _r(call("area", box)), "circle": F.round(call("area", circle, "circle"), 4), "dia": call("diameter", circle), "rad": call("radius", circle), "cx": _r(call("center", box)["x"]), "tri": F.round(call("area", triangle, "polygon"), 4), "pts": call("npoints", triangle), "nil": call("uuid_nil"), "uuids": F.length(call("gen_random_uuid")),
    }


@over("orders", "o_orderkey", {"coalesced": "coalesce(NULL, o_orderpriority)", "nulled": "nullif(o_orderstatus, 'F')", "cast_": "o_orderkey::VARCHAR", "scale_": "2", "least_scale": "CASE WHEN (o_orderkey % 100) = 0 THEN 0 WHEN (o_orderkey % 10) = 0 THEN 1 ELSE 2 END"})
def fn_conditional():
    d = (F.col("o_orderkey") / F.lit(100)).cast("decimal(18,2)")
    return {"coalesced": call("coalesce", F.lit(None), F.col("o_orderpriority")), "nulled": call("nullif", F.col("o_orderstatus"), F.lit("F")), "cast_": call("cast", F.col("o_orderkey"), "string"), "scale_": call("scale", d), "least_scale": call("min_scale", d)}


@over("customer", "c_custkey", {
    "acos_": f"round(acos({_X}), 6)", "asin_": f"round(asin({_X}), 6)", "atan_": f"round(atan({_X}), 6)", "atan2_": f"round(atan2({_X}, 0.5), 6)", "ceiling_": "ceil(c_acctbal)::BIGINT", "cos_": "round(cos(c_custkey), 6)", "sin_": "round(sin(c_custkey), 6)", "tan_": f"round(tan({_X}), 6)",
    "trim_scale_": "CASE WHEN c_custkey % 100 = 0 THEN (c_custkey // 100)::VARCHAR WHEN c_custkey % 10 = 0 THEN (c_custkey // 100) || '.' || (c_custkey // 10 % 10) ELSE (c_custkey // 100) || '.' || lpad((c_custkey % 100)::VARCHAR, 2, '0') END",
})
def fn_more_math():
    b, k, x = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_acctbal") / 20000
    return {
        "acos_": _r(call("acos", x)), "asin_": _r(call("asin", x)), "atan_": _r(call("atan", x)), "atan2_": _r(call("atan2", x, F.lit(0.5))), "ceiling_": call("ceiling", b), "cos_": _r(call("cos", k)), "sin_": _r(call("sin", k)), "tan_": _r(call("tan", x)),
        "trim_scale_": call("trim_scale", (k / F.lit(100)).cast("decimal(18,2)")),
    }


@over("part", "p_partkey", {
    "decoded": "p_brand", "initcap_": "array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_type, ' ')], ' ')", "n": "length(p_name)", "like_": "p_type LIKE '%STEEL%'", "low": "lower(p_type)", "up": "upper(p_name)", "l": "p_size || ' '", "r": "' ' || p_size", "both_": "p_size::VARCHAR",
    "at": "instr(p_name, ' ')",
})
def fn_more_string():
    b, n, t, s = F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))
    return {
        "decoded": call("decode", call("encode", F.encode(b, "utf-8"), "hex"), "hex").cast("string"), "initcap_": call("initcap", t), "n": call("length", n), "like_": call("like", t, F.lit("%STEEL%")), "low": call("lower", t), "up": call("upper", n), "l": call("ltrim", s), "r": call("rtrim", s), "both_": call("trim", s),
        "at": call("position", F.lit(" "), n),
    }


@over("orders", "o_orderkey", {
    "months_": "datediff('month', TIMESTAMP '1970-01-01', o_orderdate)::INTEGER", "days_": "day(o_orderdate)::INTEGER - 1", "later": "epoch_us(o_orderdate + INTERVAL 14 MONTH)", "made": "epoch_us(date_trunc('minute', o_orderdate)::TIMESTAMP)",
})
def fn_more_datetime():
    d = F.col("o_orderdate")
    span = call("age", d, F.lit("1970-01-01").cast("timestamp"))
    made = call("make_timestamp", F.year(d), F.month(d), F.dayofmonth(d), F.hour(d), F.minute(d), F.lit(0))
    later = d.cast("timestamp") + call("make_interval", F.lit(1), F.lit(2))
    return {"months_": span["months"], "days_": span["days"], "later": F.unix_micros(later), "made": F.unix_micros(made.cast("timestamp"))}


@over("events", "event_id", {
    "n": "2", "arr": "'[' || event_id || ',\"' || event_type || '\"]'", "obj": "'{\"id\":' || event_id || '}'", "made": "'{\"' || event_type || '\":\"v\"}'", "kind": "'object'", "row_": "'{\"event_id\":' || event_id || '}'", "list_": "'[' || event_id || ']'", "upper_": "2",
    "pretty": "'{' || chr(10) || '  \"t\" : \"' || event_type || '\"' || chr(10) || '}'",
})
def fn_more_json():
    k, t = F.col("event_id"), F.col("event_type")
    two = call("jsonb_build_array", k, t)
    return {
        "n": call("json_array_length", two), "arr": two, "obj": call("jsonb_build_object", F.lit("id"), k), "made": call("jsonb_object", F.array(t), F.array(F.lit("v"))), "kind": call("jsonb_typeof", call("jsonb_build_object", F.lit("t"), t)), "row_": call("to_json", F.struct("event_id")), "list_": call("to_jsonb", F.array(k)),
        "upper_": call("array_upper", F.array(k, k), 1), "pretty": call("jsonb_pretty", call("jsonb_build_object", F.lit("t"), t)),
    }


def fn_more_rows(spark, sf_dir):
    """The other names of the functions that give rows and of JSON aggregates."""
    e = read(spark, sf_dir, "events")
    j = F.concat(F.lit('{"k":"'), F.col("event_type"), F.lit('"}'))
    two = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(',"x"]'))
    out = e.select("event_id", F.lit("keys").alias("what"), call("json_object_keys", j).alias("v"))
    out = out.union(e.select("event_id", F.lit("text"), call("jsonb_array_elements_text", two)))
    out = out.union(e.select("event_id", F.lit("element"), call("jsonb_array_elements", two)).toDF("event_id", "what", "v").withColumn("v", F.to_json("v")))
    out = out.union(e.select("event_id", call("jsonb_each_text", j)).select("event_id", F.lit("each_text"), F.concat("key", "value")))
    out = out.union(e.select("event_id", call("jsonb_each", j)).select("event_id", F.lit("each"), F.concat("key", F.to_json("value"))))
    by = e.groupBy("event_id").agg(*[call(f, F.col("event_type"), F.col("user_id")).alias(f) for f in ("json_object_agg", "jsonb_object_agg")], call("jsonb_agg", F.col("user_id")).alias("jsonb_agg"))
    for f in ("json_object_agg", "jsonb_object_agg", "jsonb_agg"):
        out = out.union(by.select("event_id", F.lit(f), f))
    return out


Q["fn_more_rows"] = fn_more_rows
SQL["fn_more_rows"] = """SELECT event_id, 'keys' AS what, 'k' AS v FROM events UNION ALL SELECT event_id, 'text', unnest([event_id::VARCHAR, 'x']) FROM events UNION ALL SELECT event_id, 'element', unnest([event_id::VARCHAR, '"x"']) FROM events
UNION ALL SELECT event_id, 'each_text', 'k' || event_type FROM events UNION ALL SELECT event_id, 'each', 'k"' || event_type || '"' FROM events
UNION ALL SELECT event_id, f, '{"' || event_type || '":' || user_id || '}' FROM events, (SELECT 'json_object_agg' AS f UNION ALL SELECT 'jsonb_object_agg') UNION ALL SELECT event_id, 'jsonb_agg', '[' || user_id || ']' FROM events"""


def fn_allow_list(spark, sf_dir):
    """Which of the functions that a log of calls names are on the list, in any case and schema."""
    names = F.element_at(F.array(*map(F.lit, [*ALLOWED, "now", "random", "setseed"])), (F.col("o_orderkey") % (len(ALLOWED) + 3) + 1).cast("int"))
    calls = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "pg_catalog").alias("schema"), F.upper(names).alias("name"))
    builtin = spark.createDataFrame([(n,) for n in ALLOWED], "name string")
    none = normalize_function_rules(spark.createDataFrame([], "conn string, path string"))
    return classify_functions(calls, builtin, none).select("o_orderkey", "safe")


Q["fn_allow_list"] = fn_allow_list
SQL["fn_allow_list"] = f"SELECT o_orderkey, o_orderkey % {len(ALLOWED) + 3} < {len(ALLOWED)} AS safe FROM orders"
