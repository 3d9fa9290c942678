"""Policies as tables: reading, normalizing, auditing and applying them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from guardframe.scratch import durable

#: Fixed values of the configuration format and its defaults.
VERSION, MAX_DATABASES, MAX_NAME = "1.0", 50, 31
DEFAULTS = {"readOnly": "yes", "statementTimeoutMs": 5000, "maxRows": 200, "maxPayloadKiloBytes": 64, "mode": "pseudonymize", "strategy": "randomized"}
ALLOWED = {"readOnly": ("yes", "no unsafe"), "mode": ("pseudonymize",), "strategy": ("deterministic", "randomized"), "type": ("postgres",)}
TOP_KEYS = ("version", "safetyPolicy", "databases")
POLICY_KEYS = ("readOnly", "statementTimeoutMs", "maxRows", "maxPayloadKiloBytes", "columnPolicy")
DATABASE_KEYS = ("type", "connectionName", "host", "port", "databaseName", "username", "options", "safetyPolicy", "sensitiveColumns", "safeFunctions")

_POLICY = "struct<readOnly:string,statementTimeoutMs:bigint,maxRows:bigint,maxPayloadKiloBytes:bigint,columnPolicy:struct<mode:string,strategy:string>>"
_DATABASE = f"struct<type:string,connectionName:string,host:string,port:bigint,databaseName:string,username:string,options:string,safetyPolicy:{_POLICY},sensitiveColumns:array<string>,safeFunctions:array<string>>"
CONFIG = f"version string, safetyPolicy {_POLICY}, databases array<{_DATABASE}>"


@dataclass
class Policy:
    connections: DataFrame
    column_rules: DataFrame
    function_rules: DataFrame


def load_policy(spark: SparkSession, path: str, lines: bool = False) -> Policy:
    """The rule tables of JSON configurations, one a file or one a line; another version or too many databases is an error."""
    raw = spark.read.schema(CONFIG).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    bad = raw.where((F.coalesce("version", F.lit("")) != VERSION) | (F.size("databases") > MAX_DATABASES))
    if not bad.isEmpty():
        raise ValueError(f"a configuration is not of version {VERSION}, or has over {MAX_DATABASES} databases")
    each = raw.select("safetyPolicy", F.explode("databases").alias("db"))
    paths = lambda c: each.select(F.col("db.connectionName").alias("conn"), F.explode(f"db.{c}").alias("path"))
    connections = each.select(
        F.col("db.connectionName").alias("conn"), "db.type", "db.host", "db.port", "db.databaseName", "db.username",
        F.col("db.safetyPolicy").alias("own"), F.col("safetyPolicy").alias("global"),
    )
    return Policy(effective_policy(connections), normalize_column_rules(paths("sensitiveColumns")), normalize_function_rules(paths("safeFunctions")))


def _normalized(paths: DataFrame, parts: int, names: list[str]) -> DataFrame:
    """Rules of parts or parts + 1 non-empty, lower-cased names, grouped by all but the schema; others are left out."""
    split = F.split(F.lower("path"), r"\.")
    n = F.size("p")
    kept = paths.withColumn("p", split).where(n.isin(parts, parts + 1) & F.forall("p", lambda x: x != ""))
    last = [F.element_at("p", k - parts).alias(c) for k, c in enumerate(names)]
    rules = kept.select("conn", *last, F.when(n == parts + 1, F.col("p")[0]).alias("schema"))
    return rules.groupBy("conn", *names).agg(
        F.array_sort(F.collect_set("schema")).alias("schemas"), F.bool_or(F.col("schema").isNull()).alias("is_global")
    )


def normalize_column_rules(paths: DataFrame) -> DataFrame:
    """(conn, table, col, schemas, is_global) from paths(conn, path) of [schema.]table.column."""
    return _normalized(paths, 2, ["table", "col"])


def normalize_function_rules(paths: DataFrame) -> DataFrame:
    """(conn, name, schemas, is_global) from paths(conn, path) of [schema.]function."""
    return _normalized(paths, 1, ["name"])


def effective_policy(connections: DataFrame) -> DataFrame:
    """connections with each policy field from `own`, else `global`, else the default."""
    pick = lambda f, d: F.coalesce(F.col(f"own.{f}"), F.col(f"global.{f}"), F.lit(d))
    return connections.withColumns(
        {
            "read_only": pick("readOnly", DEFAULTS["readOnly"]) == "yes",
            "statement_timeout_ms": pick("statementTimeoutMs", DEFAULTS["statementTimeoutMs"]).cast("long"),
            "max_rows": pick("maxRows", DEFAULTS["maxRows"]).cast("long"),
            "max_payload_bytes": (pick("maxPayloadKiloBytes", DEFAULTS["maxPayloadKiloBytes"]) * 1024).cast("long"),
            "mode": pick("columnPolicy.mode", DEFAULTS["mode"]),
            "strategy": pick("columnPolicy.strategy", DEFAULTS["strategy"]),
        }
    ).drop("own", "global")


def audit_policy_config(configs: DataFrame) -> DataFrame:
    """(path, json_path, rule, value): every violation in configs(path, json), in one pass over any number of files."""
    c = configs.select("path", "json", F.from_json("json", CONFIG).alias("c"))
    row = lambda df, at, rule, value: df.select("path", at.alias("json_path"), F.lit(rule).alias("rule"), value.cast("string").alias("value"))
    db = c.select("path", "json", F.posexplode("c.databases").alias("i", "db"))
    raw = F.expr("get_json_object(json, concat('$.databases[', i, ']'))")
    at = F.concat(F.lit("$.databases["), F.col("i").cast("string"), F.lit("]"))
    unknown = lambda df, text, keys, where: row(
        df.withColumn("k", F.explode(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, keys))))), where, "unknown_key", F.col("k")
    )
    found = [
        row(c.where(F.coalesce("c.version", F.lit("")) != VERSION), F.lit("$.version"), "version", F.col("c.version")),
        row(c.where(F.size("c.databases") > MAX_DATABASES), F.lit("$.databases"), "too_many_databases", F.size("c.databases")),
        unknown(c, F.col("json"), TOP_KEYS, F.lit("$")),
        unknown(c, F.get_json_object("json", "$.safetyPolicy"), POLICY_KEYS, F.lit("$.safetyPolicy")),
        unknown(db, raw, DATABASE_KEYS, at),
        row(db.where(F.coalesce("db.type", F.lit("")) != "postgres"), at, "type", F.col("db.type")),
        row(db.where(F.octet_length("db.connectionName") > MAX_NAME), at, "long_name", F.col("db.connectionName")),
        row(db.where((F.col("db.port") > 65535) | (F.col("db.port") < 0)), at, "port", F.col("db.port")),
    ]
    for df, base, where in ((c, "c.safetyPolicy", F.lit("$.safetyPolicy")), (db, "db.safetyPolicy", at)):
        found += [
            row(df.where(~F.col(f"{base}.readOnly").isin(*ALLOWED["readOnly"])), where, "readOnly", F.col(f"{base}.readOnly")),
            row(df.where(~F.col(f"{base}.columnPolicy.mode").isin(*ALLOWED["mode"])), where, "mode", F.col(f"{base}.columnPolicy.mode")),
            row(df.where(~F.col(f"{base}.columnPolicy.strategy").isin(*ALLOWED["strategy"])), where, "strategy", F.col(f"{base}.columnPolicy.strategy")),
            row(df.where(F.col(f"{base}.maxPayloadKiloBytes") > (1 << 32) // 1024), where, "payload_overflow", F.col(f"{base}.maxPayloadKiloBytes")),
        ]
    for c_name, least in (("sensitiveColumns", 2), ("safeFunctions", 1)):
        part = db.select("path", "i", F.explode(f"db.{c_name}").alias("p")).withColumn("s", F.split("p", r"\."))
        bad = part.where(~F.size("s").isin(least, least + 1) | F.exists("s", lambda x: x == ""))
        found.append(row(bad, at, "path", F.col("p")))
    named = db.withColumn("n", F.count("*").over(W.partitionBy("path", F.lower("db.connectionName"))))
    found.append(row(named.where("n > 1 and db.connectionName is not null"), at, "duplicate_name", F.col("db.connectionName")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _matches(schema: Column, loose: bool) -> Column:
    """Whether a rule that was found applies; loose: a missing schema matches any rule."""
    listed = F.array_contains("schemas", F.lower(schema))
    applies = F.col("is_global") | (schema.isNull() if loose else F.lit(False)) | F.coalesce(listed, F.lit(False))
    return F.when(F.col("is_global").isNotNull(), applies).otherwise(F.lit(False))


def _of(rules: DataFrame, conn: str | None) -> DataFrame:
    return rules if conn is None else rules.where(F.lower("conn") == conn.lower())


def classify_columns(columns: DataFrame, rules: DataFrame, conn: str | None = None, in_place: bool = False) -> DataFrame:
    """columns(schema, table, column) with `sensitive` and `col_id`, by rules(conn, table, col, schemas, is_global).

    A connection's rules count alone: those of conn, or, without one, those of each row's
    own conn if columns has that. Only where neither is given do all rules count. in_place
    sends the rules to the columns, which stay as they are dealt: for rules that are written
    by hand, and columns that are many of few names.
    """
    own = conn is None and "conn" in columns.columns and "conn" in rules.columns
    merged = [F.flatten(F.collect_set("schemas")).alias("schemas"), F.max("is_global").alias("is_global")]
    r = _of(rules, conn).groupBy(*(["conn"] if own else []), "table", "col").agg(*merged)
    r = r.select(*([F.col("conn").alias("_conn")] if own else []), F.col("table").alias("_t"), F.col("col").alias("_c"), "schemas", "is_global")
    on = (F.lower("table") == F.col("_t")) & (F.lower("column") == F.col("_c"))
    joined = columns.join(F.broadcast(r) if in_place else r, on & (F.col("conn") == F.col("_conn")) if own else on, "left")
    col_id = F.lower(F.concat_ws(".", "schema", "table", "column"))
    return joined.select(*columns.columns, _matches(F.col("schema"), True).alias("sensitive"), col_id.alias("col_id"))


def classify_functions(calls: DataFrame, builtin: DataFrame, rules: DataFrame, conn: str | None = None, in_place: bool = False) -> DataFrame:
    """calls(schema, name) with `safe`: a built-in name in any schema, or a rule of the connection that is global or lists the schema; conn and in_place as in classify_columns."""
    own = conn is None and "conn" in calls.columns and "conn" in rules.columns
    b = builtin.select(F.lower("name").alias("_b")).distinct()
    r = _of(rules, conn).groupBy(*(["conn"] if own else []), "name").agg(F.flatten(F.collect_set("schemas")).alias("schemas"), F.max("is_global").alias("is_global"))
    r = r.select(*([F.col("conn").alias("_conn")] if own else []), F.col("name").alias("_n"), "schemas", "is_global")
    on = F.lower("name") == F.col("_n")
    if in_place:
        b, r = F.broadcast(b), F.broadcast(r)
    joined = calls.join(b, F.lower("name") == F.col("_b"), "left").join(r, on & (F.col("conn") == F.col("_conn")) if own else on, "left")
    return joined.select(*calls.columns, (F.col("_b").isNotNull() | _matches(F.col("schema"), False)).alias("safe"))


def describe_table(df: DataFrame, rules: DataFrame, table: str, schema: str | None = None, conn: str | None = None) -> DataFrame:
    """(column, type, nullable, sensitive) of a table, without data."""
    fields = [(schema, table, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    columns = df.sparkSession.createDataFrame(fields, "schema string, table string, column string, type string, nullable boolean")
    return classify_columns(columns, rules, conn).select("column", "type", "nullable", "sensitive")


def audit_read_only_roles(roles: DataFrame, grants: DataFrame) -> DataFrame:
    """(role, is_safe): no power over the cluster, and no writing grant on any table."""
    powers = ["super", "createdb", "createrole", "replication", "bypassrls"]
    writes = grants.where(F.upper("privilege").isin("INSERT", "UPDATE", "DELETE", "TRUNCATE") & F.col("kind").isin("table", "partitioned table"))
    writers = writes.select(F.col("role").alias("_w")).distinct()
    power = F.lit(False)
    for p in powers:
        power |= F.coalesce(F.col(p), F.lit(False))
    joined = roles.join(writers, F.col("role") == F.col("_w"), "left")
    return joined.select("role", (~power & F.col("_w").isNull()).alias("is_safe"))


def snapshot_diff_with_rename(new: DataFrame, old: DataFrame, key: str, fields: list[str], identity: list[str]) -> DataFrame:
    """(key, action, old_key): KEEP, CHANGED, RENAME, NEW or REMOVED, comparing two snapshots.

    A key in both is kept or changed by its fields. Where exactly one unmatched row of each
    side has an identity, the row was renamed.
    """
    o = old.select(F.col(key).alias("_ok"), F.struct(*fields).alias("_of"), F.struct(*identity).alias("_oi"))
    n = new.select(F.col(key).alias("_nk"), F.struct(*fields).alias("_nf"), F.struct(*identity).alias("_ni"))
    both = n.join(o.hint("merge"), F.col("_nk") == F.col("_ok"), "full_outer")
    same = both.where("_nk is not null and _ok is not null").select(
        F.col("_nk").alias("key"), F.when(F.col("_nf").eqNullSafe(F.col("_of")), "KEEP").otherwise("CHANGED").alias("action"), F.col("_ok").alias("old_key")
    )
    fresh = both.where("_ok is null").select("_nk", "_ni", F.count("*").over(W.partitionBy("_ni")).alias("_nc"))
    gone = both.where("_nk is null").select("_ok", "_oi", F.count("*").over(W.partitionBy("_oi")).alias("_oc"))
    # the counts first: only single rows of an identity meet
    pairs = fresh.where("_nc = 1").join(gone.where("_oc = 1").hint("merge"), F.col("_ni").eqNullSafe(F.col("_oi"))).select("_nk", "_ok")
    renamed = pairs.select(F.col("_nk").alias("key"), F.lit("RENAME").alias("action"), F.col("_ok").alias("old_key"))
    added = fresh.join(pairs.select("_nk").hint("merge"), "_nk", "left_anti").select(F.col("_nk").alias("key"), F.lit("NEW").alias("action"), F.lit(None).cast(old.schema[key].dataType).alias("old_key"))
    removed = gone.join(pairs.select("_ok").hint("merge"), "_ok", "left_anti").select(F.lit(None).cast(new.schema[key].dataType).alias("key"), F.lit("REMOVED").alias("action"), F.col("_ok").alias("old_key"))
    return same.unionByName(renamed).unionByName(added).unionByName(removed)


def snapshot_history(snapshots: DataFrame, version: str, key: str, fields: list[str], identity: list[str]) -> DataFrame:
    """(first_version, first_key, key, *fields, from_version, to_version): histories over any number of numbered snapshots.

    A row follows that of the version before with its key or, where exactly one unmatched
    row of each side has an identity, is that one renamed. All versions are matched at
    once. The row that a history began with names it, and is found by pointer jumping: each
    round doubles how far back the pointers go. Versions in a row with equal key and fields
    make one interval; to_version is the first that does not have it, null if the last does.
    Keys are not null, and unique in a version. All tables here grow with the snapshots, so
    none is broadcast, however small it is thought to be.
    """
    rows = snapshots.select(F.col(version).cast("long").alias("_v"), F.col(key).alias("_k"), F.struct(*fields).alias("_f"), F.struct(*identity).alias("_i"))
    rows = durable(rows)
    least, most = rows.agg(F.min("_v"), F.max("_v")).first()
    before = rows.where(F.col("_v") < F.lit(most)).select((F.col("_v") + 1).alias("_v"), F.col("_k"), F.col("_i"))
    same = rows.join(before.hint("merge"), ["_v", "_k"]).select("_v", "_k", F.col("_k").alias("_up"))
    alone = lambda df, other: df.join(other.select("_v", "_k").hint("merge"), ["_v", "_k"], "left_anti").withColumn("_n", F.count("*").over(W.partitionBy("_v", "_i"))).where("_n = 1")
    fresh = alone(rows.where(F.col("_v") > F.lit(least)).select("_v", "_k", "_i"), before)
    gone = alone(before, rows).select(F.col("_v").alias("_gv"), F.col("_i").alias("_gi"), F.col("_k").alias("_up"))
    renamed = fresh.join(gone.hint("merge"), (F.col("_v") == F.col("_gv")) & F.col("_i").eqNullSafe(F.col("_gi"))).select("_v", "_k", "_up")
    pointers = rows.select("_v", "_k").join(same.union(renamed).hint("merge"), ["_v", "_k"], "left")
    # a row without one before points to itself
    pointers = durable(pointers.select("_v", "_k", F.when(F.col("_up").isNull(), F.col("_v")).otherwise(F.col("_v") - 1).alias("_rv"), F.coalesce("_up", "_k").alias("_rk")))
    for _ in range(((most - least) if most is not None else 0).bit_length()):
        ahead = pointers.select(F.col("_v").alias("_rv"), F.col("_k").alias("_rk"), F.col("_rv").alias("_v2"), F.col("_rk").alias("_k2"))
        pointers = durable(pointers.join(ahead.hint("merge"), ["_rv", "_rk"]).select("_v", "_k", F.col("_v2").alias("_rv"), F.col("_k2").alias("_rk")))
    history = W.partitionBy("_rv", "_rk").orderBy("_v")
    state = F.struct("_k", "_f")
    new = ~state.eqNullSafe(F.lag(state).over(history)) | F.lag("_v").over(history).isNull()
    spans = rows.join(pointers.hint("merge"), ["_v", "_k"]).withColumn("_new", new.cast("long")).withColumn("_span", F.sum("_new").over(history))
    spans = spans.groupBy("_rv", "_rk", "_span").agg(F.first("_k").alias("_k"), F.first("_f").alias("_f"), F.min("_v").alias("from_version"), F.max("_v").alias("_to"))
    to = F.when(F.col("_to") < F.lit(most), F.col("_to") + 1).alias("to_version")
    return spans.select(F.col("_rv").alias("first_version"), F.col("_rk").alias("first_key"), F.col("_k").alias(key), "_f.*", "from_version", to)


def table_source(spark: SparkSession, path_or_name: str, alias: str) -> DataFrame:
    """A base relation by Parquet path or catalog name, under an alias."""
    df = spark.read.parquet(path_or_name) if "/" in path_or_name else spark.table(path_or_name)
    return df.alias(alias)


def jdbc_source(spark: SparkSession, url: str, table: str, alias: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A base relation of a database; partition (column, lower, upper, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load().alias(alias)
