import pytest
from pyspark.sql import Window as W, functions as F

from guardframe.operators.guard import Guard, GuardError
from guardframe.sources.policy import audit_policy_config, load_policy, normalize_column_rules

CONFIG = """{"version": "1.0", "safetyPolicy": {"maxRows": 50}, "databases": [
 {"type": "postgres", "connectionName": "One", "port": 5432, "sensitiveColumns": ["staff.phone", "payroll.staff.salary"], "safeFunctions": ["grade", "payroll.net_pay"]},
 {"type": "postgres", "connectionName": "two", "port": 1, "safetyPolicy": {"maxPayloadKiloBytes": 2, "readOnly": "no unsafe"}, "sensitiveColumns": []}]}"""


@pytest.fixture(scope="module")
def two(spark):
    """Two tables with columns of the same names; in staff the name is sensitive too. The rules of another connection are no matter."""
    users = spark.createDataFrame([(i, f"u{i}@x", f"n{i % 3}") for i in range(6)], "id int, email string, name string")
    staff = spark.createDataFrame([(i, f"u{i}@x", f"s{i}") for i in range(4)], "id int, email string, name string")
    paths = [("c", "users.email"), ("c", "staff.email"), ("c", "staff.name"), ("d", "users.name"), ("d", "users.email")]
    g = Guard(spark, normalize_column_rules(spark.createDataFrame(paths, "conn string, path string")), conn="c")
    return g.table(users, "users", "u"), g.table(staff, "staff", "s")


def test_columns_of_one_name_keep_their_own_ids(two):
    users, staff = two
    both = users.join(staff, F.col("u.id") == F.col("s.id")).select("u.id", ("u.email", "a"), ("s.email", "b"), ("u.name", "plain"), ("s.name", "n")).limit(10)
    rows, entries = both.result()
    got = rows.collect()
    assert len(got) == 4 and all(r.plain == f"n{r.id % 3}" and r.n.startswith("tok_c_0_") for r in got)
    assert all(r.a != r.b for r in got)  # one value in two columns has two tokens
    assert sorted((e.col_id, e.value) for e in entries.collect()) == sorted(
        [(f"{t}.email", f"u{i}@x") for t in ("users", "staff") for i in range(4)] + [("staff.name", f"s{i}") for i in range(4)]
    )


def test_ambiguous_names_are_refused(two):
    users, staff = two
    both = users.join(staff, F.col("u.id") == F.col("s.id"))
    with pytest.raises(GuardError) as e:
        both.select("email")
    assert e.value.code == "NO_COLUMN_ALIAS"


def test_rules_of_another_connection_do_not_count(two):
    assert two[0].select("u.id", "u.name").to_df().count() == 6


STEPS = {
    "DISTINCT_SENSITIVE": lambda f: f.distinct(),
    "OFFSET_SENSITIVE": lambda f: f.offset(1),
    "LIMIT_EXCEEDS": lambda f: f.limit(500),
    "WHERE_NOT_CONJ": lambda f: f.where("id = 3 or id = 1"),
    "SENSITIVE_CMP": lambda f: f.where("id > 3"),
}


@pytest.mark.parametrize("code", STEPS)
@pytest.mark.parametrize("before", [True, False])
@pytest.mark.parametrize("plain", [True, False])
def test_any_order_of_calls_is_judged(frames, code, before, plain):
    pick = (lambda f: f.select("id", "name")) if plain else (lambda f: f.select("id", "email"))
    use = (lambda: pick(STEPS[code](frames))) if before else (lambda: STEPS[code](pick(frames)))
    if plain:
        use().to_df().count()
        return
    with pytest.raises(GuardError) as e:
        use().limit(10).to_df()
    assert e.value.code == code


@pytest.mark.parametrize(
    ("condition", "code"),
    [
        ("id = 1 and name = 'n1'", None),
        ("id in (1, 2) and name is null", None),
        ("id between 1 and 2", "SENSITIVE_CMP"),
        ("name like 'n%'", "SENSITIVE_CMP"),
        ("id <> 1", "SENSITIVE_CMP"),
        ("name is not null", "SENSITIVE_CMP"),
        ("not (id = 1 and name = 'n1')", "WHERE_NOT_CONJ"),
        ("length(name) = 2 and (id = 1 or id = 2)", "WHERE_NOT_CONJ"),
        ("name = 'n1' and id > 1", "SENSITIVE_CMP"),
    ],
)
def test_forms_of_conditions(frames, condition, code):
    use = lambda: frames.where(condition).select("email").limit(5).to_df()
    if code is None:
        use().collect()
        return
    with pytest.raises(GuardError) as e:
        use()
    assert e.value.code == code
    frames.where(condition).select("name").to_df().collect()


@pytest.mark.parametrize(
    ("on", "how", "code"),
    [
        (lambda: F.col("u.id") == F.col("v.id"), "inner", None),
        (lambda: (F.col("u.id") == F.col("v.id")) & (F.col("v.name") == "n1"), "inner", None),
        (lambda: F.col("u.id") == F.col("v.id"), "left", "JOIN_NOT_INNER"),
        (lambda: F.col("u.id") < F.col("v.id"), "inner", "JOIN_ON_INVALID"),
        (lambda: F.lower("u.name") == F.col("v.name"), "inner", "JOIN_ON_INVALID"),
        (lambda: (F.col("u.id") == F.col("v.id")) | (F.col("u.id") == 1), "inner", "JOIN_ON_INVALID"),
        (lambda: F.col("u.email") == F.col("v.name"), "inner", "JOIN_ON_SENSITIVE"),
    ],
)
@pytest.mark.parametrize("early", [True, False])
def test_forms_of_joins(frames, on, how, code, early):
    """Judged whether the mode is known before the join, by a token, or after it, by a selection."""
    token = "tok_c_0_1"

    def use():
        left = frames.where_token("u.email", token) if early else frames
        both = left.join(frames.alias("v"), on(), how)
        return both.select("u.id", *([] if early else [("u.email", "mail")])).limit(5).to_df()

    if code is None:
        use().collect()
        return
    with pytest.raises(GuardError) as e:
        use()
    assert e.value.code == code


def test_a_limit_before_a_join_is_not_the_results(frames):
    with pytest.raises(GuardError) as e:
        frames.limit(5).join(frames.alias("v"), F.col("u.id") == F.col("v.id")).select("u.email").to_df()
    assert e.value.code == "LIMIT_REQUIRED"


def test_inner_queries(frames):
    inner = frames.where("id = 1").select("id").limit(5)
    assert frames.semi_join(inner.alias("w"), F.col("u.id") == F.col("w.id")).select("u.email").limit(5).to_df().count() == 1
    for use, code in (
        (lambda: frames.select("email").limit(5).alias("w"), "SENSITIVE_OUTSIDE_MAIN"),
        (lambda: frames.where("id = 1").alias("w").select("w.email"), "SENSITIVE_OUTSIDE_MAIN"),
        (lambda: frames.select("email").limit(1).scalar(), "SENSITIVE_OUTSIDE_MAIN"),
        (lambda: frames.semi_join(frames.alias("w"), F.col("u.email") == F.col("w.name")), "SENSITIVE_CMP"),
        (lambda: frames.anti_join(frames.alias("w").where("id = 1").limit(5), F.col("u.id") == F.col("w.id")).select("u.email"), "WHERE_NOT_CONJ"),
        (lambda: frames.semi_join(frames.alias("w").where("id = 1"), F.col("u.id") == F.col("w.id")).select("u.email"), "LIMIT_REQUIRED"),
        (lambda: frames.cross_join(frames.alias("w")).select("u.email"), "JOIN_NOT_INNER"),
        (lambda: frames.to_df(), "LIMIT_REQUIRED"),
    ):
        with pytest.raises(GuardError) as e:
            use()
        assert e.value.code == code


@pytest.fixture(scope="module")
def frames(spark):
    users = spark.createDataFrame([(i, f"u{i}@x", f"n{i % 3}") for i in range(6)], "id int, email string, name string")
    rules = normalize_column_rules(spark.createDataFrame([("c", "users.email")], "conn string, path string"))
    g = Guard(spark, rules, conn="c")
    vault = g.table(users, "users").select("email").limit(100).result()[1]
    return Guard(spark, rules, vault, "c").table(users, "users", "u")


def test_sensitive_columns_leave_as_tokens(frames):
    rows = frames.select("u.id", ("u.email", "mail")).limit(10).to_df().collect()
    assert len(rows) == 6 and all(r.mail.startswith("tok_c_0_") for r in rows)
    assert frames.select("id", "name").to_df().count() == 6


@pytest.mark.parametrize(
    ("use", "code"),
    [
        (lambda f: f.select("*"), "STAR"),
        (lambda f: f.select(F.upper("email").alias("x")), "SENSITIVE_SELECT_EXPR"),
        (lambda f: f.where(F.col("email") == "u1@x"), "SENSITIVE_CMP"),
        (lambda f: f.group_by("email"), "SENSITIVE_LOC"),
        (lambda f: f.order_by("email"), "SENSITIVE_LOC"),
        (lambda f: f.select("email").to_df(), "LIMIT_REQUIRED"),
        (lambda f: f.select("email").limit(201), "LIMIT_EXCEEDS"),
        (lambda f: f.select("email").distinct(), "DISTINCT_SENSITIVE"),
        (lambda f: f.select("email").offset(1), "OFFSET_SENSITIVE"),
        (lambda f: f.select("id", "email").join(f.alias("v"), F.lit(True), "left"), "JOIN_NOT_INNER"),
        (lambda f: f.join(f.alias("v"), F.col("u.email") == F.col("v.email")), "JOIN_ON_SENSITIVE"),
        (lambda f: f.where_token("name", "tok_c_0_0"), "PARAM_NON_SENSITIVE"),
    ],
)
def test_refusals(frames, use, code):
    with pytest.raises(GuardError) as e:
        use(frames)
    assert e.value.code == code


def test_where_token(frames):
    token = frames.select("id", "email").limit(200).to_df().where("id = 4").first().email
    assert [r.id for r in frames.where_token("u.email", token).select("id").limit(5).to_df().collect()] == [4]
    with pytest.raises(GuardError):
        frames.where_token("email", token).select("id").to_df()


def test_not_in_is_null_aware(spark):
    g = Guard(spark)
    a = g.table(spark.createDataFrame([(1,), (2,), (None,)], "x int"), "a")
    keys = lambda *k: g.table(spark.createDataFrame([(v,) for v in k], "y int"), "b")
    assert [r.x for r in a.not_in("x", keys(1), "y").to_df().collect()] == [2]
    assert a.not_in("x", keys(1, None), "y").to_df().count() == 0
    assert a.not_in("x", keys(), "y").to_df().count() == 3


def test_policy_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(CONFIG)
    p = load_policy(spark, str(tmp_path / "c.json"))
    got = {r.conn: r for r in p.connections.collect()}
    assert (got["One"].max_rows, got["One"].max_payload_bytes, got["One"].read_only, got["One"].strategy) == (50, 65536, True, "randomized")
    assert (got["two"].max_payload_bytes, got["two"].read_only) == (2048, False)
    assert {(r.name, tuple(r.schemas), r.is_global) for r in p.function_rules.collect()} == {("grade", (), True), ("net_pay", ("payroll",), False)}


def test_config_audit(spark):
    bad = '{"version":"2.0","x":1,"databases":[{"type":"pg","connectionName":"A","port":70000,"safeFunctions":["a.b.c"]},{"type":"postgres","connectionName":"a","safetyPolicy":{"readOnly":"maybe"}}]}'
    df = spark.createDataFrame([("good", CONFIG), ("bad", bad)], "path string, json string")
    found = {(r.path, r.rule) for r in audit_policy_config(df).collect()}
    assert found == {("bad", x) for x in ("version", "unknown_key", "type", "port", "path", "duplicate_name", "readOnly")}


STARS = {
    "select": lambda f: f.select(F.col("*")),
    "select of an alias": lambda f: f.select(F.col("users.*")),
    "struct": lambda f: f.select(F.to_json(F.struct("*")).alias("j")),
    "text": lambda f: f.select(F.expr("concat_ws('|', *)").alias("j")),
    "lambda": lambda f: f.select(F.expr("transform(array(1), x -> to_json(struct(*)))").alias("j")),
    "window": lambda f: f.select(F.max(F.to_json(F.struct("*"))).over(W.partitionBy("id")).alias("j")),
    "count of one alias": lambda f: f.select(F.expr("count(users.*) over ()").alias("j")),
    "count distinct": lambda f: f.agg(F.expr("count(distinct *)").alias("j")),
    "aggregate": lambda f: f.agg(F.max(F.to_json(F.struct("*"))).alias("j")),
    "where": lambda f: f.where("to_json(struct(*)) like '%u2@%'"),
    "having": lambda f: f.group_by("id").agg(F.count("*").alias("n")).where("to_json(struct(*)) > ''"),
    "group": lambda f: f.group_by(F.struct("*")),
    "order": lambda f: f.order_by(F.to_json(F.struct("*")).desc()),
    "order by name": lambda f: f.order_by("*"),
    "distinct on": lambda f: f.distinct_on(["id"], [F.to_json(F.struct("*")).desc()]),
    "join": lambda f: f.join(f.alias("v"), F.expr("to_json(struct(users.*)) = v.name")),
    "semi": lambda f: f.semi_join(f.alias("v").select("id").limit(5), F.expr("to_json(struct(*)) is null")),
    "not in": lambda f: f.not_in("*", f, "id"),
}


@pytest.mark.parametrize("form", STARS)
def test_stars_are_refused(frames, form):
    with pytest.raises(GuardError) as e:
        STARS[form](frames)
    assert e.value.code == "STAR"


def test_count_of_rows_is_no_star(frames):
    assert frames.agg(F.count("*").alias("n"), F.expr("count(*)").alias("m")).to_df().first() == frames.group_by().agg(F.count("*").alias("n"), F.count(F.lit(1)).alias("m")).to_df().first()
    assert frames.select("id", F.count("*").over(W.partitionBy("id")).alias("n")).to_df().count() > 0
