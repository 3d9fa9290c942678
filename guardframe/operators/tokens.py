"""Tokens in place of sensitive values, with the vault that gives the values back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from guardframe.scratch import dense_index, durable, prefix_sum

VAULT = "conn string, gen int, idx long, col_id string, value string, source_type string"
COMMITS = "conn string, gen int, next_idx long, bytes long, version long, whole boolean"
#: Longest token and connection name, largest 32-bit number, tokens of one request, bytes of a session's vault.
MAX_TOKEN, MAX_CONN, MAX_U32, MAX_TOKENS, VAULT_BYTES = 63, 31, 4294967295, 10, 64 << 20


def empty_vault(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VAULT)


#: Buckets of a vault's layouts.
SLOTS = 64


class Vault:
    """A vault as a table in two layouts: by index for tokens, by value for tokenizing.

    Each is partitioned by connection, generation and a slot, that of the index or of a
    hash of column id and value, and sorted within. Entries come in numbered appends; a row
    of `commits` for each says that it is whole, the next free index and the bytes so far,
    so nothing is counted by reading entries. An append that failed half-way is not seen,
    and is overwritten when it is run again under its number. compact() puts all appends
    into one; what it replaced is not read any more.
    """

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    def _there(self, path: str) -> bool:
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)

    def commits(self, before: int | None = None) -> list:
        """A row (version, whole, conn, gen, next_idx, bytes) for each append and scope that counts, oldest first."""
        if not self._there(f"{self.path}/commits"):
            return []
        # a row for each append since the last compaction, and scope
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect()
        rows = sorted((r for r in rows if before is None or r.version < before), key=lambda r: (r.version, r.whole))
        base = max((r.version for r in rows if r.whole), default=-1)
        return [r for r in rows if r.version > base or r.version == base and r.whole]

    def _slot_of_value(self) -> Column:
        return F.pmod(F.xxhash64("col_id", "value"), F.lit(self.slots)).cast("int")

    def _write(self, entries: DataFrame, name: str) -> None:
        by = {"by_idx": (F.pmod("idx", F.lit(self.slots)).cast("int"), ["idx"]), "by_value": (self._slot_of_value(), ["col_id", "value"])}
        for layout, (slot, order) in by.items():
            rows = entries.withColumn("slot", slot).repartition("conn", "gen", "slot").sortWithinPartitions("conn", "gen", "slot", *order)
            rows.write.mode("overwrite").partitionBy("conn", "gen", "slot").parquet(f"{self.path}/{layout}/{name}")

    def append(self, entries: DataFrame, version: int | None = None) -> None:
        """Adds entries, all or none; the same version again is the same append."""
        past = self.commits(version)
        version = 1 + max((r.version for r in past), default=-1) if version is None else version
        entries = durable(entries)
        self._write(entries, f"version={version}")
        state = {(r.conn, r.gen): (r.next_idx, r.bytes) for r in past}
        # a row for each scope that the append touches
        for r in entries.groupBy("conn", "gen").agg((F.max("idx") + 1).alias("next_idx"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes")).collect():
            before = state.get((r.conn, r.gen), (0, 0))
            state[r.conn, r.gen] = (max(before[0], r.next_idx), before[1] + r.bytes)
        self._commit(version, False, state)

    def _commit(self, version: int, whole: bool, state: dict) -> None:
        rows = [(c, g, n, b) for (c, g), (n, b) in state.items()]
        df = self.spark.createDataFrame(rows, "conn string, gen int, next_idx long, bytes long").coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.path}/commits/version={version}/whole={str(whole).lower()}")

    def compact(self) -> None:
        """One append in place of all so far."""
        past = self.commits()
        if len({r.version for r in past}) < 2:
            return
        version = past[-1].version
        self._write(self.entries(), f"version={version}-whole")
        self._commit(version, True, {(r.conn, r.gen): (r.next_idx, r.bytes) for r in past})

    def entries(self, layout: str = "by_idx", before: int | None = None) -> DataFrame:
        """All entries with their slots, those of whole appends alone."""
        names = sorted({f"version={r.version}{'-whole' if r.whole else ''}" for r in self.commits(before)})
        schema = f"{VAULT}, slot int"
        # an append without entries has no folder of a scope, but its own
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{layout}/{n}") for n in names]
        out = self.spark.createDataFrame([], schema)
        for p in parts:
            out = out.unionByName(p)
        return out

    def size(self, conn: str, gen: int, before: int | None = None) -> int:
        """The next free index of a scope, from the commits alone."""
        return max((r.next_idx for r in self.commits(before) if (r.conn, r.gen) == (conn, gen)), default=0)

    def bytes(self, conn: str, gen: int, before: int | None = None) -> int:
        """Bytes of values of a scope, from the commits alone."""
        return max((r.bytes for r in self.commits(before) if (r.conn, r.gen) == (conn, gen)), default=0)

    def lookup(self, conn: str, gen: int, idx: int) -> DataFrame:
        """The entry of one index; one slot is read."""
        return _scope(self.entries(), conn, gen).where((F.col("slot") == idx % self.slots) & (F.col("idx") == idx)).drop("slot")

    def known(self, values: DataFrame, conn: str, gen: int, before: int | None = None) -> DataFrame:
        """The entries of the slots that values (col_id, value) fall into: all that these values may have, and no other slot is read."""
        # at most `slots` rows
        slots = [r.slot for r in values.select(self._slot_of_value().alias("slot")).distinct().collect()]
        return _scope(self.entries("by_value", before), conn, gen).where(F.col("slot").isin(slots)).drop("slot")


def format_token(conn: Column | str, gen: Column, idx: Column) -> Column:
    """tok_<connection>_<generation>_<index>; null where the connection is empty or long, or the token too long."""
    conn = F.lit(conn) if isinstance(conn, str) else conn
    token = F.concat(F.lit("tok_"), conn, F.lit("_"), gen.cast("string"), F.lit("_"), idx.cast("string"))
    return F.when(F.octet_length(conn).between(1, MAX_CONN) & (F.octet_length(token) <= MAX_TOKEN), token)


def parse_token(token: Column) -> Column:
    """struct(conn, gen, idx), read from the right so that connections may hold underscores; null if malformed."""
    part = lambda k: F.regexp_extract(token, r"^tok_(.+)_([0-9]{1,10})_([0-9]{1,10})\z", k)
    gen, idx = part(2).try_cast("long"), part(3).try_cast("long")
    fits = token.rlike(r"^tok_.+_[0-9]{1,10}_[0-9]{1,10}\z") & (gen <= MAX_U32) & (idx <= MAX_U32)
    fits &= F.octet_length(token) <= MAX_TOKEN
    fits &= F.octet_length(part(1)).between(1, MAX_CONN)
    return F.when(fits, F.struct(part(1).alias("conn"), gen.alias("gen"), idx.alias("idx")))


def _scope(vault: DataFrame, conn: str, gen: int) -> DataFrame:
    return vault.where((F.col("conn") == conn) & (F.col("gen") == gen))


def tokenize(
    df: DataFrame, columns: dict[str, str], vault: DataFrame, conn: str, gen: int = 0, strategy: str = "deterministic", start: int | None = None, cap: int | None = None, used: int = 0
) -> tuple[DataFrame, DataFrame]:
    """df with tokens in the columns {name: column id}, and the new vault entries.

    Deterministic: one token for each distinct (column id, value) that the vault scope
    does not hold yet, numbered in that order from the vault's length on. Randomized: one
    for each cell, equal values included. Nulls stay null and take no entry. The values go
    through one distinct, one anti-join and a join a column, never through the driver.

    start is the first free index, where it is known; the vault may then be that part of
    the scope that these values can be in. With a cap, new entries are admitted in their
    order while the scope's values, of which it has `used` bytes, stay within so many
    bytes; the one that would exceed it fails, as do all after it, and a column `refused`
    says which rows lack a token for that.
    """
    have = _scope(vault, conn, gen)
    start = have.count() if start is None else start
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    if strategy == "randomized":
        return _tokenize_cells(df, columns, types, start, conn, gen, cap, used)
    fresh = values_of(df, columns).join(have.select("col_id", "value"), ["col_id", "value"], "left_anti")
    fresh = durable(_admitted(dense_index(fresh, ["col_id", "value"], start), cap, used))
    new = fresh.select(F.lit(conn).alias("conn"), F.lit(gen).alias("gen"), "idx", "col_id", "value", "source_type")
    known = have.select("col_id", "value", "idx").union(new.select("col_id", "value", "idx"))
    out, refused = df, F.lit(False)
    for name, col_id in columns.items():
        words = known.where(F.col("col_id") == col_id).select(
            F.col("value").alias("_value"), format_token(conn, F.lit(gen), F.col("idx")).alias("_token")
        )
        out = out.join(words, F.col(name).cast("string") == F.col("_value"), "left")
        if cap is not None:
            out = out.withColumn(f"_no_{name}", F.col(name).isNotNull() & F.col("_token").isNull())
            refused |= F.col(f"_no_{name}")
        out = out.withColumn(name, F.col("_token")).drop("_value", "_token")
    return out.select(*df.columns, *([refused.alias("refused")] if cap is not None else [])), new


def values_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(col_id, value, source_type): the distinct values of columns {name: column id} that are not null."""
    values = None
    for name, col_id in columns.items():
        part = df.select(F.lit(col_id).alias("col_id"), F.col(name).cast("string").alias("value"), F.lit(df.schema[name].dataType.simpleString()).alias("source_type"))
        values = part if values is None else values.union(part)
    return values.where("value is not null").groupBy("col_id", "value").agg(F.min("source_type").alias("source_type"))


def _admitted(entries: DataFrame, cap: int | None, used: int) -> DataFrame:
    """The entries, in the order of their index, whose values fit with all before them."""
    if cap is None:
        return entries
    run = prefix_sum(entries, ["idx"], F.octet_length("value").cast("long"), "_bytes")
    return run.where(F.col("_bytes") + used <= cap).drop("_bytes")


def _tokenize_cells(df, columns, types, start, conn, gen, cap, used):
    rows = durable(df.withColumn("_row", F.monotonically_increasing_id()))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("col_id"), F.col(c).cast("string").alias("value"), F.lit(types[c]).alias("source_type")) for k, (c, i) in enumerate(columns.items())])
    cells = rows.select("_row", F.explode(cells).alias("c")).select("_row", "c.*").where("value is not null")
    numbered = durable(_admitted(dense_index(cells, ["_row", "k"], start), cap, used))
    tokens = numbered.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("k", format_token(conn, F.lit(gen), F.col("idx"))))).alias("_tokens"))
    out, refused = rows.join(tokens, "_row", "left"), F.lit(False)
    if cap is not None:
        for k, name in enumerate(columns):
            refused |= F.col(name).isNotNull() & F.try_element_at("_tokens", F.lit(k)).isNull()
        out = out.withColumn("refused", refused)
    for k, name in enumerate(columns):
        out = out.withColumn(name, F.try_element_at("_tokens", F.lit(k)))
    new = numbered.select(F.lit(conn).alias("conn"), F.lit(gen).alias("gen"), "idx", "col_id", "value", "source_type")
    return out.select(*df.columns, *(["refused"] if cap is not None else [])), new


def detokenize(df: DataFrame, token_col: str, vault: DataFrame, as_type: str = "string") -> DataFrame:
    """df with the original values in place of tokens; null where the vault has none."""
    parsed = df.withColumn("_t", parse_token(F.col(token_col)))
    entries = vault.select(F.col("conn").alias("_c"), F.col("gen").cast("long").alias("_g"), F.col("idx").alias("_i"), F.col("value").alias("_v"))
    on = (F.col("_t.conn") == F.col("_c")) & (F.col("_t.gen") == F.col("_g")) & (F.col("_t.idx") == F.col("_i"))
    return parsed.join(entries, on, "left").withColumn(token_col, F.col("_v").cast(as_type)).select(*df.columns)


def validate_tokens(tokens: DataFrame, conn: str, gen: int, vault: DataFrame) -> DataFrame:
    """tokens(request_id, pos, token) with `error`: the first fault of each, null where there is none.

    token_count: the request holds not 1 to 10; bad_format; other_connection;
    stale_generation; unknown_index. `col_id` is that of the vault entry.
    """
    count = F.count("*").over(W.partitionBy("request_id"))
    parsed = tokens.withColumn("_n", count).withColumn("_t", parse_token(F.col("token")))
    entries = _scope(vault, conn, gen).select(F.col("idx").alias("_i"), "col_id")
    joined = parsed.join(entries, F.col("_t.idx") == F.col("_i"), "left")
    error = (
        F.when(F.col("_n") > MAX_TOKENS, "token_count")
        .when(F.col("_t").isNull(), "bad_format")
        .when(F.col("_t.conn") != conn, "other_connection")
        .when(F.col("_t.gen") != gen, "stale_generation")
        .when(F.col("_i").isNull(), "unknown_index")
    )
    return joined.select(*tokens.columns, error.alias("error"), F.when(error.isNull(), F.col("col_id")).alias("col_id"))


def check_token_scope(validated: DataFrame, wanted: str = "wanted_col_id") -> DataFrame:
    """validated with `matches`: the entry's column id is exactly that of the filtered column."""
    return validated.withColumn("matches", F.coalesce(F.col("col_id") == F.col(wanted), F.lit(False)))


def filter_by_tokens(df: DataFrame, column: str, col_id: str, tokens: list[str], vault: DataFrame, conn: str, gen: int = 0) -> DataFrame:
    """Rows whose column has the value of one of the tokens; tokens of another scope or column match nothing."""
    if not 1 <= len(tokens) <= MAX_TOKENS:
        raise ValueError(f"1 to {MAX_TOKENS} tokens are allowed, not {len(tokens)}")
    wanted = df.sparkSession.createDataFrame([(t,) for t in tokens], "token string").select(parse_token(F.col("token")).alias("t"))
    wanted = wanted.where((F.col("t.conn") == conn) & (F.col("t.gen") == gen))
    kind = df.select(F.col(column)).schema[0].dataType
    entries = _scope(vault, conn, gen).where(F.col("col_id") == col_id).select("idx", F.col("value").cast(kind).alias("_value"))
    # at most MAX_TOKENS rows on this side
    values = entries.join(F.broadcast(wanted.select("t.idx")), "idx", "left_semi").select("_value").distinct()
    return df.join(F.broadcast(values), F.col(column) == F.col("_value"), "left_semi")


def vault_quota(vault: DataFrame, cap: int = VAULT_BYTES) -> DataFrame:
    """Bytes of values of each (conn, gen), whether they exceed the cap, and the first index that does."""
    # a running sum over range partitions; taking off what the scopes before it hold leaves that of the scope
    run = prefix_sum(vault.where("value is not null").select("conn", "gen", "idx", "value"), ["conn", "gen", "idx"], F.octet_length("value").cast("long"), "_all")
    scopes = run.groupBy("conn", "gen").agg(F.min(F.col("_all") - F.octet_length("value")).alias("_before"))
    return (
        run.join(scopes, ["conn", "gen"])
        .withColumn("_run", F.col("_all") - F.col("_before"))
        .groupBy("conn", "gen")
        .agg(F.sum(F.octet_length("value")).alias("bytes"), F.min(F.when(F.col("_run") > cap, F.col("idx"))).alias("first_over"))
        .withColumn("over", F.col("bytes") > cap)
    )


def output_plan(df: DataFrame, sensitive: dict[str, str]) -> DataFrame:
    """df whose fields' metadata say how each leaves: plaintext, or token with its column id."""
    out = df
    for c in df.columns:
        meta = {"kind": "token", "col_id": sensitive[c]} if c in sensitive else {"kind": "plaintext"}
        out = out.withMetadata(c, meta | {"source_type": df.schema[c].dataType.simpleString()})
    return out


def mask_output(planned: DataFrame, vault: DataFrame, conn: str, gen: int = 0, strategy: str = "deterministic") -> tuple[DataFrame, DataFrame]:
    """The planned frame with tokens where its plan says so, and the new vault entries."""
    wanted = {f.name: f.metadata["col_id"] for f in planned.schema if f.metadata.get("kind") == "token"}
    if not wanted:
        return planned, empty_vault(planned.sparkSession)
    return tokenize(planned, wanted, vault, conn, gen, strategy)
