"""Tokenization, sessions and guarded selection on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from guardframe.operators.sessions import IDLE, LIFE
from guardframe.operators.tokens import Vault, tokenize, values_of
from guardframe.scratch import durable

#: Rows of a list that travels, and new rows that are compared at once, at least.
PACK, FOLD = 10_000, 100_000


def tokenize_stream(stream: DataFrame, columns: dict[str, str], vault_path: str, out_path: str, checkpoint: str, conn: str, gen: int = 0, trigger: dict | None = None, compact_every: int = 100) -> StreamingQuery:
    """Deterministic tokens on a stream: Parquet rows and vault entries, consistent over micro-batches.

    One writer for each connection and generation. A batch reads the slots of the vault
    that its own values fall into, and takes the next free index from the commits. Its
    entries and rows are written under its id, overwriting what a failed attempt left; of
    the vault it sees earlier batches alone, so a retry gives the same tokens. trigger is
    what DataStreamWriter.trigger takes, all that is there and no more if it is not given.
    """
    vault = Vault(stream.sparkSession, vault_path)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = durable(batch)
        known = vault.known(values_of(batch, columns), conn, gen, before=batch_id)
        out, new = tokenize(batch, columns, known, conn, gen, start=vault.size(conn, gen, before=batch_id))
        out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        vault.append(new, batch_id)
        if batch_id % compact_every == compact_every - 1:
            vault.compact()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_vault(spark: SparkSession, path: str) -> DataFrame:
    """The entries that tokenize_stream has written."""
    return Vault(spark, path).entries().drop("slot")


def guarded_stream_select(stream: DataFrame, columns: list[str], sensitive: dict[str, str], **sink) -> StreamingQuery:
    """A projection of a stream whose sensitive columns leave as tokens; the sink is tokenize_stream's."""
    picked = stream.select(*columns)
    return tokenize_stream(picked, {c: i for c, i in sensitive.items() if c in columns}, **sink)


def idle_sessions_stream(events: DataFrame, late: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """(user_id, started, ended, n) by idle time alone, of a stream with a watermark."""
    gap = F.session_window("ts", f"{idle} seconds")
    return events.withWatermark("ts", late).groupBy("user_id", gap.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended")).select("user_id", "started", "ended", "n")


class _Sessions(StatefulProcessor):
    """The open session of a user, closed by idle time, by life, or by a timer at the watermark."""

    def __init__(self, idle: int, life: int):
        self.idle, self.life = idle, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField(n, LongType()) for n in ("started", "ended", "n")]
        self.open = handle.getValueState("open", StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for part in rows for t in part["micros"].tolist())
        now = self.open.get() if self.open.exists() else None
        done = []
        for t in times:
            if now and (t - now[1] > self.idle * 1_000_000 or t - now[0] > self.life * 1_000_000 or t < now[0]):
                done.append(now)
                now = None
            now = (now[0], max(now[1], t), now[2] + 1) if now else (t, t, 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now:
            self.open.update(now)
            self.handle.registerTimer(now[1] // 1000 + self.idle * 1000 + 1)
        yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = [self.open.get()] if self.open.exists() else []
        self.open.clear()
        yield self._rows(key, done)

    def _rows(self, key, sessions) -> pd.DataFrame:
        frame = pd.DataFrame(sessions, columns=["started", "ended", "n"], dtype="int64")
        frame.insert(0, "user_id", key[0])
        return frame.astype("int64")

    def close(self) -> None:
        pass


def sessions_stream(events: DataFrame, late: str = "10 minutes", idle: int = IDLE, life: int = LIFE) -> DataFrame:
    """(user_id, started, ended, n), times in microseconds: sessionize on a stream; needs the RocksDB state store."""
    timed = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("micros"))
    return timed.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Sessions(idle, life), outputStructType="user_id long, started long, ended long, n long", outputMode="Append", timeMode="EventTime"
    )


def _stays(group: pa.Array, started: np.ndarray, session: np.ndarray, keep: int) -> np.ndarray:
    """Which rows are among the `keep` latest-created of their group."""
    code = group.dictionary_encode().indices.to_numpy()
    order = np.lexsort((session, started, code))
    code, place = code[order], np.arange(len(order))
    ends = np.flatnonzero(np.append(code[1:] != code[:-1], True))
    stays = np.empty(len(order), bool)
    stays[order] = ends[np.searchsorted(ends, place)] - place < keep
    return stays


def _packed(bucket: np.ndarray, evicted: bool, group: pa.Array, started: np.ndarray, session: np.ndarray) -> pa.RecordBatch:
    """Rows as lists, one for each run of equal buckets and PACK rows."""
    fresh = np.arange(len(bucket)) % PACK == 0
    fresh[1:] |= bucket[1:] != bucket[:-1]
    starts = np.flatnonzero(fresh)
    listed = lambda values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(bucket)), pa.int32()), values)
    columns = pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), evicted)), listed(group), listed(pa.array(started)), listed(pa.array(session))
    return pa.RecordBatch.from_arrays(list(columns), ["bucket", "evicted", "group", "started", "session"])


def _deal(keep: int):
    """Packs a bucket's rows: what others of a trigger push out, where it is, and the rest for the buckets of its groups."""

    def step(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, last = key[0].as_py(), [], False
        while not last:
            batch = next(batches, None)
            last = batch is None
            parts += [] if last else [batch.select(["home", "group", "started", "session"])]
            # at least half of what is folded is new
            if parts and (last or sum(p.num_rows for p in parts[1:]) >= max(FOLD, parts[0].num_rows)):
                rows = pa.Table.from_batches(parts).combine_chunks()
                home, started, session = (rows[c].to_numpy() for c in ("home", "started", "session"))
                group = rows["group"].combine_chunks()
                stays = _stays(group, started, session, keep)
                gone = np.flatnonzero(~stays)
                if len(gone):
                    yield _packed(np.full(len(gone), here, "int32"), True, group.take(pa.array(gone)), started[gone], session[gone])
                stay = np.flatnonzero(stays)
                if last:
                    stay = stay[np.argsort(home[stay], kind="stable")]
                    yield _packed(home[stay], False, group.take(pa.array(stay)), started[stay], session[stay])
                else:
                    parts = pa.Table.from_batches(parts).take(pa.array(stay)).combine_chunks().to_batches()

    return step


class _Newest(StatefulProcessor):
    """The latest-created sessions of the groups of a bucket, at most `keep` each; gives what they push out, and what is out already."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ("group", StringType()), ("started", LongType()), ("session", LongType())
        self.held = handle.getValueState("held", StructType([StructField(n, ArrayType(t)) for n, t in fields]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the state first, then rows of this trigger; the state is read where a row may stay
        parts, changed = [], False
        for part in rows:
            for evicted, *lists in zip(*(part[c] for c in ("evicted", "group", "started", "session"))):
                if evicted:
                    yield self._rows(lists)
                    continue
                if not parts:
                    held = self.held.get() if self.held.exists() else ([], [], [])
                    parts = [self._lists(held)]
                parts.append(self._lists(lists))
                if sum(len(p[1]) for p in parts[1:]) >= max(FOLD, len(parts[0][1])):
                    parts, out = self._fold(parts)
                    changed = True
                    yield from out
        if len(parts) > 1:
            parts, out = self._fold(parts)
            changed = True
            yield from out
        if changed:
            self.held.update(tuple(c.tolist() for c in parts[0]))

    def _lists(self, lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.asarray(c, kind) for c, kind in zip(lists, (object, "int64", "int64")))

    def _fold(self, parts: list) -> tuple[list, list[pd.DataFrame]]:
        columns = [np.concatenate(c) for c in zip(*parts)]
        stays = _stays(pa.array(columns[0], pa.string()), columns[1], columns[2], self.keep)
        gone = [c[~stays] for c in columns]
        out = [self._rows([c[k : k + PACK] for c in gone]) for k in range(0, len(gone[0]), PACK)]
        return [[c[stays] for c in columns]], out

    def _rows(self, lists: list) -> pd.DataFrame:
        return pd.DataFrame({n: [c] for n, c in zip(("group", "started", "session"), lists)})

    def close(self) -> None:
        pass


def evictions_stream(sessions: DataFrame, keep: int, by: list[str], salts: int = 16, buckets: int = 1024) -> DataFrame:
    """(*by, session, started), started in microseconds: each session once, as soon as `keep` others of its group were created after it.

    After each trigger the rows so far are those that evict_oldest_idle marks in the
    sessions so far, whatever order they came in; a session that never started goes
    first. session is a long and not null; by has numbers, strings or dates, nulls are a
    group. Rows travel as lists of a bucket of groups, so Python is called for buckets, not
    for groups. Each part of a group is cut to its own latest first, so that of a hot group
    no more than keep rows a part and trigger meet in one task. A bucket's state has at most
    keep rows of each of its groups, and is read and written whole in a trigger that has
    rows of it: let buckets be some thousandth of keep times the groups. Their number stays
    as long as the checkpoint. Needs the RocksDB state store.
    """
    micros = F.coalesce(F.unix_micros(F.col("started").cast("timestamp")), F.lit(-(2**63)))
    # a null in a key would come to Python as a number that equals nothing
    group = F.to_json(F.struct(*by))
    rows = sessions.select(group.alias("group"), micros.alias("started"), F.col("session").cast("long").alias("session"))
    home, part = F.pmod(F.xxhash64("group"), F.lit(buckets)), F.pmod(F.xxhash64("session"), F.lit(salts))
    rows = rows.select(F.pmod(home + part, F.lit(buckets)).cast("int").alias("bucket"), home.cast("int").alias("home"), "group", "started", "session")
    lists = "group array<string>, started array<long>, session array<long>"
    dealt = rows.groupBy("bucket").applyInArrow(_deal(keep), f"bucket int, evicted boolean, {lists}")
    last = dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Newest(keep), outputStructType=lists, outputMode="Append", timeMode="None")
    last = last.select(F.inline(F.arrays_zip("group", "started", "session")))
    started = F.when(F.col("started") > F.lit(-(2**63)), F.col("started"))
    return last.select(F.from_json("group", sessions.select(*by).schema).alias("_g"), "session", started.alias("started")).select("_g.*", "session", "started")
