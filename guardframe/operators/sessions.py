"""Sessions from access logs, and idle connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from guardframe.scratch import durable

#: Fixed values in seconds: idle and absolute life of a session, idle life of a connection.
IDLE, LIFE, CONNECTION_IDLE = 20 * 60, 8 * 3600, 10 * 60


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sessionize(events: DataFrame, user: str = "user_id", ts: str = "ts", idle: int = IDLE, life: int = LIFE) -> DataFrame:
    """(user, session, started, ended, n): a new session where the last event is over idle seconds back, or the session over life.

    Events are first added up by user and block of time, on the map side, so a user with
    most of all events is no more than others. A block is no longer than idle, so no session
    ends by idle time within one: the blocks alone give the runs that idle time divides, and
    a run no longer than life is one session. Windows run over blocks, of which a user has
    as many as time allows. In longer runs each session begins where the last one allows,
    so those are found by doubling, see _starts. Rows with a null user or time are left out.
    """
    step, life = max(1, min(idle, life) * 1_000_000), life * 1_000_000
    e = events.select(F.col(user).alias("user"), _micros(F.col(ts)).alias("t")).where("user is not null and t is not null")
    e = e.withColumn("block", F.floor(F.col("t") / F.lit(step)) if step > 1 else F.col("t"))
    blocks = e.groupBy("user", "block").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    w = W.partitionBy("user").orderBy("block")
    cut = F.coalesce(F.col("a") - F.lag("b").over(w) > idle * 1_000_000, F.lit(True))
    blocks = blocks.withColumn("cut", F.when(cut, F.col("a"))).withColumn("run", F.last("cut", ignorenulls=True).over(w)).drop("cut")
    blocks = durable(blocks.withColumn("long", F.max("b").over(W.partitionBy("user", "run")) - F.col("run") > life))
    sessions = blocks.where(~F.col("long")).groupBy("user", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    long = blocks.where("long").drop("long")
    most = long.agg(F.max(F.col("b") - F.col("run"))).first()[0]
    if most is not None:
        starts = _starts(e, long, step, life, rounds=(most // max(life, 1)).bit_length())
        sessions = sessions.union(_split(e, long, starts))
    number = F.row_number().over(W.partitionBy("user").orderBy("a"))
    return sessions.select(F.col("user").alias(user), number.alias("session"), F.timestamp_micros("a").alias("started"), F.timestamp_micros("b").alias("ended"), F.col("n").alias("n"))


def _starts(e: DataFrame, long: DataFrame, step: int, life: int, rounds: int) -> DataFrame:
    """(user, run, t, block) where the sessions of long runs begin.

    If a session began at an event, the next one would begin at the run's first event over
    life after it: each event's pointer. It is looked up in the one block that holds the end
    of life, or is the first event of the next block. A run's sessions are the events that
    pointers reach from its first one; each round squares the pointers and doubles the
    number of sessions reached, so a user's events are spread over tasks in every step.
    """
    times = e.join(long.select("user", "run", "block"), ["user", "block"]).select("user", "run", "block", "t").distinct()
    end = F.col("t") + life
    asked = times.select("user", "run", F.floor(end / F.lit(step)).alias("block") if step > 1 else end.alias("block"), F.col("t").alias("of"), end.alias("at"), F.lit(None).cast("long").alias("t"))
    held = times.select("user", "run", "block", F.lit(None).cast("long").alias("of"), F.col("t").alias("at"), "t")
    # an event at the very end of life is before the question, so still in the session
    later = W.partitionBy("user", "run", "block").orderBy("at", F.col("of").isNotNull()).rowsBetween(1, W.unboundedFollowing)
    found = held.union(asked).withColumn("next", F.min("t").over(later)).where("of is not null").select("user", "run", "block", "of", "next")
    places = long.select("user", "run", "block", "a").union(found.select("user", "run", "block", F.lit(None).cast("long")).distinct())
    places = places.groupBy("user", "run", "block").agg(F.min("a").alias("a"))
    after = W.partitionBy("user", "run").orderBy("block").rowsBetween(1, W.unboundedFollowing)
    places = places.withColumn("first", F.min("a").over(after)).select("user", "run", "block", "first")
    pointers = found.join(places, ["user", "run", "block"]).select("user", "run", F.col("of").alias("t"), F.coalesce("next", "first").alias("next"))
    pointers = durable(pointers.where("next is not null"))
    reached = long.select("user", "run", F.col("run").alias("t")).distinct()
    for k in range(rounds):
        more = reached.join(pointers, ["user", "run", "t"]).select("user", "run", F.col("next").alias("t"))
        reached = durable(reached.union(more).distinct())
        if k + 1 < rounds:
            ahead = pointers.select("user", "run", F.col("t").alias("next"), F.col("next").alias("later"))
            pointers = durable(pointers.join(ahead, ["user", "run", "next"]).select("user", "run", "t", F.col("later").alias("next")))
    return reached.select("user", "run", "t", F.floor(F.col("t") / F.lit(step)).alias("block") if step > 1 else F.col("t").alias("block"))


def _split(e: DataFrame, long: DataFrame, starts: DataFrame) -> DataFrame:
    """(user, run, a, b, n) of the sessions of long runs; only blocks in which one begins are read event by event."""
    at = F.col("t") >= F.col("start")
    cut = starts.withColumnRenamed("t", "start")
    pieces = e.join(cut, ["user", "block"]).groupBy("user", "run", "block", at.alias("begins")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    rest = long.join(cut.select("user", "run", "block"), ["user", "run", "block"], "left_anti").select("user", "run", "block", F.lit(False).alias("begins"), "a", "b", "n")
    pieces = pieces.union(rest)
    session = F.sum(F.col("begins").cast("long")).over(W.partitionBy("user", "run").orderBy("a"))
    return pieces.withColumn("session", session).groupBy("user", "run", "session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).drop("session")


def expired_sessions(sessions: DataFrame, at: Column, idle: int = IDLE, life: int = LIFE) -> DataFrame:
    """sessions(started, ended) that are over at an instant, with the cause: clock, idle or life."""
    now, a, b = _micros(at), _micros(F.col("started")), _micros(F.col("ended"))
    cause = (
        F.when((now < b) | (now < a), "clock").when(now - b > idle * 1_000_000, "idle").when(now - a > life * 1_000_000, "life")
    )
    return sessions.withColumn("cause", cause).where("cause is not null")


def evict_oldest_idle(sessions: DataFrame, keep: int, by: list[str]) -> DataFrame:
    """sessions with `evicted`: all but the `keep` latest-created of each group."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("started"), F.desc("session")))
    return sessions.withColumn("evicted", place > keep)


def idle_connections(uses: DataFrame, at: Column, conn: str = "conn", ts: str = "ts", idle: int = CONNECTION_IDLE) -> DataFrame:
    """(conn, last_used) of connections last used over idle seconds before an instant."""
    last = uses.groupBy(conn).agg(F.max(ts).alias("last_used"))
    return last.where(_micros(at) - _micros(F.col("last_used")) > idle * 1_000_000)
