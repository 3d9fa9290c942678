"""Joins with the last row before each, and the generation of a session at a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from guardframe.operators.tokens import parse_token


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, block: int) -> DataFrame:
    """left with `value` of the last row of right(key, time, value) at or before each row's time; null where there is none.

    Times are longs. Both sides meet within (key, block of time), so a key of most rows is
    spread over as many tasks as it has blocks; what a block begins with comes from a row
    for each key and block, over which alone a key is ordered. Of rows of right with one
    key and time the greatest value counts. Rows with a null key or time get null.
    """
    at = lambda df: df.withColumn("_block", F.floor(F.col(time) / F.lit(block)))
    a, b = at(left), at(right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias(value)))
    last = b.groupBy(key, "_block").agg(F.max_by(value, time).alias("_last"), F.lit(True).alias("_has"))
    places = last.unionByName(a.where(F.col(key).isNotNull() & F.col("_block").isNotNull()).select(key, "_block").distinct(), allowMissingColumns=True)
    places = places.groupBy(key, "_block").agg(F.max(F.struct(F.coalesce("_has", F.lit(False)).alias("h"), F.col("_last").alias("v"))).alias("_last"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("_last.h"), F.struct(F.col("_last.v").alias("v"))), ignorenulls=True).over(before)
    starts = places.select(key, "_block", carried.alias("_carried"))
    row = F.struct(*left.columns)
    rows = a.select(key, "_block", F.col(time).alias("_t"), row.alias("_row"), F.lit(None).cast(b.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    rows = rows.unionByName(b.select(key, "_block", F.col(time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    inside = W.partitionBy(key, "_block").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last(F.when(F.col("_side") == 0, F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(inside)).where("_side = 1")
    found = found.join(starts, [key, "_block"], "left")
    null = F.col(f"_row.{time}").isNull()
    return found.select("_row.*", F.when(~null, F.coalesce("_found", "_carried")["v"]).alias(value))


def generation_scope(requests: DataFrame, generations: DataFrame, block: int = 3600 * 1_000_000) -> DataFrame:
    """requests(session, at, token) with `current`, the session's generation at that time, and `error`.

    generations(session, at, gen) has a row where a session takes a generation: 0 when it
    is new, the old one when it is resumed, a higher one after a reset. error is
    no_session before the first of them, bad_format, stale_generation for a token of
    another generation, else null. Times are microseconds.
    """
    out = as_of(requests, generations.select("session", "at", "gen"), "session", "at", "gen", block)
    token = parse_token(F.col("token"))
    error = F.when(F.col("gen").isNull(), "no_session").when(token.isNull(), "bad_format").when(token["gen"] != F.col("gen"), "stale_generation")
    return out.select(*requests.columns, F.col("gen").alias("current"), error.alias("error"))
