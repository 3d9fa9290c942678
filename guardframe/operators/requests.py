"""Logged JSON requests: typed rows, error codes, statistics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The codes of an invalid request, an unknown method or tool, and bad parameters; the tools.
INVALID, UNKNOWN, PARAMETERS = -32600, -32601, -32602
TOOLS, MAX_TOKENS = ("run_sql_query", "run_sql_query_tokens"), 10
_BODY = "struct<jsonrpc:string,id:string,method:string,params:struct<name:string,arguments:struct<connectionName:string,query:string,parameters:array<string>>>>"


def parse_request_log(log: DataFrame, json: str = "json") -> DataFrame:
    """log with id, id_kind, method, tool, connection, query, parameters and error (null where the request is good).

    Works alike on a batch and on a stream. An id is an unsigned 32-bit number or a string,
    by its type at the top of the request; an id among the arguments is no matter.
    """
    r = F.from_json(json, _BODY)
    raw_id = F.get_json_object(json, "$.id")
    typed = F.try_variant_get(F.try_parse_json(json), "$.id", "variant")
    kind = F.schema_of_variant(typed)
    number = F.when(kind == "BIGINT", F.try_variant_get(typed, "$", "long"))
    kind = F.when(kind == "STRING", "string").when(number.between(0, 4294967295), "u32")
    parsed = log.withColumn("_r", r).withColumns(
        {
            "id": raw_id, "id_kind": kind, "method": F.col("_r.method"), "tool": F.col("_r.params.name"),
            "connection": F.col("_r.params.arguments.connectionName"), "query": F.col("_r.params.arguments.query"),
            "parameters": F.col("_r.params.arguments.parameters"),
        }
    )
    given = F.size("parameters")
    error = (
        F.when(F.col("_r.jsonrpc").isNull() | (F.col("_r.jsonrpc") != "2.0") | F.col("id_kind").isNull() | F.col("method").isNull(), INVALID)
        .when((F.col("method") != "tools/call") | ~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)), UNKNOWN)
        .when(F.col("connection").isNull() | F.col("query").isNull(), PARAMETERS)
        .when((F.col("tool") == TOOLS[1]) & ~F.coalesce(given.between(1, MAX_TOKENS), F.lit(False)), PARAMETERS)
    )
    return parsed.withColumn("error", error).drop("_r")


def request_stats(requests: DataFrame, width: str = "1 hour", slide: str | None = None, ts: str = "ts", latency: str | None = None, by: tuple[str, ...] = ("connection", "tool")) -> DataFrame:
    """Requests, errors and latency by group and window, tumbling or sliding."""
    window = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    more = [F.max(latency).alias("latency_max"), F.min(latency).alias("latency_min")] if latency else []
    grouped = requests.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.count("error").alias("errors"), *more)
    return grouped.select(F.col("w.start").alias("start"), *by, "n", "errors", *[c for c in grouped.columns if c.startswith("latency")])


def latency_sketches(requests: DataFrame, by: tuple[str, ...] = ("connection", "tool"), ts: str = "ts", latency: str = "latency", width: str = "1 hour", k: int = 4096) -> DataFrame:
    """(start, *by, n, sketch): a quantile sketch of each group's latencies in each window, to be kept and merged.

    A sketch holds at most about k values and is exact up to that many; beyond, ranks are
    off by about 1.3 % at k of 200 and less in proportion for more. Null latencies do not count.
    """
    window = F.window(F.col(ts), width)
    grouped = requests.where(F.col(latency).isNotNull()).groupBy(window.alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(latency).cast("double"), k).alias("sketch")).select(F.col("w.start").alias("start"), *by, "n", "sketch")


def latency_quantiles(sketches: DataFrame, by: tuple[str, ...] = ("connection", "tool"), width: str = "1 day", slide: str | None = None, probs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(start, *by, n, p50, ...): quantiles over longer windows, tumbling or sliding, from sketches alone.

    A quantile is the least value that so many of all do not exceed.
    """
    window = F.window(F.col("start"), width, slide) if slide else F.window(F.col("start"), width)
    merged = sketches.groupBy(window.alias("w"), *by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{100 * p:g}".replace(".", "_")) for p in probs]
    return merged.select(F.col("w.start").alias("start"), *by, "n", *found)


def latency_counts(requests: DataFrame, by: tuple[str, ...] = ("connection", "tool"), ts: str = "ts", latency: str = "latency", width: str = "1 hour") -> DataFrame:
    """(start, *by, latency, n): how often each latency occurs in each group and window, to be kept and merged. Null latencies do not count."""
    window = F.window(F.col(ts), width)
    grouped = requests.where(F.col(latency).isNotNull()).groupBy(window.alias("w"), *by, F.col(latency).cast("double").alias("latency")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), *by, "latency", "n")


def exact_quantiles(counts: DataFrame, by: tuple[str, ...] = ("connection", "tool"), width: str = "1 day", slide: str | None = None, probs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """latency_quantiles from latency_counts, exact at any size.

    The different latencies of one group and window are sorted in one task, which spills
    what it cannot hold; equal ones are one row.
    """
    window = F.window(F.col("start"), width, slide) if slide else F.window(F.col("start"), width)
    merged = counts.groupBy(window.alias("w"), *by, "latency").agg(F.sum("n").alias("n"))
    group = W.partitionBy("w", *by)
    # decimals: a share of n is a whole number where it should be one
    share = lambda p: F.when(F.col("_upto") >= F.lit(Decimal(repr(p))) * F.col("_all"), F.col("latency"))
    ranked = merged.withColumns({"_upto": F.sum("n").over(group.orderBy("latency").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("n").over(group)})
    found = [F.min(share(p)).alias(f"p{100 * p:g}".replace(".", "_")) for p in probs]
    return ranked.groupBy("w", *by).agg(F.sum("n").alias("n"), *found).select(F.col("w.start").alias("start"), *by, "n", *[f"p{100 * p:g}".replace(".", "_") for p in probs])


def idle_at(df: DataFrame, ts: str) -> Column:
    """The latest time of a frame, as one value for other frames' filters."""
    return df.agg(F.max(ts)).scalar()
