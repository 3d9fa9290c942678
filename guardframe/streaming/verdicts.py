"""Verdicts on a stream of facts about queries: one for each query, when all its facts are there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from guardframe.operators.audit import all_violations, first_violation
from guardframe.scratch import durable, removed, stored

#: The facts tables, as the audit takes them.
TABLES = {
    "blocks": "query_id long, block_id int, parent_block_id int, scope string, has_star boolean, has_distinct boolean, has_offset boolean, limit_value int, status string",
    "ranges": "query_id long, block_id int, pos int, kind string, schema string, table string, alias string, join_kind string",
    "nodes": "query_id long, block_id int, clause string, item int, node_id int, path array<int>, kind string, qualifier string, column string, func_schema string, func_name string, param_index int, nested_block_id int",
    "params": "query_id long, idx int, col_id string",
}
#: Facts of a part of a batch.
FACTS = 150_000
_FACT = "query_id long, ts timestamp, kind string, expected long, body string"


def as_facts(queries: DataFrame, blocks: DataFrame, ranges: DataFrame, nodes: DataFrame, params: DataFrame) -> DataFrame:
    """(query_id, ts, kind, expected, body): facts of all kinds in one frame, a batch or a stream.

    Each table has query_id and ts beside its columns; queries(query_id, ts, expected)
    says how many facts a query has.
    """
    parts = [queries.select("query_id", "ts", F.lit("queries").alias("kind"), F.col("expected").cast("long").alias("expected"), F.lit(None).cast("string").alias("body"))]
    for kind, df in zip(TABLES, (blocks, ranges, nodes, params)):
        body = F.to_json(F.struct(*[c for c in df.columns if c not in ("query_id", "ts")]))
        parts.append(df.select("query_id", "ts", F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("expected"), body.alias("body")))
    return reduce(DataFrame.union, parts)


def as_tables(facts: DataFrame) -> list[DataFrame]:
    """The facts tables of rows that as_facts made, each read once: what is asked of a generator's columns stays behind it."""
    row = lambda schema: F.inline(F.array(F.from_json("body", schema.split(", ", 1)[1])))
    return [facts.where(F.col("kind") == kind).select("query_id", row(schema)) for kind, schema in TABLES.items()]


def verdict_stream(facts: DataFrame, column_rules: DataFrame, builtin: DataFrame, function_rules: DataFrame, out_path: str, checkpoint: str, conn: str | None = None, wait: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Verdicts of queries whose facts come in any order and in any batches, as as_facts gives them.

    Facts of one query are no further apart than `wait`. The clock is the latest ts of the
    batches so far. Under out_path:

    - verdicts(query_id, code): one row a query. It is first_verdict's, in the batch that
      brings the last of as many facts as expected; INCOMPLETE in the first whose clock is
      over `wait` past the latest fact of a query that lacks some.
    - apart: facts with no id, of queries that have their verdict, or over `wait` older than
      the clock before their batch. They change nothing.
    - waiting: what the next batch needs, written under the batch's id: facts of open
      queries, and ids of closed ones for 2 * wait, after which the clock tells their facts.

    Equal facts count once. A batch that is run again reads what the one before it wrote and
    overwrites its own, so it gives the same rows. What it needs more than once is under
    out_path as well, in scratch, until its end. Its work grows with its facts and those
    that wait, not with the log. A source with no new rows runs no batch, so the clock
    stands still then.
    """
    spark = facts.sparkSession
    rules = column_rules, builtin, function_rules

    def step(batch: DataFrame, batch_id: int) -> None:
        place = lambda table, n=batch_id: f"{out_path}/{table}/batch={n}"
        past = spark.read.schema(_FACT).parquet(place("waiting", batch_id - 1)) if batch_id else spark.createDataFrame([], _FACT)
        fresh = stored(batch.select("query_id", "ts", "kind", "expected", "body"), f"{place('scratch')}/fresh")
        before = past.where("kind = 'clock'").agg(F.max("ts").alias("ts"))
        # one row, null before the first batch; a comparison with null keeps a fact
        horizon = before.select(F.col("ts") - F.expr(f"interval {wait}")).scalar()
        clock = durable(past.where("kind = 'clock'").select("ts").union(fresh.select("ts")).agg(F.max("ts").alias("ts")))
        now = clock.select("ts").scalar()
        later = lambda times: F.col("newest") + F.expr(f"{times} * interval {wait}") < now

        # facts meet what is known of their query in one exchange, to parts of so many rows at any size of the batch
        closed, known = past.where("kind = 'closed'"), past.where("kind <> 'clock'")
        parts = -(-(fresh.count() + known.count() + 1) // FACTS)
        held = fresh.withColumn("new", F.lit(True)).union(known.withColumn("new", F.lit(False))).where("query_id is not null").repartition(parts, "query_id")
        # all windows take one order, so that facts are sorted once
        whole = lambda w: w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        query, fact = whole(W.partitionBy("query_id").orderBy("kind", "body", F.desc("ts"))), W.partitionBy("query_id", "kind", "body").orderBy(F.desc("ts"))
        sure, ends = lambda c: F.coalesce(c, F.lit(False)), ~F.col("new") & (F.col("kind") == "closed")
        held = held.withColumn("apart", F.col("new") & (sure(F.max(ends).over(query)) | sure(F.col("ts") < horizon)))
        here = lambda c: F.when(~F.col("apart"), F.col(c))
        held = held.withColumns({"again": F.count_if(~F.col("apart")).over(fact.rowsBetween(W.unboundedPreceding, W.currentRow)), "most": F.max(here("expected")).over(whole(fact))})
        held = held.where((F.col("apart") | (F.col("again") == 1)) & ~sure(ends)).withColumn("expected", F.when(F.col("apart"), F.col("expected")).otherwise(F.col("most")))
        held = held.withColumns({"newest": F.max(here("ts")).over(query), "wanted": F.max(here("expected")).over(query), "got": F.count_if(here("kind") != "queries").over(query)})
        state = F.when(F.col("apart"), "apart").when(F.col("got") >= F.col("wanted"), "complete").when(later(1), "overdue").otherwise("open")
        held = stored(held.select(*past.columns, "newest", state.alias("state")), f"{place('scratch')}/held", "state")
        held.where("state = 'apart'").select(past.columns).union(fresh.where("query_id is null")).write.mode("overwrite").parquet(place("apart"))

        complete = held.where("state = 'complete'")
        tables = as_tables(complete.repartition(parts, "query_id"))
        found = first_violation(all_violations(*tables, *rules, conn=conn, order=True))
        # a complete query has its count; one without blocks has nothing to be refused for
        done = complete.where("kind = 'queries'").select("query_id").distinct().join(found.hint("merge"), "query_id", "left").select("query_id", F.coalesce("code", F.lit("OK")).alias("code"))
        overdue = held.where("state = 'overdue'").select("query_id", F.lit("INCOMPLETE").alias("code")).distinct()
        done.union(overdue).write.mode("overwrite").parquet(place("verdicts"))

        ended = held.where("state in ('complete', 'overdue')").groupBy("query_id").agg(F.max("newest").alias("newest"))
        ended = closed.select("query_id", F.col("ts").alias("newest")).union(ended).where(~F.coalesce(later(2), F.lit(False)))
        mark = lambda query_id, kind, ts: (query_id, ts, F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("expected"), F.lit(None).cast("string").alias("body"))
        kept = held.where("state = 'open'").select(past.columns).union(ended.select(*mark(F.col("query_id"), "closed", F.col("newest").alias("ts"))))
        kept.union(clock.select(*mark(F.lit(None).cast("long").alias("query_id"), "clock", F.col("ts")))).write.mode("overwrite").parquet(place("waiting"))
        removed(spark, place("scratch"))
        if batch_id > 1:  # the one before this may be read again
            removed(spark, place("waiting", batch_id - 2))

    return facts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
