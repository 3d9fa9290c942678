"""Results capped in rows and bytes, and their JSON envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from guardframe.operators.tokens import mask_output
from guardframe.scratch import dense_index, durable, prefix_sum

#: Rows and bytes of a result where the policy sets none.
MAX_ROWS, MAX_BYTES = 200, 65536


def cap_rows(df: DataFrame, order: list[Column | str], rows: int = MAX_ROWS) -> DataFrame:
    """The first rows in the order (0: all), with `truncated`: more were there."""
    if not rows:
        return df.withColumn("truncated", F.lit(False))
    # rows + 1 rows at most pass this window
    top = df.orderBy(*order).limit(rows + 1)
    place = F.row_number().over(W.orderBy(*order))
    return (
        top.withColumns({"_n": F.count("*").over(W.partitionBy()), "_place": place})
        .where(F.col("_place") <= rows)
        .withColumn("truncated", F.col("_n") > rows)
        .drop("_n", "_place")
    )


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Bytes of a row's cells as text; a null counts 0."""
    total = F.lit(0).cast("long")
    for c in columns or df.columns:
        total += F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return total


#: Rows that are ordered as one list at most; a prefix of more rows (of hardly any bytes) is cut in two levels.
TOP_ROWS = 1 << 18


def cap_payload(df: DataFrame, order: list[Column | str], most: int = MAX_BYTES, columns: list[str] | None = None) -> DataFrame:
    """The longest prefix of rows whose cells hold at most so many bytes, with `truncated`.

    The row that would exceed the cap goes whole, and all after it. One pass adds up rows
    and bytes, which gives how many rows the prefix may have; another takes that many first
    rows, of which each task hands on no more. Where these are not enough, twice as many are
    taken. So rows past the cut-off are neither sorted nor exchanged. A prefix of more than
    TOP_ROWS rows, as null cells have no bytes, is found by running sums in two levels.
    """
    size = row_bytes(df, columns)
    if not most:
        return df.withColumn("truncated", F.lit(False))
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if total <= most:
        return df.withColumn("truncated", F.lit(False))
    wanted = 2 * (most * rows // total) + 64
    while wanted <= TOP_ROWS:
        first = durable(df.withColumn("_size", size).orderBy(*order).limit(wanted))
        if first.agg(F.sum("_size")).first()[0] > most:
            # TOP_ROWS rows at most pass this window
            running = F.sum("_size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
            return first.withColumn("_bytes", running).where(F.col("_bytes") <= most).drop("_size", "_bytes").withColumn("truncated", F.lit(True))
        wanted *= 2
    return prefix_sum(df, order, size, "_bytes").where(F.col("_bytes") <= most).drop("_bytes").withColumn("truncated", F.lit(True))


def cap_result(planned: DataFrame, order: list[Column | str], vault: DataFrame, conn: str, rows: int = MAX_ROWS, most: int = MAX_BYTES, strategy: str = "deterministic") -> tuple[DataFrame, DataFrame]:
    """Row cap, then tokens, then byte cap; so tokens count by their own length, and cut rows take no token."""
    first = cap_rows(planned, order, rows).withColumnRenamed("truncated", "_cut")
    # the order may use a column that is masked: keep places
    placed = first.withColumn("_place", F.row_number().over(W.orderBy(*order))) if rows else dense_index(first, order, 1, "_place")
    for f in planned.schema:
        placed = placed.withMetadata(f.name, f.metadata)
    masked, new = mask_output(placed, vault, conn, 0, strategy)
    capped = cap_payload(masked, ["_place"], most, planned.columns)
    return capped.withColumn("truncated", F.col("truncated") | F.col("_cut")).drop("_cut", "_place"), new


def result_envelope(capped: DataFrame, order: list[Column | str], exec_ms: int = 0) -> DataFrame:
    """One row `json` for a capped result: exec_ms, columns, rows of text or null, rowcount, resultTruncated."""
    columns = [c for c in capped.columns if c != "truncated"]
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    place = F.row_number().over(W.orderBy(*order))
    rows = capped.select(place.alias("_place"), cells.alias("cells"), "truncated")
    listed = rows.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_place", "cells"))), lambda x: x["cells"]).alias("rows"),
        F.count("*").alias("rowcount"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("resultTruncated"),
    )
    names = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(capped.schema[c].metadata.get("kind", "plaintext")).alias("kind"), F.lit(capped.schema[c].dataType.simpleString()).alias("type")) for c in columns])
    return listed.select(F.to_json(F.struct(F.lit(exec_ms).alias("exec_ms"), names.alias("columns"), "rows", "rowcount", "resultTruncated")).alias("json"))
