"""Operator 10: mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from guardframe.llm.common import WORD, durable, table

#: Weights of the sources in order, repeating; the share of all words to take; how often a word may be taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words of a block; words of a shard, on average; the seed of the selection.
BLOCK, SHARD, SEED = 32, 1_000_000, "mix-1"
#: Equal rows that are numbered together, in one task.
COPIES = 512


def source_targets(sizes: DataFrame, source: str, size: str) -> DataFrame:
    """(source, source_size, target): what each source should give.

    Sources by code point, null last, weigh WEIGHTS in turn and share SHARE of all words.
    A target stops at REPEATS times its source's size; the excess goes to the others by
    weight. That is a water level: sources are taken by the ratio of their limit to their
    weight; those before the level stop at their limit, the others get weight * level.
    One row a source, so the windows over all sources are small.
    """
    total = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = total.withColumn("weight", weight).withColumn("limit", REPEATS * F.col("source_size"))
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    rest = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = ranked.withColumn("level", rest / F.sum("weight").over(after))
    level = level.withColumn("stopped", F.col("limit") < F.col("level") * F.col("weight"))
    # the level of the first source that does not stop holds for all after it
    place = F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    free = F.min_by("level", F.when(~F.col("stopped"), place))
    return level.withColumn("free", free.over(everything)).select(
        "source",
        "source_size",
        F.least(F.col("limit").cast("double"), F.coalesce(F.col("free") * F.col("weight"), F.col("limit").cast("double"))).alias("target"),
    )


def apportion(claims: DataFrame, within: list[str], order: list[Column], claim: str, seats: str) -> DataFrame:
    """claims with `quota`: whole seats by the highest quotients claim / (2 n - 1), ties to the first in order.

    Seats that surely go to a claim are counted by a divisor; only the quotients between
    two divisors, at most two for each claim, are ranked. A claim of 0 gets no seat.
    """
    group = W.partitionBy(*within)
    k, total = F.sum(F.when(F.col(claim) > 0, 1).otherwise(0)).over(group), F.sum(claim).over(group)
    half = lambda divisor: F.floor(F.col(claim) / divisor + 0.5)
    base = claims.withColumns({"_k": k, "_total": total})
    sure = F.when(F.col(seats) > F.col("_k") / 2, half(F.col("_total") / (F.col(seats) - F.col("_k") / 2))).otherwise(0)
    most = F.when(F.col("_total") > 0, half(F.col("_total") / (F.col(seats) + F.col("_k") / 2 + 1))).otherwise(0)
    base = base.withColumn("_sure", F.when(F.col(claim) > 0, sure).otherwise(0).cast("long"))
    base = base.withColumn("_most", F.when(F.col(claim) > 0, most).otherwise(0).cast("long"))
    base = base.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    open_ = base.withColumn("_n", F.explode_outer(F.expr("case when _most > _sure then sequence(_sure + 1, _most) end")))
    rank = F.row_number().over(group.orderBy((F.col(claim) / (2 * F.col("_n") - 1)).desc_nulls_last(), *order, "_n"))
    won = F.sum(F.when(F.col("_n").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    keep = [c for c in claims.columns]
    return open_.withColumn("_rank", rank).groupBy(*keep, "_sure").agg(won.alias("_won")).select(
        *keep, (F.col("_sure") + F.col("_won")).alias("quota")
    )


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"))


def source_mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    block: int = BLOCK,
    shard: int = SHARD,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: how many of its words the mix takes.

    Documents of a source are dealt to shards by a seeded digest of id and text, as many
    as its words ask for; equal rows are counted first and then dealt each by its number.
    The blocks that all sources give, SHARE of all words in all, are apportioned to the
    sources by target, and each source's to its shards by size. In a shard the documents
    lie end to end in seeded order, cut in blocks of equal words; seeded order of the
    blocks says which are taken once more than the rest, up to REPEATS times. A source's
    words so differ from its target by a block or two for each shard.

    A null or empty text has size 0 and gives nothing. A null source is a source of its
    own, the last. Rows that repeat an id, or have none, count each and take each its
    part. An empty table gives an empty result. Reruns agree.
    """
    sized = durable(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
        )
    )
    targets = source_targets(sized, "source", "size")
    blocks = targets.withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    quotas = apportion(blocks, [], [F.col("source").asc_nulls_last()], "target", "seats").select(
        F.col("source").alias("name"), "source_size", "target", F.col("quota").alias("source_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long").alias("shards"),
    )
    quotas = durable(quotas)

    # rows without words take no part; of equal rows each gets a number, so many at a time
    equal = sized.where("size > 0").groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    some = equal.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")))
    some = some.repartition("doc_id", "source", "digest", "from")
    rows = some.withColumn("copy", F.explode(F.expr(f"sequence(`from`, least(n, `from` + {COPIES}) - 1)")))
    # sources are few beside documents, but their number has no bound: a plain join, which Spark broadcasts when small
    dealt = rows.withColumn("digest", _digest("doc_id", "digest", "copy"))
    dealt = dealt.join(quotas, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source", "source_size", "target", "source_quota", "digest",
        F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.col("shards")).alias("shard"),
    )
    shards = dealt.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, ["source"], [F.col("shard")], "shard_size", "source_quota").select(
        "source", "shard", "shard_size", F.col("quota").alias("shard_quota")
    )

    lane = W.partitionBy("source", "shard")
    laid = (
        dealt.join(shards.withColumnRenamed("source", "s").withColumnRenamed("shard", "d"),
                   F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("d")))
        .withColumn("end", F.sum("size").over(lane.orderBy("digest").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("size"))
    )
    pieces = laid.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})"))).withColumn(
        "words", F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    )
    place = F.dense_rank().over(lane.orderBy(_digest("source", "shard", "block"), "block"))
    times = F.expr("shard_quota div n") + (F.col("place") <= F.expr("shard_quota % n")).cast("long")
    taken = (
        pieces.withColumn("n", F.ceil(F.col("shard_size") / block))
        .withColumn("place", place)
        .withColumn("times", F.least(times, F.lit(REPEATS)))
        .groupBy("source", "shard", "doc_id", "size", "source_size", "target", "start", "end", "digest")
        .agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )
    without = sized.where("size = 0").join(quotas, F.col("source").eqNullSafe(F.col("name")))
    return taken.union(without.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, sources weighing 5, 2, 1 in turn."""
    return source_mix(table(spark, sf_dir, "documents"))


def _apportion_sql(name: str, claims: str, within: str, order: str, claim: str, seats: str, keep: str) -> str:
    over = f"OVER (PARTITION BY {within})" if within else "OVER ()"
    part = f"PARTITION BY {within} " if within else ""
    return f"""
{name}_a AS (SELECT *, sum(CASE WHEN {claim} > 0 THEN 1 ELSE 0 END) {over} AS k_, sum({claim}) {over} AS total_ FROM {claims}),
{name}_b AS (SELECT *, CASE WHEN {claim} > 0 AND {seats} > k_ / 2.0 THEN floor({claim} / (total_ / ({seats} - k_ / 2.0)) + 0.5) ELSE 0 END::BIGINT AS sure_,
  CASE WHEN {claim} > 0 THEN floor({claim} / (total_ / ({seats} + k_ / 2.0 + 1)) + 0.5) ELSE 0 END::BIGINT AS most_ FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(sure_) {over} AS left_ FROM {name}_b),
{name}_d AS (SELECT *, unnest(CASE WHEN most_ > sure_ THEN range(sure_ + 1, most_ + 1) ELSE [NULL] END) AS n_ FROM {name}_c),
{name}_e AS (SELECT *, row_number() OVER ({part}ORDER BY {claim} / (2.0 * n_ - 1) DESC NULLS LAST, {order}, n_) AS rank_ FROM {name}_d),
{name} AS (SELECT {keep}, any_value(sure_) + sum(CASE WHEN n_ IS NOT NULL AND rank_ <= left_ THEN 1 ELSE 0 END) AS quota FROM {name}_e GROUP BY {keep})"""


OP10_SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS text_md5 FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS lim FROM total),
leveled AS (SELECT *, ((1.5 * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY lim::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lvl FROM ranked),
targets AS (SELECT source, source_size, least(lim::DOUBLE, coalesce((SELECT arg_min(lvl, lim::DOUBLE / weight) FROM leveled WHERE NOT lim < lvl * weight) * weight, lim::DOUBLE)) AS target FROM leveled),
blocks AS (SELECT *, round(sum(target) OVER () / {BLOCK})::BIGINT AS seats FROM targets),
{_apportion_sql("q", "blocks", "", "source ASC NULLS LAST", "target", "seats", "source, source_size, target")},
hashed AS (SELECT *, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || text_md5 || '|' || (row_number() OVER (PARTITION BY doc_id, source, text_md5) - 1)) AS digest FROM sized WHERE size > 0),
dealt AS (SELECT s.doc_id, s.size, s.source, q.source_size, q.target, q.quota::BIGINT AS source_quota, digest, ('0x' || digest[:8])::BIGINT % greatest(1, ceil(q.source_size / {SHARD}.0)::BIGINT) AS shard
  FROM hashed s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
per_shard AS (SELECT source, shard, source_quota, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY ALL),
{_apportion_sql("p", "per_shard", "source", "shard", "shard_size", "source_quota", "source, shard, shard_size")},
laid AS (SELECT d.*, p.shard_size, p.quota::BIGINT AS shard_quota,
  sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY digest ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM dealt d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.shard = p.shard),
pieces AS (SELECT *, stop - size AS start, unnest(range((stop - size) // {BLOCK}, (stop - 1) // {BLOCK} + 1)) AS block FROM laid),
placed AS (SELECT *, least(stop, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}) AS words, ceil(shard_size / {BLOCK}.0)::BIGINT AS n,
  dense_rank() OVER (PARTITION BY source, shard ORDER BY md5('{SEED}|' || coalesce(source, '') || '|' || shard || '|' || block), block) AS place FROM pieces)
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target,
  sum(words * least(shard_quota // n + (place <= shard_quota % n)::BIGINT, 2))::BIGINT AS taken
FROM placed GROUP BY source, shard, doc_id, size, start, stop, digest
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM sized s JOIN q ON s.source IS NOT DISTINCT FROM q.source WHERE size = 0
"""
