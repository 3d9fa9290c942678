"""Operator 7: exact top-k inner products by a Voronoi kNN join.

After the pivot-based join of Lu et al. (2012). Inner products become distances by one
more coordinate: with M the greatest length, |q - (x, sqrt(M^2 - |x|^2))|^2 = |q|^2 + M^2
- 2 q.x, so the highest products are the least distances.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from guardframe.llm.common import durable, mix, sample_by_hash, table

#: Pivots (a fixed number, so the summaries have a fixed size); data rows and queries of a local join, on average.
PIVOTS, DATA_BLOCK, QUERY_BLOCK = 64, 20_000, 512


def integer_vectors(vectors: DataFrame, vector: str, vec_id: str, scale: int) -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of each component as packed longs; rows with a null or non-finite component go."""

    def run(batches):
        for batch in batches:
            ids, packed, norms = [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("v")):
                x = x.values
                if x is None or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    x = np.floor(scale * x)
                    ids.append(i)
                    packed.append(x.astype("<i8").tobytes())
                    norms.append(float(x @ x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())],
                names=["vec_id", "v", "norm"],
            )

    return (
        vectors.where(F.col(vector).isNotNull())
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .mapInArrow(run, "vec_id long, v binary, norm double")
    )


def _matrix(packed, width: int) -> np.ndarray:
    """Rows of packed longs as an integer matrix; shorter vectors end in zeros."""
    out = np.zeros((len(packed), width), np.int64)
    for i, x in enumerate(packed):
        x = np.frombuffer(x, "<i8")
        out[i, : len(x)] = x
    return out


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _lifted(ints: np.ndarray, most: float, query: bool) -> np.ndarray:
    x = ints.astype(np.float64)
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x**2).sum(1), 0))
    return np.column_stack((x, last))


def _grouped(pivots: np.ndarray, most: float, width: int, query: bool):
    """Rows with the pivot that is nearest and the distance to it."""

    def run(batches):
        for batch in batches:
            d = _distances(_lifted(_matrix(batch.column("v").to_pylist(), width), most, query), pivots)
            group = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(group, pa.int64()), pa.array(d[np.arange(len(d)), group])],
                names=["vec_id", "v", "grp", "d"],
            )

    return run


def _bins(asked: list[tuple[int, int]], between: np.ndarray) -> list[tuple[list[int], int]]:
    """Groups (pivot, queries) put together to blocks of QUERY_BLOCK queries at most, neighbours first; a larger group is a bin of several chunks."""
    bins, size = [], 0
    for group, n in sorted(asked, key=lambda x: (between[0, x[0]], x[0])):
        if n > QUERY_BLOCK:
            bins.append(([group], -(-n // QUERY_BLOCK)))
            size = QUERY_BLOCK
        elif bins and size + n <= QUERY_BLOCK:
            bins[-1][0].append(group)
            size += n
        else:
            bins.append(([group], 1))
            size = n
    return bins


def _replicated(pivots: np.ndarray, most: float, width: int, bins: list[tuple[list[int], int]], reach: dict[int, float], blocks: int):
    """Data rows once for each block of queries that they may matter to."""

    def run(batches):
        for batch in batches:
            ids, packed = batch.column("vec_id"), batch.column("v")
            d = _distances(_lifted(_matrix(packed.to_pylist(), width), most, False), pivots)
            block = (mix(ids.fill_null(0).to_numpy().astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            for k, (groups, chunks) in enumerate(bins):
                mine = np.flatnonzero((d[:, groups] <= np.array([reach[g] for g in groups])).any(axis=1))
                for c in range(chunks if len(mine) else 0):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), k)), pa.array(np.full(len(mine), c)), pa.array(block[mine]), ids.take(pa.array(mine)), packed.take(pa.array(mine))],
                        names=["bin", "chunk", "block", "vec_id", "v"],
                    )

    return run


def _solve(k: int, width: int):
    def run(queries, data):
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and data.num_rows:
            q = _matrix(queries.column("v").to_pylist(), width)
            x = _matrix(data.column("v").to_pylist(), width)
            size = math.sqrt(float((q.astype(float) ** 2).sum(1).max()) * float((x.astype(float) ** 2).sum(1).max()))
            # sums of integers below 2**53 are exact in doubles, whatever their order
            scores = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if size < 2**52 else q @ x.T
            ids = data.column("vec_id")
            null = ids.is_null().to_numpy()
            ids = ids.fill_null(0).to_numpy()
            for own, s in zip(queries.column("vec_id").to_pylist(), scores):
                others = np.flatnonzero((ids != own) | null)
                if len(others) > k:
                    s_others = s[others]
                    others = others[s_others >= np.partition(s_others, -k)[-k]]
                best = others[np.lexsort((ids[others], null[others], -s[others]))[:k]]
                out["query_id"] += [own] * len(best)
                out["vec_id"] += [None if null[i] else int(ids[i]) for i in best]
                out["score"] += s[best].tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def knn_join(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vector: str = "embedding", vec_id: str = "vec_id"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    Queries are the rows whose id is divisible by every; candidates are all rows but those of
    the query's own id. Ties go to the smaller id (null last). Fewer candidates give fewer
    rows. Vectors that are null, or hold a null or a non-finite component, take no part;
    an empty vector has only zeros, and of vectors of unequal length the shorter ends in
    zeros. Rows that repeat a query id ask once, with the least vector. Scores are exact
    while they fit a long. No rows, or none to ask, give an empty result.

    Data and queries are grouped by the nearest of a fixed number of pivots. From each
    group's radius and k + 1 least distances of distinct ids follows how far any answer to a group
    of queries can lie; a data row is sent to the groups of queries that it may matter
    to, in blocks, and each block of queries meets each block of data in one task.
    """
    ints = durable(integer_vectors(vectors, vector, vec_id, scale))
    count, most, longest = ints.agg(F.count("*"), F.max("norm"), F.max(F.octet_length("v"))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not count:
        return vectors.sparkSession.createDataFrame([], out)
    width = max(1, longest // 8)
    # PIVOTS distinct vectors, whatever the size, alike on every run; the threshold may keep too few where vectors repeat
    lowest = lambda rows: rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()
    chosen = lowest(sample_by_hash(ints, 4 * PIVOTS, "v"))
    if len(chosen) < PIVOTS:
        chosen = lowest(ints)
    pivots = _lifted(_matrix([r.v for r in chosen], width), most, False)

    queries = ints.where(f"vec_id % {every} = 0").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = durable(queries.mapInArrow(_grouped(pivots, most, width, True), "vec_id long, v binary, grp long, d double"))
    asked = queries.groupBy("grp").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()  # PIVOTS rows at most
    grouped = ints.select("vec_id", "v").mapInArrow(_grouped(pivots, most, width, False), "vec_id long, v binary, grp long, d double")
    place = F.row_number().over(W.partitionBy("grp").orderBy("d"))
    nearest = grouped.groupBy("grp", "vec_id").agg(F.min("d").alias("d")).withColumn("place", place).where(F.col("place") <= k + 1)
    nearest = nearest.select("grp", "vec_id", "d").collect()  # PIVOTS * (k + 1) rows at most
    between = _distances(pivots, pivots)
    reach, slack = {}, 1e-6 * (1 + math.sqrt(most))
    for r in asked:
        upper = {}  # by id, as a query's own rows may be many and in several groups
        for x in nearest:
            upper[x.vec_id] = min(upper.get(x.vec_id, math.inf), r.radius + between[r.grp, x.grp] + x.d)
        upper = sorted(upper.values())
        bound = upper[k] if len(upper) > k else math.inf
        reach[r.grp] = bound + r.radius + slack
    if not reach:
        return vectors.sparkSession.createDataFrame([], out)
    blocks = -(-count // DATA_BLOCK)
    bins = _bins([(r.grp, r.n) for r in asked], between)
    sent = ints.select("vec_id", "v").mapInArrow(
        _replicated(pivots, most, width, bins, reach, blocks), "bin long, chunk long, block long, vec_id long, v binary"
    )
    place = F.create_map(*[x for k, (groups, _) in enumerate(bins) for g in groups for x in (F.lit(g).cast("long"), F.lit(k))])
    chunks = F.create_map(*[F.lit(x) for k, (_, n) in enumerate(bins) for x in (k, n)])
    asks = queries.withColumn("bin", F.element_at(place, F.col("grp")).cast("long")).select(
        "bin", F.pmod(F.xxhash64("vec_id"), F.element_at(chunks, F.col("bin").cast("int"))).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), "vec_id", "v",
    )
    cells = ("bin", "chunk", "block")
    found = asks.groupBy(*cells).cogroup(sent.groupBy(*cells)).applyInArrow(
        _solve(k, width), "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector against all others."""
    return knn_join(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH good AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum([coalesce(z[1], 0) * coalesce(z[2], 0) for z in list_zip(q.v, d.v)])::BIGINT AS score
  FROM good q JOIN good d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
