"""Operator 5: SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from guardframe.llm.common import durable, mix, row_hash, runs, slices, table
from guardframe.llm.components import connected_components

#: Fingerprints in a tile, on average, where a class of population counts has so many.
TILE = 4096
#: Classes whose sizes are broadcast; more are joined.
MOST_CLASSES = 100_000
#: Rows of a tile that are compared at a time.
ROWS = 128


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of so many lower-cased words; a shorter text is one run."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(b" ".join(x), 42) for x in zip(*(found[i:] for i in range(k)))), np.uint64, len(found) - k + 1
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; 0 for none. As a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of each row, in any number; fp is a signed long."""

    def run(batches):
        for batch in slices(batches, "text", 32 << 20):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fingerprint(shingle_hashes(t, words)) for t in texts], pa.int64())],
                names=["doc_id", "fp"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that span the bipartite graph of a boolean matrix, by breadth-first search."""
    edges, rows_left, columns_left = [], near.any(axis=1), near.any(axis=0)
    for first in np.flatnonzero(rows_left).tolist():
        if not rows_left[first]:
            continue
        rows_left[first] = False
        rows, columns = [first], []
        while rows or columns:
            if rows:
                i = rows.pop()
                new = np.flatnonzero(near[i] & columns_left)
                columns_left[new] = False
                edges += [(i, j) for j in new.tolist()]
                columns += new.tolist()
            else:
                j = columns.pop()
                new = np.flatnonzero(near[:, j] & rows_left)
                rows_left[new] = False
                edges += [(i, j) for i in new.tolist()]
                rows += new.tolist()
    return edges


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs (x of a, y of b) within the radius, thinned to what spans their components."""
    parts = []
    for start in range(0, len(a), ROWS):
        part = np.bitwise_count(a[start : start + ROWS, None] ^ b[None, :]) <= radius
        if part.any():
            parts.append((start, part))
    if not parts:
        return []
    near = np.zeros((len(a), len(b)), bool)
    for start, part in parts:
        near[start : start + len(part)] = part
    return [(int(a[i]), int(b[j])) for i, j in _forest(near) if a[i] != b[j]]


def near_links(fps: DataFrame, radius: int, blocks: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps(fp) that span all pairs within the radius.

    A fingerprint's class is the population count of each of its blocks. Two fingerprints
    whose counts differ by more than the radius in sum cannot be within it, so only tiles
    of classes that near are compared, each pair of tiles once, all against all. The more
    blocks, the fewer tile pairs; one block is the plain population count, which suits a
    wide radius. A class with many members has many tiles, so a task holds two tiles, and
    a pair of tiles gives fewer links than it has members. Empty input gives no links.
    """
    width = 64 // blocks
    signature = F.lit(0).cast("long")
    for k in range(blocks):
        mask = ((1 << width) - 1) << (k * width)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        signature += F.bit_count(F.col("fp").bitwiseAND(F.lit(mask).cast("long"))).cast("long") * (1 << (7 * k))
    near = [
        sum(d << (7 * k) for k, d in enumerate(x))
        for x in product(range(-radius, radius + 1), repeat=blocks)
        if sum(map(abs, x)) <= radius
    ]
    near = [x for x in near if x >= 0]

    classed = fps.select("fp", signature.alias("sig"))
    parts = classed.groupBy("sig").agg(F.ceil(F.count("*") / tile).alias("parts"))
    if (width + 1) ** blocks <= MOST_CLASSES:  # the number of classes does not grow with the data
        parts = F.broadcast(parts)
    tiles = durable(
        classed.join(parts, "sig")
        .groupBy("sig", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
        .agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    )
    names = tiles.select("sig", "part")
    pairs = (
        names.selectExpr("sig sig_a", "part part_a")
        .withColumn("step", F.explode(F.array(*[F.lit(x).cast("long") for x in near])))
        .withColumn("sig", F.col("sig_a") + F.col("step"))
        .join(names, "sig")
        .where("step > 0 or part_a <= part")
        .select("sig_a", "part_a", "sig", "part")
    )
    both = pairs.join(tiles.selectExpr("sig sig_a", "part part_a", "fps a"), ["sig_a", "part_a"]).join(
        tiles.selectExpr("sig", "part", "fps b"), ["sig", "part"]
    )

    def run(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
                found += compare_tiles(a, b, radius)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return both.select("a", "b").mapInArrow(run, "a long, b long")


def simhash_components(
    docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 4, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints within the radius.

    component_id is the least doc_id that a document reaches, itself included. A row is
    returned for every row given. A null text counts as empty; texts without words have
    fingerprint 0 and link like any other. Repeated rows share their fingerprint; a null
    id stays null and takes its component's least id. Other columns are not looked at.
    """
    marked = durable(fingerprints(docs, words, text, doc_id))
    least = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(least.select("fp"), radius, blocks)).selectExpr("node fp", "root")
    joined = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(component, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: 64-bit words of a wide fingerprint.
WIDE = 4
#: A class of set sizes is so many times as wide as the one below.
STEP = 1.25**0.25
#: Shingles of all sets of a tile, on average, at most.
TILE_SHINGLES = 2_000_000
WORDS = [f"w{k}" for k in range(WIDE)]


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WIDE fingerprints of the hashes, each of them scrambled by another seed."""
    with np.errstate(over="ignore"):
        return [fingerprint(mix(hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))) for k in range(WIDE)]


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int):
    """Arrays (columns of a, columns of b) of the pairs within the radius; a and b are arrays of WIDE words."""
    for start in range(0, a.shape[1], ROWS):
        some = a[:, start : start + ROWS]
        count = np.bitwise_count(some[0, :, None] ^ b[0])
        for k in range(1, WIDE - 1):
            count += np.bitwise_count(some[k, :, None] ^ b[k])
        i, j = np.nonzero(count <= radius)  # the last word is counted only where the others leave room
        if len(i):
            near = count[i, j] + np.bitwise_count(some[-1, i] ^ b[-1, j]).astype(np.int64) <= radius
            yield i[near] + start, j[near]


def candidates(sets: DataFrame, radius: int, similarity: float, tile: int = TILE) -> DataFrame:
    """(class_a, part_a, class, part, side, node): the sets that have a candidate in a pair of tiles; side 1 is that of (class, part).

    sets(node, size, w0, w1, ...) are distinct. A candidate is a pair within the radius
    whose sizes allow the similarity. Sets of a similarity have sizes in that ratio or
    nearer, so only tiles of classes of sizes that near are compared, each pair of tiles
    once, all against all. A pair of tiles gives each of its sets once at most, however
    many candidates it has. A tile is bounded in sets and in shingles.
    """
    reach = int(np.log(1 / similarity) / np.log(STEP) + 1e-6) + 1
    classed = sets.select("node", "size", *WORDS, F.floor(F.log(F.col("size").cast("double")) / float(np.log(STEP))).alias("class"))
    # the number of classes follows the longest text's logarithm
    parts = classed.groupBy("class").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("size") / TILE_SHINGLES)).alias("parts"))
    tiles = durable(
        classed.join(F.broadcast(parts), "class")
        .groupBy("class", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("node", "size", *WORDS)).alias("rows"))
    )
    names = tiles.select("class", "part")
    pairs = (
        names.selectExpr("class class_a", "part part_a")
        .withColumn("step", F.explode(F.array(*[F.lit(x) for x in range(reach + 1)])))
        .withColumn("class", F.col("class_a") + F.col("step"))
        .join(names, "class")
        .where("step > 0 or part_a <= part")
        .select("class_a", "part_a", "class", "part")
    )
    both = pairs.join(tiles.selectExpr("class class_a", "part part_a", "rows a"), ["class_a", "part_a"]).join(
        tiles.selectExpr("class", "part", "rows b"), ["class", "part"]
    )

    def run(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in PAIR)))
            out = [[] for _ in range(len(PAIR) + 2)]
            for key, a, b in zip(keys, batch.column("a"), batch.column("b")):
                words, nodes, sizes = [], [], []
                for x in (a.values, b.values):
                    words.append(np.stack([x.field(w).to_numpy(zero_copy_only=False) for w in WORDS]).view(np.uint64))
                    nodes.append(x.field("node").to_numpy(zero_copy_only=False))
                    sizes.append(x.field("size").to_numpy(zero_copy_only=False))
                same = key[:2] == key[2:]
                marks = [np.zeros(len(n), bool) for n in nodes]
                for i, j in near_pairs(*words, radius):
                    m, n = sizes[0][i], sizes[1][j]
                    good = np.minimum(m, n) >= similarity * np.maximum(m, n)
                    if same:
                        good &= nodes[0][i] != nodes[1][j]
                    marks[0][i[good]] = True
                    marks[1][j[good]] = True
                for side in range(1 if same else 2):
                    found = nodes[side][marks[side]]
                    for column, value in zip(out, (*key, side)):
                        column.append(np.full(len(found), value, np.int64))
                    out[-1].append(found)
            columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(columns, names=[*PAIR, "side", "node"])

    return both.select(*PAIR, "a", "b").mapInArrow(run, ", ".join(f"{c} long" for c in (*PAIR, "side", "node")))


#: What names a pair of tiles.
PAIR = ("class_a", "part_a", "class", "part")


def _sets(batch: pa.RecordBatch, words: int) -> tuple[list[np.ndarray], list[int]]:
    """The set of shingles of each text and its node, the first 64 bits of its SHA-256."""
    sets = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
    return sets, [int.from_bytes(hashlib.sha256(x.tobytes()).digest()[:8], "little", signed=True) for x in sets]


def near_groups(source: DataFrame, words: int = 5, radius: int = 76, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Of source(doc_id, h1, h2, text): each row's (doc_id, h1, h2), and the (h1, h2) that stays of each group.

    (h1, h2) is a hash of the row, so rows that share it have one text and id. Rows of equal
    sets of shingles become one first. Candidates are pairs of sets within the radius of
    their wide fingerprints. The sets that have one go, by pair of tiles, to a task that
    verifies their links exactly, unless the two are connected already; groups are what
    verified links connect. The least id of a group stays, a null one only where there
    is no other.
    """

    def mark(batches):
        for batch in slices(batches, "text", 16 << 20):
            sets, nodes = _sets(batch, words)
            fps = list(zip(*map(wide_fingerprint, sets))) or [()] * WIDE
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("doc_id", "h1", "h2")),
                    *(pa.array(x, pa.int64()) for x in (nodes, list(map(len, sets)), *fps)),
                ],
                names=["doc_id", "h1", "h2", "node", "size", *WORDS],
            )

    longs = ", ".join(f"{n} long" for n in ("doc_id", "h1", "h2", "node", "size", *WORDS))
    marked = durable(source.mapInArrow(mark, longs))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("m")
    distinct = durable(
        marked.groupBy("node").agg(least, *(F.max(c).alias(c) for c in ("size", *WORDS)))
    )
    found = durable(candidates(distinct.where("size > 0"), radius, similarity))
    members = distinct.join(found.select("node").distinct(), "node").select("node", "m.h1", "m.h2", *WORDS)

    def run(batches):
        for batch in slices(batches, "text", 16 << 20):
            sets, _ = _sets(batch, words)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("node", *WORDS)), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["node", *WORDS, "shingles"],
            )

    single = durable(
        source.select("h1", "h2", "text")
        .join(members, ["h1", "h2"])
        .select("node", *WORDS, "text")
        .mapInArrow(run, ", ".join(f"{n} long" for n in ("node", *WORDS)) + ", shingles binary")
        .dropDuplicates(["node"])  # equal rows
    )
    links = found.join(single, "node").groupBy(*PAIR).applyInArrow(_verified(radius, similarity), "a long, b long")
    roots = connected_components(links)
    grouped = distinct.select("node", "m").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = grouped.groupBy("root").agg(F.min("m").alias("m")).select("m.h1", "m.h2")
    return marked.select("doc_id", "h1", "h2"), kept


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    radius: int = 76,
    similarity: float = 0.8,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id) of the documents that go, so that one of each group of near-duplicates stays, the one of the least id.

    A link is a pair whose sets of shingles have a Jaccard similarity of at least the
    threshold and whose 256-bit fingerprints differ in at most radius bits; a group is
    what links connect. Texts without words equal each other. Ids should be distinct;
    rows with a null id are left alone. An empty table gives an empty result.
    """
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    source = source.select("doc_id", *row_hash("doc_id", "text"), "text")
    rows, kept = near_groups(source, words, radius, similarity)
    return rows.join(kept, ["h1", "h2"], "left_anti").select("doc_id")


def _verified(radius: int, similarity: float):
    """Links between the sets of the two sides of a pair of tiles, or of one with itself, thinned to what connects them."""

    def run(table):
        node = table.column("node").to_numpy()
        side = table.column("side").to_numpy()
        fps = np.stack([table.column(w).to_numpy() for w in WORDS]).view(np.uint64)
        data = table.column("shingles").combine_chunks()
        sets = [np.frombuffer(data[k].as_buffer(), np.uint64) for k in range(len(data))]
        rows = [np.flatnonzero(side == k) for k in (0, 1)]
        if not len(rows[1]):
            rows[1] = rows[0]
        label, out = np.arange(len(node)), []
        for left, right in near_pairs(fps[:, rows[0]], fps[:, rows[1]], radius):
            cuts = np.append(runs(left), len(left))
            for start, end in zip(cuts.tolist(), cuts[1:].tolist()):
                i, others = int(rows[0][left[start]]), rows[1][right[start:end]]
                for j in others[label[others] != label[i]].tolist():
                    if label[i] == label[j]:
                        continue
                    small, big = sorted((len(sets[i]), len(sets[j])))
                    if small < similarity * big:
                        continue
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common >= similarity * (small + big - common):
                        label[label == label[j]] = label[i]
                        out.append((node[i], node[j]))
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    return run


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of three-word shingles and its component within two bits."""
    found = simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
