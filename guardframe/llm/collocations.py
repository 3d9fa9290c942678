"""Operator 11: phrase collocations of each language, counted in counting quotient filters.

A phrase of ids of words is one number of a fixed width. An invertible permutation scrambles
it; its first bits name a shard, the next ones (the quotient) the home slot in the shard's
filter, and all the others (the remainder) are stored, so a filter loses nothing and gives
its phrases back. Each batch of texts builds filters of its phrases, sorted by fingerprint;
those of a shard are merged into one. A phrase has one entry a batch, however frequent.

Words get ids once for all texts: only words that are as frequent as a candidate must be, as
no candidate, and no part of one, holds any other. Ids tell languages apart.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from guardframe.llm.common import durable, mix, pack, removed, runs, shared_folder, slices, table, unpack

#: Bytes that end a piece and bytes between words (fixed values); bytes of text in a batch.
BREAKS, BLANKS, BATCH = b".,;:!?\n\x0b\x0c\r", b" \t", 8 << 20
#: Phrase occurrences for each shard; bits of a shard's number that are told apart in one exchange.
SHARD, FAN = 1 << 22, 8
#: Words a candidate has at most.
LONGEST = 3

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2


def code_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased (A-Z) words of the texts, how often each occurs, and all words as codes, -1 between pieces."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _KIND[raw]
    fresh = np.zeros(len(raw), bool)  # a text begins here
    fresh[(offsets[:-1] - offsets[0])[np.diff(offsets) > 0]] = True
    inside, breaks = kind == 0, (kind == 2) | fresh
    start = inside & fresh
    start[1:] |= inside[1:] & ~inside[:-1]
    first = np.flatnonzero(start)
    if not len(first):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    place = np.cumsum(inside, dtype=np.int64)[first] - 1
    letters = raw[inside]
    bounds = np.append(place, len(letters))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    piece = np.cumsum(breaks, dtype=np.int32)[first]
    gap = np.cumsum(np.concatenate(([0], piece[1:] != piece[:-1])))
    out = np.full(len(codes) + int(gap[-1]), -1, np.int32)
    out[np.arange(len(codes)) + gap] = codes
    return words.dictionary, np.bincount(codes, minlength=len(words.dictionary)), out


class Permutation:
    """An invertible scrambling of (a, c), numbers of 2 x bits and of bits, by Feistel rounds."""

    KEYS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9], np.uint64)

    def __init__(self, bits: int):
        self.bits = bits
        self.low = np.uint64((1 << bits) - 1)
        self.high = np.uint64((1 << 2 * bits) - 1)

    def forward(self, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in (0, 2):
            c = c ^ (mix(a + self.KEYS[k]) & self.low)
            a = a ^ (mix(c + self.KEYS[k + 1]) & self.high)
        return a, c

    def backward(self, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in (2, 0):
            a = a ^ (mix(c + self.KEYS[k + 1]) & self.high)
            c = c ^ (mix(a + self.KEYS[k]) & self.low)
        return a, c


def summed(a: np.ndarray, c: np.ndarray, count: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, c) in order, with the sums of their counts; sorted runs are merged."""
    if 3 * bits <= 64:
        order = np.argsort(a << np.uint64(bits) | c, kind="stable")
    else:
        order = np.lexsort((c, a))
    a, c, count = a[order], c[order], count[order]
    if not len(a):
        return a, c, count
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    return a[first], c[first], np.add.reduceat(count, first)


def _narrow(values: np.ndarray, size: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _wide(data: bytes, size: int) -> np.ndarray:
    n = len(data) // size if size else 0
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(n, size)
    return out.view("<u8").ravel().astype(np.uint64)


@dataclass
class QuotientFilter:
    """A counting quotient filter of fingerprints (a of high bits, c of low bits).

    The first `quotient` bits of a name a fingerprint's home; its other bits and c are its
    remainder. Entries are sorted, and each lies at its home or, if that is taken, after
    the entry before it. occupied marks homes that have entries, ends the last slot of each
    home's run. A count above one follows its remainder in slots marked digit, which hold
    count - 1 in digits of the width of c, lowest first.
    """

    high: int
    low: int
    quotient: int
    occupied: np.ndarray
    ends: np.ndarray
    digit: np.ndarray
    rest: np.ndarray
    last: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, c: np.ndarray, count: np.ndarray, high: int, low: int) -> QuotientFilter:
        """The filter of distinct fingerprints in order."""
        width = max(low, 1)
        more, left = np.zeros(len(a), np.int64), count - 1
        while left.any():
            more += left > 0
            left = left >> width
        slots = int(len(a) + more.sum())
        quotient = min(high, max(1, int(slots * 1.1)).bit_length())
        shift = np.uint64(high - quotient)
        home = (a >> shift).astype(np.int64)
        entry = np.repeat(np.arange(len(a)), 1 + more)
        first = np.cumsum(1 + more) - (1 + more)
        step = np.arange(slots) - first[entry]
        place = np.arange(slots) + np.maximum.accumulate(home[entry] - np.arange(slots)) if slots else np.zeros(0, np.int64)
        size = max(1 << quotient, int(place[-1]) + 1 if slots else 0)
        out = cls(high, low, quotient, np.zeros(1 << quotient, bool), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.uint64), np.zeros(size, np.uint64))
        out.occupied[home] = True
        run_ends = np.flatnonzero(np.append(home[1:] != home[:-1], True)) if slots else np.zeros(0, np.int64)
        out.ends[place[(first + more)[run_ends]]] = True
        is_digit = step > 0
        out.digit[place[is_digit]] = True
        out.rest[place[~is_digit]] = a & np.uint64((1 << (high - quotient)) - 1)
        out.last[place[~is_digit]] = c
        at = np.maximum(step - 1, 0) * width
        value = ((count[entry] - 1) >> at) & ((1 << width) - 1)
        out.last[place[is_digit]] = value[is_digit].astype(np.uint64)
        return out

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Homes that have entries, and the first and last slots of their runs."""
        homes, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.ends)
        return homes, np.maximum(homes, np.concatenate(([0], ends[:-1] + 1))), ends

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All fingerprints in order, with their counts."""
        homes, starts, ends = self._runs()
        length = ends - starts + 1
        slot = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
        is_digit = self.digit[slot]
        first = np.flatnonzero(~is_digit)
        home, head = np.repeat(homes, length)[first].astype(np.uint64), slot[first]
        if not len(first):
            return home, home, np.zeros(0, np.int64)
        entry = np.cumsum(~is_digit) - 1
        step = np.arange(len(slot)) - first[entry]
        digits = np.where(is_digit, self.last[slot].astype(np.int64) << (np.maximum(step - 1, 0) * max(self.low, 1)), 0)
        return home << np.uint64(self.high - self.quotient) | self.rest[head], self.last[head], 1 + np.add.reduceat(digits, first)

    def get(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts of fingerprints, 0 for those that are not in."""
        homes, starts, ends = self._runs()
        out = np.zeros(len(a), np.int64)
        if not len(homes):
            return out
        shift = np.uint64(self.high - self.quotient)
        home, rest = (a >> shift).astype(np.int64), a & np.uint64((1 << (self.high - self.quotient)) - 1)
        run = np.minimum(np.searchsorted(homes, home), len(homes) - 1)
        open_, slot = homes[run] == home, starts[run].copy()
        while open_.any():
            k = np.flatnonzero(open_)
            at = slot[k]
            hit = ~self.digit[at] & (self.rest[at] == rest[k]) & (self.last[at] == c[k])
            for i, s in zip(k[hit].tolist(), at[hit].tolist()):
                out[i], s, w = 1, s + 1, 0
                while s < len(self.digit) and self.digit[s] and s <= ends[run[i]]:
                    out[i] += int(self.last[s]) << w
                    s, w = s + 1, w + max(self.low, 1)
            open_[k[hit]] = False
            slot[k] += 1
            open_ &= slot <= ends[run]
        return out

    def dump(self) -> bytes:
        sizes = (self.high - self.quotient + 7) // 8, (max(self.low, 1) + 7) // 8
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.ends, self.digit)]
        return pack(self.high, self.low, self.quotient, len(self.ends), *bits, _narrow(self.rest, sizes[0]), _narrow(self.last, sizes[1]))

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        high, low, quotient, size, *bits, rest, last = unpack(data)
        marks = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for b, n in zip(bits, (1 << quotient, size, size))]
        wide = (high - quotient + 7) // 8
        return cls(high, low, quotient, *marks, _wide(rest, wide) if wide else np.zeros(size, np.uint64), _wide(last, (max(low, 1) + 7) // 8))


@dataclass(frozen=True)
class Space:
    """How phrases of ids become fingerprints: bits of an id, bits of a shard's number."""

    bits: int
    shard: int

    @classmethod
    def of(cls, ids: int, words: int) -> Space:
        """For so many ids and word occurrences."""
        bits = max(int(ids).bit_length(), 4)
        if bits > 32:
            raise ValueError(f"{ids} frequent words do not fit into 32 bits")
        return cls(bits, min(max((2 * words // SHARD).bit_length(), 0), 2 * bits - 1))

    def split(self, a: np.ndarray, c: np.ndarray, count: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
        """Filters of sorted fingerprints, one for each shard number of so many bits."""
        high = 2 * self.bits - bits
        number = a >> np.uint64(high)
        first = runs(number)
        out = []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
            inner = a[i:j] & np.uint64((1 << high) - 1)
            out.append((int(number[i]), QuotientFilter.build(inner, c[i:j], count[i:j], high, self.bits).dump()))
        return out

    def merged(self, shards: list[int], filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The fingerprints of filters with their shard numbers, in order, with sums of counts."""
        parts = []
        for number, data in zip(shards, filters):
            f = QuotientFilter.load(data)
            a, c, count = f.items()
            parts.append((a | np.uint64(number << f.high), c, count))
        return summed(*(np.concatenate(x) for x in zip(*parts)), self.bits)

    def phrases(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, in order and with counts, of the phrases of two and three ids in a sequence; an id of 0 ends a piece."""
        ids = ids.astype(np.uint64)
        two = (ids[:-1] > 0) & (ids[1:] > 0)
        a = ids[:-1] << np.uint64(self.bits) | ids[1:]
        three = two[:-1] & two[1:]
        a2, a3, c3 = a[two], a[:-1][three], ids[2:][three]
        a, c = np.concatenate((a2, a3)), np.concatenate((np.zeros(len(a2), np.uint64), c3))
        a, c = Permutation(self.bits).forward(a, c)
        return summed(a, c, np.ones(len(a), np.int64), self.bits)

    def ids(self, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The three ids (the last 0 for two) of fingerprints."""
        a, c = Permutation(self.bits).backward(a, c)
        return tuple(x.astype(np.int64) for x in (a >> np.uint64(self.bits), a & np.uint64((1 << self.bits) - 1), c))


def _stored(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _coded(docs: DataFrame) -> DataFrame:
    """(unit, lang, words, counts, size, codes): a unit is the texts of one language in a batch."""

    def run(batches):
        unit = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BATCH):
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                words, counts, codes = code_words(batch.column("text").filter(pc.equal(langs.indices, k)))
                if len(words):
                    unit += 1
                    ends = pa.array([0, len(words)], pa.int32())
                    names = pa.ListArray.from_arrays(ends, words.cast(pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([unit]), pa.array([lang]), names, pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())), pa.array([int(counts.sum())]), pa.array([pack(codes)], pa.binary())],
                        names=["unit", "lang", "words", "counts", "size", "codes"],
                    )

    return docs.mapInArrow(run, "unit long, lang string, words array<string>, counts array<long>, size long, codes binary")


def numbered(df: DataFrame, name: str = "id") -> DataFrame:
    """df with numbers from 1 on, in no order, without an exchange of rows."""
    kept = durable(df).withColumn("_at", F.monotonically_increasing_id())
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition
    before = F.broadcast(sizes.select("_part", before.alias("_before")))
    return kept.withColumn("_part", part).join(before, "_part").withColumn(name, row + F.col("_before") + 1).drop("_at", "_part", "_before")


def count_phrases(units: DataFrame, ids: DataFrame, space: Space, least: int, fan: int = FAN) -> DataFrame:
    """(w1, w2, w3, a): phrases of two (w3 is 0) and three ids that occur at least so often; ids has (unit, pos, id)."""
    coarse = min(space.shard, fan)

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left.column("codes").to_pylist():
            (codes,) = unpack(data)
            table_ = np.zeros(int(codes.max()) + 2, np.int64)
            table_[right.column("pos").to_numpy()] = right.column("id").to_numpy()
            out += space.split(*space.phrases(table_[codes]), coarse)
        return pa.table({"shard": pa.array([n for n, _ in out], pa.int64()), "filter": pa.array([f for _, f in out], pa.binary())})

    def refine(bits):
        def run(batches):
            held, size = [], 0
            for batch in batches:
                for n, f in zip(batch.column("shard").to_pylist(), batch.column("filter").to_pylist()):
                    held.append((n, f))
                    size += len(f)
                    if size > BATCH:
                        yield flushed(held, bits)
                        held, size = [], 0
            if held:
                yield flushed(held, bits)

        return run

    def flushed(held, bits):
        out = space.split(*space.merged(*zip(*held)), bits)
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([f for _, f in out], pa.binary())], names=["shard", "filter"])

    def finish(group: pa.Table) -> pa.Table:
        a, c, count = space.merged(group.column("shard").to_pylist(), group.column("filter").to_pylist())
        enough = count >= least
        w = space.ids(a[enough], c[enough])
        return pa.table({"w1": w[0], "w2": w[1], "w3": w[2], "a": count[enough]})

    filters = units.select(F.col("unit").alias("of"), "codes").groupBy("of").cogroup(ids.groupBy("unit")).applyInArrow(build, "shard long, filter binary")
    # with many shards a batch has little for each: filters of nearby shards meet first, many batches at a time
    while coarse < space.shard:
        near = F.shiftright("shard", max(coarse - fan, 0))
        coarse = min(coarse + fan, space.shard)
        filters = filters.repartition(near, F.pmod(F.xxhash64("filter"), F.lit(1 << fan))).mapInArrow(refine(coarse), "shard long, filter binary")
    return filters.groupBy("shard").applyInArrow(finish, "w1 long, w2 long, w3 long, a long")


def _score(left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^16."""
    exact = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact(F.col("a")) * exact(F.col("a"))), exact(left) * exact(right))


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", fan: int = FAN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two and three words whose words attract each other most.

    a, l and r are the occurrences of the phrase and of both sides of its worst cut, n those
    of all words. A phrase is a candidate from `least` occurrences on, and is dropped if a
    longer one that holds it occurs at least `percent` of a hundred times as often. The order
    is by score, then a, then phrase in byte order, so ties have one result. A null language
    counts as `und`; null and empty texts have no words; rows that are repeated count each time.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/collocations-{uuid.uuid4().hex}"
    units = _stored(_coded(docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))), f"{folder}/units")
    totals = _stored(units.groupBy("lang").agg(F.sum("size").alias("n")), f"{folder}/totals")
    words = units.select("unit", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("unit", "lang", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    frequent = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    known = _stored(numbered(frequent), f"{folder}/words")
    size = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    space = Space.of(known.count(), size)
    ids = words.join(known.select("lang", "word", "id"), ["lang", "word"]).select("unit", "pos", "id")
    phrases = _stored(count_phrases(units, ids, space, least, fan), f"{folder}/phrases")
    removed(spark, f"{folder}/units")

    pairs, triples = phrases.where("w3 = 0").drop("w3"), phrases.where("w3 > 0")
    sides = triples.select("a", F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = sides.groupBy("p.w1", "p.w2").agg(F.max("a").alias("longer"))
    none = F.lit(None).cast("long")
    two = pairs.join(longer, ["w1", "w2"], "left").where(~F.coalesce(100 * F.col("longer") >= percent * F.col("a"), F.lit(False)))
    two = two.select("w1", F.col("w2").alias("last"), none.alias("w2"), "a", none.alias("f12"), none.alias("f23"))
    three = triples.join(pairs.withColumnRenamed("a", "f12"), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    three = three.select("w1", F.col("w3").alias("last"), "w2", "a", "f12", "f23")
    cut = two.unionByName(three)
    cut = cut.join(known.select(F.col("id").alias("w1"), "lang", F.col("f").alias("f1")), "w1").join(known.select(F.col("id").alias("last"), F.col("f").alias("f9")), "last")
    one, other = F.struct(_score(F.col("f1"), F.coalesce("f23", "f9")).alias("score"), F.col("f1").alias("l"), F.coalesce("f23", "f9").alias("r")), F.struct(_score(F.col("f12"), F.col("f9")).alias("score"), F.col("f12").alias("l"), F.col("f9").alias("r"))
    scored = cut.withColumn("cut", F.when(F.col("f12").isNull() | (one["score"] <= other["score"]), one).otherwise(other))
    scored = _stored(scored.select("lang", "w1", "w2", "last", "a", "cut.l", "cut.r", "cut.score"), f"{folder}/scored")
    removed(spark, f"{folder}/phrases")

    # the value pairs that hold the first rows of each language; a language's rows are never in one task
    values = scored.groupBy("lang", "score", "a").agg(F.count("*").alias("k"))
    falling = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    first = values.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= top)
    reach = F.coalesce(F.sum("k").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lowest = first.withColumn("reach", reach).where(F.col("reach") < top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    near = scored.join(lowest, "lang").where(F.struct("score", "a") >= F.col("least")).drop("least")
    spelled = near.select("*", F.posexplode(F.array_compact(F.array("w1", "w2", "last"))).alias("pos", "id")).join(known.select("id", "word"), "id")
    key = ["lang", "w1", "w2", "last", "a", "l", "r", "score"]
    spelled = spelled.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within parts of a language, so that its last task sees a fixed number of rows
    dealt = spelled.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    dealt = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with p as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as u
  from (
    select coalesce(lang, 'und') as lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)),
n as (select lang, sum(len(u))::bigint as n from p group by lang),
i as (select lang, u, unnest(generate_series(1, len(u))) as k from p),
f1 as (select lang, u[k] as x, count(*) as f from i group by all),
f2 as (select lang, u[k] as x, u[k + 1] as y, count(*) as f from i where k < len(u) group by all),
f3 as (select lang, u[k] as x, u[k + 1] as y, u[k + 2] as z, count(*) as f from i where k + 1 < len(u) group by all),
longer as (
  select lang, x, y, max(f) as f
  from (select lang, x, y, f from f3 where f >= 10 union all select lang, y, z, f from f3 where f >= 10)
  group by lang, x, y),
c as (
  select a.lang, a.x || ' ' || a.y as phrase, a.f as a, l.f as l1, r.f as r1, null::bigint as l2, null::bigint as r2
  from f2 a join f1 l on l.lang = a.lang and l.x = a.x join f1 r on r.lang = a.lang and r.x = a.y
    left join longer g on g.lang = a.lang and g.x = a.x and g.y = a.y
  where a.f >= 10 and not coalesce(100 * g.f >= 50 * a.f, false)
  union all
  select a.lang, a.x || ' ' || a.y || ' ' || a.z, a.f, l1.f, r1.f, l2.f, r2.f
  from f3 a join f1 l1 on l1.lang = a.lang and l1.x = a.x join f2 r1 on r1.lang = a.lang and r1.x = a.y and r1.y = a.z
    join f2 l2 on l2.lang = a.lang and l2.x = a.x and l2.y = a.y join f1 r2 on r2.lang = a.lang and r2.x = a.z
  where a.f >= 10),
s as (
  select *, (1000000::hugeint * a * a) // (l1::hugeint * r1) as s1, case when l2 is not null then (1000000::hugeint * a * a) // (l2::hugeint * r2) end as s2
  from c),
b as (
  select lang, phrase, a, case when s2 < s1 then l2 else l1 end as l, case when s2 < s1 then r2 else r1 end as r, least(s1, s2)::bigint as score
  from s),
q as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select q.lang, rank, phrase, a, l, r, n.n, score
from q join n on n.lang = q.lang
where rank <= 2000
"""
