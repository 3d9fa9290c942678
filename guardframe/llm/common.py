"""What the operators of this subpackage share: words, packed arrays, scratch tables."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guardframe.scratch import durable as durable, removed as removed, shared_folder as shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def row_hash(*columns: str) -> tuple[Column, Column]:
    """h1 and h2, 128 bits of hash of the columns; a null is a value of its own."""
    whole = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *whole).alias("h1"), F.xxhash64(F.lit(2), *whole).alias("h2")


def sample_by_hash(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """All rows if they are no more than asked for, else about so many: those whose key has a low hash.

    One count and one filter, alike on every run; no sort, and no task that sees all rows.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 40)) < int(rows / n * (1 << 40)))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Lower-cased (A-Z only) words of each text, as codes into a list of distinct words.

    Returns (codes of all words in order, number of words of each text, distinct words).
    A null text has none.
    """
    # lowered before the cast: ascii_lower misreads a slice that was cast to large offsets
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))
    lists = pc.fill_null(lists, pa.scalar([], lists.type))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(pc.binary_length(flat), 0)
    flat, owner = flat.filter(real), owner.filter(real).to_numpy()
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    return codes, np.bincount(owner, minlength=len(texts)).astype(np.int64), words


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def slices(batches, column: str, most_bytes: int):
    """Arrow batches cut so that a text column holds about most_bytes at most (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
