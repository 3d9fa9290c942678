"""Operator 12: fill-in-middle, as a pipeline of Arrow's compute functions over each batch of documents.

A text is split into units (white space with the word after it). The batch's units are one
flat array with the index of their text beside them; a unit's ordinal in its text tells its
role (prefix, middle, suffix). Units are filtered by role, put into lists again and joined,
and the pieces are joined in the order of the document's form.

The cuts and the form come from a hash of the id, so reruns agree and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from guardframe.llm.common import slices, table

#: Marks before the prefix, the suffix and the middle (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: White space with the word after it, or the white space at the end; byte by byte, as white space is ASCII.
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
#: A byte that no UTF-8 text holds.
STOP = b"\xff"

BINARY = pa.large_binary()
_EMPTY = pa.scalar(b"", BINARY)
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of the texts in order, and the index of each one's text."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\1" + STOP), pattern=STOP)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(pc.binary_length(flat), 0)
    return flat.filter(real), parent.filter(real).to_numpy()


def joined(units: pa.Array, parent: np.ndarray, rows: int, keep: np.ndarray) -> pa.Array:
    """For each text, its kept units in one piece."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(parent[keep], minlength=rows)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), units.filter(pa.array(keep)))
    return pc.binary_join(lists, _EMPTY)


def fill_batch(batch: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    """The columns of COLUMNS for a batch of (doc_id, text, h1, h2, h3, h4)."""
    rows = batch.num_rows
    texts = pc.fill_null(batch.column("text").cast(BINARY), _EMPTY)
    h1, h2, h3, h4 = (batch.column(h).to_numpy() for h in ("h1", "h2", "h3", "h4"))
    units, parent = units_of(texts)
    n = np.bincount(parent, minlength=rows)
    ordinal = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n)
    one, two = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(one, two)[parent], np.maximum(one, two)[parent]
    prefix, middle, suffix = (joined(units, parent, rows, k) for k in (ordinal < low, (ordinal >= low) & (ordinal < high), ordinal >= high))

    marked = [pc.match_substring(texts, pattern=m) for m in (PREFIX, SUFFIX, MIDDLE)]
    marked = pc.or_(pc.or_(*marked[:2]), marked[2])
    plain = pc.or_(pc.or_(pa.array(n == 0), marked), pa.array(h3 % 100 >= rate))
    as_spm = pa.array(h4 % 100 < spm)
    mark_p, mark_s, mark_m = (pa.scalar(m, BINARY) for m in (PREFIX, SUFFIX, MIDDLE))
    psm = pc.binary_join_element_wise(mark_p, prefix, mark_s, suffix, mark_m, middle, _EMPTY)
    spm_ = pc.binary_join_element_wise(mark_s, suffix, mark_p, prefix, mark_m, middle, _EMPTY)
    output = pc.if_else(plain, texts, pc.if_else(as_spm, spm_, psm))
    form = pc.if_else(plain, "plain", pc.if_else(as_spm, "spm", "psm"))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x.cast(pa.large_string())), pa.int64())) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), form, *chars, output.cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row's whole text.

    rate of a hundred texts are rearranged, spm of a hundred of those with the suffix first.
    Empty and null texts have no units and stay plain, as do texts that hold a mark. Rows
    of one id are cut by the same numbers; a null id is hashed as no digits at all.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("_digest", digest).select("doc_id", "text", *hashes)

    def run(batches):
        for batch in slices(batches, "text", 16 << 20):
            yield fill_batch(batch, rate, spm)

    return rows.mapInArrow(run, COLUMNS)


def restore_batch(batch: pa.RecordBatch) -> pa.Array:
    """The texts that outputs were made from, by the outputs and forms alone."""
    output, form = batch.column("output").cast(BINARY), batch.column("form")
    plain = pc.equal(form, "plain")
    # in other forms the marks stand nowhere else, so there are four pieces, the first empty
    shaped = pc.if_else(plain, pa.scalar(PREFIX + SUFFIX + MIDDLE, BINARY), output)
    pieces = pc.split_pattern_regex(shaped, pattern=b"<[PSM]>")
    first, second, middle = (pc.list_element(pieces, k) for k in (1, 2, 3))
    psm = pc.equal(form, "psm")
    whole = pc.binary_join_element_wise(pc.if_else(psm, first, second), middle, pc.if_else(psm, second, first), _EMPTY)
    return pc.if_else(plain, output, whole).cast(pa.string())


def restore(filled: DataFrame) -> DataFrame:
    """filled, rows of fill_in_middle, with the column restored: the exact text that output and form spell."""

    def run(batches):
        for batch in slices(batches, "output", 16 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, restore_batch(batch)], names=[*batch.schema.names, "restored"])

    return filled.select(*(c.split()[0] for c in COLUMNS.split(", "))).mapInArrow(run, COLUMNS + ", restored string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, with digests of its output and of the text rebuilt from it."""
    rows = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents),
k as (
  select *, len(u)::bigint as n,
    ('0x' || h[1:8])::bigint % (len(u) + 1) as a, ('0x' || h[9:16])::bigint % (len(u) + 1) as b,
    ('0x' || h[17:24])::bigint % 100 as c3, ('0x' || h[25:32])::bigint % 100 as c4
  from d),
f as (
  select *, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m, array_to_string(u[greatest(a, b) + 1:n], '') as s,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c3 >= 50 then 'plain' when c4 < 80 then 'spm' else 'psm' end as form
  from k)
select doc_id, n, form,
  case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from f
"""
