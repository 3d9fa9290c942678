"""Operator 4: benchmark items inside documents, by size-partitioned MinHash containment search.

Words are compared in lower case and without punctuation. An item counts as found where a
stretch of the document twice as long as the item holds a share of its shingles, so a
passage that was cut, broken up or reworded in places is found too, while shingles that
lie scattered over a long document do not add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from guardframe.llm.common import durable, mix, slices, split_words, table

#: Words of a shingle. Share of an item's shingles that a document must hold, from that many shingles on.
WORDS, CONTAINMENT = 3, ((1, 0.8), (8, 0.4))
#: Words of a piece of a longer item, and from one piece to the next.
PIECE, STRIDE = 64, 32
#: Shingles of a sketch that must be met, where the item has so many.
MEET = 3
#: Bytes of item texts that are searched for in one pass over the documents.
ITEM_BLOCK = 16 << 20
#: log2 of the bits of the filter before the sketches are searched.
FILTER_BITS = 20
#: What stands between words: all but letters, marks and digits.
BETWEEN = r"[^\pL\pM\pN]+"


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """split_words() of the texts in lower case and without punctuation."""
    return split_words(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), BETWEEN, " "))


class Runs:
    """Exact integers for runs of word ids: a run is the place of all but its last word among those of the items, and that word.

    Ids are below 2^31. Distinct runs have distinct integers, at any number of words.
    """

    def __init__(self, ids: np.ndarray, words: int):
        self.levels: list[np.ndarray] = []  # sorted runs of two and more words, but the longest
        for size in range(2, words):
            runs = self.of(ids, size)
            self.levels.append(np.unique(runs[runs >= 0]))

    def of(self, ids: np.ndarray, words: int) -> np.ndarray:
        """The integer of every run of so many consecutive ids; -1 where a word has no id or the items have no run that begins so."""
        n = len(ids) - words + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out = np.where(ids[:n] > 0, ids[:n], -1).astype(np.int64)
        for k in range(1, words):
            last = ids[k : k + n]
            if k > 1:
                known = self.levels[k - 2]
                at = np.minimum(np.searchsorted(known, out), max(len(known) - 1, 0))
                out = np.where(known[at] == out, at, -1) if len(known) else np.full(n, -1)
            out = np.where((out >= 0) & (last > 0), (out << 31) | last, -1)
        return out


def most_in_stretch(places: np.ndarray, which: np.ndarray, stretch: int) -> int:
    """The most distinct values of which that lie at places (sorted) of one stretch of so many places."""
    places, which = places.tolist(), which.tolist()
    count: dict[int, int] = {}
    most = first = 0
    for at, value in zip(places, which):
        count[value] = count.get(value, 0) + 1
        while places[first] <= at - stretch:
            old = which[first]
            count[old] -= 1
            if not count[old]:
                del count[old]
            first += 1
        most = max(most, len(count))
    return most


class Items:
    """An index of a bounded block of items: sketches by size class, all shingles for verification.

    Items are cut into pieces of at most PIECE words. A piece of n distinct shingles is in
    class floor(log2 n), whose containment t is fixed. A stretch that holds the piece has
    at least need = ceil(t n) of its shingles, so it lacks n - need at most; of the bottom
    k = n - need + r of the piece's MinHash it therefore holds r or more, for certain. Each
    class has an index of its own and tells r, k and the length of a stretch; the search
    asks for r values of one sketch within a stretch, and no document that is shorter
    than what the class needs is looked up in it.
    """

    def __init__(self, rows: list[tuple[int, str | None, int]], words: int = WORDS, containment=CONTAINMENT):
        codes, lengths, vocabulary = normal_words(pa.array([r[1] for r in rows], pa.large_string()))
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.words, self.shingles = words, Runs(codes.astype(np.int64) + 1, words)
        self.items: list[tuple[int, int, int]] = []  # item id, times it is given, its first piece
        self.pieces: list[np.ndarray] = []  # sorted distinct shingles
        self.need: list[int] = []
        owner, self.runs = [], []
        sketches: dict[tuple[int, int], list[tuple[int, int]]] = {}
        start = 0
        for (item_id, _, times), length in zip(rows, lengths.tolist()):
            found, start = codes[start : start + length].astype(np.int64) + 1, start + length
            for first in range(0, max(length - STRIDE, 1) if length else 0, STRIDE):
                part = found[first : first + PIECE]
                run = min(words, len(part))
                distinct = np.unique(self.shingles.of(part, run))
                n = len(distinct)
                share = next(t for least, t in reversed(containment) if n >= least)
                need = int(np.ceil(share * n - 1e-9))
                r = min(MEET, need)
                lowest = distinct[np.argsort(mix(distinct.astype(np.uint64)))[: n - need + r]]
                sketches.setdefault((run, n.bit_length() - 1), []).extend((h, len(self.pieces)) for h in lowest.tolist())
                self.pieces.append(distinct)
                self.need.append(need)
                owner.append(len(self.items))
                self.runs.append(run)
            self.items.append((item_id, times))
        self.owner = np.array(owner, np.int64)
        self.meets = np.array([min(MEET, x) for x in self.need], np.int64)
        self.stretch = np.array([2 * len(p) for p in self.pieces], np.int64)
        self.classes = {}
        for key, pairs in sketches.items():
            pairs.sort()
            hashes = np.array([h for h, _ in pairs], np.int64)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[mix(hashes.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)] = True
            own = np.array([i for _, i in pairs], np.int64)
            self.classes[key] = (bits, hashes, own, int(min(self.need[i] for i in own.tolist())))

    def candidates(self, shingles: dict[int, np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """Rows (document, piece) with enough of the piece's sketch in one stretch; documents by place in the batch."""
        ends, out = np.cumsum(lengths), []
        for (run, _), (bits, sketch, owner, least) in self.classes.items():
            at = np.flatnonzero(shingles[run] >= 0)
            values = shingles[run][at]
            inside = bits[mix(values.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)]
            at, values = at[inside], values[inside]
            lo, hi = np.searchsorted(sketch, values, "left"), np.searchsorted(sketch, values, "right")
            doc = np.searchsorted(ends, at, side="right")
            real = (hi > lo) & (at + run <= ends[doc]) & (lengths[doc] - run + 1 >= least)
            at, lo, hi, doc = at[real], lo[real], hi[real], doc[real]
            # a shingle of many items meets them a part at a time
            bounds = np.searchsorted(np.cumsum(hi - lo), np.arange(1 << 22, int((hi - lo).sum()) + (1 << 22), 1 << 22), "right")
            cuts = sorted({0, len(at), *(int(np.searchsorted(doc, doc[b])) for b in bounds.tolist() if b < len(at))})
            for a, b in zip(cuts, cuts[1:]):
                many = hi[a:b] - lo[a:b]
                place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[a:b], many)
                piece, docs, where = owner[place], np.repeat(doc[a:b], many), np.repeat(at[a:b], many)
                order = np.lexsort((where, piece, docs))
                piece, docs, where = piece[order], docs[order], where[order]
                for r in np.unique(self.meets[piece]).tolist():
                    first, last = slice(None, len(piece) - r + 1), slice(r - 1, None)
                    good = (piece[first] == piece[last]) & (docs[first] == docs[last]) & (self.meets[piece[first]] == r)
                    good &= where[last] - where[first] < self.stretch[piece[first]]
                    out.append(np.stack((docs[first][good], piece[first][good]), axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def search(self, texts: pa.Array):
        """(document, item id, piece's shingles, those found, times), an item's best piece that a document holds, exactly."""
        codes, lengths, words = normal_words(texts)
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.int64, len(words))[codes]
        shingles = {run: self.shingles.of(ids, run) for run in {run for run, _ in self.classes}}
        starts = np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i in self.candidates(shingles, lengths).tolist():
            piece, run = self.pieces[i], self.runs[i]
            own = shingles[run][starts[d] : starts[d] + lengths[d] - run + 1]
            at = np.flatnonzero(own >= 0)
            which = np.minimum(np.searchsorted(piece, own[at]), len(piece) - 1)
            same = piece[which] == own[at]
            found = most_in_stretch(at[same], which[same], int(self.stretch[i]))
            if found >= self.need[i]:
                n, f = best.get((d, int(self.owner[i])), (1, 0))
                if found * n > f * len(piece):
                    best[d, int(self.owner[i])] = (len(piece), found)
        for (d, i), (n, f) in sorted(best.items()):
            yield d, self.items[i][0], n, f, self.items[i][1]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    words: int = WORDS,
    containment=CONTAINMENT,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id, item_id, shingles, found, containment): documents that hold an item's shingles to its class's share or more.

    Columns of longs to keep come after these. containment lists (least number of
    shingles, share), by the number. Words are in lower case and without punctuation. An
    item of more than PIECE words is found where one of its overlapping pieces is; the
    numbers are those of its best piece, the first of equals. found is the most distinct
    shingles of the piece in any stretch of twice as many shingles. An item of fewer
    words than a shingle is one shingle of them all; one without words is in no document.
    A null text is empty. Rows that repeat an id are judged each for itself, a null id
    included; repeated items give repeated rows. No items, or no documents, no rows.

    The items are searched in blocks of a bounded size; each block goes to all executors
    and meets all documents in one pass that shuffles nothing. Passes grow with the
    items; a block's rows are written before the next block is read.
    """
    out = "doc_id long, item_id long, shingles long, found long, containment double" + "".join(f", {c} long" for c in keep or [])
    spark = docs.sparkSession
    wanted = items.groupBy(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).agg(F.count("*").alias("times"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BLOCK))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(keep or []))
    result = None
    for b in range(blocks):
        # a part of the items that ITEM_BLOCK bounds
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(Items([(r.item_id, r.text, r.times) for r in rows], words, containment))

        def run(batches, index=index):
            for batch in slices(batches, "text", 12 << 20):
                hits = [h for h in index.value.search(batch.column("text")) for _ in range(h[4])]
                at = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at),
                        *(pa.array([h[k] for h in hits], pa.int64()) for k in (1, 2, 3)),
                        pa.array([h[3] / h[2] for h in hits], pa.float64()),
                        *(batch.column(c).take(at) for c in keep or []),
                    ],
                    names=["doc_id", "item_id", "shingles", "found", "containment", *(keep or [])],
                )

        found = source.mapInArrow(run, out)
        if blocks > 1:
            found = durable(found)
            index.destroy()
        result = found if result is None else result.union(found)
    return result


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which a stretch of it holds the share of shingles."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = f"least({WORDS}, len(w))"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pM\\pN]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pM\\pN]+') AS w FROM benchmark),
piece AS (SELECT item_id, unnest(range(0, greatest(len(w) - {STRIDE}, 1), {STRIDE})) AS first, w FROM i WHERE len(w) > 0),
cut AS (SELECT item_id, first, w[first + 1:first + {PIECE}] AS w FROM piece),
item AS (SELECT DISTINCT item_id, first, {_SHINGLES} AS k, unnest([w[j:j + {_SHINGLES} - 1] for j in range(1, len(w) - {_SHINGLES} + 2)]) AS s FROM cut),
doc AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest([w[j:j + k - 1] for j in range(1, len(w) - k + 2)]) AS s FROM d, (SELECT DISTINCT k FROM item) WHERE len(w) >= k),
n AS (SELECT item_id, first, count(*) AS shingles FROM item GROUP BY ALL),
hits AS (SELECT doc_id, item_id, first, pos, s, shingles FROM doc JOIN item USING (k, s) JOIN n USING (item_id, first)),
stretch AS (SELECT a.doc_id, a.item_id, a.first, a.shingles, count(DISTINCT b.s) AS found FROM (SELECT DISTINCT doc_id, item_id, first, pos, shingles FROM hits) a
  JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.first = b.first AND b.pos >= a.pos AND b.pos < a.pos + 2 * a.shingles GROUP BY a.doc_id, a.item_id, a.first, a.shingles, a.pos),
most AS (SELECT doc_id, item_id, first, shingles, max(found) AS found FROM stretch GROUP BY ALL)
SELECT doc_id, item_id, shingles, found, found::DOUBLE / shingles AS containment FROM most
WHERE found >= CASE {" ".join(f"WHEN shingles >= {n} THEN {t}" for n, t in reversed(CONTAINMENT))} END * shingles - 1e-9
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY found::DOUBLE / shingles DESC, first) = 1
"""
