"""Operator 1: language-model scores from sharded Elias-Fano n-gram tries.

The model is an interpolated Witten-Bell bigram over an add-one unigram. Nothing of it is
ever whole in one place. Words, with their training counts, are dealt to shards by hash;
so are contexts with their successors, and a frequent context is dealt to as many shards
as its count asks for. Each shard of contexts builds a trie of two levels, kept as
memory-mapped Elias-Fano files, and answers all questions about its contexts from it. The
number of shards follows the number of words, so the size of a shard does not grow.

What is sent is packed: one row holds all that a batch of documents asks of a shard.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guardframe.llm.common import durable, mix, pack, remainder, runs, slices, split_words, table, unpack

#: Text bytes of a batch of documents; one longer document is a batch of its own.
BATCH = 12 << 20
#: Words that a shard is asked about, on average.
SHARD = 2_000_000
#: Ids of a word that is not in the training texts, and of the mark between texts; words have the ids above.
UNKNOWN, BOUNDARY, FIRST = 0, 1, 2


class EliasFano:
    """A sorted sequence of integers below 2**63: low bits packed, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, shape: np.ndarray):
        self.low, self.high, self.ones, self.shape = low, high, ones, shape
        self.n, self.bits = int(shape[0]), int(shape[1])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        low = np.zeros(n * bits // 8 + 9, np.uint8)
        if bits:
            shifts = np.arange(bits, dtype=np.uint64)
            for start in range(0, n, 1 << 16):  # a multiple of 8, so parts end on whole bytes
                part = (values[start : start + (1 << 16), None] >> shifts) & np.uint64(1)
                packed = np.packbits(part.astype(np.uint8).reshape(-1), bitorder="little")
                low[start * bits // 8 : start * bits // 8 + len(packed)] = packed
        heads = (values >> np.uint64(bits)).astype(np.int64)
        length = (int(heads[-1]) if n else 0) + n + 2
        flags = np.zeros(-(-length // 64) * 64, np.uint8)
        flags[heads + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        return cls(low, high, ones, np.array([n, bits], np.int64))

    def parts(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones, "shape": self.shape}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        data = np.ascontiguousarray(self.low[(at >> 3)[:, None] + np.arange(8)]).view("<u8")[:, 0]
        return (data >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        before = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if zeros else self.ones
        at = np.searchsorted(before, k, side="right") - 1
        word = self.high[at] if not zeros else ~self.high[at]
        rank, pos = k - before[at], np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
            beyond = rank >= count
            rank -= np.where(beyond, count, 0)
            word = np.where(beyond, word >> np.uint64(step), word)
            pos += np.where(beyond, step, 0)
        return at * 64 + pos

    def access(self, i: np.ndarray) -> np.ndarray:
        heads = (self._select(i, zeros=False) - i).astype(np.uint64)
        return (heads << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The position of the first value that is at least x; n where there is none."""
        out = np.full(len(x), self.n, np.int64)
        if not self.n:
            return out
        heads = (x.astype(np.uint64) >> np.uint64(self.bits)).astype(np.int64)
        most = int(self.access(np.array([self.n - 1]))[0])
        inside = np.flatnonzero(x.astype(np.uint64) <= np.uint64(most))
        heads, want = heads[inside], x.astype(np.uint64)[inside] & np.uint64((1 << self.bits) - 1)
        lo = np.where(heads > 0, self._select(np.maximum(heads - 1, 0), zeros=True) - (heads - 1), 0)
        hi = self._select(heads, zeros=True) - heads
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        out[inside] = lo
        return out


def quantise(values: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their book: each code stands for the mean of an equal share of the values."""
    size = 1 << bits
    distinct = np.sort(values)
    distinct = distinct[runs(distinct)]
    if len(distinct) <= size:
        return np.searchsorted(distinct, values).astype(np.uint8), distinct
    edges = np.unique(np.quantile(values, np.linspace(0, 1, size + 1)[1:-1]))
    codes = np.searchsorted(edges, values, side="right")
    count = np.bincount(codes, minlength=size)
    book = np.bincount(codes, weights=values, minlength=size) / np.maximum(count, 1)
    return codes.astype(np.uint8), book


class NgramTrie:
    """Contexts and their successors: two sorted levels, pointers between them, 8-bit values.

    Level one holds context ids, the quantised log10 weight that each leaves to the
    unigram, and the pointer to its first successor. Level two holds successor ids as
    offsets from the context's place (context * width + id), so the whole level is one
    monotone sequence and a search for a successor is relative to its context.
    """

    LEVELS = ("contexts", "pointers", "successors")

    def __init__(self, levels: dict[str, EliasFano], arrays: dict[str, np.ndarray]):
        self.levels, self.arrays = levels, arrays

    @classmethod
    def build(cls, contexts, weights, counts, successors, values) -> NgramTrie:
        """contexts sorted, with the log10 weight and number of successors of each; then all successors' ids and log10 probabilities."""
        width = int(successors.max()) + 1 if len(successors) else 1
        owner = np.repeat(np.arange(len(contexts), dtype=np.int64), counts)
        weight_codes, weight_book = quantise(weights)
        value_codes, value_book = quantise(values)
        levels = {
            "contexts": EliasFano.build(contexts),
            "pointers": EliasFano.build(np.concatenate(([0], np.cumsum(counts)))),
            "successors": EliasFano.build(owner * width + successors),
        }
        arrays = {
            "weight_codes": weight_codes,
            "weight_book": weight_book,
            "value_codes": value_codes,
            "value_book": value_book,
            "width": np.array([width]),
        }
        return cls(levels, arrays)

    def save(self, folder: str) -> None:
        for name, level in self.levels.items():
            for part, array in level.parts().items():
                np.save(Path(folder, f"{name}-{part}.npy"), array)
        for name, array in self.arrays.items():
            np.save(Path(folder, f"{name}.npy"), array)

    @classmethod
    def open(cls, folder: str) -> NgramTrie:
        """The trie in the files of save(), mapped into memory."""
        load = lambda name: np.load(Path(folder, f"{name}.npy"), mmap_mode="r")
        levels = {x: EliasFano(*(load(f"{x}-{p}") for p in ("low", "high", "ones", "shape"))) for x in cls.LEVELS}
        return cls(levels, {x: load(x) for x in ("weight_codes", "weight_book", "value_codes", "value_book", "width")})

    def log10(self, contexts: np.ndarray, words: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 P(word | context) of each pair, given the word's unigram log10 probability."""
        level, width = self.levels, int(self.arrays["width"][0])
        out = unigram.copy()
        first = level["contexts"].successor(contexts)
        known = np.flatnonzero(first < level["contexts"].n)
        known = known[level["contexts"].access(first[known]).astype(np.int64) == contexts[known]]
        at = first[known]
        out[known] += self.arrays["weight_book"][self.arrays["weight_codes"][at]]
        held = words[known] < width
        known, at = known[held], at[held]
        target = at * width + words[known]
        place = level["successors"].successor(target)
        inside = place < level["pointers"].access(at + 1).astype(np.int64)
        known, target, place = known[inside], target[inside], place[inside]
        same = level["successors"].access(place).astype(np.int64) == target
        out[known[same]] = self.arrays["value_book"][self.arrays["value_codes"][place[same]]]
        return out


def _planes(values: np.ndarray) -> np.ndarray:
    """Integers as planes of their bytes, which compress better."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T)


def _whole(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(f"i{len(planes)}")[:, 0]


def _documents(data: bytes) -> tuple:
    """What _prepare packed: ids, nulls, held out, numbers of words, codes, words, their counts in training texts."""
    ids, nulls, held, lengths, codes, joined, train = unpack(data)
    return ids, nulls, held, lengths, _whole(codes), joined.split(b"\n") if joined else [], train


def _bigrams(lengths: np.ndarray, codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, context and target of each token; end stands for the mark between texts."""
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    targets = np.full(len(codes) + len(lengths), end, np.int32)
    inner = np.ones(len(targets), bool)
    inner[np.cumsum(lengths + 1) - 1] = False
    targets[inner] = codes
    return doc, np.concatenate((targets[-1:], targets[:-1])), targets


def _prepare(batches):
    """One row for each batch: its words as codes, with their counts in training texts."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in slices(batches, "text", BATCH):
        codes, lengths, words = split_words(batch.column("text"))
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        train = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(words))
        ids = batch.column("doc_id")
        data = pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), held, lengths, _planes(codes), b"\n".join(words), train)
        yield pa.RecordBatch.from_pydict(
            {
                "batch": [(part << 32) + number],
                "tokens": [int(lengths.sum()) + len(lengths)],
                "train_tokens": [int(train.sum() + (~held).sum())],
                "train_docs": [int((~held).sum())],
                "data": [data],
            }
        )
        number += 1


def _word_shards(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which words go to their shards, and the bounds of each shard in it."""
    shard = np.fromiter((xxhash.xxh64_intdigest(w) % shards for w in words), np.int64, len(words))
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _ask_words(shards: int):
    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column("batch").to_pylist(), batch.column("data").to_pylist()):
                *_, words, train = _documents(data)
                order, bounds = _word_shards(words, shards)
                rows = []
                for s in range(shards):
                    mine = order[bounds[s] : bounds[s + 1]]
                    if len(mine):
                        rows.append((s, number, pack(b"\n".join([words[i] for i in mine]), train[mine])))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("shard", "batch", "data"), map(list, zip(*rows)))))

    return run


def _count_words(shards: int, total: int):
    """For a shard: every asked word's training count and id; how many words have one; which are split as contexts."""

    def run(key, asked):
        shard, total_of = key[0].as_py(), {}
        lists = []
        for data in asked.column("data").to_pylist():
            joined, counts = unpack(data)
            lists.append(joined.split(b"\n"))
            for w, c in zip(lists[-1], counts.tolist()):
                total_of[w] = total_of.get(w, 0) + c
        ids = {w: FIRST + i * shards + shard for i, w in enumerate(sorted(w for w, c in total_of.items() if c))}
        hot = [(w, ids[w]) for w, c in total_of.items() if c * shards >= max(total, 1)]
        out = [
            pack(
                np.fromiter((total_of[w] for w in ws), np.int64, len(ws)),
                np.fromiter((ids.get(w, UNKNOWN) for w in ws), np.int64, len(ws)),
            )
            for ws in lists
        ]
        return pa.table(
            {
                "batch": asked.column("batch"),
                "shard": pa.array([shard] * len(out), pa.int64()),
                "known": pa.array([len(ids), *[0] * (len(out) - 1)], pa.int64()),
                "hot": pa.array([pack(hot) if hot else None, *[None] * (len(out) - 1)], pa.binary()),
                "data": pa.array(out, pa.binary()),
            }
        )

    return run


def _split_pairs(shards: int, hot: dict[bytes, int]):
    """The distinct training pairs of split contexts in a batch, by hash of their second word; an empty word is the mark."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                _, _, held, lengths, codes, words, _ = _documents(data)
                words.append(b"")
                doc, contexts, targets = _bigrams(lengths, codes, len(words) - 1)
                ids = np.fromiter((hot.get(w, UNKNOWN) for w in words), np.int64, len(words))
                kept = np.flatnonzero((ids[contexts] != UNKNOWN) & ~held[doc])
                asked, at = np.unique(targets[kept], return_inverse=True)
                order, bounds = _word_shards([words[t] for t in asked], shards)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                pairs = np.unique(place[at] * len(words) + contexts[kept])
                place, contexts = pairs // len(words), pairs % len(words)
                rows = []
                for s, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    if lo < hi:
                        a, b = np.searchsorted(place, (lo, hi))
                        rows.append((s, pack(b"\n".join([words[asked[i]] for i in order[lo:hi]]), place[a:b] - lo, ids[contexts[a:b]])))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("shard", "data"), map(list, zip(*rows)))))

    return run


def _ask_contexts(shards: int, total: int, distinct: int, train_docs: int):
    """For a batch: base scores, and what to ask the shards of contexts."""

    def run(key, state, answers):
        number = key[0].as_py()
        ids, nulls, held, lengths, codes, words, _ = _documents(state.column("data")[0].as_py())
        order, bounds = _word_shards(words, shards)
        count, word_id = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
        for s, data in zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist()):
            mine = order[bounds[s] : bounds[s + 1]]
            count[mine], word_id[mine] = unpack(data)
        count[-1], word_id[-1] = train_docs, BOUNDARY if train_docs else UNKNOWN

        docs = len(lengths)
        doc, contexts, targets = _bigrams(lengths, codes, len(words))

        unigram = np.log10((count + 1) / (total + distinct + 1))
        base = np.bincount(doc, weights=unigram[targets], minlength=docs)
        known = np.bincount(doc, weights=count[targets] > 0, minlength=docs).astype(np.int64)
        asks = count[contexts] > 0
        own = np.bincount(doc[~asks], weights=unigram[targets[~asks]], minlength=docs)
        rows = [(number % shards, number, True, pack(ids, nulls, held, lengths + 1, known, base, own))]

        contexts, targets, doc = contexts[asks], targets[asks], doc[asks]
        slices_of = 1 + count * shards // max(total, 1)
        part = mix(word_id[targets].astype(np.uint64)) % slices_of[contexts].astype(np.uint64)
        shard = (mix(mix(word_id[contexts].astype(np.uint64)) + part) % np.uint64(shards)).astype(np.int64)
        wide = int(len(words) + 1).bit_length()
        if 2 * wide + int(shards).bit_length() < 63:
            order = np.argsort((shard << (2 * wide)) | (contexts.astype(np.int64) << wide) | targets)
        else:
            order = np.lexsort((targets, contexts, shard))
        contexts, targets, doc, shard = contexts[order], targets[order], doc[order], shard[order]
        bounds = np.searchsorted(shard, np.arange(shards + 1))
        trains = np.packbits(~held)
        small = np.int32 if max(word_id.max(), count.max()) < 2**31 else np.int64
        word_id, count = word_id.astype(small), count.astype(small)
        for s in range(shards):
            lo, hi = bounds[s], bounds[s + 1]
            if lo < hi:
                c, t = contexts[lo:hi], targets[lo:hi]
                pair = np.ones(hi - lo, bool)
                pair[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
                pair = np.flatnonzero(pair)
                times, c, t = np.diff(np.append(pair, hi - lo)), c[pair], t[pair]
                heads = runs(c)
                # each target's id and count once, by id; pairs have its place among them
                asked, at = np.unique(t, return_inverse=True)
                by_id = np.argsort(word_id[asked])
                place = np.empty(len(asked), np.int32)
                place[by_id] = np.arange(len(asked))
                asked = asked[by_id]
                data = pack(
                    word_id[c[heads]], count[c[heads]], np.diff(np.append(heads, len(c))).astype(np.int32),
                    _planes(np.diff(word_id[asked], prepend=small(0))), _planes(count[asked]), _planes(place[at]), _planes(times.astype(np.int32)),
                    _planes(doc[lo:hi]), docs, trains,
                )
                rows.append((s, number, False, data))
        return pa.table(
            {
                "shard": pa.array([r[0] for r in rows], pa.int64()),
                "batch": pa.array([r[1] for r in rows], pa.int64()),
                "own": pa.array([r[2] for r in rows], pa.bool_()),
                "data": pa.array([r[3] for r in rows], pa.binary()),
            }
        )

    return run


def _count_kinds(parts):
    """For a shard: how many distinct successors it holds of each split context."""
    number, pairs = {}, []
    for data in parts.column("data").to_pylist():
        joined, place, context = unpack(data)
        words = joined.split(b"\n")
        pairs.append((context, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))[place]))
    context, word = map(np.concatenate, zip(*pairs))
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    kept = np.ones(len(order), bool)
    kept[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    context, kinds = np.unique(context[kept], return_counts=True)
    return pa.table({"context": pa.array(context, pa.int64()), "kinds": pa.array(kinds, pa.int64())})


def _score_shard(total: int, distinct: int, kinds: dict[int, int]):
    """For a shard: the trie of its contexts, and from it each asking batch's sums by document."""

    def run(asked):
        numbers, sums = [], []
        parts, batches, size = [], [], 0
        for number, own, data in zip(*(asked.column(c).to_pylist() for c in ("batch", "own", "data"))):
            if own:
                numbers.append(number)
                sums.append((True, data))
                continue
            heads, head_counts, lengths, ids, counts, at, times, doc, docs, trains = unpack(data)
            train = np.unpackbits(trains, count=docs).astype(bool)
            ids, counts, at, times, doc = np.cumsum(_whole(ids)), *map(_whole, (counts, at, times, doc))
            head = np.repeat(np.repeat(np.arange(len(heads)), lengths), times)
            at = np.repeat(at, times)
            parts.append((heads[head], head_counts[head], ids[at], counts[at], doc + np.int64(size), train[doc]))
            batches.append((number, size, docs))
            size += docs
        if parts:
            context, context_count, word, word_count, place, train = map(np.concatenate, zip(*parts))
            parts.clear()
            order = np.lexsort((word, context))
            context, word = context[order].astype(np.int64), word[order].astype(np.int64)
            pair = np.ones(len(order), bool)
            pair[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
            starts = np.flatnonzero(pair)
            seen = np.add.reduceat(train[order].astype(np.int64), starts)
            context, word = context[starts], word[starts]
            context_count = context_count[order][starts].astype(np.float64)
            unigram = np.log10((word_count[order][starts] + 1.0) / (total + distinct + 1))
            with tempfile.TemporaryDirectory() as folder:
                build_trie(context, word, seen, context_count, unigram, kinds).save(folder)
                found = NgramTrie.open(folder).log10(context, word, unigram)
            score = np.empty(len(order))
            score[order] = found[np.cumsum(pair) - 1]
            score = np.bincount(place, weights=score, minlength=size)
            for number, start, docs in batches:
                numbers.append(number)
                sums.append((False, pack(score[start : start + docs])))
        return pa.table(
            {
                "batch": pa.array(numbers, pa.int64()),
                "own": pa.array([x[0] for x in sums], pa.bool_()),
                "data": pa.array([x[1] for x in sums], pa.binary()),
            }
        )

    return run


def build_trie(context, word, seen, context_count, unigram, kinds: dict[int, int] | None = None) -> NgramTrie:
    """The trie of sorted distinct pairs with their training counts; pairs that were not seen are left out.

    P(w | v) = (1 - k) c(v w) / c(v) + k P(w), with k = T / (C + T) from the C occurrences
    and T distinct successors of v: Witten-Bell's (c(v w) + T P(w)) / (c(v) + T). kinds
    has T for the contexts of which this shard holds a part; their C is the context's
    count. Such a context is in the trie though no successor of it in this part was seen.
    """
    heads = runs(context)
    split = np.fromiter((kinds.get(c, 0) for c in context[heads].tolist()), np.int64, len(heads)) if kinds else np.zeros(len(heads), np.int64)
    owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(context))))
    here = np.bincount(owner, weights=seen > 0, minlength=len(heads)).astype(np.int64)
    mass = np.where(split > 0, context_count[heads], np.bincount(owner, weights=seen, minlength=len(heads)))
    every = np.where(split > 0, split, here)
    weight = every / np.maximum(mass + every, 1)
    kept = np.flatnonzero(seen > 0)
    share = weight[owner[kept]]
    values = np.log10((1 - share) * seen[kept] / context_count[kept] + share * 10 ** unigram[kept])
    held = np.flatnonzero(every > 0)
    return NgramTrie.build(context[heads[held]], np.log10(weight[held]), here[held], word[kept], values)


def _finish(total: int):
    def run(parts):
        score = 0.0
        for own, data in zip(parts.column("own").to_pylist(), parts.column("data").to_pylist()):
            if own:
                ids, nulls, held, tokens, known, base, first = unpack(data)
                score = score + first
            else:
                score = score + unpack(data)[0]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=nulls),
                "held_out": pa.array(held),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(ids), total), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """Unigram and bigram log10 probabilities of every text, learned from those not held out.

    Words are runs of anything but ASCII white space, A-Z in lower case; a mark between
    texts counts as one word at each text's end and is the context of its first word.
    One row is returned for each row given, repeated rows and null ids included. A null
    text is empty: it has the end alone. A null held_out counts as false. With no
    training text every probability is the add-one estimate. Other columns are ignored.
    """
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        F.col(text).alias("text"),
    )
    state = durable(source.mapInArrow(_prepare, "batch long, tokens long, train_tokens long, train_docs long, data binary"))
    sums = state.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "train_tokens", "train_docs"))).first()
    tokens, total, train_docs = sums
    shards = max(8, -(-tokens // shard))

    asked = state.select("batch", "data").mapInArrow(_ask_words(shards), "shard long, batch long, data binary")
    answers = durable(
        asked.groupBy("shard").applyInArrow(_count_words(shards, total), "batch long, shard long, known long, hot binary, data binary")
    )
    known = answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    distinct = known + (train_docs > 0)

    # words so frequent that they are split as contexts; by their counts there are no more of them than shards
    hot = dict(pair for r in answers.where("hot is not null").select("hot").toLocalIterator() for pair in unpack(r.hot)[0])
    if train_docs * shards >= max(total, 1):
        hot[b""] = BOUNDARY
    kinds = {}
    if hot:
        pairs = state.select("data").mapInArrow(_split_pairs(shards, hot), "shard long, data binary")
        parts = pairs.groupBy("shard").applyInArrow(_count_kinds, "context long, kinds long")
        kinds = {r.context: r.kinds for r in parts.groupBy("context").agg(F.sum("kinds").alias("kinds")).collect()}
    both = state.select("batch", "data").groupBy("batch").cogroup(answers.select("batch", "shard", "data").groupBy("batch"))
    asks = both.applyInArrow(_ask_contexts(shards, total, distinct, train_docs), "shard long, batch long, own boolean, data binary")
    scored = asks.groupBy("shard").applyInArrow(_score_shard(total, distinct, kinds), "batch long, own boolean, data binary")
    return scored.groupBy("batch").applyInArrow(_finish(total), OUT)


def op1_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32 modulo 7 is 2 are held out of training."""
    return score_texts(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)
