"""Operator 13: byte-pair encoding and decoding of text as a stream, in memory that does not grow with the text.

Encoding is a transducer of three stages, each of which holds back only what later text may
still change: strings of added tokens, pre-tokens, and merges. The first two look two
characters or the length of an added token ahead. How far ahead the merges must look is
computed from the merge list.

Lookahead of a merge list. In a proper list (every part of a merge is a byte or made by an
earlier merge) merges happen in the order of their ranks. Text that is not known yet, past
place n, can at first change only a merge of a pair (u, v) at n itself. It decides whether u
is taken, so it may change a later merge (u', v') to the left of it only where v' is u or
begins with u as one of its parts, and then reaches |u'| further. The longest such chain of
growing ranks, in bytes, is the lookahead: tokens of the known text that end so far before
its end are the tokens of any text that goes on from it. After a token that is stable the
rest is encoded by itself, as no merge ever crosses a boundary between final tokens.

Nothing is trained: the vocabulary is a public file of the tokenizers library's format.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from guardframe.llm.common import slices, table

#: The vocabulary, where its library keeps it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The public pattern of byte-level pre-tokens (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters pushed at a time, and bytes of one pre-token from which on it is encoded piece by piece.
CHUNK, BLOCK = 1 << 16, 1 << 12
#: Remembered pre-tokens of a task, and their characters; forgotten all at once when either is passed.
REMEMBERED, CHARACTERS = 300_000, 8 << 20
#: Characters of short texts whose pre-tokens are merged together.
TOGETHER = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Vocabulary:
    """Tokens as bytes, merges by rank, added tokens, and the pattern of pre-tokens.

    Raises ValueError for files that this encoder does not cover: merges that are not
    proper, normalizers, other pre-tokenizers, added tokens with options.
    """

    def __init__(self, spec: dict, unknown_letters: str = ""):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or spec.get("normalizer") or any(model.get(k) for k in options):
            raise ValueError("only plain byte-pair models without a normalizer are covered")
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level pre-tokens without a prefix are covered")
        self.added = {}
        for t in spec.get("added_tokens", []):
            if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"added token with options: {t['content']}")
            self.added[t["content"]] = t["id"]
        letters = byte_alphabet()
        spell = lambda t: bytes(letters[c] for c in t)
        self.bytes = {i: spell(t) for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.added.items()}
        self.byte = [model["vocab"].get(c) for c in sorted(letters, key=letters.get)]
        if None in self.byte:
            raise ValueError("a byte has no token")
        self.pairs, self.made, parts = {}, [], {}
        self.table = None
        known = set(self.byte)
        for rank, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][t] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            new = model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))]
            if not {a, b} <= known or new in known:
                raise ValueError(f"merge {rank} is not proper")
            known.add(new)
            self.pairs[a << 32 | b] = rank
            self.made.append(new)
            parts[new] = (a, b)
        self.lookahead = self._lookahead(parts)
        self.unknown_letters = unknown_letters

    def _lookahead(self, parts: dict[int, tuple[int, int]]) -> int:
        """The longest chain of merges by which text past a place may change tokens before it, in bytes."""
        reach: dict[int, int] = defaultdict(int)  # by token: how far a change at its left edge goes by later merges
        longest = 0
        for new in reversed(self.made):
            left, right = parts[new]
            far = len(self.bytes[left]) + reach[left]
            longest = max(longest, far)
            while True:  # right and all its first parts
                reach[right] = max(reach[right], far)
                if right not in parts:
                    break
                right = parts[right][0]
        return longest

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        """The vocabulary of a file, with the letters that the library's own tables do not call so."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return cls(spec, unknown_letters(path))

    def merge(self, data: bytes) -> list[int]:
        """Tokens of bytes that no boundary divides."""
        ids = [self.byte[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        pairs = self.pairs
        while len(ids) > 1:
            ranks = [pairs.get(a << 32 | b, 1 << 60) for a, b in zip(ids, ids[1:])]
            least = min(ranks)
            if least == 1 << 60:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [self.made[least]]
        return ids

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed tokens of each piece: each round makes every piece's next merge, for all pieces at once."""
        out = [b""] * len(pieces)
        short = [k for k, p in enumerate(pieces) if 0 < len(p) <= 64]
        for k, p in enumerate(pieces):
            if len(p) > 64:
                out[k] = np.array(self.merge(p), "<i4").tobytes()
        if not short:
            return out
        if self.table is None:
            keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
            ranks = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
            order = np.argsort(keys)
            self.table = np.append(keys[order], 1 << 62), np.append(ranks[order], 0), np.array(self.made, np.int64), np.array(self.byte, np.int64)
        keys, ranks, made, byte = self.table
        never = 1 << 40

        def rank_of(left, right):
            key = left << 32 | right
            at = np.searchsorted(keys, key)
            return np.where(keys[at] == key, ranks[at], never)

        ids = byte[np.frombuffer(b"".join([pieces[k] for k in short]), np.uint8)]
        piece = np.repeat(np.arange(len(short)), [len(pieces[k]) for k in short])
        # rank of each token with the next one of its piece
        rank = np.full(len(ids), never)
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inner] = rank_of(ids[inner], ids[inner + 1])
        done_ids, done_piece = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            going = least < never
            if not going.all():
                keep = np.repeat(going, size)
                done_ids.append(ids[~keep])
                done_piece.append(piece[~keep])
                ids, piece, rank = ids[keep], piece[keep], rank[keep]
                size, least = size[going], least[going]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            at = hit[np.concatenate(([True], piece[hit[1:]] != piece[hit[:-1]]))]  # the leftmost of each piece
            ids[at] = made[least]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
            at = at - np.arange(len(at))  # one token fewer for each piece before
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(ids)]
                same = piece[i] == piece[i + 1]
                rank[i[same]] = rank_of(ids[i[same]], ids[i[same] + 1])
            # the last of a piece has no next one
            last = at[(at + 1 == len(ids)) | (piece[np.minimum(at + 1, len(ids) - 1)] != piece[at])]
            rank[last] = never
        owner = np.concatenate(done_piece)
        order = np.argsort(owner, kind="stable")
        packed = np.concatenate(done_ids)[order].astype("<i4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(short))) * 4
        start = 0
        for k, end in zip(short, ends.tolist()):
            out[k] = packed[start:end]
            start = end
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place), for long pieces."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in ids if t >= 0]


def unknown_letters(path: str) -> str:
    """Characters that this process calls letters or digits and the tokenizers library does not, as ranges of a character class.

    The two follow different versions of Unicode, so only characters that are unassigned
    in Python's own table are asked.
    """
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    odd = regex.findall(r"[\p{L}\p{N}]", unassigned)
    found = [ord(c) for c in odd if len(split("a" + c)) > 1 and len(split("1" + c)) > 1]
    starts = [x for k, x in enumerate(found) if not k or found[k - 1] != x - 1]
    ends = [x for k, x in enumerate(found) if k + 1 == len(found) or found[k + 1] != x + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class _Remembered(dict):
    """Packed ids of pre-tokens met before."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.characters = vocabulary, 0

    def learn(self, words: set[str]) -> None:
        """Makes sure that all the words are here."""
        new = list(words.difference(self))
        if len(self) + len(new) > REMEMBERED or self.characters > CHARACTERS:
            self.clear()
            new, self.characters = list(words), 0
        self.update(zip(new, self.vocabulary.merge_all([w.encode() for w in new])))
        self.characters += sum(map(len, new))


class Scanner:
    """Patterns of pre-tokens: the public one, and one for texts with letters that the library does not know."""

    def __init__(self, vocabulary: Vocabulary):
        odd = vocabulary.unknown_letters
        self.plain = regex.compile(PATTERN)
        # the same for texts of ASCII alone
        self.ascii = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
        self.odd = regex.compile(f"[{odd}]") if odd else None
        letter, digit = (rf"[\p{{{k}}}--[{odd}]]" if odd else rf"\p{{{k}}}" for k in "LN")
        other = rf"[^\s\p{{L}}\p{{N}}]|[{odd}]" if odd else r"[^\s\p{L}\p{N}]"
        self.exact = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?(?:{other})+|\s+(?!\S)|\s+")
        self.runs = [regex.compile(p) for p in (rf"(?V1){letter}*+", rf"(?V1){digit}*+", rf"(?V1)(?:{other})*+")]
        self.space = regex.compile(r"\s*+")

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        return (self.exact if self.odd and self.odd.search(text) else self.plain).findall(text)

    def run_of(self, char: str) -> regex.Pattern:
        """What goes on a run that holds the character."""
        return next((p for p in self.runs if p.match(char).end()), self.space)


class Encoder:
    """Text in pieces of any size in, packed ids out as soon as no later text can change them.

    finish() gives what was held back; the encoder then begins anew. The memory is a few
    pieces, BLOCK and the lookahead, whatever the text's length.
    """

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK):
        self.vocabulary, self.block = vocabulary, block
        self.scanner, self.remembered = Scanner(vocabulary), _Remembered(vocabulary)
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.hold = max(map(len, added), default=1) - 1
        self.held, self.rest, self.run, self.open = "", "", None, b""

    def push(self, text: str) -> bytes:
        return self._packed([self._push(text, False)])[0]

    def finish(self) -> bytes:
        return self._packed([self._push("", True)])[0]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, pushed piece by piece."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, one after the other; pre-tokens of short texts are merged together."""
        out, held, owner, size = [[] for _ in texts], [], [], 0
        for k, text in enumerate(texts):
            for i in range(0, max(len(text), 1), CHUNK):
                piece = text[i : i + CHUNK]
                held.append(self._push(piece, i + CHUNK >= len(text)))
                owner.append(k)
                size += len(piece)
                if size >= TOGETHER:
                    for j, ids in zip(owner, self._packed(held)):
                        out[j].append(ids)
                    held, owner, size = [], [], 0
        for j, ids in zip(owner, self._packed(held)):
            out[j].append(ids)
        return [np.frombuffer(b"".join(x), "<i4") for x in out]

    def _packed(self, held: list[list[bytes | list[str]]]) -> list[bytes]:
        """Ids in place of the pre-tokens of each list; what is packed already stays."""
        words = set()
        for parts in held:
            words.update(*[p for p in parts if type(p) is list])
        self.remembered.learn(words)
        known = self.remembered.__getitem__
        return [b"".join([b"".join(map(known, p)) if type(p) is list else p for p in parts]) for parts in held]

    def _push(self, text: str, last: bool) -> list[bytes | list[str]]:
        """Cuts at added tokens, which end a stretch of text as the text's end does."""
        text, out, at = self.held + text, [], 0
        if self.added:
            for m in self.added.finditer(text):
                out += [*self._stretch(text[at : m.start()], True), np.array([self.vocabulary.added[m.group()]], "<i4").tobytes()]
                at = m.end()
        end = len(text) if last else max(at, len(text) - self.hold)
        self.held = text[end:]
        return out + self._stretch(text[at:end], last)

    def _stretch(self, text: str, last: bool) -> list[bytes | list[str]]:
        """Cuts a stretch into pre-tokens; one that may go on is kept, or handed on in parts once it is long."""
        text, out = self.rest + text, []
        self.rest = ""
        if self.run:
            end = self.run.match(text).end()
            stops = last or end < len(text)
            if self.run is self.scanner.space and end and (end < len(text) or not last):
                end -= 1  # the last blank goes with what follows
            out.append(self._part(text[:end], stops))
            text = text[end:]
            if not stops:
                self.rest = text
                return out
            self.run = None
        words = self.scanner.words(text)
        if not last:
            kept, size = len(words), 0
            while kept and size < 2:
                kept -= 1
                size += len(words[kept])
            words, tail = words[:kept], words[kept:]
            self.rest = "".join(tail)
            if len(tail) == 1 and size > self.block:
                self.run = self.scanner.run_of(tail[0][-1])
                at = size - (self.run is self.scanner.space)
                self.rest = tail[0][at:]
                return [*out, words, self._part(tail[0][:at], False)]
        return [*out, words]

    def _part(self, text: str, ends: bool) -> bytes:
        """Ids that are stable, of a pre-token that comes in parts."""
        self.open += text.encode()
        if not ends and len(self.open) < self.block + self.vocabulary.lookahead:
            return b""
        ids = self.vocabulary.merge(self.open)
        if ends:
            self.open = b""
            return np.array(ids, "<i4").tobytes()
        place = np.cumsum([len(self.vocabulary.bytes[i]) for i in ids])
        stable = int(np.searchsorted(place, len(self.open) - self.vocabulary.lookahead, "right"))
        self.open = self.open[int(place[stable - 1]) :] if stable else self.open
        return np.array(ids[:stable], "<i4").tobytes()


class Decoder:
    """Ids in pieces in, text out, with at most three bytes of an unfinished character kept between pieces.

    Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a character.
    Unknown ids give nothing, as in the tokenizers library.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.state.decode(b"".join([self.bytes.get(i, b"") for i in ids]))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, ids: np.ndarray) -> str:
        got = [self.push(ids[i : i + CHUNK].tolist()) for i in range(0, len(ids), CHUNK)]
        return "".join([*got, self.finish()])


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every row's whole text; the ids are those of the tokenizers library without special tokens put in.

    A null text counts as empty and has no ids. The string of an added token in a text is
    that token. Repeated rows and null ids are encoded each for itself; no other column is
    read. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in slices(batches, "text", 8 << 20):
            found = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids): the text that the ids spell. Null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            texts = [decoder.decode(lists[k].values.to_numpy(zero_copy_only=False) if lists[k].is_valid else np.zeros(0, np.int32)) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of the text that they spell."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode_ids(encode_texts(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
