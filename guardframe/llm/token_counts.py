"""Operator 9: token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a run of anything but ASCII white space with the word mark before it. Its
best segmentation into pieces is found by Viterbi's forward pass, whose score after a
prefix depends on the prefix alone. So the distinct pre-tokens of a batch go into a
trie, and each of its nodes is scored once, for all pre-tokens that share it.

The pieces are those of a public vocabulary file; nothing is trained. Byte-pair files
give merge ranks, not probabilities: a piece of rank r (from 0) gets the Zipf score
-log(r + 1). A character that no piece spells costs UNKNOWN below the least score and
counts as one token a UTF-8 byte, as byte fallback does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from guardframe.llm.common import slices, table

#: The vocabulary file, where the driver finds it; the text put before a pre-token; the penalty of an unknown character.
VOCABULARY, MARK, UNKNOWN = "/opt/tokenizers/piece_bpe_32k.model", "▁", 10.0
#: Characters from which on a pre-token is scored by itself: so long a one shares its prefix with hardly any other.
LONG = 256


def load_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Score of each ordinary piece of a sentencepiece file, by rank of their own scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(r + 1) for r, i in enumerate(ids)}


class Pieces:
    """The pieces as a trie of sorted transitions: (state, character) -> state, with the score where a piece ends."""

    def __init__(self, scores: dict[str, float]):
        states = {"": 0}
        edges = []
        for piece in sorted(scores):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                    edges.append(((states[piece[: k - 1]] << 21) | ord(piece[k - 1]), states[piece[:k]]))
        edges.sort()
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.next = np.array([s for _, s in edges], np.int64)
        self.score = np.full(len(states), -np.inf)
        for piece, score in scores.items():
            self.score[states[piece]] = score
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.scores, self.nested = scores, None

    def tree(self) -> dict:
        """The trie as nested dictionaries, with a piece's score under the empty key; made when first asked for."""
        if self.nested is None:
            self.nested = {}
            for piece, score in self.scores.items():
                node = self.nested
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = score
        return self.nested

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states; -1 where no piece goes on."""
        key = (state << 21) | char
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.next[at], -1) if len(self.keys) else np.full(len(key), -1)


def count_long(word: str, pieces: Pieces) -> int:
    """Tokens of the best segmentation of one word, by the forward pass over its characters alone."""
    tree, unknown, n = pieces.tree(), pieces.unknown, len(word)
    best, tokens = [-math.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for start in range(n):
        now, count, node, end = best[start], tokens[start], tree, start
        while (node := node.get(word[end])) is not None:
            end += 1
            score = node.get("")
            if score is not None and (now + score > best[end] or (now + score == best[end] and count + 1 < tokens[end])):
                best[end], tokens[end] = now + score, count + 1
            if end == n:
                break
        if "" not in tree.get(word[start], ()):
            size, end = len(word[start].encode("utf-8", "surrogatepass")), start + 1
            if now + unknown > best[end] or (now + unknown == best[end] and count + size < tokens[end]):
                best[end], tokens[end] = now + unknown, count + size
    return tokens[n]


def count_tokens(words: list[str], pieces: Pieces) -> np.ndarray:
    """Tokens of the best segmentation of each word; of equal scores the one with fewer tokens."""
    if any(len(w) >= LONG for w in words):
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        out[short] = count_tokens([words[i] for i in short], pieces)
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = count_long(w, pieces)
        return out
    order = sorted(range(len(words)), key=words.__getitem__)
    chars = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    length = np.fromiter((len(words[i]) for i in order), np.int64, len(words))
    start = np.cumsum(length) - length

    out = np.zeros(len(words), np.int64)
    active = np.flatnonzero(length > 0)
    node = np.zeros(len(words), np.int64)  # the place of each word's prefix among the nodes of this depth
    best, tokens = np.zeros(1), np.zeros(1, np.int64)  # of the nodes of this depth
    # pieces under way at this depth: the node they are at, best score and tokens before them, state
    at = np.zeros(0, np.int64)
    before, count, state = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = 0
    while len(active):
        char, above = chars[start[active] + depth], node[active]
        new = np.ones(len(active), bool)
        new[1:] = (above[1:] != above[:-1]) | (char[1:] != char[:-1])
        parent, letter = above[new], char[new]
        # every node takes over its parent's pieces under way, and begins one
        first = np.searchsorted(at, np.arange(len(best) + 1))
        many = first[parent + 1] - first[parent]
        owner = np.repeat(np.arange(len(parent)), many)
        taken = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[parent], many)
        owner = np.concatenate((owner, np.arange(len(parent))))
        before = np.concatenate((before[taken], best[parent]))
        count = np.concatenate((count[taken], tokens[parent]))
        begun = np.concatenate((np.zeros(len(taken), bool), np.ones(len(parent), bool)))
        state = np.concatenate((state[taken], np.zeros(len(parent), np.int64)))
        state = pieces.step(state, letter[owner])
        ends = np.where(state >= 0, pieces.score[state], -np.inf)
        # a character that is no piece by itself may always stand alone, byte by byte
        alone = begun & (ends == -np.inf)
        size = 1 + (letter[owner] > 0x7F) + (letter[owner] > 0x7FF) + (letter[owner] > 0xFFFF)
        total = before + np.where(alone, pieces.unknown, ends)
        cost = count + np.where(alone, size, 1)
        rank = np.lexsort((cost, -total, owner))
        head = rank[np.searchsorted(owner[rank], np.arange(len(parent)))]
        best, tokens = total[head], cost[head]
        going = np.flatnonzero(state >= 0)
        going = going[np.argsort(owner[going], kind="stable")]
        at, before, count, state = owner[going], before[going], count[going], state[going]

        node[active] = np.cumsum(new) - 1
        depth += 1
        done = active[length[active] == depth]
        out[np.array(order)[done]] = tokens[node[done]]
        active = active[length[active] > depth]
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row's whole text.

    A null or empty text has none of either. Repeated rows and null ids are counted each
    for itself; no other column is read. Nothing is shuffled: a batch of documents shares
    its own trie, and the vocabulary, of a fixed size, goes to all executors once.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(load_scores(vocabulary)))

    def run(batches):
        for batch in slices(batches, "text", 24 << 20):
            index: dict[bytes, int] = {}
            codes, sizes = [], []
            for data in batch.column("text").cast(pa.large_binary()).to_pylist():
                found = (data or b"").split()
                sizes.append(len(found))
                codes += [index.setdefault(w, len(index)) for w in found]
            counts = count_tokens([MARK + w.decode() for w in index], pieces.value)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(owner, weights=counts[np.array(codes, np.int64)], minlength=len(sizes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(total)], names=["doc_id", "n_words", "n_tokens"]
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long"
    )


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
