import random

import numpy as np
import pytest

from guardframe.llm import token_counts as tc

SCORES = tc.load_scores()


def brute(word, scores):
    low = min(scores.values()) - tc.UNKNOWN
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        options = []
        for i in range(max(0, j - 48), j):
            if word[i:j] in scores:
                options.append((best[i][0] + scores[word[i:j]], best[i][1] + 1))
        if word[j - 1] not in scores:
            options.append((best[j - 1][0] + low, best[j - 1][1] + len(word[j - 1].encode())))
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def test_counts_are_those_of_a_plain_viterbi():
    rng = random.Random(3)
    pool = list(SCORES)
    words = ["", "▁", "▁a", "▁hello", "▁naïveté", "▁漢字かな", "▁🙂🙂", "▁" + "x" * 300]
    words += ["▁" + "".join(rng.choice(pool).replace("▁", "") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    words += ["▁" + "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    words = list(dict.fromkeys(words))
    rng.shuffle(words)
    got = tc.count_tokens(words, tc.Pieces(SCORES))
    assert got.tolist() == [brute(w, SCORES) for w in words]


def test_long_words_are_those_of_a_plain_viterbi_and_quick():
    rng = random.Random(5)
    pool = [p.replace("▁", "") for p in SCORES]
    words = ["▁" + "".join(rng.choice(pool) for _ in range(300)) for _ in range(5)] + ["▁" + "漢é🙂z" * 200, "▁" + "x" * 3000]
    pieces = tc.Pieces(SCORES)
    assert all(len(w) >= tc.LONG for w in words)
    assert tc.count_tokens([*words, "▁short"], pieces).tolist() == [*(brute(w, SCORES) for w in words), brute("▁short", SCORES)]
    assert tc.count_tokens(["▁" + "QUJD" * 50_000], pieces)[0] > 0


def test_counts_agree_with_a_public_unigram_implementation():
    tokenizers = pytest.importorskip("tokenizers")
    vocab = [("<unk>", 0.0), *SCORES.items()]
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(vocab, unk_id=0))
    words = ["▁" + w for w in "the quick brown fox jumps over internationalization unbelievably lazy dogs thhaonre".split()]
    assert tc.count_tokens(words, tc.Pieces(SCORES)).tolist() == [len(model.encode(w).tokens) for w in words]


def test_tiny_vocabulary_and_ties():
    scores = {"a": -1.0, "b": -1.0, "ab": -2.0, "▁": -1.0}
    assert tc.count_tokens(["▁ab", "▁abab", "▁c"], tc.Pieces(scores)).tolist() == [2, 3, 2]
    assert tc.count_tokens([], tc.Pieces(scores)).tolist() == []


def test_rows(spark):
    rows = [(1, "ab  cd\n ab", 7), (1, "ab  cd\n ab", 7), (None, None, 1), (2, "", 2), (3, " \t ", 3)]
    got = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")).collect()
    one = int(np.sum(tc.count_tokens(["▁ab", "▁cd", "▁ab"], tc.Pieces(SCORES))))
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in got) == [(0, 0, 0), (1, 3, one), (1, 3, one), (2, 0, 0), (3, 0, 0)]
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
