"""Results that must be whole: near copies, hot contexts, concatenated archives, repeated and null ids."""

import base64
import bz2
import gzip
import lzma
import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from guardframe.llm import knn, ngram, secrets, simhash


def _copies(rng, k):
    """A text of shingles that differ, and another at a similarity of 0.8 to 0.9 of five-word shingles."""
    n = int(rng.integers(60, 300))
    words = [f"p{k}w{i}" for i in range(n + 4)]
    gone = 0.1 + 0.1 * (k % 11) / 10
    drop = int(n * gone)  # words cut off the end leave n - drop of n shingles
    return " ".join(words), " ".join(words[: n + 4 - drop])


def test_near_duplicates_of_a_similarity_of_80_to_90_are_all_found(spark):
    rng = np.random.default_rng(8)
    docs = []
    for k in range(150):
        a, b = _copies(rng, k)
        docs += [(2 * k, a), (2 * k + 1, b)]
    got = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {2 * k + 1 for k in range(150)}


def test_near_duplicates_with_a_passage_that_is_repeated(spark):
    docs = []
    for k in range(20):
        words = " ".join(f"p{k}w{i}" for i in range(200))
        line = " ".join(f"p{k}line{i}" for i in range(10))
        docs += [(2 * k, f"{words}\n{line}"), (2 * k + 1, words + f"\n{line}" * 150)]
    got = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {2 * k + 1 for k in range(20)}


def test_stages_judge_rows_whose_ids_are_repeated_or_null(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ture", "ness", "ba"], rng.integers(2, 5)))
    fresh = lambda: " ".join(word() for _ in range(60))
    junk = lambda: " ".join(word() + "@@@" for _ in range(60))
    item = " ".join(word() for _ in range(20))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], schema)
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    want = lambda rows: sorted((i is None, i or 0, t) for i, t in rows)
    spark.createDataFrame([(k, int(k % 2), 0) for k in range(80)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [(k, fresh()) for k in range(1, 80, 2)] + [(500, fresh()), (None, fresh())]
    bad = [(k, junk()) for k in range(0, 80, 2)] + [(500, junk()), (None, junk())]
    assert texts(corpus_pipeline.quality(spark, frame(good + bad + good[:1]), str(tmp_path))) == want(good + good[:1])

    held = [(500, f"{fresh()} {item}"), (None, f"{fresh()} {item}")]
    assert texts(corpus_pipeline.decontaminate(spark, frame(good + held), str(tmp_path))) == want(good)

    a, b, c, d = fresh(), fresh(), fresh(), fresh()
    rows = [(7, a), (7, a), (7, b), (8, a + " more"), (None, a), (None, c), (None, c), (None, c + " more"), (9, d), (None, d)]
    left = texts(corpus_pipeline.near_dedup(spark, frame(rows), str(tmp_path)))
    assert [x for x in left if not x[0]] == want([(7, a), (7, b), (9, d)])
    assert len(left) == 4 and left[-1][2] in (c, c + " more")


def test_a_hot_context_of_one_successor_is_alike_in_all_shards(spark):
    others = [f"w{k}" for k in range(40)]
    texts = ["hot next " * 40 + others[k % 40] for k in range(60)] + [f"hot {w} {w}" for w in others]
    tokens = [[*t.split(), "END"] for t in texts]
    held = [k >= 60 for k in range(len(texts))]
    c, b = Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            c.update(t)
            b.update(zip(["END", *t], t))
    after = Counter(v for v, _ in b)
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 1) / (n + v + 1)
    full = lambda h, w: (b[h, w] + after[h] * p(w)) / (c[h] + after[h]) if c[h] else p(w)
    want = [sum(math.log10(full(h, w)) for h, w in zip(["END", *t], t)) for t in tokens]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shard in (500, 2_000_000):
        got = {r.doc_id: r.score for r in ngram.score_texts(df, F.col("doc_id") >= 60, shard=shard).collect()}
        assert max(abs(got[k] - w) for k, w in enumerate(want)) < 1e-6, shard


def test_knn_with_an_id_that_fills_a_third_of_the_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 40]) for i in range(1, 400)]
    rows += [(100, [5.0 + float(x) for x in rng.normal(size=4) * 1e-3]) for _ in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in knn.knn_join(df).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for q in (100, 200, 300):
        own = min((np.array(v, "<i8").tobytes(), v) for i, v in ints if i == q)[1]
        scores = sorted(((-sum(x * y for x, y in zip(own, v)), i) for i, v in ints if i != q))[:10]
        assert got[q] == [(i, -s) for s, i in scores]


def test_knn_of_few_distinct_vectors_has_pivots(spark):
    for seed in range(3):
        rows = [(100 + k % 2, [float(seed), float(k % 2)]) for k in range(3000)]
        got = knn.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert len(got) == 10 and {r.vec_id for r in got} == {101}


KEY = "AKIA" + "Q7" * 8


def kinds(data):
    _, spans, _, cut = secrets.scan(base64.b64encode(data).decode())
    return {k for k, *_ in spans}, cut


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress])
def test_all_members_of_a_packed_piece_are_read(pack):
    assert kinds(pack(b"nothing here " * 9) + pack(b"password = hunter2hunter2 ") + pack(KEY.encode())) == ({"assign", "access"}, False)
    assert kinds(pack(pack(b"plain words ") + pack(KEY.encode()))) == ({"access"}, False)


def test_long_packed_pieces_are_read_to_the_end():
    text = ("é words and more words\n" * 3_200_000).encode()  # over 64 MB
    assert kinds(gzip.compress(text + KEY.encode(), 1)) == ({"access"}, False)


def test_a_control_character_or_an_invalid_byte_hides_nothing():
    assert kinds(b"some words\x00and \xff others " + KEY.encode()) == ({"access"}, False)
