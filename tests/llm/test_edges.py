"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guardframe.llm import decontaminate, knn, lines, mixing, ngram, quality, simhash, toxicity
from guardframe.llm.common import remainder, split_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, held boolean, stats string, _gone string, block long"


def rows(*texts, ids=None):
    ids = ids or range(len(texts))
    return [(i, t, None, f"s{k % 4}" if k % 5 else None, None, 0.5, 1, True, "x", "y", 3) for k, (i, t) in enumerate(zip(ids, texts))]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with all that may go wrong."""
    texts = ["the cat sat on the mat today", "the cat sat on the mat today", None, "", " \n\t ", LONG, "é ü 漢字 words here\nand here", "x" * 50_000, "\x00odd\x7f"]
    return spark.createDataFrame(rows(*texts, "again and again", "again and again", None, ids=[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None]), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram(spark, odd, none):
    got = ngram.score_texts(odd, remainder(F.col("doc_id"), 7) == 2).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert len(got) == len(texts)
    tokens = {i: [*(t or "").encode().lower().split(), "END"] for i, t in enumerate(x for _, x in texts)}
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    c, b, after, total = Counter(), Counter(), defaultdict(set), Counter()
    for k, t in tokens.items():
        if not held[k]:
            c.update(t)
            for v, w in zip(["END", *t], t):
                b[v, w] += 1
                total[v] += 1
                after[v].add(w)
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 1) / (n + v + 1)
    full = lambda h, w: (b[h, w] + len(after[h]) * p(w)) / (total[h] + len(after[h])) if total[h] else p(w)
    want = sorted((len(t), round(sum(math.log10(p(w)) for w in t), 4), round(sum(math.log10(full(h, w)) for h, w in zip(["END", *t], t)), 2)) for t in tokens.values())
    have = sorted((r.n_tokens, round(r.base_score, 4), round(r.score, 2)) for r in got)
    assert [(a, x) for a, x, _ in have] == [(a, x) for a, x, _ in want]
    assert all(abs(a[2] - b[2]) <= 0.02 * max(1, a[0]) for a, b in zip(have, want))
    assert all(r.train_tokens == n for r in got)
    assert ngram.score_texts(none, F.lit(False)).count() == 0
    assert {r.base_score for r in ngram.score_texts(odd.limit(1), F.lit(True)).collect()} == {0.0}


def test_words_of_a_slice():
    odd = ["Aé b C", None, "D\nE  f", "", "Gé hÉ Ij", "k"]
    for texts, kind in itertools.product((odd, [t for t in odd if t]), (pa.string(), pa.large_string())):
        for start in range(len(texts)):
            codes, lengths, words = split_words(pa.array(texts, kind).slice(start))
            got = [words[c].decode() for c in codes]
            assert got == [w for t in texts[start:] for w in (t or "").translate(LOWER).split()]
            assert lengths.tolist() == [len((t or "").split()) for t in texts[start:]]


def test_ngram_over_several_batches_of_one_partition(spark):
    """A batch of rows that is cut by its size gives the same words as rows on their own."""
    texts = [f"É{k}Ab " * 200_000 + f"End{k} x" for k in range(4)]
    assert sum(len(t.encode()) for t in texts) * 3 > ngram.BATCH
    docs = spark.createDataFrame([(k, t * 3) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in ngram.score_texts(docs, F.col("doc_id") == 2).collect()}
    tokens = {k: [*(t * 3).translate(LOWER).split(), "END"] for k, t in enumerate(texts)}
    count = Counter(w for k, ws in tokens.items() if k != 2 for w in ws)
    total = sum(count.values())
    for k, ws in tokens.items():
        assert got[k].n_tokens == len(ws) and got[k].n_known == sum(count[w] > 0 for w in ws) and got[k].train_tokens == total
        assert got[k].base_score == pytest.approx(sum(n * math.log10((count[w] + 1) / (total + len(count) + 1)) for w, n in Counter(ws).items()))


def test_many_shards_change_nothing(spark, odd):
    a = ngram.score_texts(odd, F.lit(False), shard=2_000_000).collect()
    b = ngram.score_texts(odd, F.lit(False), shard=500).collect()
    key = lambda r: (r.n_tokens, r.base_score)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert x[:6] == y[:6] and abs(x.score - y.score) < 0.03 * max(1, x.n_tokens)


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1 << 60), (1000, 5000), (5000, 1 << 40), (70_000, 1 << 20)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    e = ngram.EliasFano.build(values)
    if n:
        assert (e.access(np.arange(n)).astype(np.int64) == values).all()
    asked = np.concatenate((rng.integers(0, top, 500), values[:200], values[-200:] + 1))
    assert (e.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie_files_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(1, 60, (400, 2))})
    context, word = map(np.array, zip(*pairs))
    count = rng.integers(0, 4, len(pairs))
    unigram = np.full(len(pairs), -2.0)
    ngram.build_trie(context, word, count, np.full(len(pairs), 50.0), unigram).save(str(tmp_path))
    got = ngram.NgramTrie.open(str(tmp_path)).log10(context, word, unigram)
    for c in np.unique(context):
        at = context == c
        kinds, mass = (count[at] > 0).sum(), count[at].sum()
        if mass:
            k = kinds / (mass + kinds)
            want = np.log10(np.where(count[at] > 0, (1 - k) * count[at] / 50, 0) + k * 10**-2.0)
            assert np.abs(got[at] - want).max() < 0.05


def test_quality_and_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality long, toxic long")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        got = scores(odd, labels, F.lit(False)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert scores(none, labels, F.lit(False)).count() == 0
        flat = scores(odd, labels.limit(0), F.lit(False)).collect()
        assert {r.score for r in flat} == {0.5}
    assert quality.statistics(None) == quality.statistics(" \n") == [0.0] * len(quality.STATISTICS)


def test_rules_compile_to_what_they_say(spark):
    stats = [[float(k % 5), float(k)] for k in range(20)]
    df = spark.createDataFrame([(s,) for s in stats], "stats array<double>")
    rule = ((0, False, 2.0), (1, True, 6.0))
    model = quality.RuleModel(-1.0, [(rule, 2.5)])
    got = [r.p for r in df.select(model.column().alias("p")).collect()]
    want = [1 / (1 + math.exp(1.0 - 2.5 * (s[0] <= 2 and s[1] > 6))) for s in stats]
    assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    """Junk and abuse planted in plain text are found in documents that no model saw."""
    rng = np.random.default_rng(5)
    syllables = ["ta", "ri", "mo", "sen", "lu", "vak", "ne", "dol"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.integers(30, 90))]
        junk, toxic = i % 4 == 0, i % 3 == 0
        if junk:
            words = [w + "###" for w in words]
        if toxic:
            for k in rng.integers(0, len(words), 8):
                words[k] = str(rng.choice(["wretched", "grubworm", "blockhead"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    for scores, column, mod, held in ((quality.quality_scores, "quality", 5, 0), (toxicity.toxicity_scores, "toxic", 3, 1)):
        got = scores(docs, labels, remainder(F.col("doc_id"), mod) == held).where("held_out").join(labels, "doc_id").collect()
        assert len(got) > 80 and np.mean([r.predicted == r[column] for r in got]) > 0.95


def test_simhash(spark, odd, none):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.simhash_components(odd).collect()}
    assert got[0] == (got[1][0], 0) and got[1][1] == 0
    assert got[2] == got[3] == got[4] and got[2][0] == 0 and got[2][1] == 2
    assert simhash.simhash_components(odd).count() == odd.count() and simhash.simhash_components(none).count() == 0
    gone = {r.doc_id for r in simhash.near_duplicates(odd).collect()}
    assert {1, 3, 4} <= gone and not gone & {0, 2, 5, 6, 7, 8, None}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("radius", "blocks"), [(2, 4), (2, 1), (3, 8), (10, 1)])
def test_tiles_lose_no_link(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63, 60)
    fps = set(base.tolist())
    for f in base[:30].tolist():
        for _ in range(6):
            flipped = np.uint64(f & (2**64 - 1))
            for bit in rng.choice(64, rng.integers(1, radius + 2), replace=False).tolist():
                flipped ^= np.uint64(1) << np.uint64(bit)
            fps.add(int(flipped.astype(np.int64)))
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, blocks, tile=8).collect()
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    u = np.array(fps).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    for a, b in links:
        i, j = fps.index(a), fps.index(b)
        assert near[i, j]
        label[root(a)] = root(b)
    assert all(root(fps[i]) == root(fps[j]) for i, j in zip(*np.nonzero(near)))


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 1000)  # many tiles
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(30):
        words = list(base)
        words[k * 13] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(f"other{k}-{i}" for i in range(50)) for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect()} == set(range(1, 30))


def test_contamination(spark, odd, none):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (2, "hi there"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame(rows("before " + item.upper() + " after", "one two three four five six seven eight x ten", "oh hi\tthere!", "oh HI There you", None), SCHEMA)
    got = sorted((r.doc_id, r.item_id, r.shingles, r.found) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(0, 1, 8, 8), (0, 1, 8, 8), (1, 1, 8, 6), (1, 1, 8, 6), (2, 2, 1, 1), (3, 2, 1, 1)]
    assert decontaminate.contaminated(odd, items).count() == 0 and decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def _held(item, words):
    """The best (found, shingles) of an item's pieces in a document's words, by trying every stretch."""
    best = (0, 1)
    for first in range(0, max(len(item) - 32, 1), 32):
        part = item[first : first + 64]
        k = min(3, len(part))
        wanted = {tuple(part[j : j + k]) for j in range(len(part) - k + 1)}
        own = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
        found = max((len(wanted & set(own[a : a + 2 * len(wanted)])) for a in range(len(own))), default=0)
        if found >= (0.4 if len(wanted) >= 8 else 0.8) * len(wanted) - 1e-9 and found * best[1] > best[0] * len(wanted):
            best = (found, len(wanted))
    return best


def test_contamination_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 400)}"
    items = [(i, " ".join(word() for _ in range(rng.integers(1, 150 if i % 5 == 0 else 60)))) for i in range(40)]
    docs = []
    for k in range(120):
        words = [word() for _ in range(rng.integers(0, 300))]
        if k % 2:
            passage = items[k % 40][1].split()
            for _ in range(k % 9):
                passage[rng.integers(0, len(passage))] = "changed"
            passage[k % 7 : k % 7] = [word() for _ in range(k % 11)] * (k % 5)
            words[5:5] = passage[(k % 4) * 3 :]
        docs.append((k, " ".join(words)))
    docs.append((200, "\n".join(f"{items[5][1]} {items[10][1]}" for _ in range(50))))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, x in docs:
        for i, t in items:
            found, n = _held(t.split(), x.split())
            if found:
                want[d, i] = (found, n)
    assert len(want) > 40
    for size in (1500, 16 << 20):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", size)
        got = decontaminate.contaminated(*frames).collect()
        assert {(r.doc_id, r.item_id): (r.found, r.shingles) for r in got} == want and len(got) == len(want)


def _changed(rng, words, how):
    """A passage of an item, as it may stand in a document."""
    words = list(words)
    if how == "whole":
        return words
    if how == "bare":
        return [x for w in words if (x := "".join(c for c in w.upper() if c.isalnum()))]
    if how == "half":
        at = int(rng.integers(0, len(words) - len(words) // 2))
        return words[at : at + (len(words) + 1) // 2]
    if how == "cut":
        for _ in range(2):
            at = int(rng.integers(1, len(words)))
            words[at:at] = [f"between{k}" for k in range(6)]
        return words
    for k in range(len(words)):
        if rng.random() < how:
            words[k] = f"other{k}"
    return words


@pytest.mark.parametrize("how", ["whole", "bare", "half", "cut", 0.02, 0.05, 0.1, 0.15])
def test_changed_passages_are_found_and_clean_documents_are_not(spark, how):
    """Recall of at least 0.9 for each kind of change; documents of the same vocabulary stay clean."""
    rng = np.random.default_rng(4)
    draw = lambda n: [f"w{int(k)}{'.' if k % 7 == 0 else ''}" for k in rng.zipf(1.3, n) % 3000]
    items = [(i, draw(int(rng.integers(14, 60)))) for i in range(150)]
    docs = []
    for i, words in items:
        host = draw(400)
        docs += [(2 * i, [*host[:200], *_changed(rng, words, how), *host[200:]]), (2 * i + 1, host)]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    caught = sum((2 * i, i) in got for i, _ in items) / len(items)
    clean = 1 - len({d for d, _ in got if d % 2}) / len(items)
    assert caught >= 0.9 and clean >= 0.98, (caught, clean)


def test_lines(spark, odd, none):
    notice = "all rights reserved by the owners"
    texts = [f"alpha {k}\n  {notice} \nbeta {k}" for k in range(8)] + [notice, "short line", "short line", "short line", "short line", None, ""]
    docs = spark.createDataFrame(rows(*texts), SCHEMA)
    got = {r.doc_id: r for r in lines.line_dedup(docs).collect()}
    assert got[0].text == texts[0] and got[1].text == "alpha 1\nbeta 1" and got[8].text == "" and got[9].text == "short line"
    assert [got[k].n_removed for k in (0, 1, 8, 13)] == [0, 1, 1, 0] and got[13].text is None and got[14].n_lines == 0
    assert lines.line_dedup(odd).count() == odd.count() and lines.line_dedup(none).count() == 0
    assert [f.name for f in lines.line_dedup(docs).schema][: len(docs.columns)] == docs.columns
    few = docs.where("doc_id in (1, 2)")
    assert all(r.n_removed == 0 for r in lines.line_dedup(few).collect())


def test_knn(spark):
    rng = np.random.default_rng(0)
    table = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(400)]
    table += [(400, None), (401, [1.0, None, 1.0]), (402, [float("nan")] * 6), (500, [float("inf")] * 6), (600, [1.0, 2.0]), (700, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 7) for i, v in table], "vec_id long, embedding array<double>, d long")
    got = [tuple(r) for r in knn.knn_join(df).orderBy("query_id", "rank").collect()]
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q is not None and q % 100 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in good if i != q))[:10]
            want += [(q, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(best)]
    assert got == sorted(want)
    assert knn.knn_join(df.limit(0)).count() == 0 and knn.knn_join(df.where("vec_id = 1")).count() == 0
    assert knn.knn_join(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 50)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 5)) * 5
    table = [(i, [float(x) for x in centers[i % 8] + rng.normal(size=5) * 0.1]) for i in range(600)]
    got = {(r.query_id, r.rank): r.vec_id for r in knn.knn_join(spark.createDataFrame(table, "vec_id long, embedding array<float>"), k=3, every=10).collect()}
    m = np.floor(1024 * np.array([v for _, v in table], np.float32).astype(float))
    s = m @ m.T
    for q in range(0, 600, 10):
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-s[q, i], i))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == order


def test_mix_of_rows_that_are_alike(spark, monkeypatch):
    """A third of all rows are one row, and another third are empty: each takes its part and no shard has them all."""
    monkeypatch.setattr(mixing, "COPIES", 50)
    docs = [(7, "same words here " * 20, "a")] * 600 + [(k, None, "void") for k in range(600)] + [(k, f"w{k} " * 50, "b") for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.source_mix(df, shard=2000)
    again = sorted(map(tuple, got.collect()))
    assert again == sorted(map(tuple, mixing.source_mix(df.repartition(7), shard=2000).collect())) and len(again) == 1800
    hot = [r for r in again if r[0] == 7 and r[1] == 60]
    assert len(hot) == 600 and abs(sum(r[4] for r in hot) - hot[0][3]) < 0.02 * hot[0][3]
    assert all(r[4] == 0 for r in again if r[1] == 0) and all(r[4] <= 2 * r[1] for r in again)


def test_keys_of_lines_have_128_bits(spark):
    df = spark.range(5).selectExpr("concat('line ', id) line").select("line", *(h.alias(n) for h, n in zip(lines._key(), ("a", "b"))))
    chained = df.select("b", *(F.xxhash64(F.lit(k), "a").alias(f"x{k}") for k in (1, 2)), F.xxhash64("line", F.lit(1)).alias("y"), F.xxhash64("line", F.lit(2)).alias("z"))
    assert all(r.b not in (r.x1, r.x2, r.y, r.z) for r in chained.collect())


def test_mix(spark, odd, none):
    got = mixing.source_mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.source_mix(none).count() == 0
    rng = np.random.default_rng(1)
    docs = [(i, " ".join("w" * 3 for _ in range(rng.integers(0, 400))), ["a", "b", "c", None][min(3, int(rng.integers(0, 9)))]) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    a = mixing.source_mix(df, shard=5000).toPandas()
    b = mixing.source_mix(df, shard=5000).toPandas()
    assert a.sort_values("doc_id").taken.tolist() == b.sort_values("doc_id").taken.tolist()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    by = {i: s for i, _, s in docs}
    a["source"] = [by[i] for i in a.doc_id]
    for s in order:
        part = a[a.source.isna()] if s is None else a[a.source == s]
        assert abs(part.target.iloc[0] - target[s]) < 1e-6 * target[s]
        assert abs(part.taken.sum() - target[s]) < 0.05 * target[s]


def test_apportionment_is_sainte_lague(spark):
    rng = np.random.default_rng(9)
    claims = [(k, g, float(rng.integers(0, 1000))) for g in range(6) for k in range(rng.integers(1, 9))]
    seats = {g: int(rng.integers(0, 60)) for g in range(6)}
    df = spark.createDataFrame([(k, g, c, seats[g]) for k, g, c in claims], "k int, g int, c double, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], [F.col("k")], "c", "seats").collect()}
    for g, n in seats.items():
        mine = [(k, c) for k, gg, c in claims if gg == g and c > 0]
        best = sorted(((-c / (2 * s - 1), k) for k, c in mine for s in range(1, n + 1)))[:n]
        want = Counter(k for _, k in best)
        assert all(got[g, k] == want[k] for k, gg, _ in claims if gg == g)


def test_fingerprints_equal_a_plain_count_of_bits():
    """XXH64 of each run of words, in the order of the statement, one bit after the other."""
    xxhash = pytest.importorskip("xxhash")
    rng = np.random.default_rng(9)
    texts = [None, "", " \t\n", "One", "two WORDS", "a b c", "a b c d e f a b c a b c", "\u00c4 \u00e4\u00df\x0bx\x1cy z", LONG]
    texts += [" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in (3, 4, 40, 700)]
    for t in texts:
        words, now = [], ""
        for c in (t or "") + " ":
            if c in " \t\n\x0b\x0c\r":
                words += [now] if now else []
                now = ""
            else:
                now += c.lower() if "A" <= c <= "Z" else c
        grams = [words[k : k + 3] for k in range(len(words) - 2)] if len(words) > 2 else [words] if words else []
        hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert simhash.fingerprint(simhash.shingle_hashes(t, 3)) % (1 << 64) == want, t


def test_statistics_are_those_of_a_plain_count():
    text = "The Cat sat. the cat sat on | it!\nThe Cat sat.\n\nR\u00e4um auf 42 ##"
    got = dict(zip(quality.STATISTICS, quality.statistics(text)))
    data, words = text.encode(), text.encode().split()
    low = [w.decode().lower() for w in words]
    n = len(words)
    counts = Counter(w.encode() for w in low)
    want = {
        "log_chars": math.log1p(len(data)), "log_words": math.log1p(n), "word_length": sum(map(len, words)) / n, "longest_word": math.log1p(max(map(len, words))),
        "upper": sum(65 <= b <= 90 for b in data) / len(data), "digit": 2 / len(data), "space": sum(b in b" \n" for b in data) / len(data), "symbol": 2 / len(data), "mark": 2 / len(data),
        "bar": 1 / len(data), "bang": 1 / len(data), "odd_ends": 1 / n, "distinct_words": len(counts) / n, "top_word": max(counts.values()) / n, "repeated_runs": 0.0, "repeated_lines": 1 - 3 / 3,
        "line_words": math.log1p(n / 3), "stops": data.count(b".") / n, "capitals": sum(w[:1].isupper() for w in words) / n, "non_ascii": 2 / len(data), "short_words": sum(len(w) < 4 for w in words) / n,
        "word_entropy": -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n), "doubled": sum(a == b for a, b in zip(low, low[1:])) / n,
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value), name


def test_decontamination_stage_with_clashing_columns_and_without_rows(spark, tmp_path):
    """The row hashes of a stage take other names where the table has theirs; empty tables stay empty."""
    import corpus_pipeline

    spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_h1 string, row_h2 long, item_id long"
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine", None, None, None, "x", 1, 2), (None, "nothing to see", None, None, None, "x", 1, 2)], schema)
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [None]
    for stage in (corpus_pipeline.decontaminate, corpus_pipeline.near_dedup, corpus_pipeline.lines, corpus_pipeline.mix):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_runs_of_words_are_told_apart():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 9, 4000)
    for words in (1, 2, 3, 4, 5):
        runs = decontaminate.Runs(ids, words)
        for size in range(1, words + 1):
            got = runs.of(ids, size)
            want = [tuple(ids[k : k + size]) for k in range(len(ids) - size + 1)]
            assert len(set(zip(got.tolist(), want))) == len(set(got.tolist())) == len(set(want)) and got.min() >= 0
        other = np.array([1, 2, 0, 3, 99, 1, 2])
        assert runs.of(other, 1).tolist() == [1, 2, -1, 3, 99, 1, 2] and (runs.of(other, words)[2 - words + 1 if words < 3 else 0 : 3] == -1).all()


def test_an_item_of_millions_of_distinct_words(spark):
    """More words than 21 bits hold, in one item."""
    words = [f"{k:x}" for k in range(1 << 24, (1 << 24) + (1 << 21) + 5000)]
    item = " ".join(words)
    docs = spark.createDataFrame([(1, " ".join(words[-90:-20])), (2, " ".join(words[7:500:3])), (3, " ".join(words[:70]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()) == [(1, 5), (3, 5)]
