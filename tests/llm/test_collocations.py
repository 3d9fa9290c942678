"""Collocations against plain counts; quotient filters against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from guardframe.llm import collocations as co


def brute(rows, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in good.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= percent * c[q]}
        found = []
        for p, a in good.items():
            if p not in gone:
                s, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def odd_rows(seed=1):
    rng = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "naïve", "漢字", "\x00x", "\x1cy", "É", "a\x0bb", "🙂"]
    joins = [" ", "  ", "\t", ". ", ", ", "\n", "; ", " \r\n", ":", "!"]
    rows = []
    for _ in range(600):
        text = "".join(rng.choice(words) + rng.choices(joins, [30, 5, 3, 2, 2, 2, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" .,\n", "fr"), ("long words " * 20_000, "en"), ("x" * 100_000, "en"), ("same same same. " * 50, "zz"), rows[0], rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None if k % 9 == 0 else k, t, g, 3, "w") for k, (t, g) in enumerate(odd_rows())], "doc_id long, text string, lang string, id long, word string")


@pytest.mark.parametrize(("least", "percent", "top", "shard", "fan"), [(10, 50, 2000, 1 << 22, 8), (2, 90, 7, 1 << 10, 8), (1, 50, 100_000, 1 << 6, 2)])
def test_rows(docs, monkeypatch, least, percent, top, shard, fan):
    monkeypatch.setattr(co, "SHARD", shard)
    got = co.collocations(docs, least, percent, top, fan=fan)
    assert sorted(map(tuple, got.collect())) == brute(odd_rows(), least, percent, top)


def test_empty(docs):
    assert co.collocations(docs.limit(0)).count() == 0
    assert co.collocations(docs.where("text is null")).count() == 0


def test_words_and_pieces():
    words, counts, codes = co.code_words(pa.array(["A b.c", None, "", "b\tC  d,,e", ". .", "e"]))
    names = [w.decode() for w in words.to_pylist()]
    assert [names[k] if k >= 0 else "|" for k in codes] == ["a", "b", "|", "c", "|", "b", "c", "d", "|", "e", "|", "e"]
    assert dict(zip(names, counts.tolist())) == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 2}


@pytest.mark.parametrize("bits", [4, 11, 21, 22, 32])
def test_the_permutation_is_undone(bits):
    rng = np.random.default_rng(bits)
    a, c = rng.integers(0, 1 << 2 * bits, 5000, dtype=np.uint64), rng.integers(0, 1 << bits, 5000, dtype=np.uint64)
    x, y = co.Permutation(bits).forward(a, c)
    assert x.max() < 1 << 2 * bits and y.max() < 1 << bits and len(set(zip(x.tolist(), y.tolist()))) == len(set(zip(a.tolist(), c.tolist())))
    assert all((p == q).all() for p, q in zip(co.Permutation(bits).backward(x, y), (a, c)))


@pytest.mark.parametrize(("high", "low", "n", "most"), [(8, 4, 0, 1), (8, 4, 200, 3), (16, 8, 3000, 100_000), (44, 22, 5000, 1 << 40), (64, 32, 5000, 2), (3, 4, 100, 1 << 20), (40, 20, 1, 1)])
def test_a_filter_gives_back_what_it_was_built_from(high, low, n, most):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << high, n, dtype=np.uint64)
    a[: n // 3] = a[0] if n else 0  # many entries of one home
    c, count = rng.integers(0, 1 << low, n, dtype=np.uint64), rng.integers(1, most + 1, n)
    a, c, count = co.summed(a, c, count, max(low, -(-high // 2)))
    f = co.QuotientFilter.load(co.QuotientFilter.build(a, c, count, high, low).dump())
    assert all((x == y).all() for x, y in zip(f.items(), (a, c, count)))
    held = dict(zip(zip(a.tolist(), c.tolist()), count.tolist()))
    more = rng.integers(0, 1 << high, 300, dtype=np.uint64), rng.integers(0, 1 << low, 300, dtype=np.uint64)
    asked = np.concatenate((a, more[0])), np.concatenate((c, more[1]))
    assert f.get(*asked).tolist() == [held.get(k, 0) for k in zip(asked[0].tolist(), asked[1].tolist())]


def test_filters_merge_across_shards_of_any_width():
    rng = np.random.default_rng(3)
    space = co.Space(22, 6)
    want, filters = Counter(), []
    for k in range(5):
        ids = rng.integers(0, 40, 3000)
        for i in range(len(ids) - 1):
            if ids[i] and ids[i + 1]:
                want[int(ids[i]), int(ids[i + 1]), 0] += 1
                if i + 2 < len(ids) and ids[i + 2]:
                    want[int(ids[i]), int(ids[i + 1]), int(ids[i + 2])] += 1
        filters += space.split(*space.phrases(ids), 2 * (k % 3))  # of different widths
    at = np.cumsum([0] + [len(co.QuotientFilter.load(f).items()[0]) for _, f in filters])[-1]
    assert at > 1000
    a, c, count = space.merged(*zip(*filters))
    assert dict(zip(zip(*(x.tolist() for x in space.ids(a, c))), count.tolist())) == want


def test_numbers_have_no_gaps(spark):
    got = sorted(r.id for r in co.numbered(spark.range(1000).selectExpr("id * 3 as x").repartition(7).where("x % 2 = 0")).collect())
    assert got == list(range(1, 501))
