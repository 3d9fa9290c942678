"""The pipeline on a small folder of tables, stage by stage, against plain Python."""

import numpy as np
import pytest

import corpus_pipeline

NOTICE = "distributed under the terms of the example license"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ture", "ness", "ba"], rng.integers(2, 5)))
    items = [" ".join(word() for _ in range(20)) for _ in range(6)]
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(60)]
        good = i % 4 != 3
        if not good:
            words = [w + "@@@" for w in words]
        if i % 40 == 8:
            words[10:10] = items[i % 6].split()
        text = " ".join(words[:30]) + "\n" + NOTICE + "\n" + " ".join(words[30:])
        docs.append((i, text, "en", f"src{i % 7}"))
        labels.append((i, int(good), 0))
    near = docs[4][1].split(" ")  # not the first document, which keeps the notice
    near[3] = "altered"
    docs += [(500, docs[4][1], "en", "src0"), (501, " ".join(near), "en", "src0"), (502, None, None, None), (503, "", "en", "src1")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def grams(text):
    t = (text or "").lower().split()
    return set(zip(*(t[k:] for k in range(5))))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        assert docs.columns == columns, name
        docs = spark.createDataFrame(rows, docs.schema)
        seen.append({r.doc_id: r for r in rows})
    quality, lines, near, clean = seen
    assert not any("@@@" in (r.text or "") for r in quality.values())
    assert {i for i in range(240) if i % 4 != 3} <= set(quality)
    assert lines.keys() == quality.keys() and sum(NOTICE in (r.text or "") for r in lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in lines.values() if r.text is not None)
    assert 4 in near and 500 not in near and 501 not in near
    left = [(i, grams(r.text)) for i, r in near.items() if r.text]
    assert all(len(a & b) < 0.8 * len(a | b) for k, (_, a) in enumerate(left) for _, b in left[k + 1 :])
    items = [grams(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {i for i, r in near.items() if any(len(s & grams(r.text)) >= 0.8 * len(s) for s in items)}
    assert dirty and set(clean) == set(near) - dirty


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) > 150 and all(0 <= r.taken <= 2 * r["size"] for r in out)
    taken, target = sum(r.taken for r in out), {r.target for r in out}
    assert abs(taken - 1.5 * sum(r["size"] for r in out)) < 0.05 * taken and len(target) >= 3
