"""Fill-in-middle against a plain version, and the exact way back."""

import hashlib
import os
import random
import re

import pytest

from guardframe.llm import fim

LONG = "lorem ipsum  dolor\n" * 20_000
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, rate=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(1)
    parts = ["<", ">", "<S", "P>", "<P", "S>", "M", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "a", "wörd", "漢字", "🙂", "\x00", " ", "<M"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    return [None, "", " ", "\n\n", "x", "x" * 50_000, LONG, "a <P> b", "<M>", "tail \n ", "again and again", "again and again", *texts]


KEY = lambda r: (r[0] is None, r[0] or 0, str(r[5]))


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 50), (0, 0)])
def test_rows(spark, rate, spm):
    rows = [(k, t, 7, "psm", "out") for k, t in enumerate(odd_texts())] + [(None, "no id here", 7, "x", "y"), (5, "same id", 1, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, output string")
    got = fim.restore(fim.fill_in_middle(df, rate=rate, spm=spm)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=KEY) == sorted((plain(i, t, rate, spm) for i, t, *_ in rows), key=KEY)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.restored) for r in got) == sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0


def test_query_and_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, t) for k, t in enumerate(odd_texts())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op12_fill_in_middle(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((*plain(i, t)[:5], sha(plain(i, t)[5]), sha(t or "")) for i, t in rows)
    assert sorted(map(tuple, got)) == want
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(fim.OP12_SQL).fetchall()) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
def test_registered_query(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert sorted(map(tuple, fim.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect())) == sorted(con.sql(fim.OP12_SQL).fetchall())
