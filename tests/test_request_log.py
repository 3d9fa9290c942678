"""Lines of a request log: byte ranges, days, bad lines, and a stream that follows files as they grow."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from guardframe.operators.requests import INVALID, parse_request_log
from guardframe.sources.request_log import request_log

GOOD = '{"jsonrpc":"2.0","id":%d,"method":"tools/call","params":{"name":"run_sql_query","arguments":{"connectionName":"c","query":"%s"}}}'
LINES = [(GOOD % (k, "é" * (k % 40))).encode() for k in range(300)]
ODD = [b"\xff\xfe no text", b"no json", b"", b"x" * 5000, LINES[0]]


@pytest.fixture
def folder(tmp_path):
    for day, lines, end in (("2024-01-01", LINES, b"\n"), ("2024-01-02", ODD, b"\r\n"), ("2024-01-03", LINES[:3], b"\n"), ("none", LINES[:1], b"\n")):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "a.log").write_bytes(end.join(lines) + end)
    (tmp_path / "day=2024-01-01" / "_SUCCESS").write_bytes(b"no log\n")
    (tmp_path / "day=2024-01-01" / "empty.log").write_bytes(b"")
    return tmp_path


def rows(df):
    return sorted((str(r.day), r.file.split("day=")[1], r.start, r.line, bytes(r.bad) if r.bad is not None else None) for r in df.collect())


def want(folder):
    out = []
    for f in folder.glob("day=*/a.log"):
        day, at = f.parent.name[4:], 0
        for line in f.read_bytes().split(b"\n"):
            text = line.removesuffix(b"\r")
            if text:
                bad = text[0] == 255
                out.append(("None" if day == "none" else day, f"{day}/a.log", at, None if bad else text.decode(), text if bad else None))
            at += len(line) + 1
    return sorted(out, key=lambda r: r[:3])


@pytest.mark.parametrize("split", [1, 97, 4096, 1 << 26])
def test_lines_of_any_byte_ranges(spark, folder, split):
    # ranges of one byte only where files are short
    path = folder / "day=2024-01-03" if split == 1 else folder
    expected = [r for r in want(folder) if split > 1 or r[0] == "2024-01-03"]
    assert sorted(rows(request_log(spark, str(path), split=split)), key=lambda r: r[:3]) == expected


def test_days_choose_files(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        log = request_log(spark, folder.as_uri(), split=1 << 20)
        assert log.where(F.col("day") >= date(2024, 1, 2)).rdd.getNumPartitions() == 2
        assert {str(r.day) for r in log.where("day > '2024-01-01' and day in ('2024-01-03', '2024-01-01')").collect()} == {"2024-01-03"}
        assert log.where("day = '2024-01-01' and start > 0").count() == len(LINES) - 1
        assert log.where("day < '2020-01-01'").count() == 0
        assert log.where("day is null").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert request_log(spark, str(folder)).where("day <= '2024-01-02'").select("day").distinct().count() == 2
    assert request_log(spark, str(folder / "nothing")).count() == 0


def test_lines_are_requests(spark, folder):
    parsed = parse_request_log(request_log(spark, str(folder)), json="line")
    assert parsed.where("day = '2024-01-01' and error is null and id_kind = 'u32'").count() == len(LINES)
    assert {r.error for r in parsed.where("day = '2024-01-02' and start < 20").collect()} == {INVALID}


def test_stream_follows_growing_files(spark, folder, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp("log") / n) for n in ("out", "state"))

    def run():
        stream = request_log(spark, str(folder), stream=True, split=500)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()
        return sorted(rows(spark.read.parquet(out)), key=lambda r: r[:3])

    assert run() == want(folder)
    # half a line waits; a new file and a new day are found
    with open(folder / "day=2024-01-03" / "a.log", "ab") as f:
        f.write(LINES[7] + b"\n" + LINES[8][:20])
    before = want(folder)
    assert run() == [r for r in before if r[3] != LINES[8][:20].decode()]
    with open(folder / "day=2024-01-03" / "a.log", "ab") as f:
        f.write(LINES[8][20:] + b"\n")
    (folder / "day=2024-01-04").mkdir()
    (folder / "day=2024-01-04" / "a.log").write_bytes(LINES[9] + b"\n")
    assert run() == want(folder)
    assert run() == sorted(rows(request_log(spark, str(folder))), key=lambda r: r[:3])
