"""Edits of JSON text: odd paths, malformed text, numbers as they are written."""

import pytest
from pyspark.sql import functions as F

from guardframe.functions.allowed import _edited, jsonb_delete_path, jsonb_set

DEEP = "[" * 100_000 + "]" * 100_000


@pytest.mark.parametrize(
    ("text", "path", "new", "how", "want"),
    [
        ('{"a":{"b":[1.10,2]}}', ["a", "b", "0"], "9.50", "set", '{"a":{"b":[9.50,2]}}'),
        ('{"n":12345678901234567890.5,"m":1.10,"k":1E400}', ["x"], "1", "set", '{"n":12345678901234567890.5,"m":1.10,"k":1E400,"x":1}'),
        ('{"a":[1,2]}', ["a", "x"], "9", "set", None),
        ('{"a":[1,2]}', ["a", "x", "y"], "9", "delete", None),
        ('{"a":[1,2]}', ["a", "-1"], None, "delete", '{"a":[1]}'),
        ('{"a":[1,2]}', ["a", "9"], "3", "set", '{"a":[1,2,3]}'),
        ('{"a":[1,2]}', ["a", "-9"], "3", "set", '{"a":[3,1,2]}'),
        ('{"a":1}', ["b", "c"], "3", "set", '{"a":1}'),
        ('{"a":1}', ["a", "c"], "3", "set", '{"a":1}'),
        ('{"a":null}', ["a", "c"], "3", "set", '{"a":null}'),
        ('{"a":"\u00e9 \\" x"}', ["b"], '"\u6f22"', "insert", '{"a":"\u00e9 \\" x","b":"\u6f22"}'),
        ('{"a":1}', [], "3", "set", '{"a":1}'),
        ("3", ["a"], "3", "set", "3"),
        ("{broken", ["a"], "3", "set", None),
        ('{"a":NaN}', ["a"], "3", "set", None),
        ('{"a":1}', ["a"], "broken", "set", None),
        ('{"a":1}', ["a"], None, "set", None),
        (None, ["a"], "3", "set", None),
        (DEEP, ["0"], None, "delete", None),
    ],
)
def test_edits(text, path, new, how, want):
    assert _edited(text, path, new, how) == want


def test_one_bad_row_is_one_null(spark):
    df = spark.createDataFrame([(1, '{"a":[1.10]}'), (2, "{broken"), (3, None), (4, '{"a":{"0":2}}')], "id int, j string")
    got = df.select("id", jsonb_delete_path(F.col("j"), ["a", "0"]).alias("d"), jsonb_set(F.col("j"), ["a", "0"], F.lit("7.0")).alias("s")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, '{"a":[]}', '{"a":[7.0]}'), (2, None, None), (3, None, None), (4, '{"a":{}}', '{"a":{"0":7.0}}')]
