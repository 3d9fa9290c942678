import base64
import bz2
import gzip
import io
import random
import re
import tarfile
import urllib.parse
import zipfile
import zlib

import numpy as np
import pytest

from guardframe.llm import secrets

KEY = "AKIA" + "Q7" * 8
PLAIN = f"password = hunter2hunter2 and {KEY}"


def brute(text):
    out = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


@pytest.mark.parametrize(
    "text",
    ["", "Password:abcdefgh token=short secret='longenough1' api_key==x", "a" * 40 + "z" + "0" * 31, PLAIN, "ToKeN = 12345678 AKIA1", "ſecret=12345678"],
)
def test_base_matches_are_those_of_the_patterns(text):
    assert sorted(secrets.matches(text)) == sorted(brute(text))


def wrap(how, text):
    return {
        "url": lambda: "".join(f"%{b:02x}" for b in text.encode()),
        "unicode": lambda: "".join(f"\\u{ord(c):04x}" for c in text),
        "base64": lambda: base64.b64encode(text.encode()).decode(),
        "gzip": lambda: base64.b64encode(gzip.compress(text.encode())).decode(),
        "hex": lambda: text.encode().hex(),
    }[how]()


@pytest.mark.parametrize("ways", [["url"], ["unicode"], ["base64"], ["gzip"], ["base64", "url"], ["url", "base64", "gzip"], ["base64"] * 4])
def test_layers_are_unwrapped_to_the_source_span(ways):
    inner = PLAIN
    for how in ways:
        inner = wrap(how, inner)
    text = f"é before {inner} after"
    _, spans, layers, cut = secrets.scan(text)
    kinds = {k for k, *_ in spans}
    assert {"assign", "access"} <= kinds and layers > len(ways) and not cut
    at = text.index(inner)
    for kind, start, end in spans:
        assert at <= start < end <= at + len(inner)


def test_url_spans_map_to_the_characters_that_carry_them():
    text = "x=1&q=" + urllib.parse.quote("token=") + "abcdefgh12"
    _, spans, *_ = secrets.scan(text)
    assert spans == [("assign", 6, len(text))]


def test_base_spans_stay_and_cycles_end():
    text = PLAIN + " " + base64.b64encode(PLAIN.encode()).decode() + " %25252541"
    base, spans, *_ = secrets.scan(text)
    assert set(base) <= set(spans) and base == sorted(brute(text), key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_rows(spark):
    rows = [(1, PLAIN, "x"), (1, PLAIN, "x"), (None, None, None), (2, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = secrets.secret_spans(df).collect()
    assert len(out) == 4 and sum(r.n_assign for r in out) == 2
    assert secrets.secret_spans(df.limit(0)).count() == 0


def _wrapped(data, width=64):
    text = base64.b64encode(data).decode()
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


def _raw_deflate(data):
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


SECRET = b"see password = hunter2hunter2 and more words"
CODED = base64.b64encode(SECRET).decode()
FORMS = {
    "after an underscore": (f"a x_{CODED} b", (2, 4 + len(CODED))),
    "after a path": (f"b path/{CODED}", (2, 7 + len(CODED))),
    "packed, after a path": ("path/to/file/" + base64.b64encode(gzip.compress(SECRET, mtime=0)).decode(), None),
    "two bytes a character": (base64.b64encode(SECRET.decode().encode("utf-16-le")).decode(), None),
    "with a byte order mark": (base64.b64encode(SECRET.decode().encode("utf-16")).decode(), None),
    "over several lines": (_wrapped(SECRET * 4), None),
    "packed, over several lines": (_wrapped(gzip.compress(SECRET + bytes(range(200)), mtime=0)), None),
    "after a bad escape": ("%FF" + "".join(f"%{c:02x}" for c in SECRET), None),
    "deflate without a header": (base64.b64encode(_raw_deflate(SECRET)).decode(), None),
    "packed in deflate without a header": (base64.b64encode(_raw_deflate(gzip.compress(SECRET, mtime=0))).decode(), None),
    "a control character": (base64.b64encode(b"\x01" + SECRET).decode(), None),
}


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_layers(form):
    text, span = FORMS[form]
    base, spans, _, cut = secrets.scan(text)
    assert not cut and any(s[0] == "assign" for s in spans) and not [s for s in base if s[0] == "assign"]
    assert span is None or ("assign", *span) in spans
    assert all(0 <= a < b <= len(text) for _, a, b in spans)


def test_long_runs_take_time_in_proportion():
    """Half a million characters of the base64 alphabet, and lines of them, end soon."""
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    for text in (base64.b64encode(data).decode(), _wrapped(data), "A" * 500_000, "a" * 40 + " " * 200_000):
        secrets.scan(text)


SECRET = "password=Hunter2Hunter2"


def _tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as f:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            f.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _zip(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as f:
        for name, data in files:
            f.writestr(name, data)
    return out.getvalue()


NOISE = random.Random(1).randbytes(5000)
ARCHIVES = {
    "tar.gz": _tar([("a.txt", b"nothing"), ("b.txt", SECRET.encode()), ("c.bin", NOISE)]),
    "tar of gz": _tar([("a.bin", NOISE), ("b.gz", gzip.compress(SECRET.encode()))]),
    "zip": _zip([("a.bin", NOISE), ("b.txt", b"words " * 50 + SECRET.encode()), ("c.txt", b"more " * 50)]),
    "zip, stored": _zip([("b.txt", SECRET.encode())], zipfile.ZIP_STORED),
    "zip of zip": _zip([("x.zip", _zip([("b.txt", b"words " * 50 + SECRET.encode())]))]),
    "zip of a long text": _zip([("b.txt", b"line of words\n" * 600_000 + SECRET.encode())]),
    "binary around": NOISE + SECRET.encode() + b"\0" + NOISE,
    "few bytes before": bytes(range(128, 136)) + SECRET.encode(),
    "gzip after bytes": NOISE + gzip.compress(SECRET.encode()) + NOISE,
    "bare deflate": zlib.compress(b"some words and " * 9 + SECRET.encode())[2:-4],
}


@pytest.mark.parametrize("name", ARCHIVES)
def test_archives_and_binary_data_hide_nothing(name):
    for text in (base64.b64encode(ARCHIVES[name]).decode(), base64.encodebytes(ARCHIVES[name]).decode()):
        base, spans, _, cut = secrets.scan("see " + text)
        assert not base and ("assign" in {k for k, *_ in spans}) and not cut, name


@pytest.mark.parametrize("before", ["", "x", "ab", "abc", "abcd", "abcde", "a+b/", "Zz9"])
@pytest.mark.parametrize("data", [gzip.compress(SECRET.encode()), zlib.compress(SECRET.encode() * 3), bz2.compress(SECRET.encode()), SECRET.encode()])
def test_a_piece_after_any_letters(before, data):
    text = before + base64.b64encode(data).decode().rstrip("=")
    assert [(k, b) for k, a, b in secrets.scan(text)[1]] == [("assign", len(text))]


def test_a_piece_at_any_place_of_a_long_layer():
    """Wrapped pieces, runs and open assignments across the end of a chunk."""
    inner = base64.encodebytes(gzip.compress(random.Random(2).randbytes(38_000) + SECRET.encode())).decode()
    cases = [inner, "password =" + " " * 20_000 + "Hunter2Hunter2", base64.b64encode(NOISE + SECRET.encode()).decode(), 'token" : "abcdefgh12345678"']
    for k, case in enumerate(cases):
        for off in (-len(case) - 5, -len(case) + 1, -len(case) // 2, -1000, -40, -9, 0, 3):
            at = secrets.CHUNK + off
            layer = ("plain words here\n" * (at // 17 + 1))[: at - 1] + " " + case + "\nand more words\n" * 1000
            _, spans, _, cut = secrets.scan(base64.b64encode(gzip.compress(layer.encode(), 1)).decode())
            assert "assign" in {x for x, *_ in spans} and not cut, (k, off)


@pytest.mark.parametrize("name", ARCHIVES)
def test_results_do_not_depend_on_what_is_held_at_a_time(name, monkeypatch):
    """Contents over CHUNK are looked at as short ones are: members, deflate without a header, text among bytes."""
    text = "see " + base64.b64encode(gzip.compress(ARCHIVES[name], mtime=0)).decode()
    short = secrets.scan(text)
    monkeypatch.setattr(secrets, "CHUNK", 16)
    long = secrets.scan(text)
    assert "assign" in {k for k, *_ in short[1]} and long[:2] == short[:2] and not long[3]


def test_an_archive_longer_than_a_chunk_is_searched():
    """Secrets in packed members before and after the first megabytes, and in a long member, of a packed archive."""
    noise = random.Random(3).randbytes(secrets.CHUNK + 9)
    for files in ([("a.gz", gzip.compress(SECRET.encode())), ("b.bin", noise)], [("b.txt", b"words " * 1_000_000), ("a.gz", gzip.compress(SECRET.encode()))], [("x.tgz", _tar([("b.bin", noise), ("a.gz", gzip.compress(SECRET.encode()))]))]):
        _, spans, _, cut = secrets.scan(base64.b64encode(_tar(files)).decode())
        assert "assign" in {k for k, *_ in spans} and not cut


def test_many_long_layers_are_read_to_the_innermost(monkeypatch):
    monkeypatch.setattr(secrets, "DEPTH", 3)
    data = random.Random(4).randbytes(secrets.CHUNK + 9) + b"\0 " + SECRET.encode()
    for _ in range(8):
        data = gzip.compress(data, 1)
    _, spans, _, cut = secrets.scan(base64.b64encode(data).decode())
    assert "assign" in {k for k, *_ in spans} and not cut
