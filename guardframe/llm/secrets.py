"""Operator 2: secret scans through layers of encoding, by a worklist with cycle detection."""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import os
import re
import tempfile
import zlib
from bisect import bisect_right
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from guardframe.llm.common import slices, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: One of these is in any text that an assignment is found in; a cheap test before the pattern.
_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Characters of a decoded text that are read at a time; bytes that go through a decompressor at a time.
CHUNK, STEP = 4 << 20, 1 << 20
#: Characters that a chunk repeats from the one before, and those without white space after which it ends in any case.
OVERLAP, LONGEST = 4096, 64 << 20
#: Long compressed layers straight around one another after which the content goes to a file, in place of being unpacked through all of them.
DEPTH = 64
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]")
#: The shortest run of printable characters that may be part of a secret or of a packed piece.
_PRINTABLE = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]{6}")
#: Where packed members may begin inside other bytes.
_MEMBER = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|BZh[1-9]1AY&SY|\xfd7zXZ\x00|PK\x03\x04|\x78[\x01\x5e\x9c\xda]")
#: Characters that encoded pieces and secrets are made of, and an assignment that more text may go on.
_RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=.%\\{}"
_OPEN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*+(?:[:=]\x20*+["']?)?[A-Za-z0-9+/_.=%\\{}-]*+\Z""")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{32,}+[ \t]*+\r?\n[ \t]*+)++[A-Za-z0-9+/_-]*+={0,2}")
_STANDARD = str.maketrans("-_", "+/")
_HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain secrets of one layer, leftmost and non-overlapping in each kind."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(h in low for h in _HINTS):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A decoded text with the way back to the source.

    Pieces are (start, end, source start, source end, opaque): characters of an opaque
    piece stand for the whole source span, those of a plain one for one character each.
    """

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int, bool]]):
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    def source(self, start: int, end: int) -> tuple[int, int]:
        a = self.pieces[bisect_right(self.starts, start) - 1]
        b = self.pieces[bisect_right(self.starts, end - 1) - 1]
        return (a[2] if a[4] else a[2] + start - a[0]), (b[3] if b[4] else b[2] + end - b[0])

    def replaced(self, edits: list[tuple[int, int, str]]) -> Layer:
        """The layer with spans of its text replaced."""
        parts, pieces, at, size = [], [], 0, 0

        def keep(to: int) -> None:
            nonlocal at, size
            while at < to:
                p = self.pieces[bisect_right(self.starts, at) - 1]
                stop = min(to, p[1])
                span = (p[2], p[3]) if p[4] else (p[2] + at - p[0], p[2] + stop - p[0])
                parts.append(self.text[at:stop])
                pieces.append((size, size + stop - at, *span, p[4]))
                size, at = size + stop - at, stop

        for start, end, new in edits:
            keep(start)
            if new:
                pieces.append((size, size + len(new), *self.source(start, end), True))
                parts.append(new)
                size += len(new)
            at = end
        keep(len(self.text))
        return Layer("".join(parts), pieces)


def _readable(text: str) -> bool:
    """Whether decoded characters have a run of printable ones in which there may be something to find."""
    return _PRINTABLE.search(text) is not None


def _packed(head: bytes) -> bool:
    """Whether bytes begin as a compressed stream does."""
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 1 and (head[0] << 8 | head[1]) % 31 == 0 or head[:4] == b"\x28\xb5\x2f\xfd" or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00"


def _deflated(pieces):
    """The content of a deflate stream without a header; raises where bytes are none: they give nothing, or break or end before their end and before more than CHUNK."""
    z, size = zlib.decompressobj(-15), 0
    try:
        for piece in pieces:
            while piece and not z.eof:
                out = z.decompress(piece, STEP)
                piece, size = z.unconsumed_tail, size + len(out)
                if out:
                    yield out
        while not z.eof and (out := z.decompress(z.unconsumed_tail, STEP)):
            size += len(out)
            yield out
    except zlib.error:
        if size <= CHUNK:
            raise
        return
    if not size or not z.eof and size <= CHUNK:
        raise ValueError("no whole deflate stream")


def _stepper(head: bytes):
    """For the first bytes of a compressed stream, a function from input to (output, input left, at the end, more to come); None for others."""
    if not _packed(head):
        return None
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        z = zlib.decompressobj(wbits=47)

        def step(data):
            out = z.decompress(data, STEP)
            return out, z.unused_data if z.eof else z.unconsumed_tail, z.eof, len(out) == STEP or bool(z.unconsumed_tail)

        return step
    if head[:4] == b"\x28\xb5\x2f\xfd":
        frame = zstandard.ZstdDecompressor().decompressobj()

        def step(data):
            out = frame.decompress(data[:1024])  # a little input may be a lot of output
            left = (frame.unused_data if frame.eof else b"") + data[1024:]
            return out, left, frame.eof, bool(left)

        return step
    d = bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor()

    def step(data):
        out = d.decompress(data, STEP)
        return out, d.unused_data if d.eof else b"", d.eof, not d.eof and not d.needs_input

    return step


_BROKEN = (zlib.error, zstandard.ZstdError, OSError, lzma.LZMAError, EOFError, ValueError)


def _inflate(pieces):
    """The content of all members and frames of a compressed stream, with what follows them; raises if it is none."""
    pieces, rest, first = iter(pieces), b"", True
    while True:
        while len(rest) < 6 and (more := next(pieces, None)) is not None:
            rest += more
            rest = rest if first else rest.lstrip(b"\0")  # padding between members
        if not rest:
            return
        step, data, some = _stepper(rest), rest, False
        try:
            if step is None:
                raise ValueError("not compressed")
            while True:
                out, data, end, go_on = step(data)
                if out:
                    some = True
                    yield out
                if end:
                    break
                if not go_on:
                    if (data := next(pieces, None)) is None:
                        return
        except _BROKEN:
            if first and not some:
                raise
            if not some:
                yield b"\n" + rest
                yield from pieces
            return
        rest, first = data.lstrip(b"\0"), False


def _short(make):
    """A source that gives what make() does: from memory where that is at most CHUNK, and else anew each time; raises if there is nothing to decompress."""
    head, size = [], 0
    for out in make():
        head.append(out)
        size += len(out)
        if size > CHUNK:
            return make
    data = b"".join(head)
    return lambda: iter([data])


def _spooled(source):
    """The same bytes from a file, so that sources in one another do not pile up."""
    file = tempfile.TemporaryFile()
    for piece in source():
        file.write(piece)
    file.flush()

    def read():
        at = 0
        while piece := os.pread(file.fileno(), STEP, at):
            at += len(piece)
            yield piece

    return read


def _sight(source) -> tuple[bytes, bytes, bool]:
    """The digest and the first bytes of a source, and whether it is not all text."""
    digest, head, odd, decoder = hashlib.sha256(), b"", False, codecs.getincrementaldecoder("utf-8")("replace")
    for piece in chain(source(), [b""]):
        digest.update(piece)
        head = head if len(head) >= 8 else head + piece[:8]
        odd = odd or _ODD.search(decoder.decode(piece, not piece)) is not None
    return digest.digest(), head, odd


def _unpacked(source):
    """Texts of bytes, through any compressed layers around them, a chunk at a time; each with whether it had to be cut.

    source() gives the bytes in pieces, each time from the start. What is too long to be held is read anew
    for each look at it, so bytes of any length are looked at in the same ways.
    """
    seen, long = set(), 0
    while True:
        digest, head, odd = _sight(source)
        if digest in seen:
            return
        seen.add(digest)
        if _packed(head):
            inside = lambda s=source: _inflate(s())
        elif not odd:
            break
        else:
            # bytes that are not all text may hold text, members of archives, or be a bare deflate stream
            yield from _members(source)
            inside = lambda s=source: _deflated(s())
        try:
            inner = _short(inside)
        except _BROKEN:
            break
        if not _packed(head):
            yield from _texts(source())
        if inner is inside and (long := long + 1) % DEPTH == 0:
            inner = _spooled(inner)
        source = inner
    yield from _texts(source())


class _Tape:
    """Bytes that come in pieces, read from `at` on; what is before `mark`, or without one before `at`, is let go."""

    def __init__(self, pieces):
        self.pieces, self.data, self.base, self.at, self.mark, self.ended = iter(pieces), b"", 0, 0, None, False

    def fill(self, n: int) -> bool:
        """Whether there are n more bytes."""
        while len(self.data) - self.at < n and not self.ended:
            if (piece := next(self.pieces, None)) is None:
                self.ended = True
                break
            gone = self.at if self.mark is None else self.mark
            self.data, self.base, self.at = self.data[gone:] + piece, self.base + gone, self.at - gone
            self.mark = None if self.mark is None else 0
        return len(self.data) - self.at >= n

    def skip(self, n: int) -> None:
        while n and self.fill(1):
            step = min(n, len(self.data) - self.at)
            self.at, n = self.at + step, n - step

    def take(self, n: int) -> bytes:
        self.fill(1)
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out


def _raw():
    """A stepper of deflate without a header."""
    z = zlib.decompressobj(-15)

    def step(data):
        out = z.decompress(data, STEP)
        return out, z.unused_data if z.eof else z.unconsumed_tail, z.eof, len(out) == STEP or bool(z.unconsumed_tail)

    return step


def _members(source):
    """Texts of the packed members inside bytes, as in archives; each place is read once."""
    tape = _Tape(source())
    while True:
        m = _MEMBER.search(tape.data, tape.at)
        if m is None:
            # the longest sign has ten bytes
            tape.at = max(tape.at, len(tape.data) - 9)
            if not tape.fill(len(tape.data) - tape.at + 1):
                return
            continue
        tape.at = tape.mark = m.start()
        names, make = 0, None
        if m[0] == b"PK\x03\x04":
            if not tape.fill(30):
                return
            head = tape.data[tape.at : tape.at + 30]
            names = 30 + sum(head[k] | head[k + 1] << 8 for k in (26, 28))
            if head[8] | head[9] << 8 == 8:  # stored members are part of the bytes as they stand, others are not read
                make = _raw
        elif tape.base + tape.at:  # a whole packed stream is read as such
            tape.fill(8)
            make = lambda head=tape.data[tape.at : tape.at + 8]: _stepper(head)
        start, step = tape.base + tape.at + names, make and make()
        if step is None:
            tape.at, tape.mark = tape.at + 1, None
            continue
        tape.skip(names)
        head, size, stream = [], 0, _member(tape, step)
        for out in stream:
            tape.mark = None
            head.append(out)
            size += len(out)
            if size > CHUNK:
                break
        if size > CHUNK:
            head.clear()
            yield from _unpacked(lambda start=start, make=make: _member_at(source, start, make()))
            for _ in stream:  # to its end
                pass
        elif size:
            yield from _unpacked(_short(lambda: head))
        else:
            tape.at, tape.mark = tape.mark + 1, None


def _member_at(source, start: int, step):
    tape = _Tape(source())
    tape.skip(start)
    return _member(tape, step)


def _member(tape: _Tape, step):
    """The content of one packed member on a tape, which is left after it, or, if it is broken, after what was read."""
    left = b""
    try:
        while True:
            if not left and not (left := tape.take(1 << 16)):
                return
            out, left, end, go_on = step(left)
            if out:
                yield out
            while not end and go_on and not left:  # output that needs no more input
                out, left, end, go_on = step(b"")
                if out:
                    yield out
            if end:
                tape.at -= len(left)
                return
    except _BROKEN:
        return


def _wide(head: bytes) -> str | None:
    """The name of the two-byte encoding that bytes seem to be text of."""
    head = head[:1024]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    half = len(head) // 2
    if half >= 4:
        for name, zeros, others in (("utf-16-le", head[1::2], head[::2]), ("utf-16-be", head[::2], head[1::2])):
            if zeros.count(0) >= 0.8 * half and others.count(0) <= 0.2 * half:
                return name
    return None


def _held(text: str) -> int:
    """Where what more text may go on begins: a run, a piece in lines, an assignment."""
    end = len(text.rstrip())
    hold = len(text.rstrip(_RUN))
    for pattern in (_BASE64, _WRAPPED, _HEX_BYTES):
        for m in pattern.finditer(text):
            if m.end() >= end:
                hold = min(hold, m.start())
                break
    low = text.lower()
    if (key := max(low.rfind(h) for h in _HINTS)) >= 0 and _OPEN.match(text, key):
        hold = min(hold, key)
    return hold


def _texts(pieces):
    """Readable text of bytes in chunks, each with the last characters of the one before; what a chunk's end would divide is held back for the next."""
    pieces = iter(pieces)
    first = next((x for x in pieces if x), b"")
    decoder, text, tried = codecs.getincrementaldecoder(_wide(first) or "utf-8")("replace"), "", CHUNK
    for piece in chain([first], pieces):
        text += decoder.decode(piece)
        if len(text) < tried:
            continue
        end = _held(text)
        if end <= OVERLAP and len(text) < LONGEST:
            tried = 2 * len(text)
            continue
        whole = end > OVERLAP
        end = end if whole else len(text)
        if _readable(text[:end]):
            yield text[:end], not whole
        text, tried = text[end - OVERLAP :], CHUNK + len(text) - end
    text += decoder.decode(b"", True)
    if _readable(text):
        yield text, False


def _from_base64(body: str) -> bytes:
    body = body[: len(body) - 1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _base64_contents(token: str):
    """What a run of base64 characters may hold: it may have swallowed what stood before it, so it is read in each of the four alignments."""
    body = re.sub(r"\s+", "", token).rstrip("=").translate(_STANDARD)
    for k in range(4):
        yield _from_base64(body[k:])


def decoded(layer: Layer):
    """The layers one step of decoding away, each with whether it had to be cut: URL and Unicode escapes in place, packed pieces each on its own."""
    text = layer.text
    if "%" in text:
        edits = [(*m.span(), s) for m in _PERCENT.finditer(text) if (s := bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")).strip("\ufffd")]
        if edits:
            yield layer.replaced(edits), False
    if "\\" in text:
        edits = []
        for m in _ESCAPE.finditer(text):
            point = int(next(g for g in m.groups() if g), 16)
            if point < 0x110000 and not 0xD800 <= point < 0xE000:
                edits.append((*m.span(), chr(point)))
        if edits:
            yield layer.replaced(edits), False
    for pattern, contents in ((_BASE64, _base64_contents), (_WRAPPED, _base64_contents), (_HEX_BYTES, lambda t: [bytes.fromhex(t)])):
        for m in pattern.finditer(text):
            for data in contents(m[0]):
                for inner, long in _unpacked(lambda data=data: iter([data])) if data else ():
                    yield (Layer(inner, [(0, len(inner), *layer.source(*m.span()), True)]) if inner else None), long


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, bool]:
    """Plain secrets, all secrets in source positions, number of layers read, whether a piece was cut.

    The worklist starts with the text and holds, for each layer on the way, what is still
    to come out of it, so of a long packed piece only a chunk at a time. Each layer is scanned, decoded one step, and what
    comes out joins the list unless the same text from the same span was there before; so
    it ends, at a fixpoint, cycles included. A secret of an inner layer has the span of
    the source characters that carry it.
    """
    text = text or ""
    base = matches(text)
    found, layers, cut = set(base), 0, False
    work = [iter([(Layer(text, [(0, len(text), 0, len(text), False)]), False)])] if text else []
    seen = set()
    while work:
        layer, long = next(work[-1], (None, None))
        if long is None:
            work.pop()
            continue
        cut |= long
        if layer is None or not layer.text:
            continue
        mark = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.pieces[0][2], layer.pieces[-1][3])
        if mark in seen:
            continue
        seen.add(mark)
        if layers:
            found |= {(kind, *layer.source(start, end)) for kind, start, end in matches(layer.text)}
        layers += 1
        work.append(decoded(layer))
    order = lambda spans: sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return order(base), order(found), layers, cut


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long, cut boolean"


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row given: the secrets of its whole text, plain and encoded.

    base_sha256 and the three numbers are of the plain ones; spans has all, as
    kind:start:end by start, then kind, in code points of the source, end exclusive. layers
    is the number of texts read for it, chunks of long ones each; cut says that LONGEST
    characters of a packed piece that might all be one run were read in overlapping parts. A null text counts as empty. Each row is on its own:
    repeated rows and null ids change nothing, and no other column is read.
    """

    def run(batches):
        for batch in slices(batches, "text", 32 << 20):
            rows = []
            for t in batch.column("text").to_pylist():
                base, spans, layers, cut = scan(t)
                n = [sum(s[0] == kind for s in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers, cut))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[x.split()[0] for x in OUT.split(", ")],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, OUT)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secret_spans(table(spark, sf_dir, "documents"))
