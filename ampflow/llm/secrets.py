"""Secret scans through nested encodings.

A worklist starts with the text itself.  Each layer is scanned, then decoded in
every way that applies: URL escapes and Unicode escapes (characters by number in
six notations) by one level and to their own fixpoint, each base64 run by itself, over line ends and from each of
four places, all compressed streams inside it, raw deflate from its start or after a sign in
it, and percent-escaped binary data.
A layer whose content was met before at the same place is not read again, so
cycles end and the list runs to its fixpoint; streams that make ever larger
ones of themselves end at as many layers as the text could hold.  A layer knows which span of the
layer around it each of its characters came from; findings are given in the
original text.

Escapes that nest (``%252541``) are taken off together in one pass, so their
depth does not matter.  What a stream unpacks to is read in windows of
``WINDOW`` bytes; a base64 run or a stream that goes on beyond its window is
read as a stream of its own.  So a bomb takes time in proportion to what it
unpacks to, but no more memory than a few windows; those that zstd and xz
declare for themselves come to that, as far as they are filled.

Spans are in code points, end exclusive.  A null text is empty and has none;
repeated rows give repeated rows, an empty table none.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import bounded_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: The shortest stream that holds a finding has 6 bytes (sixteen zeros in zlib, its check left out), 8 in base64.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}={0,2}")
#: The shortest finding has 16 characters, 22 in base64.
PLAIN = 22
#: Base64 that goes on over line ends.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_CODE = r"\\u[0-9A-Fa-f]{4}"
#: A character by its number: ``%u0070``, ``\\x70``, ``\\U00000070``, ``\\u{70}``, ``&#112;``, ``&#x70;``.
_NUMBER = r"%u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,8}\}|&#[0-9]{1,8};|&#[xX][0-9A-Fa-f]{1,8};"
UNICODE = re.compile(rf"(?:{_CODE})+|{_NUMBER}")
ESCAPE = re.compile(rf"%[0-9A-Fa-f]{{2}}|{_CODE}|{_NUMBER}")
#: What one of them begins with.
_MARKS = ("%", "\\u", "\\U", "\\x", "&#")
#: An escape that has just ended, and the most characters it has.
_ENDED, LONGEST = re.compile(rf"(?:{ESCAPE.pattern})\Z"), 12
#: Escaped bytes among others, as of binary data.
BINARY = re.compile(r"(?<![!-$&-~])[!-$&-~]*+%[0-9A-Fa-f]{2}[!-~]*")
#: No header tells of raw deflate: it is looked for at a run's start and where what stands before it may end.
SIGN = re.compile(r"[+/]")
#: Unpacked bytes that are read together.
WINDOW = 1 << 25
#: Packed bytes read at once: what came before a broken place is kept.
STEP = 1 << 10
#: zlib's two bytes: deflate with a window of 2^8 to 2^15, a multiple of 31, no preset dictionary.
_ZLIB = [bytes([a, b]) for a in range(0x08, 0x80, 0x10) for b in range(256) if (a * 256 + b) % 31 == 0 and not b & 0x20]
# How compressed streams begin.
_GZIP, _ZSTD, _BZ2, _XZ = b"\x1f\x8b\x08", b"\x28\xb5\x2f\xfd", b"BZh", b"\xfd7zXZ\0"
_BEGIN = [_GZIP, *_ZLIB, _ZSTD, _BZ2, _XZ]
MAGIC = re.compile(b"|".join(map(re.escape, [_GZIP, *_ZLIB, _ZSTD, _XZ])) + rb"|BZh[1-9](?:1AY&SY|\x17rE8P\x90)")
#: Runs that may hold a finding or a stream.
ASCII = re.compile(rb"[\t\n\r\x20-\x7e]{8,}")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){8,}|(?:\x00[\t\n\r\x20-\x7e]){8,}")
#: What ``_fixpoint`` makes of escaped bytes.
_BYTE = re.compile("[\udc80-\udcff]")
_BYTES = re.compile("[\0-\x7f\udc80-\udcff]+")
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_RUN = (_DIGITS + "-_").encode()
Reader = Callable[[int], Iterator[bytes]]


def _in_base64(data: bytes) -> str:
    """A pattern of base64 that holds ``data`` at any place."""
    out = []
    for before in range(3):
        bits = "?" * 8 * before + "".join(f"{b:08b}" for b in data)
        bits += "?" * (-len(bits) % 6)
        groups = [bits[i : i + 6] for i in range(0, len(bits), 6)]
        out.append("".join("[" + "".join(c for k, c in enumerate(_DIGITS) if all(x in ("?", y) for x, y in zip(g, f"{k:06b}"))) + "]" for g in groups if set(g) != {"?"}))
    return "|".join(out)


PACKED = re.compile("|".join(map(_in_base64, _BEGIN)))


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what stands in the text as it is."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A text, and which span of the original any span of it came from."""

    __slots__ = ("text", "span", "whole")

    def __init__(self, text: str, span: Callable[[int, int], tuple[int, int]], whole: bool = True):
        self.text, self.span, self.whole = text, span, whole  # whole: not itself a text with one level of escapes taken off


def _constant(span: tuple[int, int]) -> Callable[[int, int], tuple[int, int]]:
    return lambda a, b: span


# Escapes --------------------------------------------------------------------


def _peeled(outer: _Layer, text: str, at: array, low: array, high: array, whole: bool) -> _Layer:
    """A layer with escapes decoded: ``at`` the places of decoded characters, ``low`` and ``high`` what they stood for."""

    def place(i: int, end: bool) -> int:
        j = bisect_right(at, i) - 1
        if j < 0:
            return i + end
        return (high[j] if end else low[j]) if at[j] == i else high[j] + i - at[j] - 1 + end

    return _Layer(text, lambda a, b: outer.span(place(a, False), place(b - 1, True) if b > a else place(a, False)), whole)


def _once(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with one level of escapes decoded; None if there is none."""
    parts, size, done = [], 0, 0
    at, low, high = array("q"), array("q"), array("q")
    for m in pattern.finditer(layer.text):
        for a, b, char in decode(m.group(), m.start()):
            parts += [layer.text[done:a], char]
            size += a - done
            at.append(size)
            low.append(a)
            high.append(b)
            size, done = size + 1, b
    return _peeled(layer, "".join(parts) + layer.text[done:], at, low, high, False) if at else None


def _url(run: str, at: int) -> Iterator[tuple[int, int, str]]:
    data = bytes.fromhex(run.replace("%", ""))
    i = 0
    while i < len(data):
        first = data[i]
        n = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
        try:
            char = data[i : i + n].decode() if n else ""
        except UnicodeDecodeError:
            char = ""
        if len(char) == 1:
            yield at + 3 * i, at + 3 * (i + n), char
            i += n
        else:
            i += 1  # not text: this escape stays as it is


def _number(escape: str) -> int:
    """The number that one escape names."""
    if escape[0] == "&":
        return int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
    return int(escape.strip("%\\uUx{}"), 16)


def _unicode(run: str, at: int) -> Iterator[tuple[int, int, str]]:
    if run[:2] != "\\u" or run[2] == "{":
        code = _number(run)
        if 0 <= code < 0xD800 or 0xE000 <= code < 0x110000:
            yield at, at + len(run), chr(code)
        return
    units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
    i = 0
    while i < len(units):
        u = units[i]
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            yield at + 6 * i, at + 6 * (i + 2), chr(0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00)
            i += 2
            continue
        if not 0xD800 <= u < 0xE000:
            yield at + 6 * i, at + 6 * (i + 1), chr(u)
        i += 1


def _fixpoint(layer: _Layer) -> _Layer | None:
    """The layer with escapes of all kinds decoded until none is left, in one pass; None if there is none.

    What a decoded character completes is decoded in its turn.  Escaped bytes
    that are not ASCII become the lone surrogates that stand for such bytes:
    no finding runs over them, and streams among them can be read.
    """
    text, n = layer.text, len(layer.text)
    if not ESCAPE.search(text):
        return None
    out: list[str] = []
    at, low, high = array("q"), array("q"), array("q")
    pos = hot = 0  # hot: characters to come that an escape may need yet
    while pos < n:
        if not hot:
            m = ESCAPE.search(text, pos)
            stop = m.start() if m else n
            out += text[pos:stop]
            pos, hot = stop, LONGEST
            continue
        out.append(text[pos])
        pos, hot = pos + 1, hot - 1
        while True:
            ended = _ENDED.search("".join(out[-LONGEST:]))
            if not ended:
                break
            size, code = len(ended[0]), _number(ended[0])
            if code >= 0x110000:
                break
            start = len(out) - size
            j = bisect_right(at, start) - 1
            begin = start if j < 0 else low[j] if at[j] == start else high[j] + start - at[j] - 1
            del out[start:]
            while at and at[-1] >= start:
                at.pop()
                low.pop()
                high.pop()
            at.append(start)
            low.append(begin)
            high.append(pos)
            out.append(chr(0xDC00 + code if ended[0][0] == "%" and size == 3 and code >= 0x80 else 0xFFFD if 0xD800 <= code < 0xE000 else code))
            hot = LONGEST
    return _peeled(layer, "".join(out), at, low, high, True)


# Bytes ----------------------------------------------------------------------


class _Stream:
    """One compressed stream, unpacked piece by piece; then ``used`` has its length, 0 if it does not end.

    ``raw``: deflate without a header.  A zstd frame's window is held in memory as far as the frame fills it.
    """

    def __init__(self, chunks: Iterator[bytes], raw: bool = False):
        self.chunks, self.raw, self.used = chunks, raw, 0

    def __iter__(self) -> Iterator[bytes]:
        d, read = None, 0
        for chunk in self.chunks:
            for i in range(0, len(chunk), STEP):
                part = bytes(chunk[i : i + STEP])
                if d is None:
                    kind = "zlib" if self.raw else "zstd" if part[:4] == _ZSTD else "bz2" if part[:3] == _BZ2 else "xz" if part[:6] == _XZ else "zlib"
                    if kind == "zstd":
                        d = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()  # the format's limit
                    else:
                        d = bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor(lzma.FORMAT_XZ) if kind == "xz" else zlib.decompressobj(-15 if self.raw else 47)
                read += len(part)
                try:
                    if kind == "zstd":
                        yield d.decompress(part)
                    elif kind in ("bz2", "xz"):
                        yield d.decompress(part, WINDOW)
                        while not d.eof and not d.needs_input:
                            yield d.decompress(b"", WINDOW)
                    else:
                        yield d.decompress(part, WINDOW)
                        while d.unconsumed_tail and not d.eof:
                            yield d.decompress(d.unconsumed_tail, WINDOW)
                except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, zstandard.ZstdError):
                    return
                if d.eof:
                    self.used = read - len(d.unused_data)
                    return


def _member(read: Reader, at: int, used: list[int]) -> Iterator[bytes]:
    """What the stream at ``at`` unpacks to, and those that follow it at once; the place after each goes to ``used``."""
    while True:
        stream = _Stream(read(at))
        yield from stream
        if not stream.used:
            return
        at += stream.used
        used.append(at)
        head = b""
        for chunk in read(at):
            head += bytes(chunk[:16])
            if len(head) >= 16:
                break
        if not MAGIC.match(head):
            return


def _reader(data: bytes) -> Reader:
    view = memoryview(data)
    return lambda at: iter([view[at:]])


def _from(pieces: Callable[[], Iterator[bytes]]) -> Reader:
    """A reader over what can be produced again from the start only."""

    def read(at: int) -> Iterator[bytes]:
        for piece in pieces():
            if at < len(piece):
                yield piece[at:]
                at = 0
            else:
                at -= len(piece)

    return read


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of windows that overlap by what may be an unfinished run, up to half of one."""
    held, start, fresh = b"", 0, 0
    parts: list[bytes] = []
    for piece in pieces:
        for i in range(0, len(piece), WINDOW):
            parts.append(piece[i : i + WINDOW])
            fresh += len(parts[-1])
            if fresh + len(held) > WINDOW:
                held, parts, fresh = held + b"".join(parts), [], 0
                yield start, held
                keep = min(max(1024, len(held) - len(held.rstrip(_RUN + b"=\"': ."))), WINDOW // 2)
                start, held = start + len(held) - keep, held[-keep:]
    if fresh or not start:
        yield start, held + b"".join(parts)


def _decoded(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of the base64 run with which the chunks begin."""
    left = b""
    for chunk in chunks:
        run = re.match(rb"[A-Za-z0-9+/_-]*", chunk).group()
        code = left + run.replace(b"-", b"+").replace(b"_", b"/")
        whole = len(code) - len(code) % 4
        yield base64.b64decode(code[:whole])
        left = code[whole:]
        if len(run) < len(chunk):
            return


def _unpacked(read: Reader, data: bytes, base: int, span: tuple[int, int], met: set, whole: list[tuple[int, int]]) -> Iterator[_Layer | Iterator]:
    """Layers of the streams that begin in ``data``, which stands at ``base`` of what ``read`` reads.

    The places of streams that end are added to ``whole``.  Of streams within
    streams the iterators are given, which the worklist reads to their end before it goes on.
    """
    at = 0
    while m := MAGIC.search(data, at):
        used: list[int] = []
        yield _inside(lambda: _member(read, base + m.start(), used), span, met)  # noqa: B023  used up before the next turn
        at = used[-1] - base if used else m.start() + 1
        if used:
            whole.append((m.start(), at))


def _inside(pieces: Callable[[], Iterator[bytes]], span: tuple[int, int], met: set) -> Iterator[_Layer | Iterator]:
    """Layers of a stream's content, through all its streams; all have the span of the run that the stream came from."""
    digest, windows, first = hashlib.sha256(), 0, b""
    for start, data in _windows(pieces()):
        if not windows:
            first = data
        digest.update(f"{start}:".encode() + data)
        windows += 1
    key = (digest.digest(), span)
    if key in met or windows == 1 and not first:
        return
    met.add(key)
    again, long = _from(pieces), False
    for start, data in [(0, first)] if windows == 1 else _windows(pieces()):
        whole: list[tuple[int, int]] = []
        yield _unpacked(_reader(data) if windows == 1 else again, data, 0 if windows == 1 else start, span, met, whole)
        for _, _, text in _texts(data, whole, windows == 1):
            yield _Layer(text, _constant(span))
        begin = len(data.rstrip(_RUN))
        if windows > 1 and len(data) - begin >= WINDOW // 2:
            for skip in range(4) if begin or not long else ():  # a base64 run of over half a window: once, from its start
                yield _inside(lambda: _decoded(again(start + begin + skip)), span, met)  # noqa: B023
        long = len(data) - begin >= WINDOW // 2


def _texts(data: bytes, whole: list[tuple[int, int]], complete: bool = True) -> Iterator[tuple[int, int, str]]:
    """(first byte, bytes a character or 0 for UTF-8, text) of what is text in the bytes: all, or runs of ASCII in 8 or 16 bits.

    Runs inside ``whole`` streams are not given: they are read unpacked.
    """
    if complete:
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            pass
        else:
            if text:
                yield 0, 0, text
            if b"\0" not in data:
                return
    for width, pattern in ((1, ASCII), (2, WIDE)):
        for m in pattern.finditer(data):
            if not any(a <= m.start() and m.end() <= b for a, b in whole):
                yield m.start(), width, m.group().replace(b"\0", b"").decode("ascii")


# Layers ---------------------------------------------------------------------


def _runs(text: str) -> Iterator[tuple[str, array | range]]:
    """Base64 runs: (their characters, the place of each in the text)."""
    for m in BASE64.finditer(text):
        run = m.group().rstrip("=")
        if len(run) >= PLAIN or PACKED.search(run.replace("-", "+").replace("_", "/")):
            yield run, range(m.start(), m.start() + len(run))
    for m in WRAPPED.finditer(text):
        at = array("q", [i for i in range(m.start(), m.end()) if text[i] not in " \t\r\n="])
        yield "".join([text[i] for i in at]), at


def _base64(layer: _Layer, met: set) -> Iterator[_Layer]:
    """Of each run, from its start and the next three places: what is text as it is, and what its compressed streams hold."""
    for run, at in _runs(layer.text):
        run = run.replace("-", "+").replace("_", "/")
        packed = PACKED.search(run)
        starts = [0, *(m.end() for m in SIGN.finditer(run))] if len(run) >= PLAIN else []
        for skip in range(4):
            n = len(run) - skip
            n -= n % 4 == 1
            data = base64.b64decode(run[skip : skip + n] + "=" * (-n % 4))
            whole: list[tuple[int, int]] = []
            if packed and MAGIC.search(data):
                yield from _unpacked(_reader(data), data, 0, layer.span(at[0], at[-1] + 1), met, whole)
            if n < PLAIN:
                continue
            for start in starts if len(data) > 4 else ():
                first = (start - skip) * 3 // 4
                if start % 4 == skip and n - start >= PLAIN - 4 and data[first] & 6 != 6:  # there is no such first block
                    yield _inside(lambda: iter(_Stream(_reader(data)(first), raw=True)), layer.span(at[start], at[-1] + 1), met)  # noqa: B023
            for first, width, text in _texts(data, whole):

                def span(a: int, b: int, at=at, skip=skip, n=n, first=first, width=width, text=text) -> tuple[int, int]:
                    x, y = (first + (width * i if width else len(text[:i].encode())) for i in (a, b))
                    return layer.span(at[skip + x * 4 // 3], at[min(skip + n, skip - (-y * 4 // 3)) - 1] + 1)

                yield _Layer(text, span)


def _binary(layer: _Layer, met: set) -> Iterator[_Layer]:
    """What compressed streams in percent-escaped bytes hold, as they stand or with all escapes taken off."""
    for m in BINARY.finditer(layer.text):
        for run in {m.group(), m.group().replace("+", " ")}:
            data = unquote_to_bytes(run)
            if MAGIC.search(data):
                yield from _unpacked(_reader(data), data, 0, layer.span(m.start(), m.end()), met, [])
    for m in _BYTES.finditer(layer.text) if _BYTE.search(layer.text) else ():
        data = m.group().encode("utf-8", "surrogateescape")
        if MAGIC.search(data):
            yield from _unpacked(_reader(data), data, 0, layer.span(m.start(), m.end()), met, [])


def _layers(layer: _Layer, met: set) -> Iterator[_Layer]:
    """All that decodes from a layer, one after another."""
    yield from _base64(layer, met)
    if "%" in layer.text or not layer.text.isascii():
        yield from _binary(layer, met)
    if not any(mark in layer.text for mark in _MARKS):
        return
    if layer.whole:
        for pattern, decode in ((URL, _url), (UNICODE, _unicode)):
            if x := _once(layer, pattern, decode):
                yield x
    if x := _fixpoint(layer):
        yield x


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(findings in the text as it is, findings with those of decoded layers): (start, kind, end)."""
    root = _Layer(text or "", lambda a, b: (a, b))
    base = scan(root.text)
    deepest = 64 + 4 * len(root.text)  # a layer around another takes a character or more, so only what makes itself anew goes deeper
    found, met, work = set(base), set(), [_layers(root, streams := set())]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if isinstance(layer, Iterator):
            if len(work) < deepest:
                work.append(layer)
            continue
        key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.span(0, len(layer.text)), layer.whole)
        if key in met:
            continue
        met.add(key)
        for start, kind, end in scan(layer.text):
            a, b = layer.span(start, end)
            found.add((a, kind, b))
        if len(work) < deepest:
            work.append(_layers(layer, streams))
    return base, sorted(found)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every found span replaced by a mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], "[SECRET]"] if a >= at else []
        at = b
    return "".join(out) + text[at:]


def scans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, counts by kind, base_sha256, spans."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every = find(text)
            kinds = [kind for _, kind, _ in base]
            rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found secret in ``text`` replaced by a mark; a null text stays null."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, find(t)[1]) for t in texts], dtype=object)

    return docs.withColumn("text", run("text"))


def op8(spark, sf_dir: str) -> DataFrame:
    return scans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
