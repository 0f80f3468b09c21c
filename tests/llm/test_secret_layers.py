"""Layers that are more than one member, line, width or alignment."""

import base64
import bz2
import gzip
import urllib.parse
import zlib

import pytest
import zstandard

from ampflow.llm import secrets

SECRET = b'token = "abcdefghijklmnop12"'
FILL = bytes(range(32, 127)) * 9


def b64(data):
    return base64.b64encode(data).decode()


def kinds(text):
    return {secrets.KINDS[k] for _, k, _ in secrets.find(text)[1]}


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, zstandard.compress])
def test_second_member(pack):
    assert kinds(b64(pack(b"nothing here") + pack(SECRET))) == {"assign"}
    assert kinds(b64(pack(SECRET[:12]) + pack(SECRET[12:]))) == {"assign"}
    assert kinds(b64(b"raw \x00\xff bytes" + pack(SECRET))) == {"assign"}
    assert kinds(b64(pack(b"\xff\xfe\x00" + pack(SECRET)))) == {"assign"}
    assert kinds(urllib.parse.quote(pack(SECRET))) == kinds("x=" + urllib.parse.quote_plus(pack(SECRET))) == {"assign"}


@pytest.mark.parametrize("payload", [SECRET, FILL + SECRET + FILL, gzip.compress(FILL + SECRET), b"x" * 41 + SECRET])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
def test_wrapped_lines(payload, end):
    code = b64(payload)
    for width in (64, 76):
        text = end.join(code[i : i + width] for i in range(0, len(code), width))
        assert kinds(f"Part: base64\n\n{text}\nend of it") == {"assign"}


def test_span_over_a_line_end():
    code = b64(b"x" * 41 + SECRET)
    text = code[:76] + "\n" + code[76:]
    ((a, kind, b),) = secrets.find(text)[1]
    assert kind == 0 and a == 41 * 4 // 3 and b > 77 and b <= len(text)


@pytest.mark.parametrize("code", ["utf-16-le", "utf-16-be", "utf-16"])
def test_sixteen_bits(code):
    assert kinds("powershell -enc " + b64(SECRET.decode().encode(code))) == {"assign"}
    assert kinds(b64(gzip.compress(SECRET.decode().encode(code)))) == {"assign"}


@pytest.mark.parametrize("before", ["a/", "blob_", "path/to/", "x-y-", "https://h.example/v/"])
def test_prefixes(before):
    assert kinds(before + b64(SECRET)) == kinds(before + b64(gzip.compress(SECRET))) == {"assign"}


def test_what_stands_before_a_broken_place_is_kept():
    import random

    body = SECRET + b"\n" + random.Random(1).randbytes(9000)
    assert kinds(b64(gzip.compress(body)[:6000])) == {"assign"}


def test_no_finding_in_plain_words():
    assert kinds("a-long-hyphenated-word-of-many-parts\nanother-long-word-of-many-parts\n") == set()


def test_short_streams():
    """The shortest finding, packed: 6 bytes, 8 characters of base64."""
    assert kinds(b64(zlib.compress(b"0" * 40))) == kinds("x " + b64(zlib.compress(b"0" * 16)[:6]) + " y") == {"hex"}
    assert kinds("see path/" + b64(zlib.compress(b"0" * 16)) + "!") == {"hex"}


def test_escapes_to_their_fixpoint():
    inner = "token=abcdefghijklmnop"
    for depth in range(1, 6):
        for first in (urllib.parse.quote, lambda t: "".join(f"\\u{ord(c):04x}" for c in t)):
            text = first(inner)
            for i in range(depth):
                text = urllib.parse.quote(text) if i % 2 else "".join(f"\\u{ord(c):04x}" if c in "%\\" else c for c in text)
            assert (0, 0, len(text)) in secrets.find(text)[1]
    packed = urllib.parse.quote(urllib.parse.quote(gzip.compress(SECRET)))
    assert kinds(packed) == {"assign"}


@pytest.mark.parametrize("wrap", [lambda b: b, lambda b: b"\xff" * 70_000 + gzip.compress(b), lambda b: b"no " * 30_000 + base64.b64encode(gzip.compress(b)), lambda b: gzip.compress(b"y z " * 30_000 + gzip.compress(b))])
def test_streams_longer_than_a_window(monkeypatch, wrap):
    """What unpacks to many windows is read to its end, streams and runs inside it too."""
    import random

    monkeypatch.setattr(secrets, "WINDOW", 1 << 14)
    noise = random.Random(3).randbytes(60_000)
    body = wrap(b"lorem " * 9_000 + noise + SECRET + noise + b" dolor" * 9_000)
    assert "assign" in kinds(b64(gzip.compress(body)))
    assert "assign" not in kinds(b64(gzip.compress(wrap(b"lorem " * 9_000 + noise + noise))))


def test_a_stream_that_holds_itself_ends(monkeypatch):
    monkeypatch.setattr(secrets, "_member", lambda read, at, used: iter([b64(gzip.compress(b"x" * 99)).encode()]))
    assert secrets.find(b64(gzip.compress(b"x" * 99)))[0] == []


def deflated(data, bits):
    c = zlib.compressobj(9, zlib.DEFLATED, bits)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize("bits", [*range(9, 16), -9, -15])
def test_deflate_with_any_window_or_no_header(bits):
    assert kinds(b64(deflated(SECRET, bits))) == kinds("blob_" + b64(deflated(FILL + SECRET, bits))) == {"assign"}


@pytest.mark.parametrize("window", [27, 28, 31])
def test_zstd_with_long_windows(window):
    """The size of what is packed is not said, so the frame names the whole window."""
    c = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=window, enable_ldm=False, chain_log=6, hash_log=6)).compressobj()
    assert kinds(b64(c.compress(SECRET) + c.flush())) == {"assign"}


def test_xz():
    import lzma

    assert kinds(b64(lzma.compress(SECRET))) == kinds(b64(lzma.compress(b"x") + lzma.compress(SECRET))) == {"assign"}
    assert kinds(urllib.parse.quote(lzma.compress(SECRET))) == {"assign"}


NOTATIONS = ["\\u{%x}", "\\x%02x", "\\U%08x", "%%u%04x", "&#%d;", "&#x%x;", "\\u%04x"]


@pytest.mark.parametrize("said", NOTATIONS)
def test_characters_by_number(said):
    inner = "token=abcdefghijklmnop"
    text = "".join(said % ord(c) for c in inner)
    assert secrets.find(text)[1] == [(0, 0, len(text))]
    part = "see " + inner.replace("=", said % ord("=")) + " there"
    assert secrets.find(part)[1] == [(4, 0, len(part) - 6)]
    for other in NOTATIONS:  # nested: the signs of one written in another
        twice = "".join(other % ord(c) if c in "\\%&{};" else c for c in text)
        assert (0, 0, len(twice)) in secrets.find(twice)[1]


def test_numbers_beyond_unicode_stay():
    assert secrets.find("\\U00110000 \\u{ffffffff} &#99999999; \\ud800 &#55296; \\x4")[1] == []


def test_deep_streams():
    data = SECRET
    for _ in range(600):
        data = gzip.compress(data, 1)
    assert kinds(b64(data)) == {"assign"}


def test_streams_that_grow_without_end_end(monkeypatch):
    """A member that always unpacks to a larger one."""
    size = iter(range(10**9))
    monkeypatch.setattr(secrets, "_member", lambda read, at, used: iter([zlib.compress(b"x" * 9) + str(next(size)).encode()]))
    assert secrets.find(b64(zlib.compress(b"x" * 99)))[1] == []


def test_time_grows_with_the_text():
    """Long runs beside a percent sign, many escapes: each once quadratic or close to it."""
    import time

    start = time.monotonic()
    for text in ("% " + "p" * 400_000, "%25" * 100_000 + "&#37;" * 50_000, "\\u005c" * 60_000 + "% ", "\\u{" * 100_000, "&#" * 150_000):
        assert secrets.find(text)[1] == []
    assert time.monotonic() - start < 60
