"""Secrets within nested encodings, each as users meet them."""

import base64
import gzip
import time
import zlib

import pytest
import zstandard

from ledgerloom.llm import secret_scan as S

SECRET = "password=hunter2secret"


def b64(x):
    return base64.b64encode(x).decode()


def kinds(text):
    return {k for k, _, _ in S.all_spans(text)}


@pytest.mark.parametrize(
    "text",
    [
        "secret\\u003dabc123xyz",
        "pass\\u0077ord=hunter2",
        "\\u0074\\u006fken=abcdef9",
        "password%3Dhunter2secret",
        "password%252525253Dhunter2secret",
        "go http://host/dl/" + b64(SECRET.encode()) + " now",
        "x " + base64.urlsafe_b64encode(("é?>~" + SECRET + "?>~é" * 4).encode()).decode() + " y",
        base64.encodebytes(("filler words " * 9 + SECRET + " and more " * 9).encode()).decode(),
        "a " + b64(gzip.compress(b"nothing") + gzip.compress(SECRET.encode())) + " b",
        "a " + b64(zstandard.compress(b"nothing") + zstandard.compress(SECRET.encode())) + " b",
        "a " + "".join(f"%{x:02x}" for x in zlib.compress(SECRET.encode())) + " b",
        "a " + b64(b64(b64(SECRET.encode()).encode()).encode()) + " b",
        "a " + b64(b"\x00\x01\x02" * 30 + SECRET.encode()) + " b",
    ],
)
def test_layers(text):
    assert "assign" in kinds(text)
    assert all(0 <= a < b <= len(text) for _, a, b in S.all_spans(text))


def test_long_streams_are_read_to_their_end():
    assert "assign" in kinds("a " + b64(zlib.compress(b"0 " * (35 << 20) + SECRET.encode(), 1)) + " b")


def test_long_texts_take_linear_time():
    for text in ("x" * 1_000_000, "%41" * 300_000, "%" + "25" * 400_000 + "41", "\\u0041" * 150_000, "aB3-" * 250_000):
        begin = time.process_time()
        S.all_spans(text)
        assert time.process_time() - begin < 20
