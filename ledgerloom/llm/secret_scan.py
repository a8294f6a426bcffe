"""Secret scan with a worklist of decoded layers.

The whole text is the first layer. A layer of text gives new ones: itself with its percent
escapes decoded, itself with its \\u escapes decoded, the readable parts of its base64
runs (each taken at all four places where a group of four characters can begin, so that
a path before the code does not matter), and the compressed streams in decoded bytes. A
stream is a layer of bytes: its readable parts are layers of text, and streams anywhere
in it are layers of bytes again, however deep. They are scanned and searched until none
is new: a layer's content that was seen before at its place is not taken up again, so
cycles end (a stream that holds itself as well). Every layer maps its characters back to
spans of the text, and so do the finds in it.

A stream is never held as a whole. It is opened again from the bytes that it lies in, and
each pass feeds it on piece by piece, to all streams that may begin in it at once, so that
an inner stream may be of any length and begin and end anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import text_of

#: The three kinds of secrets, in the order that ties take.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Escapes of escapes (%2525..., \\u005cu005c...) are one escape.
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"\\(?:u005[cC])*u([0-9A-Fa-f]{4})")
#: A run of base64 in either alphabet; lines of LINE characters or more belong together.
RUN, LINE = 16, 60
BASE64 = re.compile(rf"(?:[A-Za-z0-9+/_-]{{{LINE},}}\r?\n)+[A-Za-z0-9+/_-]+={{0,2}}|[A-Za-z0-9+/_-]{{{RUN},}}={{0,2}}")
#: The first bytes of gzip, zstd and zlib streams, and how many tell one.
MAGIC, HEAD = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]"), 4
#: Decoded bytes that can hold a secret (the shortest has SHORTEST); others part them.
SHORTEST = 12
READABLE = re.compile(rb"[\t\n\r\x20-\x7e\x80-\xff]{12,}")
UNREADABLE = re.compile(rb"[^\t\n\r\x20-\x7e\x80-\xff]")
#: Where text may be parted, as no secret and no code goes on there: after a character that
#: none has, or after spaces that no sign of an assignment stands beside.
PARTED = re.compile(rb"[!#$&()*,;<>?@\[\]^`{|}~\t]|[^\x80-\xff:= ] +(?=[^\x80-\xff:= ])")
#: Bytes of a stream that come at once, and of compressed bytes that are fed at once.
PIECE, STEP, ZSTD_STEP = 1 << 22, 1 << 16, 1 << 10


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one layer, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class _Inflater:
    """A compressed stream that is fed: gzip with the members after it, zlib, or zstd with
    the frames after it. done: it has ended or broken off; what came before counts."""

    def __init__(self, zstd: bool):
        self.done, self.waiting, self.zstd = False, b"", zstd
        self.next, self.step = (b"\x28\xb5\x2f\xfd", ZSTD_STEP) if zstd else (b"\x1f\x8b\x08", STEP)
        self.now = self._opened()

    def _opened(self):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj() if self.zstd else zlib.decompressobj(47)

    def feed(self, data: memoryview) -> Iterator[bytes]:
        import zstandard

        at, step = 0, 64
        try:
            while at < len(data) and not self.done:
                # Small at first: most of what looks like a stream is none.
                own, at, step = data[at : at + step], at + step, min(4 * step, self.step)
                yield from self._part(self.waiting + bytes(own) if self.waiting else own)
        except (zlib.error, zstandard.ZstdError):
            self.done = True

    def _part(self, own) -> Iterator[bytes]:
        self.waiting = b""
        while True:
            if self.now is None:  # between members or frames
                if len(own) < len(self.next):
                    self.waiting = bytes(own)
                    return
                if own[: len(self.next)] != self.next:
                    self.done = True
                    return
                self.now = self._opened()
            out = self.now.decompress(own) if self.zstd else self.now.decompress(own, PIECE)
            yield out
            if self.now.eof:
                own, self.now = self.now.unused_data, None
            elif self.zstd:
                return
            else:
                own = self.now.unconsumed_tail
                if not own and len(out) < PIECE:
                    return


class _Bytes:
    """Decoded bytes that are at hand, as pieces."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def pieces(self, start: int = 0) -> Iterator[memoryview]:
        whole = memoryview(self.raw)
        for k in range(start, len(whole), PIECE):
            yield whole[k : k + PIECE]


class _Stream:
    """What a compressed stream at a place of other bytes holds, opened anew by each reader."""

    def __init__(self, source, start: int, zstd: bool):
        self.source, self.start, self.zstd = source, start, zstd

    def pieces(self, start: int = 0) -> Iterator[memoryview]:
        inflater, gone = _Inflater(self.zstd), 0
        for own in self.source.pieces(self.start):
            for out in inflater.feed(own):
                if gone + len(out) > start:
                    yield memoryview(out)[max(0, start - gone) :]
                gone += len(out)
            if inflater.done:
                return


class _Probe:
    """A stream that may begin at a place: whether it does, and what its content is."""

    def __init__(self, start: int, zstd: bool):
        self.start, self.zstd, self.inflater = start, zstd, _Inflater(zstd)
        self.digest, self.size = hashlib.sha256(), 0

    def feed(self, data: memoryview) -> None:
        for out in self.inflater.feed(data):
            self.digest.update(out)
            self.size += len(out)


def _streams(source) -> Iterator[tuple[_Stream, bytes]]:
    """The streams that begin anywhere in the source, each with a digest of its content."""
    open_now, carry, at = [], b"", 0
    for piece in source.pieces():
        for p in open_now:
            p.feed(piece)
        yield from ((_Stream(source, p.start, p.zstd), p.digest.digest()) for p in open_now if p.inflater.done and p.size >= SHORTEST)
        open_now = [p for p in open_now if not p.inflater.done]
        # A stream's first bytes may lie over the edge of two pieces.
        near, begin = carry + bytes(piece[: HEAD - 1]), at - len(carry)
        edge = [(begin + m.start(), m[0]) for m in MAGIC.finditer(near) if m.start() < len(carry) < m.end()]
        for start, head in [*edge, *((at + m.start(), m[0]) for m in MAGIC.finditer(piece))]:
            p = _Probe(start, head[0] == 0x28)
            if start < at:
                p.feed(memoryview(near[start - begin : len(carry)]))
            p.feed(piece[max(0, start - at) :])
            if not p.inflater.done:
                open_now.append(p)
            elif p.size >= SHORTEST:
                yield _Stream(source, start, p.zstd), p.digest.digest()
        at += len(piece)
        carry = (carry + bytes(piece[-(HEAD - 1) :]))[-(HEAD - 1) :]
    yield from ((_Stream(source, p.start, p.zstd), p.digest.digest()) for p in open_now if p.size >= SHORTEST)


def _texts(source) -> Iterator[str]:
    """The readable parts of the source's bytes. Long ones come in parts, cut where no
    secret and no code goes on."""
    held = b""
    for piece in source.pieces():
        held += piece
        cut = 0
        for m in UNREADABLE.finditer(held, max(0, len(held) - len(piece))):
            cut = m.end()
        if not cut and len(held) > PIECE:
            cut = max((m.end() for m in PARTED.finditer(held, len(held) - len(piece))), default=0)
        if cut:
            yield from (m[0].decode("utf-8", "surrogateescape") for m in READABLE.finditer(held[:cut]))
            held = held[cut:]
    yield from (m[0].decode("utf-8", "surrogateescape") for m in READABLE.finditer(held))


class _One:
    """The places of a layer that maps to one span as a whole."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start, self.end

    def part(self, places) -> _One:
        return self


class _Each:
    """The places of a layer's characters in the text, and of its end."""

    def __init__(self, places):
        self.places = places
        self.start, self.end = int(places[0]), int(places[-1])

    def span(self, a: int, b: int) -> tuple[int, int]:
        import numpy as np

        after = b + int(np.searchsorted(self.places[b:], self.places[b - 1], side="right"))
        return int(self.places[a]), int(self.places[min(after, len(self.places) - 1)])

    def part(self, places) -> _Each:
        return _Each(self.places[places])


def _of_bytes(raw: bytes, at) -> Iterator:
    """Layers in decoded bytes: the streams in them, then their readable parts. at: the
    place of each byte, and of the end."""
    import numpy as np

    if MAGIC.search(raw):
        for stream, digest in _streams(_Bytes(raw)):
            yield (stream, digest), _One(int(at[stream.start]), int(at[-1]))
    for m in READABLE.finditer(raw):
        text = m[0].decode("utf-8", "surrogateescape")
        if not _worth(text):
            continue
        places = at[m.start() : m.end() + 1]
        if len(text) < len(m[0]):
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            size = np.where((code < 0x80) | (code >> 8 == 0xDC), 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
            places = places[np.append(0, np.cumsum(size))]
        yield text, _Each(places)


def _of_stream(stream: _Stream) -> Iterator:
    """Layers in a stream's content; all are at the stream's own place."""
    for text in _texts(stream):
        if _worth(text):
            yield text, _HERE
    for inner in _streams(stream):
        yield inner, _HERE


def _worth(text: str) -> bool:
    """Whether a layer can give anything at all."""
    return bool(base_spans(text) or PERCENT.search(text) or ESCAPE.search(text) or BASE64.search(text))


def _bytes_of(text: str):
    """The text's UTF-8 bytes, and the character that each byte belongs to."""
    import numpy as np

    raw = text.encode("utf-8", "surrogateescape" if any("\udc80" <= c <= "\udcff" for c in text) else "surrogatepass") if not text.isascii() else text.encode()
    if len(raw) == len(text):
        return raw, np.arange(len(text))
    starts = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
    if int(starts.sum()) != len(text):  # bytes that are no UTF-8 stand for themselves
        size = np.array([1 if "\udc80" <= c <= "\udcff" else len(c.encode("utf-8", "surrogatepass")) for c in text])
        return raw, np.repeat(np.arange(len(text)), size)
    return raw, np.cumsum(starts) - 1


def _unescaped(text: str, escape: re.Pattern, byte) -> Iterator:
    """The whole text with its escapes decoded by byte(match)."""
    import numpy as np

    raw, places, last = [], [], 0
    for m in escape.finditer(text):
        if m.start() > last:
            part, of = _bytes_of(text[last : m.start()])
            raw.append(part)
            places.append(of + last)
        own = byte(m)
        raw.append(own)
        places.append(np.full(len(own), m.start()))
        last = m.end()
    if not raw:
        return
    part, of = _bytes_of(text[last:])
    yield from _of_bytes(b"".join([*raw, part]), np.concatenate([*places, of + last, [len(text)]]))


_HIGH, _LOW = r"\\(?:u005[cC])*u([dD][89abAB][0-9A-Fa-f]{2})", r"\\(?:u005[cC])*u([dD][c-fC-F][0-9A-Fa-f]{2})"
#: Two escapes that make one character are taken together.
_ESCAPES = re.compile(f"{_HIGH}{_LOW}|{ESCAPE.pattern}")


def _utf16(m: re.Match) -> bytes:
    if m[1]:
        return chr(0x10000 + ((int(m[1], 16) & 0x3FF) << 10 | int(m[2], 16) & 0x3FF)).encode()
    return chr(int(m[3], 16)).encode("utf-8", "replace")


def _layers(text: str) -> Iterator:
    """Decoded layers of a layer: their text and their characters' places in it."""
    import numpy as np

    if "%" in text:
        yield from _unescaped(text, PERCENT, lambda m: bytes([int(m[1], 16)]))
    if "\\u" in text:
        yield from _unescaped(text, _ESCAPES, _utf16)
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=")
        # A word in letters of one case, or with one capital first, is no base64.
        if body.isalpha() and (body[1:].islower() or body.isupper()):
            continue
        place = np.arange(m.start(), m.start() + len(body))
        if "\n" in body:
            place = place[[c not in "\r\n" for c in body]]
            body = body.replace("\r", "").replace("\n", "")
        body = body.replace("-", "+").replace("_", "/")
        for begin in range(4):
            whole = (len(body) - begin) // 4 * 4
            rest = (len(body) - begin) % 4
            code = body[begin : begin + whole] + (body[begin + whole :] + "=" * (4 - rest) if rest > 1 else "")
            raw = base64.b64decode(code)
            at = place[begin + np.arange(len(raw)) * 4 // 3]
            yield from _of_bytes(raw, np.append(at, m.end()))


#: The place of what lies in a stream: the stream's own.
_HERE = _One(0, 0)


def all_spans(text: str) -> set[tuple[str, int, int]]:
    """(kind, start, end) in the text, of the text itself and of all its layers.
    A find in a decoded layer spans all encoded characters that it came from, one in a
    compressed stream the whole of the encoded run from the stream's beginning on."""
    found, seen = set(base_spans(text)), set()
    work: list[tuple[Iterator, _Each | _One | None]] = [(_layers(text), None)]
    while work:
        step = next(work[-1][0], None)
        if step is None:
            work.pop()
            continue
        (inner, places), at = step, work[-1][1]
        if places is _HERE:
            places = at
        elif at is not None:
            places = at if isinstance(places, _One) and isinstance(at, _One) else _One(*at.span(places.start, max(places.end, places.start + 1))) if isinstance(places, _One) else at.part(places.places)
        content = inner.encode("utf-8", "surrogatepass") if isinstance(inner, str) else b"stream " + inner[1]
        key = hashlib.sha256(b"%d %d " % (places.start, places.end) + content).digest()
        if key in seen:
            continue
        seen.add(key)
        if isinstance(inner, str):
            for kind, a, b in base_spans(inner):
                found.add((kind, *places.span(a, b)))
            work.append((_layers(inner), places))
        else:
            work.append((_of_stream(inner[0]), places))
    return found


def listed(spans) -> str:
    """kind:start:end by start, then kind as listed, then end; joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): one row for each row of docs,
    in the tasks that read them. base: the spans of the text itself; spans: those
    and the ones from decoded layers. Null and empty texts have none. Null ids stay
    null, repeated rows give repeated rows, other columns are not read, and an empty
    table gives none. Time is linear in the length of a layer's content, which is read
    once for each layer below it; no layer is cut short."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(t)
                n = [sum(1 for x in base if x[0] == kind) for kind in KINDS]
                rows.append((k, *n, listed(base), listed(all_spans(t))))
            if rows:
                columns = [pa.array(x, pa.int64() if i < 4 else pa.string()) for i, x in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col(key).cast("long"), text_of(text)).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
