"""Fill-in-the-middle training texts by in-place block rotation.

A text is cut at two places of its code points. Its bytes stand in one bytearray,
with a sentinel before each of the three segments, and segments change places there
by rotations: a block is rotated by reversing its two parts and then the whole. The
inverse rotation puts the segments back, and without the sentinels the text is there
again, byte for byte. Nothing but the buffer and one block of a reversal is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import fresh, text_of

#: The sentinels of prefix, suffix and middle; of 100 texts how many are
#: changed, and of 100 changed ones how many have the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHANGED, SUFFIX_FIRST, SEED = 90, 20, "1"
#: Bytes that a reversal exchanges at once, and bytes of output that go out together.
BLOCK, SLICE = 1 << 16, 16_000_000


def _reverse(buffer, start: int, end: int) -> None:
    """Reverses buffer[start:end] (a numpy view) in place, blocks from both ends."""
    while end - start > 1:
        n = min(BLOCK, (end - start) // 2)
        head = buffer[start : start + n].copy()
        buffer[start : start + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = head[::-1]
        start, end = start + n, end - n


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """data[start:middle] and data[middle:end] change places, by three reversals."""
    import numpy as np

    view = np.frombuffer(data, np.uint8)
    _reverse(view, start, middle)
    _reverse(view, middle, end)
    _reverse(view, start, end)


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text cut at the bytes first and second, with sentinels, in the form's order:
    "psm" (prefix, suffix, middle), "spm" (suffix, prefix, middle) or "plain"."""
    data = bytearray(text)
    if form == "plain":
        return data
    # From the back, so that the places before stay valid.
    data[second:second] = SUFFIX
    data[first:first] = MIDDLE
    data[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(data, middle if form == "psm" else 0, suffix, len(data))
    return data


def rebuild(output: bytes, form: str) -> bytearray:
    """The text that arrange() was given. A text holds no sentinel, so the first of each
    kind is the one that was put in."""
    data = bytearray(output)
    if form == "plain":
        return data
    middle = data.find(MIDDLE)
    if form == "psm":
        start = data.find(SUFFIX)
        rotate(data, start, middle, len(data))
        second = start + len(data) - middle
        first = start
    else:
        start = data.find(PREFIX)
        rotate(data, 0, start, len(data))
        first, second = middle - start, len(data) - start
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        del data[at : at + len(mark)]
    return data


def choice(key: int | None, n: int, marked: bool, seed: str = SEED) -> tuple[str, int, int]:
    """The form, and the places (in code points) where prefix and middle end."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not n or marked or h3 % 100 >= CHANGED else "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    return form, first, second


def transform(docs: DataFrame, seed: str = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): a row for each row of docs,
    made by the task that reads it.

    Null texts are empty; empty texts, those that hold a sentinel, and a tenth of the
    rest stay plain, without cuts (null). Texts are whole, however long. Repeated rows
    give repeated rows; a null id stays null and is cut as by an empty id. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            rows, size = [], 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                k, t = k.as_py(), t.as_py()
                raw = t.encode()
                form, first, second = choice(k, len(t), PREFIX in raw or SUFFIX in raw or MIDDLE in raw, seed)
                a = first if len(raw) == len(t) else len(t[:first].encode())
                b = second if len(raw) == len(t) else a + len(t[first:second].encode())
                cuts = (None, None) if form == "plain" else (first, second - first)
                rows.append((k, len(t), form, *cuts, bytes(arrange(raw, a, b, form))))
                size += len(raw)
                if size >= SLICE:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return docs.select(F.col(key).cast("long"), text_of(text)).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """rows with the exact text as a further column, rebuilt from output and form. A null
    output or form gives null. All other columns stay as they are; `name` must not be
    one of theirs (fresh() finds one that is not)."""
    if name.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"rows already have a column {name}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            begin, size, out = 0, 0, []
            for i, (o, f) in enumerate(zip(batch.column(output), batch.column(form), strict=True), 1):
                raw = o.as_buffer() if o.is_valid and f.is_valid else None
                out.append(None if raw is None else bytes(rebuild(raw, f.as_py())))
                size += len(raw or b"")
                if size >= SLICE or i == batch.num_rows:
                    part = batch.slice(begin, i - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, name])
                    begin, size, out = i, 0, []

    schema = rows.schema
    return rows.mapInArrow(run, type(schema)([*schema.fields]).add(name, "string"))


def digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """transform() and restore(), with the texts as SHA-256 digests."""
    made = transform(docs, text=text, key=key)
    (back,) = fresh(made, "restored")
    rows = restore(made, name=back)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(back).alias("restored_sha256"))
