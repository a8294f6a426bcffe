"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with some whole WARC
records, and at its end a seek table in a skippable frame (the seekable format:
per frame its compressed and decompressed size; number of frames, flags and the
magic number last). A record is found by its frame and its offset in there.
Equal payloads of REVISIT_BYTES or more are stored once: the others become
revisit records that carry the digest, the length and the id of the response.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import open_for_read, open_for_write, scratch, text_of, written

REVISIT_BYTES, FRAME_BYTES, BUNDLE_BYTES = 1000, 1 << 20, 1 << 28
#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "path string, page_id long, frame_at long, frame_size long, at long, length long"


def record(page_id: int | None, url: str, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC record. kind: response or revisit (whose block is empty)."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at this offset, and where the next begins."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, raw[end + 4 : stop], stop + 4


class Bundle:
    """Writes frames of about FRAME_BYTES."""

    def __init__(self, uri: str):
        import zstandard

        self.uri, self.stream, self.packer = uri, open_for_write(uri), zstandard.ZstdCompressor(level=3)
        self.at, self.raw, self.waiting, self.frames, self.index = 0, bytearray(), [], [], []

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.waiting.append((page_id, len(self.raw), len(raw)))
        self.raw += raw
        if len(self.raw) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.raw:
            frame = self.packer.compress(bytes(self.raw))
            self.stream.write(frame)
            self.index += [(self.uri, p, self.at, len(frame), at, n) for p, at, n in self.waiting]
            self.frames.append((len(frame), len(self.raw)))
            self.at += len(frame)
            self.raw, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()
        return self.index


def seek_table(stream) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame, from the footer."""
    end = stream.size()
    stream.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    stream.seek(end - 9 - 8 * n)
    raw, at, out = stream.read(8 * n), 0, []
    for small, large in struct.iter_unpack("<II", raw):
        out.append((at, small, large))
        at += small
    return out


def unpacked(frame: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(frame)


def read_record(path: str, frame_at: int, frame_size: int, at: int) -> tuple[dict[str, str], bytes]:
    """Random access: reads one frame and parses one record."""
    stream = open_for_read(path)
    stream.seek(frame_at)
    head, block, _ = parse(unpacked(stream.read(frame_size)), at)
    return head, block


def _typed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size and refers_to (null for responses).
    Only digests of large payloads are grouped; a hot one is pre-aggregated."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_of("html").alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("html", "utf-8")), "size": F.octet_length("html").cast("long")})
    keys = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    shared = keys.where("n > 1").select(F.col("digest").alias("_digest"), F.col("size").alias("_size"), "response")
    met = rows.join(shared, (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size")), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("response"))
    return met.withColumn("refers_to", F.when(F.col("response").isNotNull() & other, F.col("response"))).drop("_digest", "_size", "response")


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes every page's record; returns the index (path, page_id, frame_at,
    frame_size, at, length) from its own table.

    Null html is an empty payload, a null url an empty one. Of equal payloads of at
    least REVISIT_BYTES bytes that with the largest page_id is the response; pages
    with a null id never are (unless all are null: then all are responses), and
    rows that repeat the response's id are responses too. File names carry the
    task's attempt, so that a task run twice leaves no torn file in the index. An
    empty table gives an empty index.
    """
    folder = scratch(pages.sparkSession, "warc")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, bundle, n, names = TaskContext.get(), None, 0, [x.split()[0] for x in INDEX.split(", ")]

        def rows(index):
            for i in range(0, len(index), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 0 else pa.int64()) for k, x in enumerate(zip(*index[i : i + 10_000], strict=True))], names)

        for batch in batches:
            for x in batch.to_pylist():
                if bundle is None:
                    bundle = Bundle(f"{folder}/part-{task.partitionId():06d}-{task.attemptNumber()}-{task.taskAttemptId()}-{n:04d}.warc.zst")
                    n += 1
                again = x["refers_to"] is not None
                payload = b"" if again else x["html"].encode("utf-8", "surrogatepass")
                bundle.add(x["page_id"], record(x["page_id"], x["url"], "revisit" if again else "response", x["digest"], x["size"], x["refers_to"], payload))
                if bundle.at >= BUNDLE_BYTES:
                    yield from rows(bundle.close())
                    bundle = None
        if bundle is not None:
            yield from rows(bundle.close())

    return written(_typed(pages).mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """A row for each record, from the archives alone: each bundle's seek table is
    read, then its frames one after another. A response's length and digest are
    taken from its payload and must equal its headers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        number = lambda x: int(x[10:-1]) if x[10:-1] else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                stream = open_for_read(path)
                for at, small, _ in seek_table(stream):
                    stream.seek(at)
                    raw, begin, rows = unpacked(stream.read(small)), 0, []
                    while begin < len(raw):
                        head, block, begin = parse(raw, begin)
                        kind, size, digest = head["WARC-Type"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload does not match its digest")
                        rows.append((number(head["WARC-Record-ID"]), size, digest, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    paths = index.groupBy("path").agg(F.count("*").alias("n")).select("path")
    return paths.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
