"""Token-id files: every id in the fewest bits that the vocabulary needs.

File format: ids in groups of 64, each group ``bits`` little-endian 64-bit words
(id i of a group starts at bit ``i * bits``); groups in blocks of BLOCK ids;
then a JSON footer (bits, number of ids, byte offset of every block, and for
every document its id, start and length), the footer's length as 8 bytes, and
the magic bytes. Any id is found by arithmetic, any range by reading its blocks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import open_for_read, open_for_write, scratch, text_of, written

MAGIC, BLOCK, FILE_IDS = b"LLBITS01", 65_536, 16_000_000


def bits_for(vocabulary: int) -> int:
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack_bits(ids, bits: int):
    """Unsigned ids to 64-bit words; the last group is filled up with zeros."""
    import numpy as np

    n = -(-len(ids) // 64)
    grid = np.zeros(n * 64, np.uint64)
    grid[: len(ids)] = ids
    grid, out = grid.reshape(n, 64), np.zeros((n, bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= grid[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= grid[:, i] >> np.uint64(64 - shift)
    return out.ravel()


def unpack_bits(words, bits: int, count: int):
    import numpy as np

    grid = np.asarray(words, np.uint64).reshape(-1, bits)
    out, mask = np.empty((len(grid), 64), np.uint64), np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        x = grid[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (grid[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = x & mask
    return out.ravel()[:count].astype(np.uint32)


class Writer:
    """Appends documents' ids to one file, a block at a time."""

    def __init__(self, uri: str, bits: int):
        self.stream, self.bits = open_for_write(uri), bits
        self.waiting, self.held, self.n, self.at, self.blocks, self.documents = [], 0, 0, 0, [], []

    def add(self, doc_id: int | None, ids) -> None:
        self.documents.append((doc_id, self.n, len(ids)))
        self.n += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 8 * BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        import numpy as np

        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            raw = pack_bits(ids[k : min(k + BLOCK, whole)], self.bits).astype("<u8").tobytes()
            self.blocks.append(self.at)
            self.stream.write(raw)
            self.at += len(raw)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._blocks(True)
        foot = json.dumps({"bits": self.bits, "n": self.n, "blocks": self.blocks, "documents": self.documents}).encode()
        self.stream.write(zlib.compress(foot, 1) + len(zlib.compress(foot, 1)).to_bytes(8, "little") + MAGIC)
        self.stream.close()


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, uri: str):
        self.stream = open_for_read(uri)
        end = self.stream.size()
        self.stream.seek(end - 16)
        tail = self.stream.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        size = int.from_bytes(tail[:8], "little")
        self.stream.seek(end - 16 - size)
        foot = json.loads(zlib.decompress(self.stream.read(size)))
        self.bits, self.n, self.blocks, self.documents = foot["bits"], foot["n"], foot["blocks"], foot["documents"]

    def ids(self, start: int, length: int):
        """The ids from start on, reading only the groups that hold them."""
        import numpy as np

        out = []
        while length > 0:
            block, inside = divmod(start, BLOCK)
            take = min(length, BLOCK - inside)
            first, last = inside // 64, -(-(inside + take) // 64)
            self.stream.seek(self.blocks[block] + first * self.bits * 8)
            words = np.frombuffer(self.stream.read((last - first) * self.bits * 8), "<u8")
            out.append(unpack_bits(words, self.bits, (last - first) * 64)[inside - first * 64 :][:take])
            start, length = start + take, length - take
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def walk(self, span: int = 16 * BLOCK) -> Iterator:
        """(document, start, ids) of every document in order, unpacked span by span."""
        import numpy as np

        held, base = np.zeros(0, np.uint32), 0
        for doc, start, n in self.documents:
            while base + len(held) < start + n:
                end = base + len(held)
                held = np.concatenate([held[start - base :], self.ids(end, min(span, self.n - end))])
                base = start
            yield doc, start, held[start - base : start - base + n]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every whole text (null: empty), adds end_id, and writes files in
    ascending key order; returns the manifest (part, path, n_ids, first), read
    from its own table, so that only files of tasks that succeeded are named.

    Documents are dealt out by ranges of the key and, within equal keys, of the
    text's hash; null keys come first, repeated rows are separate documents.
    A file takes FILE_IDS ids and then whatever its last document still needs.
    """
    folder = scratch(docs.sparkSession, "token-files")
    dealt = docs.select(F.col(key).alias("k"), text_of(text).alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = dealt.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from ledgerloom.llm.tokens import encoder

        task, enc = TaskContext.get(), encoder(tokenizer)
        rows, file, bits = [], None, bits_for(max(enc.size, end_id + 1))

        def closed() -> None:
            file.close()
            rows.append((task.partitionId(), len(rows), path, file.n))

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, ids, ends in enc.slices(batch.column(1), end_id):
                for i in range(len(ends) - 1):
                    if file is None:
                        path = f"{folder}/part-{task.partitionId():06d}-{task.attemptNumber()}-{task.taskAttemptId()}-{len(rows):04d}.ids"
                        file = Writer(path, bits)
                    file.add(keys[k + i], ids[ends[i] : ends[i + 1]])
                    if file.n >= FILE_IDS:
                        closed()
                        file = None
        if file is not None:
            closed()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["part", "seq", "path", "n_ids"])

    return written(dealt.mapInArrow(write, "part long, seq long, path string, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document in the files: doc_id, start (ids of all documents
    before it), n_tokens and ids_crc32, all from the files themselves. Starts come
    from sums over the manifest's parts, then within a part."""
    within, before = Window.partitionBy("part").orderBy("seq"), Window.orderBy("part")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", (F.sum("all").over(before) - F.col("all")).alias("base"))
    files = manifest.join(parts, "part").select("path", (F.col("base") + F.sum("n_ids").over(within) - F.col("n_ids")).alias("base"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, docs = Reader(path), []
                for k, start, ids in file.walk():
                    docs.append((k, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                for i in range(0, len(docs), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*docs[i : i + 10_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
