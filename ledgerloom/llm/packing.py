"""Cost-balanced packing of token documents into fixed-length training sequences.

Attention over n tokens of one document costs about LINEAR * n + QUADRATIC * n**2.
Within a block of documents (BLOCK_TOKENS ids, or one longer document) the number
of sequences is the least that holds all ids. Documents give their full sequences
first; the rests go in descending length to the sequence of the lowest cost so
far that has room for them, sought among the LOOK of lowest cost; where none has,
the roomiest of those takes what fits and the rest goes on. So only the last
sequence of each block can be short, and no id is lost or doubled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import text_of

LINEAR, QUADRATIC, BLOCK_TOKENS, LOOK = 1.0, 1.0 / 1024, 2_000_000, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (document, start, length, sequence, offset) and the sequences' costs."""
    pieces, costs = [], []
    rest = []
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((d, start, capacity, len(costs), 0))
            costs.append(cost(capacity))
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    first, total = len(costs), sum(n for n, _, _ in rest)
    room = -(-total // capacity)
    costs += [0.0] * room
    # The last sequence takes what the others leave, so that it alone is short.
    short = total - capacity * (room - 1) if room else 0
    left = {first + i: capacity if i < room - 1 else short for i in range(room)}
    open_now = [(0.0, s) for s in left]
    for n, d, start in rest:
        while n:
            seen = []
            while open_now and len(seen) < LOOK and (not seen or left[seen[-1][1]] < n):
                seen.append(heapq.heappop(open_now))
            c, s = seen[-1] if left[seen[-1][1]] >= n else max(seen, key=lambda x: left[x[1]])
            fits = min(n, left[s])
            whole = capacity if s < first + room - 1 else short
            pieces.append((d, start, fits, s, whole - left[s]))
            left[s] -= fits
            costs[s] = c + cost(fits)
            for x in seen:
                if x[1] != s:
                    heapq.heappush(open_now, x)
            if left[s]:
                heapq.heappush(open_now, (costs[s], s))
            n, start = n - fits, start + fits
    return pieces, costs


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Packs every whole text (null: empty), with end_id after it; a row for each piece.

    Each task packs the rows it reads, block by block, so nothing is shuffled and
    memory holds one block. sequence_id is the task's number times 2**33 plus a
    count. Repeated rows are separate documents, as are those with a null key (which
    stays null). Only the key and the text are read: other columns, whatever their
    names, do not matter. An empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from ledgerloom.llm.tokens import encoder

        enc, next_id = encoder(tokenizer), TaskContext.get().partitionId() << 33
        keys, held, size = [], [], 0

        def block():
            nonlocal next_id
            lengths = [len(x) for x in held]
            pieces, costs = assign(lengths, capacity)
            d, start, length, s, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(held[i][a : a + n]) for i, a, n, _, _ in pieces]
            columns = [pa.array([keys[i] for i in d], pa.int64()), start, length, np.array(crc, np.int64), np.array(lengths, np.int64)[d], s + next_id, offset, np.array(costs)[s]]
            next_id += len(costs)
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for k, ids, ends in enc.slices(batch.column(1), end_id):
                ids = ids.astype("<u4", copy=False)
                for i in range(len(ends) - 1):
                    keys.append(own[k + i])
                    held.append(ids[ends[i] : ends[i + 1]])
                    size += len(held[-1])
                    if size >= BLOCK_TOKENS:
                        yield block()
                        keys, held, size = [], [], 0
        if held:
            yield block()

    return docs.select(F.col(key).cast("long"), text_of(text)).mapInArrow(run, PIECES)
