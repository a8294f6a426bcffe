"""Language-model scores by logistic mixing of hashed-context bit predictors.

A token is coded in binary decisions: CLASS_BITS for the size class of its count
in the training documents (0: not seen; one class for the end), then HASH_BITS of
the word's hash, then its share of its cell's counts; a word that was not seen is
spelled byte by byte. Each decision has four predictors, counts of ones and zeros
under a hashed context (for words: none, the last frequent word, the last two of
them, the last word; for bytes: the place, two, three and four bytes). Their log odds
are combined with weights that a gate picks by how much the longest context has
seen, and the result is refined by an adaptive table of what came true at such a
probability. Weights and table are learned online, chunk after chunk, on all
training tokens of every block, each predicted without its own counts. Last, a
document's own words adapt the model: with weight REPEAT a token is drawn from
the document's tokens before it.

On Spark: blocks of whole documents (about BLOCK_TOKENS) hold their own word
list and ids; word counts are summed over all blocks, shard by shard of the words'
hashes, and go back to the blocks, a row of arrays for each block and shard. The predictors' tables have a fixed size; tasks send their
own tables in slices, which are added up in as many levels as the tasks' number asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop_table, text_of, written

BLOCK_TOKENS, CHUNK, CLASS_BITS, HASH_BITS, WORD_SLOTS, BYTE_SLOTS = 1_000_000, 16_384, 5, 6, 1 << 19, 1 << 17
#: A word is frequent if it is at least that share of the training tokens.
FREQUENT = 1e-3
END, PLAIN, SLICES, RATE, GATES, STEPS, REPEAT = 31, 4096, 32, 0.3, 8, 24, 0.1
#: The weight of the flat share, which the unigram base gives any word that was not seen.
FLAT = 0.5
#: Shards of the words' hashes, each of which is counted by itself.
WORD_SHARDS = 1024
#: Tables that are added up in one task.
FAN = 16
TABLE = PLAIN * 2 + 3 * WORD_SLOTS + 3 * BYTE_SLOTS


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def _packed(x: bytes) -> bytes:
    import zstandard

    return zstandard.compress(x, 1)


def _unpacked(x: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(x)


def _blocks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row for each block: documents, the block's words (parted by blanks; the first
    is the empty one, which stands for the end) and the documents' word ids."""

    class Words(dict):
        def __missing__(self, w):
            self[w] = n = len(self)
            return n

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        words, ids, keys, size, nbytes = Words({b"": 0}), [], [], [], []

        def block():
            wrap = lambda x, t: pa.ListArray.from_arrays([0, len(x)], pa.array(x, t))
            blob = lambda x: pa.array([_packed(x)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([base + made]), wrap(keys, pa.int64()), wrap(size, pa.int32()), wrap(nbytes, pa.int64()), blob(b" ".join(words)), blob(np.concatenate(ids).astype("<i4").tobytes())], ["block", "keys", "size", "nbytes", "words", "ids"])

        total = 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                own = [words[w] for w in raw.lower().split()]
                own.append(0)
                ids.append(np.array(own, np.int32))
                keys.append(k)
                size.append(len(own))
                nbytes.append(len(raw))
                total += len(own)
                if total >= BLOCK_TOKENS:
                    yield block()
                    made += 1
                    words, ids, keys, size, nbytes, total = Words({b"": 0}), [], [], [], [], 0
        if keys:
            yield block()

    return docs.select(F.col(key).cast("long"), text_of(text)).mapInArrow(run, "block long, keys array<long>, size array<int>, nbytes array<long>, words binary, ids binary")


def _block_words(blocks: DataFrame) -> DataFrame:
    """(shard, block, at, h, g, n): the words of each block, by 96 hash bits, with their
    counts in its training documents. A row holds a block's words of one shard as arrays."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh32_intdigest, xxh64_intdigest

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                words = _unpacked(r["words"]).split(b" ")
                ids = np.frombuffer(_unpacked(r["ids"]), "<i4")
                train = np.repeat([not held_out(k) for k in r["keys"]], r["size"])
                n = np.bincount(ids[train], minlength=len(words))
                h = np.array([xxh64_intdigest(w, 42) for w in words], np.uint64)
                g = np.array([xxh32_intdigest(w, 43) for w in words], np.uint32)
                shard = (g & np.uint32(WORD_SHARDS - 1)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(WORD_SHARDS + 1)).tolist()
                own = [k for k in range(WORD_SHARDS) if ends[k] < ends[k + 1]]
                raw = [[x[ends[k] : ends[k + 1]].tobytes() for k in own] for x in (order.astype("<i4"), h[order], g[order], n[order])]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([r["block"]] * len(own), pa.int64()), *(pa.array(x, pa.binary()) for x in raw)], ["shard", "block", "at", "h", "g", "n"])

    return blocks.select("block", "keys", "size", "words", "ids").mapInArrow(run, "shard int, block long, at binary, h binary, g binary, n binary")


def _word_counts(words: DataFrame) -> DataFrame:
    """(block, at, c) for each block and shard: its words that stand in training documents
    and their counts over all blocks; and for each shard a row without a block, with its
    distinct words (n_words) and their counts summed by cell (cell, sums)."""

    def add(table):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        at, h, g, n = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("at", "<i4"), ("h", "<u8"), ("g", "<u4"), ("n", "<i8")))
        ends = np.append(0, np.cumsum([len(x) for x in at]))
        h, g, n = np.concatenate(h), np.concatenate(g), np.concatenate(n)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        c = np.empty(len(order), np.int64)
        c[order] = total[np.cumsum(new) - 1]
        known = np.flatnonzero(total > 0)
        h, total = h[new][known], total[known]
        kind = np.where(h == np.uint64(xxh64_intdigest(b"", 42)), END, size_class(total))
        cell, of = np.unique(kind << HASH_BITS | (h & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64), return_inverse=True)
        sums = np.zeros(len(cell), np.int64)
        np.add.at(sums, of, total)
        found = [(x[keep := y > 0].tobytes(), y[keep].tobytes()) for x, y in zip(at, np.split(c, ends[1:-1]), strict=True)]
        blocks, longs = table.column("block").to_pylist(), pa.list_(pa.int64())
        none, columns = [None] * len(blocks), zip(*found, (None, None), strict=True)
        return pa.table([pa.array([*blocks, None], pa.int64()), *(pa.array(x, pa.binary()) for x in columns), pa.array([*none, len(known)], pa.int64()), pa.array([*none, cell], longs), pa.array([*none, sums], longs)], ["block", "at", "c", "n_words", "cell", "sums"])

    return words.groupBy("shard").applyInArrow(add, "block long, at binary, c binary, n_words long, cell array<long>, sums array<long>")


def _each(batches: Iterator) -> Iterator:
    """The blocks of a task, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1))


def size_class(c):
    """0 for 0, then one more than the whole binary logarithm, below END."""
    import numpy as np

    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), END - 1), 0)


def _mixed(*parts):
    """32 hash bits of some whole numbers."""
    import numpy as np

    h = np.uint32(2166136261)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint32, copy=False)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


class Block:
    """The arrays of one block's row (a record batch of one row)."""

    def __init__(self, row):
        import numpy as np
        from xxhash import xxh64_intdigest

        flat = lambda c: row.column(row.schema.get_field_index(c)).flatten()
        one = lambda c: row.column(row.schema.get_field_index(c))[0].as_py()
        self.keys, self.words = flat("keys").to_pylist(), _unpacked(one("words")).split(b" ")
        self.size, self.nbytes = flat("size").to_numpy(), flat("nbytes").to_numpy()
        self.ids, n_train = np.frombuffer(_unpacked(one("ids")), "<i4"), one("n_train")
        self.count = np.zeros(len(self.words), np.int64)
        for at, c in zip(one("at"), one("c"), strict=True):
            self.count[np.frombuffer(at, "<i4")] = np.frombuffer(c, "<i8")
        full = np.array([xxh64_intdigest(w, 42) for w in self.words], np.uint64)
        self.hash, self.bits = (full >> np.uint64(32)).astype(np.uint32), (full & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.train = np.array([not held_out(k) for k in self.keys])[self.doc]
        start = np.zeros(len(self.ids) + 2, bool)
        start[np.append(0, np.cumsum(self.size))[:-1]] = True
        # What stands before each token of its document: the last word and the last two
        # frequent words (0: none yet).
        first = np.repeat(np.append(0, np.cumsum(self.size))[:-1], self.size)
        place, own = np.arange(len(self.ids)), self.hash[self.ids]
        self.last = np.where(place > first, np.append(np.uint32(0), own[:-1]), np.uint32(0))
        often = (self.count >= FREQUENT * n_train)[self.ids] & (self.ids > 0)
        where = np.maximum.accumulate(np.where(often, place, -1))
        where = np.append(-1, where[:-1])
        self.near = np.where(where >= first, own[where], np.uint32(0))
        again = np.where(where >= 0, where[where], -1)
        self.near2 = np.where((where >= first) & (again >= first), own[again], np.uint32(0))


def _word_decisions(block: Block, at, kind):
    """(group, tokens' places in `at`, bits n x d, table places 4 x n x d) of the
    class decisions of tokens `at` (group 0) and of the hash decisions (group 1)."""
    import numpy as np

    d, kind = np.arange(CLASS_BITS, dtype=np.int32), kind.astype(np.int32)
    known = np.flatnonzero((kind > 0) & (kind != END))
    h = block.bits[block.ids[at[known]]].astype(np.int32)
    e = np.arange(HASH_BITS, dtype=np.int32)
    parts = (
        (0, np.arange(len(at)), (1 << d) | (kind[:, None] >> (CLASS_BITS - d)), (kind[:, None] >> (CLASS_BITS - 1 - d)) & 1),
        (1, known, 32 + kind[known, None] * 64 + ((1 << e) | (h[:, None] >> (HASH_BITS - e))), (h[:, None] >> (HASH_BITS - 1 - e)) & 1),
    )
    contexts = (_mixed(block.near[at], 3), _mixed(block.near[at], block.near2[at]), _mixed(block.last[at], 5))
    for group, row, node, bit in parts:
        places = np.empty((4, *node.shape), np.int32)
        places[0], node = node, node.astype(np.uint32)
        for i, c in enumerate(contexts):
            slot = _mixed(c[row][:, None], node)
            slot &= np.uint32(WORD_SLOTS - 1)
            np.add(slot.view(np.int32), np.int32(2 * PLAIN + i * WORD_SLOTS), out=places[i + 1])
        yield group, row, bit.astype(bool), places


def _byte_decisions(words: list[bytes]):
    """(words' places, bits n x 8, table places) for the bytes of words and the blank
    after each."""
    import numpy as np

    raw = np.frombuffer(b"".join([w + b" " for w in words]), np.uint8).astype(np.int32)
    size = np.array([len(w) + 1 for w in words])
    place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    back = [np.where(place >= k, np.append(np.zeros(k, np.int32), raw)[: len(raw)], 0) for k in (1, 2, 3, 4)]
    d = np.arange(8, dtype=np.int32)
    node, bit = (1 << d) | (raw[:, None] >> (8 - d)), (raw[:, None] >> (7 - d)) & 1
    places, base = np.empty((4, *node.shape), np.int32), 2 * PLAIN + 3 * WORD_SLOTS
    places[0], node = PLAIN + (np.minimum(place, 15) * 256)[:, None] + node, node.astype(np.uint32)
    for i, c in enumerate((_mixed(*back[:2]), _mixed(*back[:3]), _mixed(*back))):
        slot = _mixed(c[:, None], node)
        slot &= np.uint32(BYTE_SLOTS - 1)
        np.add(slot.view(np.int32), np.int32(base + i * BYTE_SLOTS), out=places[i + 1])
    return np.repeat(np.arange(len(words)), size), bit.astype(bool), places


def _chunks(block: Block, at, count):
    """Decisions of the tokens `at`, whose counts are `count`, chunk after chunk:
    (group, tokens' places in `at`, bits, places), or for spellings (group 2) the
    tokens' places, the word of each token and of each byte in place of the second.
    A word that was not seen is spelled once for all its tokens in a chunk."""
    import numpy as np

    for k in range(0, len(at), CHUNK):
        part = at[k : k + CHUNK]
        kind = size_class(count[k : k + CHUNK])
        kind[block.ids[part] == 0] = END
        for group, row, bit, places in _word_decisions(block, part, kind):
            yield group, row + k, bit, places
        new = np.flatnonzero(kind == 0)
        if len(new):
            own, where = np.unique(block.ids[part[new]], return_inverse=True)
            word, bit, places = _byte_decisions([block.words[i] for i in own])
            yield 2, (new + k, where, word), bit, places


def _total(parts: DataFrame, width: int):
    """The sum of the tasks' tables. parts: slice, part (the task's number), payload
    (packed int64). width: numbers in a slice. FAN tables meet in a task, level after
    level, so that no task reads more of them with more tasks."""
    import numpy as np
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        total = np.zeros(width, np.int64)
        for x in pdf["payload"]:
            total += np.frombuffer(zstandard.decompress(x), np.int64)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [pdf["part"].iloc[0]], "payload": [zstandard.compress(total.tobytes(), 1)]})

    import zstandard

    schema = "slice int, part int, payload binary"
    left, out = parts.rdd.getNumPartitions(), np.zeros((SLICES, width), np.int64)
    while left > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("slice", "part").applyInPandas(add, schema)
        left = -(-left // FAN)
    for r in parts.toLocalIterator():
        out[r["slice"]] = np.frombuffer(zstandard.decompress(bytes(r["payload"])), np.int64)
    return out.ravel()


def _sliced(table):
    """A task's own table as rows for _total."""
    import numpy as np
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    flat = table.ravel().astype(np.int64, copy=False)
    if len(flat) % SLICES:
        flat = np.append(flat, np.zeros(-len(flat) % SLICES, np.int64))
    flat = flat.reshape(SLICES, -1)
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in flat], pa.binary())], ["slice", "part", "payload"])


def _width(n: int) -> int:
    return -(-n // SLICES)


def _counted(blocks: DataFrame):
    """The predictors' counts (2 x TABLE) over all tokens of training documents, each
    coded by its word's count without itself."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        table = np.zeros(2 * TABLE, np.int64)  # the zeros and the ones of a place stand together
        for b in _each(batches):
            at = np.flatnonzero(b.train)
            for _, _, bit, places in _chunks(b, at, b.count[b.ids[at]] - 1):
                # An addend of the table's own type and places of the index's own: else
                # each addition is cast.
                where = places.astype(np.intp)
                where *= 2
                where += bit
                np.add.at(table, where.ravel(), np.int64(1))
        yield _sliced(table)

    out = _total(blocks.mapInArrow(run, "slice int, part int, payload binary"), _width(2 * TABLE))
    return np.ascontiguousarray(out[: 2 * TABLE].reshape(TABLE, 2).T)


def _stretch(ones, zeros):
    import numpy as np

    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


def _bucket(seen):
    """The gate: how often the longer context was seen, by binary logarithm."""
    import numpy as np

    return np.minimum(np.log2(seen + np.float32(1)), GATES - 1).astype(np.uint8)


def _cell(score):
    import numpy as np

    return np.clip((score + 6) * 2, 0, STEPS - 1).astype(np.int32)


def _learned(blocks: DataFrame, counts):
    """Gated weights (gates x 4) and the refining table's hits and trials (2 x gates
    x STEPS). Each block learns online from all tokens of its training documents, in
    the order of the hashes of their ids, every one predicted without its own counts; the blocks' weights are averaged by how much each gate was used."""
    import numpy as np

    gates = 3 * GATES
    # What a place says without one token's own decision, at twice the place and its bit:
    # log odds and gate depend on the counts alone, so each is taken once, not in every token.
    odds, gate = np.empty(2 * TABLE, np.float32), np.empty(2 * TABLE, np.uint8)
    zero, one = (x.astype(np.float32) for x in counts)
    for bit in (0, 1):
        of_zero, of_one = np.maximum(zero - (1 - bit), 0), np.maximum(one - bit, 0)
        odds[bit::2], gate[bit::2] = _stretch(of_one, of_zero), _bucket(of_one + of_zero)

    def run(batches: Iterator) -> Iterator:
        sums, hits = np.zeros((gates, 5)), np.zeros((2, gates * STEPS))
        for b in _each(batches):
            order = sorted(range(len(b.keys)), key=lambda d: zlib.crc32(f"learn {b.keys[d]}".encode()))
            starts = np.append(0, np.cumsum(b.size))
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in order])
            at = at[b.train[at]]
            w, heard = np.full((gates, 4), 0.3), np.zeros(gates)
            for group, _, bit, places in _chunks(b, at, b.count[b.ids[at]] - 1):
                bit, places = bit.ravel(), places.reshape(4, -1)
                places *= np.int32(2)
                places += bit
                x = odds.take(places)
                g = gate.take(places[2]).astype(np.int64)
                g += group * GATES
                now = w.astype(np.float32).T.copy()
                score = now[0].take(g) * x[0]
                for i in (1, 2, 3):
                    score += now[i].take(g) * x[i]
                p = 1 / (1 + np.exp(-np.clip(score, -20, 20)))
                cell = (g * STEPS + _cell(score)) * 2 + bit
                seen = np.bincount(cell, minlength=2 * gates * STEPS).reshape(-1, 2)
                hits[0] += seen[:, 1]
                hits[1] += seen.sum(1)
                gap, bend = bit - p, p * (1 - p)
                for i in range(4):
                    up, down = np.bincount(g, gap * x[i], minlength=gates), np.bincount(g, bend * x[i] ** 2, minlength=gates)
                    w[:, i] += RATE * up / (down * 2 + 20)
                heard += np.bincount(g, minlength=gates)
            sums[:, :4] += w * heard[:, None] / 1000
            sums[:, 4] += heard / 1000
        yield _sliced(np.rint(np.concatenate([sums.ravel(), hits.ravel() / 10])))

    n = gates * 5 + 2 * gates * STEPS
    out = _total(blocks.mapInArrow(run, "slice int, part int, payload binary"), _width(n))[:n].astype(float)
    sums = out[: gates * 5].reshape(gates, 5)
    weights = np.where(sums[:, 4:] > 0, sums[:, :4] / np.maximum(sums[:, 4:], 1e-9), 0.3)
    return weights, out[gates * 5 :].reshape(2, gates, STEPS) * 10


def _scores(group, bit, places, odds, gate, weights, refine):
    """log2 of the probability of each decision, n x d."""
    import numpy as np

    g = group * GATES + gate.take(places[2]).astype(np.int32)
    score = weights[:, 0].copy().take(g) * odds.take(places[0])
    for i in (1, 2, 3):
        score += weights[:, i].copy().take(g) * odds.take(places[i])
    better = refine.take(g * STEPS + _cell(score))
    p = np.float32(0.75) / (1 + np.exp(-np.clip(score, -20, 20))) + np.float32(0.25) * better
    p = np.clip(np.where(bit, p, 1 - p), np.float32(2.0**-18), np.float32(1 - 2.0**-18))
    return np.log(p) * np.float32(1 / np.log(2))


def _repeats(block: Block):
    """The share of a token's word among the tokens before it in its document."""
    import numpy as np

    first = np.repeat(np.append(0, np.cumsum(block.size))[:-1], block.size)
    place = np.arange(len(block.ids))
    order = np.argsort(block.doc * len(block.words) + block.ids, kind="stable")
    key = (block.doc * len(block.words) + block.ids)[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return rank / np.maximum(place - first, 1)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte: one row for each row of docs.

    Learns from the documents whose crc32(id as text) mod 7 is not 2. Tokens: the
    words between ASCII white space, A-Z lowered, and one end. Null texts are
    empty: an end alone. A null id is the empty text for the crc32. Repeated rows
    count and are scored as often as they stand there. Without any training
    document all counts are 0. An empty table gives no rows.
    """
    import numpy as np

    blocks = written(_blocks(docs, text, key), "lm-blocks")
    # The counts of a shard's words go back to all blocks by one shuffle.
    words = written(_word_counts(_block_words(blocks)), "lm-words")
    # Counts of each cell of class and hash: a table of fixed size.
    cells, totals = np.zeros((32, 1 << HASH_BITS)), words.where("block IS NULL")
    n_words = totals.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    for r in totals.select(F.inline(F.arrays_zip("cell", "sums"))).groupBy("cell").agg(F.sum("sums").alias("c")).collect():
        cells.ravel()[r["cell"]] = r["c"]
    n_train = int(cells.sum())
    back = words.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("found"))
    none = F.array().cast("array<binary>")
    joined = blocks.join(back.hint("merge"), "block", "left").select(*blocks.columns, F.coalesce("found.at", none).alias("at"), F.coalesce("found.c", none).alias("c"), F.lit(n_train).alias("n_train"))
    joined = written(joined, "lm-joined")
    drop_table(blocks)
    drop_table(words)
    counts = _counted(joined)
    weights, hits = _learned(joined, counts)
    refine = (hits[0] + 2) / (hits[1] + 4)
    middle = 1 / (1 + np.exp(-((np.arange(STEPS) + 0.5) / 2 - 6)))
    refine = np.where(hits[1] >= 100, refine, middle).astype(np.float32).ravel()
    odds, gate, weights = _stretch(counts[1].astype(np.float32), counts[0]).astype(np.float32), _bucket(counts.sum(0)), weights.astype(np.float32)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in _each(batches):
            c, at = b.count[b.ids], np.arange(len(b.ids))
            bits = np.zeros(len(at))
            for group, row, bit, places in _chunks(b, at, c):
                s = _scores(group, bit, places, odds, gate, weights, refine).sum(1, dtype=float)
                if group < 2:
                    bits[row] += s
                else:
                    tokens, where, word = row
                    bits[tokens] += np.bincount(word, s)[where]
            kinds = size_class(b.count)
            share = np.log2(np.maximum(b.count, 1) / np.maximum(cells[kinds, b.bits], 1))
            share[(kinds == 0) | (np.arange(len(kinds)) == 0)] = 0
            bits += share[b.ids]
            spelled = bits.copy()
            new = np.flatnonzero((c == 0) & (b.ids > 0))
            flat = -np.log2(n_train + 1.0 * (n_words + 1))
            bits[new] = np.logaddexp2(bits[new] + np.log2(1 - FLAT), flat + np.log2(FLAT))
            again = _repeats(b)
            for x in (bits, spelled):
                x += np.log2(1 - REPEAT) + np.logaddexp2(0, np.log2(np.maximum(again, 1e-300)) + np.log2(REPEAT / (1 - REPEAT)) - x)
            base = np.log10(b.count + 1.0) - np.log10(n_train + 1.0 * (n_words + 1))
            n = len(b.size)
            total = np.bincount(b.doc, bits, minlength=n)
            out = [pa.array(b.keys, pa.int64()), pa.array([held_out(k) for k in b.keys]), b.size.astype(np.int64), np.bincount(b.doc, c > 0, minlength=n).astype(np.int64), np.full(n, n_train, np.int64), np.bincount(b.doc, base[b.ids], minlength=n), total * np.log10(2.0), -np.bincount(b.doc, spelled, minlength=n) / np.maximum(b.nbytes, 1)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
