"""Alignment of two tokenizers over the same bytes, with corpus-wide pair counts.

Token A and token B are linked where their byte ranges overlap; places where tokens of
both end cut a text into groups. A first pass counts each task's links by pair of ids.
The distinct pairs of a shard (of B ids) get a minimal perfect hash, and the tasks'
counts become dense vectors indexed by it, which are added up FAN at a time in as many
levels as tasks ask for. The first pass keeps the documents' ids as well, so that no text
is encoded twice: the second aligns them again and looks the counts up; the key that is
kept at a number tells whether it is the pair's own.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop_memories, drop_table, open_for_read, open_for_write, scratch, text_of, written

#: Shards of B ids, counts that meet in a task, distinct pairs that a task holds before it
#: passes them on, bytes of tables that a worker keeps, and bytes of groups in a batch.
SHARDS, FAN, HELD, KEPT, BATCH = 64, 16, 2_000_000, 100_000_000, 4_000_000
#: Bytes of texts that are aligned at once.
PART = 1_000_000
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


@lru_cache(4)
def _digits(size: int):
    """For each id below size its decimal digits as bytes, zeros before them."""
    import numpy as np

    width = len(str(max(size - 1, 1)))
    n = np.arange(size)[:, None]
    powers = 10 ** np.arange(width - 1, -1, -1)
    out = (n // powers % 10 + ord("0")).astype(np.uint8)
    out[(n < powers) & (powers > 1)] = 0
    return out


@lru_cache(4)
def _lengths(a_path: str, b_path: str):
    """The number of bytes of every token of A and of B."""
    import numpy as np

    from ledgerloom.llm.piece_tokens import piece_encoder
    from ledgerloom.llm.tokens import encoder

    a = encoder(a_path, special=False)
    names = [a.tokenizer.id_to_token(i) or "" for i in range(a.size)]
    return np.array([len(x) for x in names], np.int64), np.array([len(x) for x in piece_encoder(b_path).bytes_of], np.int64)


class Aligned:
    """Texts' tokens over their bytes: a_ids, b_ids (flat), size[a text's bytes, 0 if it has
    no tokens]; links are (keys, link_ends), pairs as a << 32 | b."""

    def __init__(self, a_ids, b_ids, a_bytes, b_bytes, sizes):
        import numpy as np

        self.a, self.b = a_ids, b_ids
        self.a_ends, self.b_ends = np.cumsum(a_bytes), np.cumsum(b_bytes)
        stops, total = np.append(0, np.cumsum(sizes)), int(np.sum(sizes))
        at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        at_a[self.a_ends], at_b[self.b_ends] = True, True
        count = lambda x: np.cumsum(x, dtype=np.int32 if total < 2**31 else np.int64)
        self.till_a, self.till_b, self.both = count(at_a), count(at_b), at_a & at_b
        self.till_group, cuts = count(self.both), np.flatnonzero(at_a | at_b)
        # Between two cuts lie one token of A and one of B, and each overlap just once.
        self.keys = a_ids[self.till_a[cuts - 1]].astype(np.uint64) << np.uint64(32) | b_ids[self.till_b[cuts - 1]]
        self.link_ends = np.searchsorted(cuts, stops, side="right")
        self.stops = stops
        self.counts = [np.diff(x[stops]) for x in (self.till_a, self.till_b, self.till_group)] + [np.diff(self.link_ends)]

    def groups(self, a_size: int, b_size: int) -> list[bytes]:
        """Each text's groups: a1,a2|b1;a3|b2,b3 in decimal ids; empty without tokens."""
        import numpy as np

        ends = np.append(0, np.flatnonzero(self.both))
        of_a, of_b = self.till_group[self.a_ends - 1], self.till_group[self.b_ends - 1]
        place_a = np.arange(len(self.a)) + self.till_b[ends[of_a]]
        place_b = np.arange(len(self.b)) + self.till_a[ends[of_b + 1]]
        digits_a, digits_b = _digits(a_size), _digits(b_size)
        width = max(digits_a.shape[1], digits_b.shape[1])
        cells = np.zeros((len(self.a) + len(self.b), width + 1), np.uint8)
        cells[place_a, : digits_a.shape[1]], cells[place_b, : digits_b.shape[1]] = digits_a[self.a], digits_b[self.b]
        cells[place_a, width] = np.where(self.both[self.a_ends], ord("|"), ord(","))
        cells[place_b, width] = np.where(self.both[self.b_ends], ord(";"), ord(","))
        shown = cells != 0
        size = np.append(0, np.cumsum(shown.sum(1)))
        raw = cells[shown].tobytes()
        at = size[self.till_a[self.stops] + self.till_b[self.stops]].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def encoded(texts, a_path: str, b_path: str) -> Iterator[tuple]:
    """For slices of an Arrow array of strings without nulls: the first row, the row after
    the last, the ids of A and of B (flat), how many of each a text has, and its bytes with
    the space before it. Texts that are empty, or whose tokens do not give those bytes, have
    no tokens and no bytes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from ledgerloom.llm.piece_tokens import piece_encoder
    from ledgerloom.llm.tokens import encoder

    a, b = encoder(a_path, special=False), piece_encoder(b_path)
    a_length, _ = _lengths(a_path, b_path)
    spaced = pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" "))
    for k, a_ids, a_ends in a.slices(spaced):
        stop = k + len(a_ends) - 1
        own = texts.slice(k, stop - k)
        b_ids, b_count, good = b.of(own)
        size = pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
        a_count, good = np.diff(a_ends), good & (size > 0)
        held = np.append(0, np.cumsum(a_length[a_ids]))
        good &= held[a_ends[1:]] - held[a_ends[:-1]] == size + 1
        if not a.cuts:
            good &= [not g or a.tokenizer.decode(a_ids[x:y].tolist(), skip_special_tokens=False) == f" {t}" for g, x, y, t in zip(good, a_ends[:-1], a_ends[1:], own.to_pylist(), strict=True)]
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, a_count)], b_ids[np.repeat(good, b_count)]
        yield k, stop, a_ids, b_ids, np.where(good, a_count, 0), np.where(good, b_count, 0), np.where(good, size + 1, 0)


def aligned(texts, a_path: str, b_path: str) -> Iterator[tuple[int, int, Aligned]]:
    """For slices of an Arrow array of strings without nulls: the first row, the row after
    the last, and the alignment of a space and the text. Texts that encoded() gives no
    tokens have none."""
    for k, _, *ids in encoded(texts, a_path, b_path):
        for begin, end, found in aligned_ids(*ids, a_path, b_path):
            yield k + begin, k + end, found


def aligned_ids(a_ids, b_ids, a_count, b_count, size, a_path: str, b_path: str) -> Iterator[tuple[int, int, Aligned]]:
    """For runs of about PART bytes of texts that are given as by encoded(): the first text,
    the text after the last, and the alignment."""
    import numpy as np

    a_length, b_length = _lengths(a_path, b_path)
    a_at, b_at, till = (np.append(0, np.cumsum(x)) for x in (a_count, b_count, size))
    begin = 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(till, till[begin] + PART)) - 1)
        own_a, own_b = a_ids[a_at[begin] : a_at[end]], b_ids[b_at[begin] : b_at[end]]
        yield begin, end, Aligned(own_a, own_b, a_length[own_a], b_length[own_b], size[begin:end])
        begin = end


def _shard_of(keys):
    import numpy as np

    b = keys & np.uint64(0xFFFFFFFF)
    return ((b * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(SHARDS)


def _merged(keys, counts):
    """Distinct keys in order, with the sums of their counts."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _kind(size: int) -> str:
    """The type of a table's ids below size."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _ids_of(column, kind: str):
    """The ids of an Arrow column of binaries (flat), and how many each has."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    flat = np.frombuffer(column.buffers()[2], kind) if ends[-1] else np.zeros(0, kind)
    return flat[ends[0] : ends[-1]], np.diff(ends)


def _counted(docs: DataFrame, a_path: str, b_path: str, text: str, key: Column) -> DataFrame:
    """Rows of two kinds. (doc_id, size, a, b): each document's bytes with the space before
    them and its ids, 0 and empty without tokens. (shard, part, keys, counts): each task's
    links by pair of ids. A row's other columns are null."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), [], 0

        def passed_on(held):
            keys, counts = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            shard = _shard_of(keys)
            order = np.argsort(shard, kind="stable")
            keys, counts, ends = keys[order], counts[order], np.searchsorted(shard[order], np.arange(SHARDS + 1))
            own = [s for s in range(SHARDS) if ends[s] < ends[s + 1]]
            raw = [[x[ends[s] : ends[s + 1]].tobytes() for s in own] for x in (keys, counts)]
            return row(len(own), shard=pa.array(own, pa.int32()), part=pa.array([part] * len(own), pa.int64()), keys=pa.array(raw[0], pa.binary()), counts=pa.array(raw[1], pa.binary()))

        def row(n, **columns):
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in types.items()], list(types))

        def blob(ids, count, kind):
            ends = np.append(0, np.cumsum(count)) * np.dtype(kind).itemsize
            raw = pa.py_buffer(ids.astype(kind).tobytes())
            return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), raw]).cast(pa.binary())

        types = {"doc_id": pa.int64(), "size": pa.int64(), "a": pa.binary(), "b": pa.binary(), "shard": pa.int32(), "part": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
        kinds = [_kind(len(x)) for x in _lengths(a_path, b_path)]
        for batch in batches:
            for k, _, *ids in encoded(batch.column(1), a_path, b_path):
                for begin, end, found in aligned_ids(*ids, a_path, b_path):
                    if len(found.keys):
                        held.append(np.unique(found.keys, return_counts=True))
                        size += len(held[-1][0])
                    if size >= HELD:
                        held = [_merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                        size = len(held[0][0])
                        if size >= HELD // 2:
                            yield passed_on(held)
                            held, size = [], 0
                    n = slice(begin, end)
                    yield row(end - begin, doc_id=batch.column(0).slice(k + begin, end - begin), size=pa.array(ids[4][n]), a=blob(found.a, ids[2][n], kinds[0]), b=blob(found.b, ids[3][n], kinds[1]))
        if held:
            yield passed_on(held)

    rows = docs.select(key.cast("long").alias("doc_id"), text_of(text))
    return rows.mapInArrow(run, "doc_id long, size long, a binary, b binary, shard int, part long, keys binary, counts binary")


def _runs(batches: Iterator, *names: str) -> Iterator:
    """(values of names, iterator of rows) for each run of rows that have equal ones."""
    from itertools import groupby

    rows = (dict(zip(batch.schema.names, (x[i] for x in batch.columns), strict=True)) for batch in batches for i in range(batch.num_rows))
    return groupby(rows, lambda r: tuple(r[c].as_py() for c in names))


def _hashed(parts: DataFrame, folder: str) -> DataFrame:
    """(shard, n, path): a file for each shard with the hash of its distinct pairs and, in
    the hash's order, their keys. A task holds one shard's keys."""

    def run(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa

        from ledgerloom.llm.pair_hash import PairHash

        for (shard,), rows in _runs(batches, "shard"):
            keys, more, size = np.zeros(0, np.uint64), [], 0
            for r in rows:
                more.append(np.frombuffer(r["keys"].as_buffer(), np.uint64))
                size += len(more[-1])
                if size > max(len(keys), 1 << 18):
                    keys, more, size = np.unique(np.concatenate([keys, *more])), [], 0
            keys = np.unique(np.concatenate([keys, *more]))
            own = PairHash.of(keys)
            kept = np.empty_like(keys)
            kept[own.index(keys)] = keys
            # A new name for each attempt: only the one whose row arrives is read.
            path = f"{folder}/hash-{shard}-{uuid.uuid4().hex}"
            _save(path, {"sizes": own.sizes}, own.words, kept)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([path])], ["shard", "n", "path"])

    rows = parts.select("shard", "keys").repartition(SHARDS, "shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, "shard int, n long, path string")


def _save(path: str, head: dict, *arrays) -> None:
    """A file of a JSON head, with the arrays' lengths, and the arrays as they are."""
    raw = json.dumps(head | {"lengths": [int(x.nbytes) for x in arrays]}).encode()
    with open_for_write(path) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for x in arrays:
            out.write(x.tobytes())


def _load(path: str) -> tuple[dict, list[bytes]]:
    with open_for_read(path) as f:
        head = json.loads(f.read(int.from_bytes(f.read(8), "little")))
        return head, [f.read(n) for n in head["lengths"]]


class Pairs:
    """A shard's hash and keys, and once they are added up its counts, with whether a
    pair's count is the highest of its B id."""

    def __init__(self, path: str, counts: str | None = None):
        import numpy as np

        from ledgerloom.llm.pair_hash import PairHash

        head, (words, keys) = _load(path)
        self.hash, self.keys = PairHash(head["sizes"], np.frombuffer(words, np.uint64)), np.frombuffer(keys, np.uint64)
        if counts is not None:
            _, (n, best) = _load(counts)
            self.counts, self.best = np.frombuffer(n, np.int64), np.frombuffer(best, bool)
        self.nbytes = 40 * len(self.keys)

    def index(self, keys):
        """The place of each key, all of which have to be the shard's."""
        import numpy as np

        at = self.hash.index(keys)
        if len(keys) and (at.min() < 0 or not np.array_equal(self.keys[at], keys)):
            raise ValueError("a pair of ids that the first pass did not meet: the documents have changed")
        return at


class _Kept:
    """The shards that a worker used last, up to KEPT bytes of them."""

    def __init__(self, paths: dict[int, tuple]):
        self.paths, self.held = paths, OrderedDict()

    def __getitem__(self, shard: int) -> Pairs:
        if shard not in self.held:
            self.held[shard] = Pairs(*self.paths[shard])
            while len(self.held) > 1 and sum(x.nbytes for x in self.held.values()) > KEPT:
                self.held.popitem(last=False)
        self.held.move_to_end(shard)
        return self.held[shard]


def _summed(parts: DataFrame, hashes: dict[int, tuple], folder: str) -> DataFrame:
    """(shard, path): each shard's counts, added up as dense vectors in a tree, and which
    are the highest of their B id."""
    import numpy as np

    def add(sparse: bool, last: bool):
        def run(batches: Iterator) -> Iterator:
            import uuid

            import pyarrow as pa

            kept = _Kept(hashes)
            for (shard, part), rows in _runs(batches, "shard", "part"):
                total = np.zeros(len(kept[shard].keys), np.int64)
                for r in rows:
                    counts = np.frombuffer(r["counts"].as_buffer(), np.int64)
                    if sparse:
                        total[kept[shard].index(np.frombuffer(r["keys"].as_buffer(), np.uint64))] += counts
                    else:
                        total += counts
                if not last:
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["shard", "part", "counts"])
                    continue
                _, of = np.unique(kept[shard].keys & np.uint64(0xFFFFFFFF), return_inverse=True)
                most = np.zeros(of.max() + 1, np.int64)
                np.maximum.at(most, of, total)
                path = f"{folder}/counts-{shard}-{uuid.uuid4().hex}"
                _save(path, {}, total, total == most[of])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path])], ["shard", "path"])

        return run

    left, sparse = (parts.agg(F.max("part")).first()[0] or 0) + 1, True
    while True:
        left = -(-left // FAN)
        rows = parts.withColumn("part", F.floor(F.col("part") / FAN)).repartition(min(SHARDS * left, 4096), "shard", "part").sortWithinPartitions("shard", "part")
        if left == 1:
            return rows.mapInArrow(add(sparse, True), "shard int, path string")
        parts, sparse = written(rows.mapInArrow(add(sparse, False), "shard int, part long, counts binary"), "pair-sums"), False


def pair_tables(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> dict[int, tuple]:
    """The counts of all pairs of ids that are linked in docs: for each shard the files of
    its hash and its counts, in the folder that all executors share."""
    coded = written(_counted(docs, a_path, b_path, text, F.lit(None)), "token-pairs")
    tables = _tables(coded)
    drop_table(coded)
    return tables


def _tables(coded: DataFrame) -> dict[int, tuple]:
    """pair_tables() of the rows that _counted() gave."""
    folder, parts = scratch(coded.sparkSession, "pairs"), coded.where("shard IS NOT NULL").select("shard", "part", "keys", "counts")
    hashes = {r["shard"]: (r["path"],) for r in _hashed(parts, folder).collect()}
    counts = _summed(parts, hashes, folder).collect()
    return {r["shard"]: (*hashes[r["shard"]], r["path"]) for r in counts}


def pair_counts(docs: DataFrame, tables: dict[int, tuple]) -> DataFrame:
    """(a_id, b_id, n, best) of pair_tables(): a row for each pair of ids."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for shard in batch.column(0).to_pylist():
                own = Pairs(*tables[shard])
                a, b = (own.keys >> np.uint64(32)).astype(np.int64), (own.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(own.counts), pa.array(own.best)], ["a_id", "b_id", "n", "best"])

    shards = docs.sparkSession.createDataFrame([(s,) for s in sorted(tables)], "shard int").repartition(SHARDS, "shard")
    return shards.mapInArrow(run, "a_id long, b_id long, n long, best boolean")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): a row for each row
    of docs. a_path: a file of the tokenizers library, which encodes a space and the text;
    b_path: one of sentencepiece, which adds the space itself; strings of special tokens
    are plain text for both. n_best: links whose pair's count over all of docs is the
    highest of its B id, ties included; count_sum: the counts summed over the links;
    groups: the ids, "a1,a2|b1;a3|b2,b3".

    Null and empty texts, and those whose tokens do not give the text's own bytes, have no
    tokens: zeros, and empty groups. Texts are whole, however long. Repeated rows count and
    are returned as often as they stand; null ids stay null; other columns, whatever their
    names, are not read; an empty table gives no rows."""
    coded = written(_counted(docs, a_path, b_path, text, F.col(key)), "token-pairs")
    tables = _tables(coded)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        drop_memories()  # words that this worker encoded before: nothing is encoded here
        kept = _Kept(tables)
        kinds = [_kind(len(x)) for x in _lengths(a_path, b_path)]
        for batch in batches:
            ids, counts = zip(*(_ids_of(x, kind) for x, kind in zip(batch.columns[2:], kinds, strict=True)), strict=True)
            for k, _, found in aligned_ids(*ids, *counts, batch.column(1).to_numpy(), a_path, b_path):
                keys, of = np.unique(found.keys, return_inverse=True)
                shard, counts, best = _shard_of(keys), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(SHARDS + 1))
                for s in np.unique(shard).tolist():
                    mine = order[ends[s] : ends[s + 1]]
                    at = kept[s].index(keys[mine])
                    counts[mine], best[mine] = kept[s].counts[at], kept[s].best[at]
                ups = [np.append(0, np.cumsum(x[of], dtype=np.int64))[found.link_ends] for x in (best, counts)]
                columns = [*found.counts, *(np.diff(x) for x in ups)]
                a_length, b_length = _lengths(a_path, b_path)
                groups = found.groups(len(a_length), len(b_length))
                begin, size = 0, 0
                for i, g in enumerate(groups, 1):
                    size += len(g)
                    if size >= BATCH or i == len(groups):
                        own = [pa.array(x[begin:i].astype(np.int64)) for x in columns]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(k + begin, i - begin), *own, pa.array(groups[begin:i], pa.binary()).cast(pa.string())], ["doc_id", *COUNTS, "n_best", "count_sum", "groups"])
                        begin, size = i, 0

    rows = coded.where("shard IS NULL").select("doc_id", "size", "a", "b")
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups string")


def groups_digest(groups: str = "groups") -> Column:
    """SHA-256 of the groups; empty ones stay empty."""
    return F.when(F.col(groups) == "", F.lit("")).otherwise(F.sha2(F.col(groups).cast("binary"), 256))
