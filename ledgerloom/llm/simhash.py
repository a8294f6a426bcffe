"""SimHash near-duplicates, candidates by the generalised pigeonhole principle.

Fingerprints that differ in at most R bits, cut into m partitions with thresholds
t_i that sum to R - m + 1, differ in at most t_i bits of some partition i (a
threshold of -1 leaves a partition out). Correlated bits are put into the same
partition, which keeps the partitions unlike each other; the thresholds, and m
itself, are those of the least estimated work, found by dynamic programming over
candidate counts estimated from histograms of all distinct fingerprints.
Candidates are probed by an equi-join on (partition, value) and verified there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import text_of, written

WORDS, SEED, RADIUS, GROUP = 3, 42, 3, 8
#: Of a probe row and of a compared pair, in the same unit.
PROBE_COST, PAIR_COST = 1.0, 0.05


def fingerprint_of(text: str, words: int = WORDS) -> int:
    """Bits that are set in over half the XXH64 of the word shingles (A-Z lowered,
    words parted by ASCII white space; fewer words: one shingle; none: zero)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    starts = [0]
    for w in parts:
        starts.append(starts[-1] + len(w) + 1)
    ends = starts[words:] if len(parts) >= words else starts[-1:]
    return print_of(np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)], "<u8"))


def print_of(h) -> int:
    """Bits that are set in over half of an array of 64-bit hashes."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts are empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = [fingerprint_of(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x - (x >> 63 << 64) for x in fp], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text)).mapInArrow(run, "doc_id long, fp long")


def _summed(fps: DataFrame, shape: tuple[int, int], count) -> object:
    """The sum over all rows of count(array of fingerprints), a small fixed matrix:
    tasks send their own sums, Spark adds them, and shape[0] * shape[1] numbers
    come to the driver."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(shape, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["at", "n"])

    out = np.zeros(shape[0] * shape[1], np.int64)
    for r in fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(shape)


def correlated_groups(fps: DataFrame) -> list[list[int]]:
    """Groups of GROUP bits, each begun by the bit of the strongest tie left and
    filled with the bits that correlate most with it."""
    import numpy as np

    def count(x):
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
        return np.rint(bits.T @ bits).astype(np.int64)

    c = _summed(fps, (65, 65), count).astype(float)
    n = max(c[64, 64], 1)
    mean = c[64, :64] / n
    cov = c[:64, :64] / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tie = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(tie, 0)
    left, groups = list(range(64)), []
    while left:
        sub = tie[np.ix_(left, left)]
        group = [left[int(sub.max(1).argmax())]]
        left.remove(group[0])
        while len(group) < GROUP:
            best = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _distances(hist) -> list:
    """For each group of bits, how likely two fingerprints differ there in d bits."""
    import numpy as np

    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    out = []
    for h in hist:
        p = h / max(h.sum(), 1)
        joint = np.outer(p, p)
        out.append(np.array([joint[apart == d].sum() for d in range(GROUP + 1)]))
    return out


def allocate(partitions: list[list[int]], near: list, n: int, radius: int) -> tuple[float, list[int]]:
    """The thresholds of the least work, by dynamic programming over the partitions
    and the threshold still to give: work[i][t] is what partition i costs at t."""
    import math

    import numpy as np

    work = []
    for groups in partitions:
        dist = np.ones(1)
        for g in groups:
            dist = np.convolve(dist, near[g])
        width = GROUP * len(groups)
        work.append([0.0] + [n * sum(math.comb(width, e) for e in range(t + 1)) * PROBE_COST + n * n / 2 * float(dist[: t + 1].sum()) * PAIR_COST for t in range(radius + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in work:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, w in enumerate(row, -1):
                if used + t + 1 <= radius + 1 and (used + t + 1 not in step or c + w < step[used + t + 1][0]):
                    step[used + t + 1] = (c + w, [*ts, t])
        best = step
    return best[radius + 1]


def plan(fps: DataFrame, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """Bit partitions and their thresholds for these distinct fingerprints."""
    import numpy as np

    groups = correlated_groups(fps)

    def count(x):
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return np.stack([np.bincount(np.packbits(bits[:, g], axis=1, bitorder="little")[:, 0], minlength=256) for g in groups])

    hist = _summed(fps, (len(groups), 256), count)
    near, n = _distances(hist), int(hist[0].sum())
    options = []
    for m in range(2, radius + 2):
        sizes = [len(range(i, len(groups), m)) for i in range(m)]
        ends = np.cumsum(sizes)
        parts = [list(range(b - a, b)) for a, b in zip(sizes, ends, strict=True)]
        options.append((*allocate(parts, near, n, radius), parts))
    _, thresholds, parts = min(options, key=lambda x: x[0])
    return [sorted(b for g in p for b in groups[g]) for p in parts], thresholds


def _projection(fp: Column, bits: list[int]) -> Column:
    """The masked fingerprint: no need to move the bits together."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u < v: every pair of distinct fingerprints at radius or fewer bits.
    Each is among at most sum(C(64, d)) others, whatever the number of documents."""
    partitions, thresholds = plan(fps, radius)
    found = None
    for i, (bits, t) in enumerate(zip(partitions, thresholds, strict=True)):
        if t < 0:
            continue
        masks = [sum(1 << b for b in s) for e in range(t + 1) for s in combinations(bits, e)]
        flips = F.array(*[F.lit(m - (m >> 63 << 64)).cast("long") for m in masks])
        index = fps.select(F.col("fp").alias("v"), _projection(F.col("fp"), bits).alias("at"), F.lit(i).alias("part"))
        probe = fps.select(F.col("fp").alias("u"), _projection(F.col("fp"), bits).alias("own"), F.lit(i).alias("part"))
        probe = probe.select("u", "part", F.explode(flips).alias("flip"), "own").select("u", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("at"))
        index, probe = (index, probe) if found is None else (found[0].unionAll(index), found[1].unionAll(probe))
        found = (index, probe)
    index, probe = found
    met = (probe["part"] == index["part"]) & (probe["at"] == index["at"]) & (probe["u"] < index["v"]) & (F.bit_count(probe["u"].bitwiseXOR(index["v"])) <= radius)
    return probe.join(index.hint("merge"), met).select("u", "v").distinct()


def class_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u < v: of nodes (node, fp), each with the least node of its class, the nodes
    that links of at most radius differing bits join. One pair a node at most."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    roots = components(links(prints.select("fp"), radius))
    named = written(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "named")
    firsts = named.groupBy("root").agg(F.min("least").alias("first"))
    met = nodes.select("node", "fp").join(named.join(firsts, "root").select("fp", "first").hint("merge"), "fp").where("node <> first")
    return met.select(F.least("node", "first").alias("u"), F.greatest("node", "first").alias("v"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs; component_id is the
    least doc_id reachable over links of at most radius differing bits.

    Equal fingerprints are one node, so copies cost no pairs. Null and empty texts
    have the fingerprint zero and link like any other. Rows with a null id take
    part; a component of null ids only has a null component_id. Repeated rows give
    repeated rows; an empty table gives none.
    """
    fps = written(fingerprints(docs, words, text, key), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = written(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")
