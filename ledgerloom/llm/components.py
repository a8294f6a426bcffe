"""Connected components of a link table by alternating large and small stars.

Every round is two groupings; a node's neighbours are never gathered, as the
least neighbour comes from an aggregate that is joined back. Each round's links
are a table in the shared folder, so that lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop_table, written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the least of u and its neighbours."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, goes to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def find_roots(pairs) -> dict[int, int]:
    """Union-find: the root of every node of pairs that is not its own root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def forest(links: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(u, v) with the same components: each task joins its links by union-find, a block
    of them at a time, and keeps a link to the root for each node."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[int, int]] = []

        def joined():
            found = find_roots(held)
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["u", "v"])

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= block:
                yield joined()
                held = []
        if held:
            yield joined()

    return links.where("u <> v").select("u", "v").mapInArrow(run, "u long, v long")


def _print(links: DataFrame) -> tuple:
    """Number and hashes of the rows of a table without repeated rows: equal for equal
    tables, and for others with a chance of about one in 2**64 only."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u", F.lit(7)))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for every node that has a link to another node, the
    least node that it reaches. links: two columns u and v of one ordered type;
    loops and repeats are allowed, rows with a null end are left out."""
    now = written(links.where("u <> v").select("u", "v").distinct(), "links")
    before = _print(now)
    for _ in range(rounds):
        new = written(_small_star(_large_star(now).distinct()), "links")
        after = _print(new)
        drop_table(now)
        now = new
        # Stars only: every v is a root, and nothing moved.
        if before == after:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
