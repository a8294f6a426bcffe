"""Global row numbers without one task for all rows, and shuffles of them by arithmetic."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import written

ROUNDS, PRIME = 24, 2_147_483_647


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "row") -> tuple[DataFrame, int]:
    """rows with their place from 0 in the order, and how many there are. The order has to
    tell all rows apart. Rows go to ranges of the order, each is numbered in its task, and
    the ranges' counts (one number for each, which come to the driver) give the offsets."""
    keys = [F.col(x) if isinstance(x, str) else x for x in order]
    part = f"_{name}_part"
    dealt = written(rows.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    counts = {r[part]: r["count"] for r in dealt.groupBy(part).count().collect()}
    parts = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    offsets = F.array(*[F.lit(x).cast("long") for x in [0, *accumulate(parts)]])
    place = F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1 + F.element_at(offsets, F.col(part) + 1)
    return dealt.withColumn(name, place.cast("long")).drop(part), sum(parts)


def round_keys(n: int, seed: int, epoch: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    """For each round a number below n and three below PRIME, from seed and epoch."""
    out = []
    for k in range(rounds):
        h = hashlib.sha256(f"{seed}:{epoch}:{k}".encode()).digest()
        x = [int.from_bytes(h[i : i + 8], "big") for i in (0, 8, 16, 24)]
        out.append((x[0] % max(n, 1), *(1 + y % (PRIME - 1) for y in x[1:])))
    return out


def _coin(m, a, b, c):
    """A bit of a number by keyed arithmetic that every engine computes alike."""
    return (m % PRIME * a + m // PRIME * b + c) % PRIME % 2


def permuted(row: Column | str, n: int, seed: int, epoch: int) -> Column:
    """Where a row below n stands in the epoch's shuffle: a permutation of 0 to n - 1. In
    each round a number and its mirror image change places or do not, by a coin that both
    share; taking the rounds backwards undoes it."""
    keys = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(k, "kabc", strict=True)]) for k in round_keys(n, seed, epoch)])

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(r["k"] - x, F.lit(n).cast("long"))
        m = F.greatest(x, mirror)
        coin = (m % PRIME * r["a"] + F.floor(m / PRIME) * r["b"] + r["c"]) % PRIME % 2
        return F.when(coin == 1, mirror).otherwise(x)

    return F.aggregate(keys, (F.col(row) if isinstance(row, str) else row).cast("long"), swap)


def rows_of_batch(batch: int, size: int, n: int, seed: int, epoch: int) -> list[int]:
    """The row numbers of an epoch's batch, in its order, by arithmetic alone."""
    out = []
    for x in range(batch * size, min(n, batch * size + size)):
        for k, a, b, c in reversed(round_keys(n, seed, epoch)):
            mirror = (k - x) % n
            x = mirror if _coin(max(x, mirror), a, b, c) else x
        out.append(x)
    return out


def epoch_batches(numbered_rows: DataFrame, n: int, seed: int, epoch: int, size: int, row: str = "row") -> DataFrame:
    """Rows with their batch and place in it for an epoch: exact batches of `size` over the
    whole table, the same however it is partitioned; nothing is shuffled or sorted."""
    at = permuted(row, n, seed, epoch)
    return numbered_rows.withColumn("_at", at).withColumns({"batch_id": F.floor(F.col("_at") / size).cast("long"), "slot": F.col("_at") % size}).drop("_at")


def read_batch(numbered_rows: DataFrame, batch: int, size: int, n: int, seed: int, epoch: int, row: str = "row") -> DataFrame:
    """One batch of an epoch, found again without the others: a filter on row numbers,
    which a table that is sorted by them answers from few row groups."""
    places = rows_of_batch(batch, size, n, seed, epoch)
    slot = F.array_position(F.array(*[F.lit(x).cast("long") for x in places]), F.col(row)) - 1 if places else F.lit(None).cast("long")
    return numbered_rows.where(F.col(row).isin(places)).withColumns({"batch_id": F.lit(batch).cast("long"), "slot": slot})
