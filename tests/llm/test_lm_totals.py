"""Sums of the mixing model's count tables."""

import numpy as np

from ledgerloom.llm import lm_mixing


def test_totals_beyond_32_bits(spark):
    def run(batches):
        for _ in batches:
            pass
        yield lm_mixing._sliced(np.array([2_000_000_000, 3, 0]))

    parts = spark.range(4, numPartitions=4).mapInArrow(run, "slice int, part int, payload binary")
    assert lm_mixing._total(parts, lm_mixing._width(3))[:3].tolist() == [8_000_000_000, 12, 0]
