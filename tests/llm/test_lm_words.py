"""Word counts of the mixing model: rows of arrays, a shard at a time."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import lm_mixing
from tests.llm.helpers import documents


def test_word_counts_move_as_arrays(spark):
    texts = [" ".join(f"w{i % 3000 * 7 % (5000 + d)}" for i in range(d, 20_000, 3)) for d in range(8)]
    blocks = lm_mixing._blocks(documents(spark, texts).coalesce(1), "text", "doc_id").cache()
    rows = lm_mixing._block_words(blocks)
    assert rows.count() <= lm_mixing.WORD_SHARDS * blocks.count() < sum(len(lm_mixing._unpacked(r["words"]).split(b" ")) for r in blocks.collect())
    want = Counter(w for d, t in enumerate(texts) if not lm_mixing.held_out(d) for w in [*t.encode().split(), b""])
    found = lm_mixing._word_counts(rows).collect()
    words, got = {r["block"]: lm_mixing._unpacked(r["words"]).split(b" ") for r in blocks.collect()}, {}
    for r in found:
        if r["block"] is not None:
            at, c = np.frombuffer(r["at"], "<i4"), np.frombuffer(r["c"], "<i8")
            got |= {words[r["block"]][i]: n for i, n in zip(at.tolist(), c.tolist(), strict=True)}
    assert got == want
    totals = [r for r in found if r["block"] is None]
    assert sum(r["n_words"] for r in totals) == len(want) and sum(sum(r["sums"]) for r in totals) == sum(want.values())
    assert lm_mixing._word_counts(rows.where(F.lit(False))).count() == 0
