"""Benchmark items that leak often, and items of frequent words only."""

import random

from ledgerloom.llm import decontam
from tests.llm.helpers import documents, words


def test_frequent_items_are_found(spark):
    rng = random.Random(8)
    common = [f"of{i}" for i in range(40)]
    items = [" ".join(words(rng, 30, 3000)) for _ in range(10)] + [" ".join(rng.sample(common, 25))]
    texts, want = [], set()
    for i in range(150):
        w = [x for y in words(rng, rng.randrange(100, 300), 3000) for x in (y, rng.choice(common))]
        for j, leaks in ((0, i % 3 == 0), (10, i % 25 == 1), (1 + i % 9, i % 10 == 2)):
            if leaks:
                at = rng.randrange(len(w))
                w[at:at] = items[j].split()
                want.add((i, j))
        texts.append(" ".join(w))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents(spark, texts), bench).collect()}
    # A leak put inside another one cuts it in two.
    assert got <= want and len(want - got) <= 1 and {x for x in want if x[1] == 10} <= got
