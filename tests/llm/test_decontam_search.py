"""The latent search against all windows and items in plain Python, with paraphrases."""

import random

from ledgerloom.llm import decontam
from tests.llm.helpers import documents, words


def plain_found(texts, items):
    half, out = decontam.PASSAGE // 2, set()
    for i, t in enumerate(texts):
        w = decontam.words_of(t or "")
        for j, item in enumerate(items):
            x = decontam.words_of(item)
            for p in range(-(-len(w) // half)):
                for q in range(-(-len(x) // decontam.PASSAGE)):
                    a, b = decontam.region(x, q, p)
                    end = x[-max(1, len(x) // 4) :]
                    if decontam.common_length(x, w[a:b]) >= decontam.MATCH * len(x) and decontam.common_length(end, w[a:b]) >= decontam.ANSWER * len(end):
                        out.add((i, j))
    return out


def test_search_finds_what_all_comparisons_find(spark):
    rng = random.Random(12)
    # Pairs of words that mean the same and stand in the same company: the items have
    # the first of each pair only, the documents either.
    other = lambda w: [x + "syn" if rng.random() < 0.5 else x for x in w]
    items = [words(rng, rng.randrange(16, 58), 300) for _ in range(60)] + [words(rng, 300, 300)]
    texts = [other(words(rng, rng.randrange(1, 400), 300)) for _ in range(240)]
    for i in range(0, 240, 3):
        item = list(items[i // 3 % 61])
        for k in rng.sample(range(len(item)), len(item) * (i % 4) // 13):
            item[k] += "syn" if k % 2 else "else"
        at = rng.randrange(len(texts[i]) + 1)
        texts[i][at:at] = item
    texts, items = [" ".join(x) for x in texts] + ["", None, "x " * 90_000], [" ".join(x) for x in items]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    docs = documents(spark, texts).withColumnRenamed("lang", "same").withColumnRenamed("source", "bad_id")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    want = plain_found(texts[:-1], items)
    assert len(want) >= 75 and got <= want and len(want - got) <= len(want) // 50
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}


def test_texts_that_share_an_id_and_nothing(spark):
    item = " ".join(words(random.Random(1), 40, 3000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, ["quite clean", f"so {item} on", f"so {item} on", None], ids=[4, 4, 4, None])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontam.drop_contaminated(docs, bench).collect()) == [(0, ""), (4, "quite clean")]
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 4 and decontam.contaminated(docs.limit(0), bench).count() == 0
