"""Near-duplicates of the pipeline against all pairs in plain Python."""

import random

import corpus_pipeline
from ledgerloom.llm import near_dedup
from tests.llm.helpers import documents, words


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(texts):
    own, root = [sets(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for i in range(len(own)) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return set(root)


def changed(rng, text, n):
    w = text.split()
    for i in rng.sample(range(0, len(w), 5), n):
        w[i] = f"changed{rng.randrange(10**6)}"
    return " ".join(w)


def test_stage_drops_near_copies_down_to_0_8(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(120, 300), 4000)) for _ in range(40)]
    texts += [changed(rng, t, n) for t in texts[:20] for n in (1, 2, 3, 4, 7)]
    for _ in range(30):  # a chain, and a group of copies of one text
        texts.append(changed(rng, texts[-1], 2))
    texts += [changed(rng, texts[30], 2) for _ in range(60)]
    texts += ["", None, "a b", "A  b", "a b c"]
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, documents(spark, texts), "").collect()}
    assert got == plain_kept(texts)


def test_stage_of_nothing(spark):
    docs = documents(spark, ["a b c d", "a b c d", "q"], ids=[5, 5, None])
    assert sorted(r["text"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()) == ["a b c d", "q"]
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_texts_that_share_an_id(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, 100, 4000)) for _ in range(3))
    texts, ids = [a, b, b, changed(rng, b, 1), c.upper(), c, c], [5, 5, 5, 7, 8, 8, 9]
    docs = documents(spark, texts, ids=ids).withColumnRenamed("lang", "kept").withColumnRenamed("source", "same")
    got = near_dedup.keep_one(docs)
    kept = sorted((r["doc_id"], r["text"]) for r in got.collect())
    assert got.columns == docs.columns and kept[:2] == sorted([(5, a), (5, b)]) and len(kept) == 3 and kept[2][1].lower() == c.lower()


def test_a_family_costs_few_pairs(spark, monkeypatch):
    """Texts of one origin at 0.3 to 1.0, as in a large group of near copies: the pairs
    that are compared grow with the family, and the kept ones are those of all pairs."""
    from ledgerloom.llm import set_links

    made, real = [], set_links.similar

    def counted(pairs, sets, share):
        made[-1] += pairs.count()
        return real(pairs, sets, share)

    monkeypatch.setattr(set_links, "similar", counted)
    rng = random.Random(8)
    base = " ".join(words(rng, 150, 4000))
    texts = [changed(rng, base, rng.randrange(0, 22)) for _ in range(800)]
    for n in (200, 800):
        made.append(0)
        got = {r["doc_id"] for r in near_dedup.keep_one(documents(spark, texts[:n])).collect()}
        if n == 200:
            assert got == plain_kept(texts[:n])
    assert made[1] < 4 * 1.5 * made[0] and made[1] < 20 * 800, made
