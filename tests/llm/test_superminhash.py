"""SuperMinHash against the element-by-element algorithm and all pairs in plain Python."""

import random

import numpy as np
import pytest

from ledgerloom.llm import set_links
from ledgerloom.llm import superminhash as S
from ledgerloom.llm.components import components, find_roots, forest
from tests.llm.helpers import documents, prose, words

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def one_by_one(elements, m):
    """The algorithm as published: an element at a time, swaps made as they are needed,
    stopping at the highest level that any place still holds."""
    out, level_of, count, top = [None] * m, [m - 1] * m, [0] * (m - 1) + [m], m - 1
    for e in elements:
        p, j = list(range(m)), 0
        while j <= top:
            z = mixed(e + (j + 1) * 0x9E3779B97F4A7C15 & MASK)
            k = j + ((z & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            rank = (j << 32) + (z >> 32)
            if out[p[j]] is None or rank < out[p[j]]:
                before = level_of[p[j]]
                out[p[j]] = rank
                if j < before:
                    count[before] -= 1
                    count[j] += 1
                    level_of[p[j]] = j
                    while count[top] == 0:
                        top -= 1
            j += 1
    return out


@pytest.mark.parametrize("m", [1, 2, 7, 32])
def test_ranks_are_those_of_the_sequential_algorithm(m):
    rng = random.Random(m)
    sets = [[rng.getrandbits(64) for _ in range(n)] for n in (1, 2, 3, 10, 50, 400)]
    got = S.signatures(np.array([x for s in sets for x in s], np.uint64), [len(s) for s in sets], m)
    assert got.tolist() == [one_by_one(s, m) for s in sets]


def test_agreeing_places_tell_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        found = []
        for _ in range(60):
            n = 200
            common = round(2 * n * share / (1 + share))
            x = rng.integers(0, 2**63, 2 * n - common, np.uint64)
            a, b = S.signatures(np.concatenate([x[:n], x[len(x) - n :]]), [n, n])
            found.append((a == b).mean())
        true = common / (2 * n - common)
        assert abs(np.mean(found) - true) < 0.02
        # Independent ranks have a variance of true * (1 - true) / SLOTS.
        assert np.var(found) < 1.3 * true * (1 - true) / S.SLOTS


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def plain(texts):
    own, root = [shingles(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for i in range(len(own)) for j in range(i) if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])]
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return [(i, len(own[i]), root[i], root[i] == i) for i in range(len(texts))]


def changed(rng, text, n, pool=10**6):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"changed{rng.randrange(pool)}"
    return " ".join(w)


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(80, 300), 4000)) for _ in range(30)]
    texts += [changed(rng, t, n) for t in texts[:15] for n in (1, 2, 3, 4, 6, 9)]
    for _ in range(30):  # a chain
        texts.append(changed(rng, texts[-1], 2))
    texts += [changed(rng, texts[20], rng.randrange(1, 20)) for _ in range(120)]  # a family, near and far
    texts += [changed(rng, texts[21], rng.randrange(1, 20), 6) for _ in range(80)]  # whose changes repeat
    for _ in range(60):  # texts that lack parts of one text
        w = texts[22].split()
        cut = rng.randrange(1, max(2, len(w) // 6))
        at = rng.randrange(len(w) - cut)
        texts.append(" ".join(w[:at] + w[at + cut :]))
    texts += [texts[23].upper()] * 40 + ["", None, " \n ", "a b", "A  b", "a b c", "a b c d", "É b c", "é b c"]
    got = sorted(map(tuple, S.near_duplicates(documents(spark, texts)).collect()))
    assert got == plain(texts)


def test_a_family_costs_few_pairs(spark, monkeypatch):
    """Texts that are near their origin but not each other: pairs grow with the family."""
    made = []
    real = set_links.similar

    def counted(pairs, sets, share):
        made[-1] += pairs.count()
        return real(pairs, sets, share)

    monkeypatch.setattr(set_links, "similar", counted)
    rng = random.Random(7)
    base = " ".join(words(rng, 150, 4000))
    texts = [changed(rng, base, rng.randrange(1, 24)) for _ in range(1200)]
    for n in (300, 1200):
        made.append(0)
        assert S.near_duplicates(documents(spark, texts[:n])).count() == n
    assert made[1] < 4 * 1.3 * made[0] and made[1] < 40 * 1200


def test_odd_rows(spark):
    empty = documents(spark, ["x"]).limit(0)
    assert S.near_duplicates(empty).count() == 0
    a, b = "one two three four five", "six seven eight nine"
    docs = documents(spark, [a, a, b, b, a, None, "", a, b], ids=[7, 7, 7, None, 9, None, 3, 3, None]).withColumnRenamed("lang", "node").withColumnRenamed("source", "same")
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=repr)
    want = [(3, 0, 3, True), (3, 3, 3, True), (7, 2, 7, True), (7, 3, 3, False), (7, 3, 3, False), (9, 3, 3, False), (None, 0, None, False), (None, 2, 7, False), (None, 2, 7, False)]
    assert got == sorted(want, key=repr)
    nulls = documents(spark, [b, b], ids=[None, None])
    assert [tuple(r) for r in S.near_duplicates(nulls).collect()] == [(None, 2, None, False)] * 2


def test_very_long_text(spark):
    rng = random.Random(9)
    long = " ".join(words(rng, 60_000, 4000))
    got = S.near_duplicates(documents(spark, [long, changed(rng, long, 1000), *prose(3, 5)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got}[1] == 0


def test_union_find_and_forest(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    roots = find_roots(pairs)
    assert all(roots.get(u, u) == roots.get(v, v) for u, v in pairs)
    links = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    ask = lambda x: sorted(map(tuple, components(x).collect()))
    assert ask(forest(links, 20)) == ask(links)
