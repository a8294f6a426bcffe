"""SimHash classes are the first step of the pipeline's near-dedup."""

import random

import corpus_pipeline
from ledgerloom.llm import near_dedup, set_links, simhash
from tests.llm.helpers import documents, words
from tests.llm.test_near_dedup import changed, plain_kept


def test_classes_meet_near_copies(spark):
    rng = random.Random(3)
    base = [" ".join(words(rng, 400, 4000)) for _ in range(30)]
    texts = base + [changed(rng, t, 1) for t in base]
    own = set_links.profiles(documents(spark, texts), near_dedup.WORDS, near_dedup.bands_of, print_of=simhash.print_of).cache()
    prints = {r["doc_id"]: r for r in own.collect()}
    apart = [(prints[i]["fp"] ^ prints[i + 30]["fp"]).bit_count() if prints[i]["fp"] ^ prints[i + 30]["fp"] >= 0 else 64 for i in range(30)]
    met = {(r["u"], r["v"]) for r in simhash.class_pairs(own.select("node", "fp")).collect()}
    want = {tuple(sorted((prints[i]["node"], prints[i + 30]["node"]))) for i in range(30) if apart[i] <= simhash.RADIUS}
    assert want <= met and len(want) > 3 and all(u < v for u, v in met)


def test_stage_uses_them(spark, monkeypatch):
    """The stage's links begin with the fingerprints' classes; no pair is lost beyond them,
    and none is kept that its sets do not confirm."""
    rng, calls, real = random.Random(4), [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: calls.append(1) or real(*a, **k))
    texts = [" ".join(words(rng, 200, 4000)) for _ in range(20)]
    texts += [changed(rng, t, n) for t in texts for n in (1, 6, 20)] + [None, ""]
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, documents(spark, texts), "").collect()}
    assert got == plain_kept(texts) and calls
