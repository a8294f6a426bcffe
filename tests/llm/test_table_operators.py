import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import graph_ann, lm_mixing, warc
from ledgerloom.llm.shared import open_for_read
from tests.llm.helpers import documents, prose, words

# WARC


def test_archives(spark):
    big, other = "é" * 700, "x" * 1500
    pages = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (2, "http://c\r\nX: y", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write_archives(df.withColumnRenamed("url", "url"))
    got = sorted(map(tuple, warc.read_archives(index).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for k, _, t in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        again = t == big and k != 5
        want.append((k, len((t or "").encode()), sha(t), "revisit" if again else "response", 5 if again else None))
    assert got == want
    for r in index.where("page_id IS NOT NULL").collect():
        head, block = warc.read_record(r["path"], r["frame_at"], r["frame_size"], r["at"])
        assert head["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>" and (head["WARC-Type"] == "revisit" or hashlib.sha1(block).hexdigest() == head["WARC-Payload-Digest"][5:])
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_seek_table(tmp_path):
    import zstandard

    uri = f"file://{tmp_path}/a.warc.zst"
    bundle = warc.Bundle(uri)
    raw = [warc.record(i, "u", "response", "d", 3, None, random.Random(i).randbytes(90_000)) for i in range(40)]
    for i, x in enumerate(raw):
        bundle.add(i, x)
    index = bundle.close()
    frames = warc.seek_table(open_for_read(uri))
    assert len(frames) > 2 and sum(f[2] for f in frames) == sum(map(len, raw)) and {r[2] for r in index} == {f[0] for f in frames}
    assert zstandard.ZstdDecompressor().stream_reader((tmp_path / "a.warc.zst").read_bytes(), read_across_frames=True).read() == b"".join(raw)


# Nearest neighbours


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        out[q] = sorted(((-s[j], i) for j, i in enumerate(ids) if i != q))[:k]
    return out


@pytest.mark.parametrize("shard", [300, 5000])
def test_recall(spark, shard):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 24))
    x[100:160] = x[100]  # copies
    x *= rng.uniform(0.5, 2, (1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = [i for i in range(1500) if i % 20 == 0]
    got = {}
    for r in graph_ann.search(df, df.where("vec_id % 20 = 0"), 20, shard_rows=shard).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want, hits = exact(list(range(1500)), x, queries, 20), 0
    for q in queries:
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(own, own[1:]))
        assert all(math.isclose(s, x[q] @ x[v], rel_tol=1e-12, abs_tol=1e-12) for _, v, s in own)
        worst = -want[q][-1][0] - 1e-9
        hits += sum(s >= worst for _, _, s in own)
    assert hits / (20 * len(queries)) >= 0.95


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (1, [2.0, 1.0]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (None, [1.0, 1.0]), (4, [2.0, 1.0]), (5, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in graph_ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 4, 2.0)]
    assert graph_ann.search(df.limit(0), df.limit(0)).count() == 0


# Language model


def plain_base(texts, ids):
    token = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split(), None]
    train = [token(t) for i, t in zip(ids, texts, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for d in train:
        for w in d:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return {i: (len(token(t)), sum(w in counts for w in token(t)), n, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in token(t))) for i, t in zip(ids, texts, strict=True)}


def test_language_model(spark):
    texts = [*prose(1, 300, 200), None, "", "É\x0bX y z", "x " * 5000]
    rng = random.Random(5)
    texts += ["the red fox ran over the hill and " + " ".join(words(rng, 6, 50)) + " the end" for _ in range(400)]
    got = {r["doc_id"]: r for r in lm_mixing.score(documents(spark, texts).withColumnRenamed("lang", "words")).collect()}
    want = plain_base(texts, range(len(texts)))
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and -math.inf < r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_held_out_texts_teach_nothing(spark):
    texts = prose(6, 200, 80)
    held = [i for i in range(200) if lm_mixing.held_out(i)]
    other = list(texts)
    for i in held[1:]:
        other[i] = "quite different " + texts[i][::-1]
    a, b = ({r["doc_id"]: r["score"] for r in lm_mixing.score(documents(spark, t)).collect()} for t in (texts, other))
    assert math.isclose(a[held[0]], b[held[0]], rel_tol=1e-9)


def test_language_model_of_nothing(spark):
    assert lm_mixing.score(documents(spark, ["x"]).limit(0)).count() == 0
    k = next(i for i in range(99) if lm_mixing.held_out(i))
    r = lm_mixing.score(documents(spark, ["a b", "a b"], ids=[k, k])).collect()
    assert len(r) == 2 and r[0]["train_tokens"] == 0 and r[0]["n_known"] == 0


def test_decisions_make_a_distribution():
    """Over all classes and hashes of one place, the products of the decisions' odds
    add up to one for any table."""
    rng = np.random.default_rng(0)

    class One:
        pass

    n = 31 * 64
    b = One()
    kind = np.repeat(np.arange(31), 64)
    b.ids, b.bits = np.arange(n), np.tile(np.arange(64), 31)
    b.near = b.near2 = b.last = np.full(n, 9, np.uint32)
    odds, gate = rng.normal(size=lm_mixing.TABLE).astype(np.float32), np.zeros(lm_mixing.TABLE, np.uint8)
    weights, refine = np.full((3 * lm_mixing.GATES, 4), 0.3, np.float32), np.full(3 * lm_mixing.GATES * lm_mixing.STEPS, 0.5, np.float32)
    bits = np.zeros(n)
    for group, row, bit, places in lm_mixing._word_decisions(b, np.arange(n), kind):
        bits[row] += lm_mixing._scores(group, bit, places, odds, gate, weights, refine).sum(1)
    unseen = 2.0 ** bits[0]
    end = 2.0 ** sum(lm_mixing._scores(g, t, p, odds, gate, weights, refine).sum() for g, _, t, p in lm_mixing._word_decisions(b, np.arange(1), np.array([31])) if g == 0)
    assert math.isclose(unseen + end + (2.0 ** bits[64:]).sum(), 1, rel_tol=1e-4)
