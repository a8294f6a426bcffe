"""Nearest neighbours with many equal vectors, ties and vectors of several lengths."""

import numpy as np

from ledgerloom.llm import graph_ann


def exact(rows, k):
    out = {}
    for i, v in rows:
        if v is None or i is None or i % 20 or not np.isfinite(v).all() or not np.any(v):
            continue
        own = {}
        for j, w in rows:
            if j is not None and j != i and w is not None and len(w) == len(v) and np.isfinite(w).all() and np.any(w):
                own[j] = max(own.get(j, -np.inf), sum(a * b for a, b in zip(v, w, strict=True)))
        out[i] = [j for _, j in sorted((-s, j) for j, s in own.items())[:k]]
    return out


def test_copies_ties_and_lengths(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)).round(3)
    x[200:600] = x[200]  # a hot vector
    x[600:640] = x[7] * 0.5
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000 + i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(5, [1.0] * 12), (40, x[40].tolist()), (None, [1.0] * 12), (2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS ids", "2 AS shard", "3 AS h")
    got = {}
    for r in graph_ann.search(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=300).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = exact(rows, 20)
    assert set(got) == set(want) and all(sorted(r) == list(range(1, len(want[q]) + 1)) for q, r in got.items())
    hits = [len({*r.values()} & {*want[q]}) / len(want[q]) for q, r in got.items()]
    assert np.mean(hits) > 0.98
    assert all([r[i] for i in sorted(r)] == want[q] for q, r in got.items() if 200 <= q < 600)
