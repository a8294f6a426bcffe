"""Nearest neighbours by inner product over robust-pruned directed graphs.

Rows with equal vectors are one point, with the k + 1 smallest of their ids (no more
can be among the k nearest). Points are dealt by hash into shards of about SHARD. Each
shard gets a graph: points are inserted in batches; a greedy beam search from the entry point proposes a
row's neighbours, and relaxed distance pruning keeps a proposal only if no kept
neighbour is ALPHA times nearer to it than the row is. A query's beam search walks
every shard's graph, and the shards' best are merged.

Inner products become distances by one more coordinate, sqrt(M - |x|^2) with M
the largest squared length, which queries have as zero. Found rows are scored
again on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import written

SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA, BATCH, QUERIES = 8192, 32, 64, 96, 1.2, 512, 4096


def _dots(a, b):
    """Products of each row of a with its own list of rows b (n x k x d)."""
    import numpy as np

    return np.matmul(b, a[:, :, None])[:, :, 0]


def beam_search(points, norms, graph, entry, queries, width: int):
    """For every query the `width` nearest points that a best-first walk finds, as
    ids and squared distances (nearest first; -1 and infinity where there are
    fewer). All queries walk in step. points: n x d, norms: their squared lengths,
    graph: n x degree, -1 for no edge."""
    import numpy as np

    q, n = len(queries), len(points)
    ids, far = np.full((q, width), -1, np.int64), np.full((q, width), np.inf, np.float32)
    done = np.ones((q, width), bool)
    seen = np.zeros((q, n), bool)
    starts = np.broadcast_to(np.asarray(entry, np.int64), (q, len(entry)))
    length = (queries**2).sum(1)
    d = length[:, None] + norms[starts] - 2 * (queries @ points[starts[0]].T)
    k = min(width, starts.shape[1])
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    ids[:, :k], far[:, :k], done[:, :k] = np.take_along_axis(starts, order, 1), np.take_along_axis(d, order, 1), False
    seen[:, starts[0]] = True
    live = np.arange(q)
    while len(live):
        open_at = np.where(done[live], np.inf, far[live])
        best = open_at.argmin(1)
        going = np.isfinite(open_at[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        done[live, best] = True
        near = graph[ids[live, best]]
        new = (near >= 0) & ~np.take_along_axis(seen[live], np.maximum(near, 0), 1)
        rows, cols = np.nonzero(new)
        if not len(rows):
            continue
        seen[live[rows], near[rows, cols]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[rows, cols] = length[live[rows]] + norms[near[rows, cols]] - 2 * np.einsum("ij,ij->i", queries[live[rows]], points[near[rows, cols]])
        all_far = np.concatenate([far[live], d], 1)
        all_ids = np.concatenate([ids[live], near], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[live], ids[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_far, all_ids, all_done))
        done[live] |= ~np.isfinite(far[live])
    order = np.argsort(far, axis=1, kind="stable")
    far, ids = np.take_along_axis(far, order, 1), np.take_along_axis(ids, order, 1)
    ids[~np.isfinite(far)] = -1
    return ids, far


def robust_prune(points, norms, own, proposed, degree: int, alpha: float):
    """For every row of `own` its kept neighbours among `proposed` (m x k, -1: none)."""
    import numpy as np

    m, k = proposed.shape
    safe = np.maximum(proposed, 0)
    vectors = points[safe]
    d = norms[own][:, None] + norms[safe] - 2 * _dots(points[own], vectors)
    d[(proposed < 0) | (proposed == own[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, safe = np.take_along_axis(d, order, 1), np.take_along_axis(safe, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    twice = np.zeros_like(d, bool)
    twice[:, 1:] = (safe[:, 1:] == safe[:, :-1]) & np.isfinite(d[:, 1:])
    d[twice] = np.inf
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out, left, at = np.full((m, degree), -1, np.int64), np.isfinite(d), np.arange(m)
    for i in range(degree):
        pick = left.argmax(1)
        some = left[at, pick]
        if not some.any():
            break
        out[some, i] = safe[at, pick][some]
        left[at, pick] = False
        left &= ~(some[:, None] & (alpha * between[at, pick] <= d))
    return out


def build(points, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = BATCH):
    """The graph of one shard and its entry points: two passes over the rows, the
    first with alpha 1, in batches that search the graph as it stands."""
    import numpy as np

    n = len(points)
    norms = (points**2).sum(1)
    rng = np.random.default_rng(n)
    # Random first edges: a graph that can be walked before any row is inserted.
    graph = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1, np.int64)
    graph[graph == np.arange(n)[:, None]] = -1
    middle = ((points - points.mean(0)) ** 2).sum(1).argmin() if n else 0
    entry = np.unique(np.concatenate([[middle], rng.integers(0, n, min(n, 8))])) if n else np.zeros(0, np.int64)
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            own = order[k : k + batch]
            found, _ = beam_search(points, norms, graph, entry, points[own], width)
            graph[own] = robust_prune(points, norms, own, np.concatenate([found, graph[own]], 1), degree, a)
            # Edges back; a row whose list overflows is pruned again.
            src, dst = np.repeat(own, degree), graph[own].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            rows, first, count = np.unique(dst, return_index=True, return_counts=True)
            more = np.full((len(rows), min(int(count.max(initial=0)), 2 * degree)), -1, np.int64)
            slot = np.arange(len(dst)) - np.repeat(first, count)
            fits = slot < more.shape[1]
            more[np.repeat(np.arange(len(rows)), count)[fits], slot[fits]] = src[fits]
            for j in range(0, len(rows), batch):
                r = rows[j : j + batch]
                graph[r] = robust_prune(points, norms, r, np.concatenate([graph[r], more[j : j + batch]], 1), degree, a)
    return graph, entry


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): the distinct rows with a key and a vector of finite components, not all
    zero. A negative zero counts as zero."""
    v = F.transform(F.col(column).cast("array<double>"), lambda x: x + F.lit(0.0))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id", F.xxhash64("v").alias("h"), "v").agg(F.size("v").alias("dim"))


def points(rows: DataFrame, k: int) -> DataFrame:
    """(dim, ids, id, v): distinct vectors with the k + 1 smallest ids that have them,
    in order. A hot vector is cut down to so many rows before the shuffle."""
    place = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id")).alias("place")
    kept = rows.select("dim", "h", "v", "id", place).where(F.col("place") <= k + 1)
    return kept.groupBy("dim", "h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("dim", "ids", F.col("ids")[0].alias("id"), "v")


def _shards(dealt: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: its points' ids, vectors and graph as bytes."""
    import pandas as pd

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("id", kind="stable")
        v = np.vstack(pdf["v"].to_numpy()).astype(np.float64)
        x = v.astype(np.float32)
        more = np.sqrt(np.maximum(pdf["largest"].iloc[0] - (x.astype(float) ** 2).sum(1), 0)).astype(np.float32)
        x = np.hstack([x, more[:, None]])
        graph, entry = build(x)
        ids, count = np.concatenate(pdf["ids"].to_numpy()).astype(np.int64), pdf["ids"].str.len().to_numpy(np.int64)
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "ids": [ids.tobytes()], "count": [count.tobytes()], "points": [x.tobytes()], "vectors": [v.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entry": [entry.astype(np.int64).tobytes()]})

    schema = "dim int, shard int, ids binary, count binary, points binary, vectors binary, graph binary, entry binary"
    return dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(make, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of
    vectors but those with its own key; the largest inner product first, ties to the
    smaller key.

    Rows with a null key, or with vectors that are null, zero or hold null or
    non-finite components, take no part. A query is compared with the vectors of its
    own length only. Rows that repeat a key with another vector are separate
    candidates; of equal ids found for a query the best one counts once, and repeated
    rows count once. Fewer candidates than k: all that are found; an empty table gives
    none. Other columns are not read. Queries reach the shards in blocks of QUERIES.
    """
    distinct = written(points(usable(vectors, key, column), k), "points")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    lengths = distinct.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"), F.max(square).alias("largest"))
    total = int(lengths.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0])
    dealt = distinct.join(lengths, "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    graphs = written(_shards(dealt, total), "graphs")
    asked = usable(queries, key, column)
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries")).join(lengths, "dim")
    every = asked.select("dim", "queries", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def walk(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                count, flat = np.frombuffer(r["count"], np.int64), np.frombuffer(r["ids"], np.int64)
                begin = np.cumsum(count) - count
                ids, vs = flat[begin], np.frombuffer(r["vectors"]).reshape(len(count), -1)
                points, graph = np.frombuffer(r["points"], np.float32).reshape(len(ids), -1), np.frombuffer(r["graph"], np.int32).reshape(len(ids), -1)
                norms, entry = (points**2).sum(1), np.frombuffer(r["entry"], np.int64)
                own, q = np.array([x["id"] for x in r["queries"]]), np.array([x["v"] for x in r["queries"]], float)
                for i in range(0, len(own), BATCH):
                    part = np.hstack([q[i : i + BATCH], np.zeros((len(q[i : i + BATCH]), 1))]).astype(np.float32)
                    found, _ = beam_search(points, norms, graph, entry, part, min(max(beam, k + 1), max(len(ids), 1)))
                    # Summed in the order of the components, as a plain loop would.
                    score = np.zeros(found.shape)
                    for j in range(q.shape[1]):
                        score += q[i : i + BATCH, j, None] * vs[np.maximum(found, 0), j]
                    score[(found < 0) | ((ids[np.maximum(found, 0)] == own[i : i + BATCH, None]) & (count[np.maximum(found, 0)] == 1))] = -np.inf
                    order = np.lexsort((ids[np.maximum(found, 0)], -score), axis=1)[:, : k + 1]
                    score, found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
                    at, col = np.nonzero(np.isfinite(score))
                    point = found[at, col]
                    n = count[point]
                    place = np.repeat(begin[point] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[i + at], n)), pa.array(flat[place]), pa.array(np.repeat(score[at, col], n))], ["query_id", "vec_id", "score"])

    met = graphs.repartition(total, "dim", "shard").join(every.repartition(total, "dim", "shard").hint("merge"), ["dim", "shard"])
    found = met.select("ids", "count", "points", "vectors", "graph", "entry", "queries").mapInArrow(walk, "query_id long, vec_id long, score double").where("query_id <> vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", best, "vec_id", "score").where(F.col("rank") <= k)
