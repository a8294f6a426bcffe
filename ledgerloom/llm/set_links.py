"""Links between documents whose sets of word shingles are similar.

Documents with equal sets are one node. A profile gives each node the keys of its LSH
bands; nodes that share a key met, and pairs that met are confirmed on their full sets.
Only as many pairs are made as the components need:

1. in the first FIRST bands each node with the least and the greatest of its bucket,
2. in buckets that still hold several components, each node with the least and the
   greatest one, and then with the one that shares most of its shingles with others,
3. of the nodes in buckets that are mixed even then, those of different components that
   share one of their rarest shingles, where the places of that shingle leave room for
   enough common ones (an exact filter: a similar pair always passes it).

So a group of copies costs no pairs among its own, and a family of texts at less than
the needed similarity costs only what its rare shingles have in common. The links found
have the components of all similar pairs that met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components, forest
from ledgerloom.llm.shared import drop_memories, drop_table, text_of, written

FIRST, SEED, SLICE = 5, 42, 200_000


class Hashes(dict):
    """Words to their XXH64, the latest `keep` ones."""

    def __init__(self, keep: int = 300_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.keep:
            self.clear()
        self[word] = out = xxh64_intdigest(word, SEED)
        return out


def shingles_of(text: str, words: int, hashes: dict[bytes, int]):
    """The sorted distinct 64-bit hashes of the text's word shingles: A-Z lowered, words
    parted by ASCII white space; fewer words: one shingle of all; none: none."""
    import numpy as np

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in parts], np.uint64)
    n = max(1, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ (s >> np.uint64(32)))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def profiles(docs: DataFrame, words: int, keys_of: Callable, text: str = "text", key: str = "doc_id", print_of: Callable | None = None) -> DataFrame:
    """(doc_id, same, node, n, bands, fp), a row for each document. same: a hash of the text;
    node: a hash of its set of n shingles, null without words; bands: keys_of(sets) for
    a list of sets that are not empty gives a list of signed longs for each; fp: the set's
    fingerprint of 64 bits, null without words or print_of."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        drop_memories()
        hashes = Hashes()
        for batch in batches:
            begin, size, nodes, counts, bands, prints, sets = 0, 0, [], [], [], [], []
            for i, t in enumerate(batch.column(1), 1):
                own = shingles_of(t.as_py(), words, hashes)
                nodes.append(_signed(xxh64_intdigest(own.tobytes(), SEED)) if len(own) else None)
                counts.append(len(own))
                prints.append(_signed(print_of(own)) if print_of and len(own) else None)
                sets.append(own)
                size += len(own)
                if size >= SLICE or i == batch.num_rows:
                    keys = iter(keys_of([x for x in sets if len(x)]))
                    bands = [next(keys) if len(x) else [] for x in sets]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, i - begin), batch.column(2).slice(begin, i - begin), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.int64())],
                        ["doc_id", "same", "node", "n", "bands", "fp"],
                    )
                    begin, size, nodes, counts, prints, sets = i, 0, [], [], [], []

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text), F.xxhash64(text_of(text)).alias("same"))
    return rows.mapInArrow(run, "doc_id long, same long, node long, n long, bands array<long>, fp long")


def _sets(docs: DataFrame, chosen: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """(node, shingles) of the nodes in chosen (node, doc_id, same): one of each node's
    documents is read again, so that no other sets are kept or moved."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        drop_memories()
        hashes = Hashes()
        for batch in batches:
            raw = [shingles_of(t.as_py(), words, hashes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["node", "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"), F.xxhash64(text_of(text)).alias("same"))
    known = rows.join(chosen.where("doc_id IS NOT NULL"), ["doc_id", "same"]).select("node", "text")
    bare = rows.where("doc_id IS NULL").join(chosen.where("doc_id IS NULL").drop("doc_id"), "same").select("node", "text")
    return known.unionAll(bare).mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _close(n: str, other: str, share: int):
    """Whether sets of these sizes can be similar at all."""
    return F.least(n, other) * 100 >= F.greatest(n, other) * share


def similar(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (u, v) with 100 * common >= share * union of their sets."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= share * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    first, second = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    met = pairs.select("u", "v").join(first.hint("merge"), "u").join(second.hint("merge"), "v")
    return written(met.select("u", "v", "of_u", "of_v").mapInArrow(run, "u long, v long"), "similar")


def _stars(cells: DataFrame, share: int) -> DataFrame:
    """(u, v): each node with the least and the greatest of its bucket, where these are of
    another component and near enough in size. cells: at, node, n, root."""
    ends = cells.groupBy("at").agg(F.min(F.struct("node", "n", "root")).alias("low"), F.max(F.struct("node", "n", "root")).alias("high"))
    cells = cells.join(ends, "at")
    of = lambda hub: cells.where((F.col("root") != F.col(f"{hub}.root")) & _close("n", f"{hub}.n", share)).select(F.least("node", f"{hub}.node").alias("u"), F.greatest("node", f"{hub}.node").alias("v"))
    return of("low").unionAll(of("high")).distinct()


def _mixed(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """The cells of buckets that hold nodes of several components, with these as root."""
    cells = cells.select("at", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    mixed = cells.groupBy("at").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("at")
    return cells.join(mixed, "at")


def _by_rarity(sets: DataFrame) -> DataFrame:
    """(node, size, alone, ranked): a node's shingles from the rarest on, as (times, shingle)
    with how many nodes of sets have it; alone: how many no other node has."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.frombuffer(raw.as_buffer(), np.int64) for raw in batch.column(1)]
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(own))], ["node", "shingle"])

    each = sets.mapInArrow(run, "node long, shingle long")
    times = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node"))
    alone = times.where("times = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    # Shingles of one node only need no row: they come first and meet nothing.
    shared = each.join(times.where("times > 1").select("shingle", "times"), "shingle")
    ranked = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("ranked"))
    out = sets.select("node", F.expr("length(shingles) div 8").alias("size")).join(alone, "node", "left").join(ranked, "node", "left")
    return out.na.fill(0, ["alone"])


def _rare_pairs(ranked: DataFrame, roots: DataFrame, share: int) -> DataFrame:
    """(u, v) of different components that share a shingle among their rarest, at places
    that leave room for enough common ones. In the order of rarity, what a similar pair
    has in common begins within the first (100 - share) % of either set and is at most
    what remains there in both."""
    rows = ranked.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    rows = rows.where("ranked IS NOT NULL").select("node", "root", "size", "alone", F.posexplode("ranked").alias("place", "x"))
    rows = rows.select("node", "root", "size", F.col("x.shingle").alias("shingle"), (F.col("size") - F.col("alone") - F.col("place")).alias("rest"))
    rows = written(rows.where(F.col("rest") * 100 >= F.col("size") * share), "rare-shingles")
    room = lambda rest, a, b: F.col(rest) * (100 + share) >= (F.col(a) + F.col(b)) * share
    # An entry stays if the smallest set of another component under its shingle leaves room.
    each = rows.groupBy("shingle", "root").agg(F.min("size").alias("size"))
    best = each.groupBy("shingle").agg(F.min(F.struct("size", "root")).alias("first"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    second = each.join(best, "shingle").where(F.col("root") != F.col("first.root")).groupBy("shingle").agg(F.min("size").alias("second"))
    other = F.when(F.col("root") == F.col("first.root"), F.col("second")).otherwise(F.col("first.size"))
    rows = rows.join(best, "shingle").join(second, "shingle").withColumn("other", other).where(room("rest", "size", "other")).drop("first", "second", "other")
    a, b = (rows.select("shingle", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "root", "size", "rest"))) for x in "ab")
    met = a.join(b.hint("merge"), (a["shingle"] == b["shingle"]) & (a["a_root"] < b["b_root"]) & room("a_rest", "a_size", "b_size") & room("b_rest", "a_size", "b_size"))
    return met.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).distinct()


def _roots(found: DataFrame) -> DataFrame:
    return written(components(forest(found)), "roots")


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], share: int, met: DataFrame | None = None) -> DataFrame:
    """(u, v): similar pairs with the components of all similar pairs that met. nodes: (node,
    n, bands), a row for each node; sets_of(nodes) gives their (node, shingles). met: pairs
    (u, v) that another method found; they are confirmed first, and buckets then only join
    what these have left apart."""
    cells = nodes.select("node", "n", F.posexplode("bands").alias("band", "key")).withColumn("at", F.xxhash64("band", "key"))
    shared = cells.groupBy("at").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("at")
    cells = written(cells.join(shared, "at").select("at", "node", "n", "band"), "buckets")
    asked = cells.select("node")
    if met is not None:
        met = written(met, "met")
        asked = asked.unionAll(met.select("u")).unionAll(met.select("v"))
    sets = written(sets_of(asked.distinct()), "sets")
    begin = cells.where(F.col("band") < FIRST)
    if met is None:
        found = similar(_stars(begin.withColumn("root", F.col("node")), share), sets, share)
    else:
        found = similar(met, sets, share)
        found = found.unionAll(similar(_stars(_mixed(begin, _roots(found)), share), sets, share))
    roots = _roots(found)
    mixed = written(_mixed(cells, roots), "mixed-buckets")
    found = written(found.unionAll(similar(_stars(mixed, share), sets, share)), "linked")
    roots = _roots(found)
    # From here on only nodes of buckets that are mixed still.
    mixed = written(_mixed(mixed, roots), "mixed-buckets")
    open_sets = written(sets.join(mixed.select("node").distinct(), "node", "left_semi"), "open-sets")
    ranked = written(_by_rarity(open_sets), "ranked")
    alone = mixed.join(ranked.select("node", "alone"), "node")
    hubs = alone.groupBy("at").agg(F.min(F.struct("alone", "node", "n", "root")).alias("hub"))
    near = alone.join(hubs, "at").where((F.col("root") != F.col("hub.root")) & _close("n", "hub.n", share))
    near = near.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")).distinct()
    found = written(found.unionAll(similar(near, open_sets, share)), "linked")
    roots = _roots(found)
    still = _mixed(mixed, roots).select("node").distinct()
    found = found.unionAll(similar(_rare_pairs(ranked.join(still, "node", "left_semi"), roots, share), open_sets, share))
    for done in (cells, sets, mixed, open_sets, ranked):
        drop_table(done)
    return found


def grouped(docs: DataFrame, words: int, share: int, keys_of: Callable, text: str = "text", key: str = "doc_id", print_of: Callable | None = None, pairs_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, same, node, n, least, root, first): a row for each document. root names the
    component of its node (null without words); least: the least doc_id of its node;
    first: the struct (doc_id, node) of the component's least doc_id that is not null.
    pairs_of: pairs (u, v) of nodes (node, fp) by their fingerprints, to be confirmed before
    any bucket is looked at; print_of: the fingerprint of a set."""
    rows = written(profiles(docs, words, keys_of, text, key, print_of), "profiles")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "same")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    nodes = written(nodes, "nodes")

    def sets_of(chosen: DataFrame) -> DataFrame:
        one = nodes.join(chosen, "node", "left_semi").select("node", "one.doc_id", "one.same")
        return _sets(docs, one, words, text, key)

    met = pairs_of(nodes.select("node", "fp")) if pairs_of else None
    roots = _roots(links(nodes, sets_of, share, met))
    named = nodes.select("node", F.col("one.doc_id").alias("least")).join(roots, "node", "left")
    named = written(named.select("node", "least", F.coalesce("component", "node").alias("root")), "named")
    first = named.where("least IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("least").alias("doc_id"), "node")).alias("first"))
    classes = named.join(first, "root", "left").select("node", "least", "root", "first")
    rows = rows.drop("bands", "fp")
    none = [F.lit(None).cast(classes.schema[c].dataType).alias(c) for c in ("least", "root", "first")]
    return rows.where("node IS NOT NULL").join(classes.hint("merge"), "node").select("doc_id", "same", "node", "n", "least", "root", "first").unionAll(rows.where("node IS NULL").select("doc_id", "same", "node", "n", *none))

