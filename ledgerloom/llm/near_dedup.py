"""Near-duplicate documents by SimHash, confirmed by their five-word shingles.

Documents with equal sets of shingles are one node with a SimHash fingerprint of its
shingles. Fingerprints at simhash.RADIUS or fewer bits are found by simhash's generalised
pigeonhole search and joined to classes; each node meets the first of its class, and the
pair is confirmed on the sets. Similarity SIMILAR leaves fingerprints about ten bits apart,
far beyond a radius that can be searched, so an exact step follows for what the classes
leave apart: nodes that share the least hashes of one of BANDS bands meet, and a pair that met is linked if its sets' Jaccard
similarity is at least SIMILAR per cent. At 0.8 a pair meets with a chance of 0.9996,
above it with a greater one. How the pairs are found without comparing all of a bucket:
see set_links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.set_links import SEED, grouped
from ledgerloom.llm.shared import fresh, text_of, written

WORDS, SIMILAR, BANDS, ROWS = 5, 80, 20, 5


def bands_of(sets) -> list[list[int]]:
    """A signed long for each band of each set: the hash of its ROWS least hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    addends, out = rng.integers(0, 2**63, BANDS * ROWS, np.uint64), []
    for own in sets:
        least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
        for k in range(0, len(own), 1 << 12):
            least = np.minimum(least, (own[k : k + (1 << 12)] * factors[:, None] + addends[:, None]).min(1))
        raw, size = least.tobytes(), ROWS * 8
        keys = [xxh64_intdigest(raw[b * size : b * size + size], b) for b in range(BANDS)]
        out.append([k - (k >> 63 << 64) for k in keys])
    return out


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates: of each component the document with
    the least id stays, once. Null and empty texts are equal. Rows with a null id
    cannot be told apart and stay. Different texts under one id are different
    documents: each stays unless its own component has a smaller id; of rows with
    equal sets of shingles under that id one stays. An empty table gives an empty
    table; other columns stay as they are, whatever their names."""
    own_text, same_text, kept_id = fresh(docs, "own", "same", "kept")
    known = grouped(docs, WORDS, SIMILAR, bands_of, text, key, simhash.print_of, simhash.class_pairs).where("doc_id IS NOT NULL")
    worded = known.where((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.node") == F.col("node"))).select("doc_id", "node", "same")
    blank = known.where("node IS NULL").select("doc_id", "node", "same")
    least = blank.agg(F.min("doc_id").alias("least"))
    blank = blank.join(F.broadcast(least), blank["doc_id"] == least["least"]).drop("least")
    # A document's node is known again from its id and text, without its shingles.
    keep = worded.unionAll(blank).groupBy("doc_id", "node").agg(F.min("same").alias("same"), F.count(F.lit(1)).alias("n"))
    keep = written(keep.select(F.col("doc_id").alias(kept_id), F.col("same").alias(same_text), "n"), "kept")
    mine = docs.where(F.col(key).isNotNull()).withColumn(own_text, F.xxhash64(text_of(text)))
    of = (mine[key] == keep[kept_id]) & (mine[own_text] == keep[same_text])
    # Only ids that stand on several rows need a look for repeated rows.
    once = mine.join(keep.where("n = 1"), of, "left_semi").drop(own_text)
    again = mine.join(keep.where("n > 1"), of, "left_semi").dropDuplicates([key, own_text]).drop(own_text)
    return once.unionByName(again).unionByName(docs.where(F.col(key).isNull()))
