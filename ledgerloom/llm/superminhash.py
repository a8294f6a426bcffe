"""Near-duplicates by SuperMinHash signatures.

An element's ranks in the SLOTS places of a signature are correlated: with a random
fraction r_j and a random permutation p of the places, its value at place p_j is j + r_j,
so that no two of its values lie at the same level j, and a place is filled at level 0 by
about each SLOTS-th element. The least value of each place over a set's elements is the
signature; two signatures agree at a place with the chance of the sets' Jaccard
similarity, at a lower variance than with independent ranks. As soon as all places hold
values below level j, no element's later ranks can matter, and the search stops: most
sets need one or two levels.

Bands of the signature make candidates, which are confirmed on the full sets of shingles
and joined by union-find (see set_links).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import set_links

#: Words of a shingle, and least similarity in per cent. At 85 % a pair misses all of 22
#: bands of 6 places with a chance of 3 in 100,000, above it with a smaller one.
WORDS, SIMILAR, BANDS, ROWS = 3, 85, 22, 6
SLOTS = BANDS * ROWS


def _mixed(x):
    """Splitmix64's finish: random bits from a counter."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(elements, lengths, slots: int = SLOTS):
    """A row of `slots` ranks for each set: level * 2**32 plus a fraction of 32 bits.
    elements: the distinct 64-bit hashes of all sets, one set after another; lengths:
    how many each has, none zero. Ranks are those of the element-by-element algorithm;
    levels are taken for all elements at once."""
    import numpy as np

    low = np.uint64(0xFFFFFFFF)
    out = np.full((len(lengths), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    owner, x = np.repeat(np.arange(len(lengths)), lengths), elements.astype(np.uint64)
    held = np.arange(len(lengths))
    places = None
    for level in range(slots):
        z = _mixed(x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        drawn = (((z & low) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64) + level
        # The permutation's next place is exchanged with one of those that are left.
        at = drawn if places is None else places[np.arange(len(x)), drawn].astype(np.int64)
        np.minimum.at(flat, owner * slots + at, (z >> np.uint64(32)) + np.uint64(level << 32))
        left = out[held].max(1) >= np.uint64((level + 1) << 32)
        if not left.any():
            break
        more = np.zeros(len(lengths), bool)
        more[held[left]] = True
        keep, held = more[owner], held[left]
        if places is None:
            drawn = drawn[keep]
            places = np.tile(np.arange(slots, dtype=np.uint16), (len(drawn), 1))
            places[np.arange(len(drawn)), drawn] = 0
        else:
            places[np.arange(len(x)), drawn] = places[:, level]
            places = places[keep]
        owner, x = owner[keep], x[keep]
    return out


def band_keys(sets, bands: int = BANDS, rows: int = ROWS) -> list[list[int]]:
    """A signed long for each band of each set's signature."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not sets:
        return []
    ranks = signatures(np.concatenate(sets), [len(x) for x in sets], bands * rows)
    out, size = [], rows * 8
    for raw in ranks:
        raw = raw.tobytes()
        keys = [xxh64_intdigest(raw[b * size : b * size + size], b) for b in range(bands)]
        out.append([k - (k >> 63 << 64) for k in keys])
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SIMILAR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs. n_shingles:
    the number of distinct shingles; component_id: the least doc_id reachable over pairs
    with 100 * common >= share * union; kept: whether that is the row's own.

    Texts without words (null, empty, blank) have an empty set and link to nothing, not
    even to each other. Repeated rows give repeated rows, all kept or none; different
    texts under one id are different documents, each with its own component. A null id
    takes part: a component of null ids only has a null component_id and is not kept.
    Texts are whole, however long; other columns, whatever their names, are not read. An
    empty table gives no rows."""
    rows = set_links.grouped(docs, words, share, band_keys, text, key)
    found = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(False)).alias("kept"))
