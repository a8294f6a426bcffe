"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of PASSAGE words over the whole corpus's vocabulary: words of the
benchmark have numbers of their own, all others share HASHED slots. The TF-IDF matrix
A of all passages gets a randomised SVD: Spark sums the sketch Z = A'(A G) in one
pass, G being Gaussian, and the singular vectors L of the words follow from Z and G by
the Nystroem form. The items' passages are rows of A too, with ITEMS times the energy
of the corpus, so that the few dimensions that are kept (a third as many as there are
items) serve to tell items apart. Every window of the documents (two half passages, so
that windows overlap by half) is compared with every item passage by the cosine of
their images in that space. Near ones that hold enough of the passage's words are
checked word by word: the longest common subsequence with the item, and with the
item's end, which holds its answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop_table, fresh, text_of, written
from ledgerloom.llm.tokens import Known

#: NEAR: least cosine of a candidate. MATCH, ANSWER: least common share of the item's
#: words and of its last quarter's. BLOCK: items searched at once. RANK: dimensions, a
#: third of the items within these bounds. SLACK: share of MATCH that a candidate's
#: words need before order counts. Words of any frequency carry weight, so that an
#: item that leaks often is found.
PASSAGE, HASHED, ITEMS, NEAR, MATCH, ANSWER, BLOCK, RANK, SLACK = 64, 1 << 14, 10.0, 0.55, 0.65, 0.5, 1024, (16, 256), 0.8
ROWS, WORDS = 1024, 60_000
FOUND = "doc_id long, same long, item_id long, cosine double, common double, answer double, start long"
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_BLANK = re.compile(r"[^\W_]+| ")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_numbers(pieces: list[str], vocabulary: dict[str, int]):
    """The numbers of the words of pieces without blanks, and how many each piece has."""
    from zlib import crc32

    import numpy as np

    # All at once: a blank is no part of a word, nor does the case of what stands beside
    # it depend on it.
    found = _WORD_OR_BLANK.findall(" ".join(pieces).lower())
    known = vocabulary | {" ": -1}
    numbers = np.array([known[w] if w in known else -2 - crc32(w.encode("utf-8", "surrogatepass")) % HASHED for w in found], np.int64)
    ends = np.append(np.flatnonzero(numbers == -1), len(numbers))
    words = numbers[numbers != -1]
    words = np.where(words < 0, len(vocabulary) - 2 - words, words)
    return words.astype(np.uint32), (np.diff(ends, prepend=-1) - 1 if pieces else np.zeros(0, np.int64))


def _encoded(docs: DataFrame, vocabulary: dict[str, int], text: str, key: str) -> DataFrame:
    """(doc_id, same, ids): each text's words as numbers, with a hash of the text."""

    def made(pieces):
        return word_numbers(pieces.to_numpy(zero_copy_only=False).tolist(), vocabulary)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = Known(made, 250_000)
        for batch in batches:
            texts, k = batch.column(2), 0
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else []
            while k < len(texts):  # slices of 4 MB: a word has no blank, so pieces between blanks are taken apart once
                stop = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + 4_000_000)))
                cut = pc.split_pattern(texts.slice(k, stop - k), " ")
                pieces = cut.flatten().dictionary_encode()
                flat, start, length = known.of(pieces.dictionary)
                at, of = pieces.indices.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))
                n = length[at]
                ends = np.append(0, np.cumsum(n))
                place = np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])
                raw, ends = pa.py_buffer(flat[place].astype("<u4").tobytes()), ends[of] * 4
                ids = pa.Array.from_buffers(pa.large_binary(), stop - k, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, stop - k), batch.column(1).slice(k, stop - k), ids], ["doc_id", "same", "ids"])
                k = stop

    return docs.select(F.col(key).cast("long"), F.xxhash64(text_of(text)), text_of(text)).mapInArrow(run, "doc_id long, same long, ids binary")


def _parts(column) -> Iterator:
    """Runs of a batch's documents of about WORDS words: first row, lists of numbers."""
    import numpy as np

    own, first, size = [], 0, 0
    for i, x in enumerate(column):
        own.append(np.frombuffer(x.as_buffer(), "<u4"))
        size += len(own[-1])
        if size >= WORDS:
            yield first, own
            own, first, size = [], i + 1, 0
    if own:
        yield first, own


def cut(rows: list, size: int, nothing: int):
    """The rows' pieces of `size` numbers, one below the other, filled up with
    `nothing`; and how many pieces each row has."""
    import numpy as np

    lengths = np.array([len(r) for r in rows], np.int64)
    n = -(-lengths // size)
    out = np.full(int(n.sum()) * size, nothing, np.int32)
    begin = (np.cumsum(n) - n) * size
    for r, b in zip(rows, begin.tolist(), strict=True):
        out[b : b + len(r)] = r
    return out.reshape(-1, size), n


def _sums(table, pieces):
    """For each piece the sum of its words' rows of the table."""
    import numpy as np

    out = np.empty((len(pieces), table.shape[1]), np.float32)
    for k in range(0, len(pieces), ROWS):
        table[pieces[k : k + ROWS]].sum(1, out=out[k : k + ROWS])
    return out


def _frequencies(encoded: DataFrame, size: int):
    """In how many passages each word stands, and how many passages there are."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for _, rows in _parts(batch.column(0)):
                pieces, _ = cut(rows, PASSAGE, size)
                pieces.sort(axis=1)
                new = np.ones(pieces.shape, bool)
                new[:, 1:] = pieces[:, 1:] != pieces[:, :-1]
                total += np.bincount(pieces[new], minlength=size + 1)
                n += len(pieces)
        at = np.flatnonzero(total[:size])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["word", "n"])

    out, n = np.zeros(size, np.int64), 0
    for r in encoded.select("ids").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            n = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, n


def row_sums(rows, at, key):
    """Sums of the rows `at` that have equal keys (in order): the keys and their sums. Keys
    with equally many rows are summed at once."""
    import numpy as np

    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(key)))
    out, by = np.empty((len(start), rows.shape[1]), rows.dtype), np.argsort(n, kind="stable")
    for own in np.split(by, np.flatnonzero(np.diff(n[by])) + 1) if len(by) else []:
        out[own] = rows[at[start[own][:, None] + np.arange(n[own[0]])]].sum(1)
    return key[start], out


def gram(pieces, idf, weighted):
    """The keys and rows of A'(A test) for these passages; A has rows of length one.
    weighted: test, each word's row times its idf."""
    import numpy as np

    y = _sums(weighted, pieces) / np.maximum((idf[pieces] ** 2).sum(1), 1e-9)[:, None]
    flat = pieces.ravel()
    by = np.argsort(flat.astype(np.uint16) if len(weighted) < 1 << 16 else flat, kind="stable")  # small numbers are sorted by their digits
    words, sums = row_sums(y, by // pieces.shape[1], flat[by])
    return words, sums * idf[words][:, None]


def _sketch(encoded: DataFrame, idf, test):
    """Z = A'(A test) over all passages of the corpus, a row for each word."""
    import numpy as np

    (size, rank), weighted = test.shape, test * idf[:, None]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        z = np.zeros((size, rank), np.float32)
        for batch in batches:
            for _, rows in _parts(batch.column(0)):
                pieces, _ = cut(rows, PASSAGE, size - 1)
                for k in range(0, len(pieces), ROWS):
                    words, sums = gram(pieces[k : k + ROWS], idf, weighted)
                    z[words] += sums
        at = np.flatnonzero(z.any(1))
        flat = pa.array(z[at].astype(np.float64).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.FixedSizeListArray.from_arrays(flat, rank).cast(pa.list_(pa.float64()))], ["word", "z"])

    parts = encoded.select("ids").mapInArrow(run, "word long, z array<double>").groupBy("word")
    out = np.zeros((size, rank))
    for r in parts.agg(F.array(*[F.sum(F.col("z")[j]) for j in range(rank)]).alias("z")).toLocalIterator():
        out[r["word"]] = r["z"]
    return out


def latent_words(z, test):
    """The right singular vectors of A (words x rank) from Z = A'A test."""
    import numpy as np

    core = test.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(initial=0), 1e-12) * 1e-6
    if not keep.any():
        return np.zeros((len(z), 1))
    u, s, _ = np.linalg.svd(z @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u[:, s > s[0] * 1e-4]


def common_length(a: list[int], b) -> int:
    """Length of the longest common subsequence, a word of b at a time over the
    bits of a number."""
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for x in b:
        m = place.get(x, 0)
        if m:
            row = (row + (row & m) | row & ~m) & whole
    return len(a) - row.bit_count()


def region(item: list[int], passage: int, half_at: int) -> tuple[int, int]:
    """Where an item whose passage fits the window from half passage half_at on can
    stand in the document: half a passage is given before and after."""
    half = PASSAGE // 2
    return max(0, (half_at - 1) * half - passage * PASSAGE), (half_at + 3) * half + max(0, len(item) - passage * PASSAGE - half)


def _search(encoded: DataFrame, size: int, table, items: list[tuple[int, list[int]]]) -> DataFrame:
    """table: the words' rows in the latent space times their weight, and a row of zeros."""
    import numpy as np

    half, (passages, n) = PASSAGE // 2, cut([x for _, x in items], PASSAGE, len(table) - 1)
    of, number = np.repeat(np.arange(len(items)), n), np.concatenate([np.arange(k) for k in n])
    image = _sums(table, passages)
    length = np.linalg.norm(image, axis=1)
    image = np.where(length[:, None] > 0, image / np.maximum(length, 1e-9)[:, None], 0).T.astype(np.float32).copy()
    passages = np.where(passages < size, passages, size)
    # So many words of the passage have to stand around its window, in any order.
    needed = np.ceil(np.where(n[of] > 1, SLACK, 1.0) * MATCH * (passages < size).sum(1)).astype(np.int32)

    def candidates(rows: list):
        """(document, half passage in it, item passage, cosine) of the windows near one."""
        pieces, n = cut(rows, half, len(table) - 1)
        if not len(pieces):
            return
        first = np.append(0, np.cumsum(n))
        last = np.zeros(len(pieces), bool)
        last[first[1:][n > 0] - 1] = True  # no window runs into the next document
        window = np.concatenate([_sums(table, pieces), np.zeros((1, table.shape[1]), np.float32)])
        window = window[:-1] + np.where(last[:, None], 0, window[1:])
        window /= np.maximum(np.linalg.norm(window, axis=1), 1e-9)[:, None]
        doc = np.repeat(np.arange(len(rows)), n)
        around = np.full((len(pieces) + 3, half), len(table) - 1, np.int32)
        around[1:-2] = pieces
        for k in range(0, len(pieces), 2 * ROWS):
            cosine = window[k : k + 2 * ROWS] @ image
            row, j = np.nonzero(cosine >= NEAR)
            if not len(row):
                continue
            windows, of_pair = np.unique(row, return_inverse=True)
            there = np.zeros((len(windows), size + 1), bool)
            for step in range(4):  # the half passages before, in and after the window
                there[np.arange(len(windows))[:, None], np.minimum(around[windows + k + step], size)] = True
            there[:, size] = False
            use = there[of_pair[:, None], passages[j]].sum(1) >= needed[j]
            at, j, row = row[use] + k, j[use], row[use]
            yield from zip(doc[at].tolist(), (at - first[doc[at]]).tolist(), j.tolist(), cosine[row, j].tolist(), strict=True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, types = ["doc_id", "same", "item_id", "cosine", "common", "answer", "start"], [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            found: dict[tuple[int, int], tuple] = {}
            for i, rows in _parts(batch.column(2)):
                for d, p, j, cosine in candidates(rows):
                    mine, have = items[of[j]][1], found.get((i + d, of[j]))
                    if have and have[1] == 1.0:
                        continue
                    begin, stop = region(mine, int(number[j]), p)
                    text = rows[d][begin:stop].tolist()
                    common = common_length(mine, text) / len(mine)
                    end = mine[-max(1, len(mine) // 4) :]
                    if common >= MATCH and (answer := common_length(end, text) / len(end)) >= ANSWER and (not have or common > have[1]):
                        found[i + d, of[j]] = (cosine, common, answer, begin)
            if found:
                keys, same = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = [(keys[d], same[d], items[j][0], *x) for (d, j), x in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return encoded.mapInArrow(run, FOUND)


def _found(docs: DataFrame, benchmark: DataFrame, text: str, key: str) -> DataFrame:
    import numpy as np

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).where(F.col("text").isNotNull())
    blocks, out = max(1, -(-items.count() // BLOCK)), None
    for b in range(blocks):
        own = [(r[0], words_of(r[1])) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()]
        own = sorted((x for x in own if x[1]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if not own:
            continue
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, x in own for w in x))}
        size = len(vocabulary) + HASHED
        encoded = written(_encoded(docs, vocabulary, text, key), "encoded-passages")
        df, n = _frequencies(encoded, size)
        idf = np.append(np.where(df > 0, np.log((n + 1) / (df + 1)) + 1, 0.0), 0.0).astype(np.float32)
        coded = [(k, [vocabulary[w] for w in x]) for k, x in own]
        test = np.random.default_rng(7).standard_normal((size + 1, min(max(len(own) // 3, RANK[0]), RANK[1]))).astype(np.float32)
        test[size] = 0
        z = _sketch(encoded, idf, test)
        passages, _ = cut([x for _, x in coded], PASSAGE, size)
        words, sums = gram(passages, idf, test * idf[:, None])
        z[words] += sums * (ITEMS * max(n, 1) / len(passages))
        latent = latent_words(z, test.astype(float)) * idf[:, None]
        latent[size] = 0
        found = written(_search(encoded, len(vocabulary), latent.astype(np.float32), coded), "contaminated")
        drop_table(encoded)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, cosine, common, answer, start): the best window of every
    document that holds an item's words: at least MATCH of them in order, and
    ANSWER of its last quarter. start: the region's first word in the document.

    Words are runs of letters and digits, lower case. Null or empty texts and items
    match nothing; rows with a null id are searched and keep the null; repeated
    rows give repeated rows; items with one id are separate items; an empty table on
    either side gives no rows. Other columns are not read. Items are taken in blocks
    of BLOCK, so that no more than a block is held at once.
    """
    return _found(docs, benchmark, text, key).drop("same")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the texts that hold a benchmark item; other texts under the same
    id stay, and so do rows with a null id. Columns stay as they are, whatever their
    names; an empty table on either side takes nothing away."""
    bad_id, bad_text = fresh(docs, "bad_id", "bad_text")
    bad = _found(docs, benchmark, text, key).select(F.col("doc_id").alias(bad_id), F.col("same").alias(bad_text)).distinct()
    return docs.join(bad, (F.col(key) == F.col(bad_id)) & (F.xxhash64(text_of(text)) == F.col(bad_text)), "left_anti")
