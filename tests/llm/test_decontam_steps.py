"""Decontamination's steps on many words at once against one word at a time."""

import zlib

import numpy as np

from ledgerloom.llm import decontam


def test_word_numbers_of_many_pieces():
    vocabulary = {"the": 0, "straße": 1, "σας": 2, "i": 3}
    pieces = ["The", "", "the-STRASSE.straße", "ΣΑΣ", "Σ", "a_b\nThe\tΣΑΣ", "İ", "...", "日本語42", "I", "\U0001f600", ""]
    number = lambda w: vocabulary.get(w, len(vocabulary) + zlib.crc32(w.encode("utf-8", "surrogatepass")) % decontam.HASHED)
    want = [[number(w) for w in decontam.words_of(x)] for x in pieces]
    got, n = decontam.word_numbers(pieces, vocabulary)
    assert n.tolist() == [len(x) for x in want]
    assert got.dtype == np.uint32 and got.tolist() == [i for x in want for i in x]
    for few in ([], [""], ["..."]):
        got, n = decontam.word_numbers(few, vocabulary)
        assert len(got) == 0 and n.tolist() == [0] * len(few)


def test_row_sums_of_equal_keys():
    rng = np.random.default_rng(1)
    rows, key = rng.standard_normal((50, 7)).astype(np.float32), np.sort(rng.zipf(1.5, 2000) % 300)
    at = rng.integers(0, 50, len(key))
    keys, sums = decontam.row_sums(rows, at, key)
    assert keys.tolist() == sorted(set(key.tolist()))
    for k, x in zip(keys, sums, strict=True):
        np.testing.assert_allclose(x, rows[at[key == k]].astype(float).sum(0), atol=1e-3)
    keys, sums = decontam.row_sums(rows, at[:0], key[:0])
    assert len(keys) == 0 and sums.shape == (0, 7)
