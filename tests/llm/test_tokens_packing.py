import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import packing, token_files
from ledgerloom.llm.tokens import encoder, tokenizer_path
from tests.llm.helpers import documents, prose

ODD = ["", None, " ", "a", "  two  blanks ", "line\nfeed\n\n x\n", "it's 12 34,5 !! don't", "é è ß ñandú — 漢字 🙂", "x <|endoftext|> y", "<|endoftext|>", "tab\t x\x1c y", " \x1cq", "mixed\r\n \r\n end", "a" * 5000, "word " * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(library):
    own = encoder(tokenizer_path())
    rng = random.Random(3)
    pieces = [" ", "  ", "\n", ".", ",", "'s", "\t", "Ab", "zoo", "9", "é", "***", "<|endoftext|>", " ", "x'y", "_"]
    texts = [*ODD, *prose(1, 30), *["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(400)]]
    for t in texts:
        assert own.encode(t or "").tolist() == library(t), repr(t)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    words = token_files.pack_bits(ids, bits)
    assert (token_files.unpack_bits(words, bits, 1000) == ids).all() and len(words) == -(-1000 // 64) * bits


def test_bits_for():
    assert [token_files.bits_for(n) for n in (0, 1, 2, 3, 50257, 65536, 65537)] == [1, 1, 1, 2, 16, 16, 17]


def test_files(spark, library):
    texts = [*ODD, *prose(2, 40)]
    docs = documents(spark, texts, ids=[7 * i % 101 for i in range(len(texts))]).withColumnRenamed("lang", "k")
    manifest = token_files.write_token_files(docs, tokenizer_path())
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.read_token_files(manifest).collect()}
    start = 0
    for k, t in sorted((7 * i % 101, t) for i, t in enumerate([x or "" for x in texts])):
        ids = [*library(t), 2]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    file = token_files.Reader(manifest.orderBy("part", "seq").first()["path"])
    whole = file.ids(0, file.n)
    assert (file.ids(5, 9) == whole[5:14]).all() and file.ids(3, 0).size == 0


def test_files_of_nothing_and_repeats(spark):
    none = token_files.write_token_files(documents(spark, ["x"]).limit(0), tokenizer_path())
    assert token_files.read_token_files(none).count() == 0
    twice = token_files.write_token_files(documents(spark, ["x y", "x y", None], ids=[1, 1, None]), tokenizer_path())
    got = sorted(map(tuple, token_files.read_token_files(twice).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 1] and [r[1] for r in got] == [0, 1, 4]


def check(pieces, lengths, capacity):
    by_doc, by_seq = {}, {}
    for d, start, n, s, offset in pieces:
        assert n > 0
        by_doc.setdefault(d, []).append((start, n))
        by_seq.setdefault(s, []).append((offset, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(by_doc.get(d, [])):
            assert start == at
            at += size
        assert at == n
    for rows in by_seq.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(by_seq) == -(-sum(n % capacity for n in lengths) // capacity) + sum(n // capacity for n in lengths)


def test_assignment_is_a_cut_of_all_ids():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.choice([1, 3, rng.randrange(1, 40), rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 30))]
        check(packing.assign(lengths, 16)[0], lengths, 16)


def test_costs_are_balanced():
    lengths = [200] * 40 + [20] * 400
    _, costs = packing.assign(lengths, 1024)
    assert max(costs[:-1]) < 1.2 * min(costs[:-1])


def test_pack(spark, library):
    texts = [*ODD, *prose(4, 60, 400)]
    got = packing.pack(documents(spark, texts), tokenizer_path(), 256).collect()
    ids = {i: [*library(t), 0] for i, t in enumerate(texts)}
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    assert packing.pack(documents(spark, ["x"]).limit(0), tokenizer_path()).count() == 0


def test_ids_of_columns(library):
    import pyarrow as pa

    own, rng = encoder(tokenizer_path()), random.Random(6)
    own.words.clear(), own.units.clear()
    texts = [t or "" for t in ODD] + prose(8, 60) + [" ", " x", "\n", "l'eau d'été 'tis", "a\nb\nc.\nd", "　wide\xa0blank", "١٢ ²³ ǅ"]
    for _ in range(3):
        rng.shuffle(texts)
        for k, ids, ends in own.slices(pa.array(["skipped", *texts]).slice(1), 7):
            for i in range(len(ends) - 1):
                assert ids[ends[i] : ends[i + 1]].tolist() == [*library(texts[k + i]), 7]
    assert list(own.slices(pa.array([], pa.string()))) == []


def test_few_needless_cuts():
    rng = random.Random(9)
    lengths = [rng.randrange(1, 60) for _ in range(2000)]
    pieces, costs = packing.assign(lengths, 64)
    assert len(pieces) - len(lengths) < len(costs) / 2
