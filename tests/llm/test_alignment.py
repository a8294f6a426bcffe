"""Alignment and pair counts against plain Python, and the perfect hash."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import alignment as L
from ledgerloom.llm.pair_hash import PairHash
from ledgerloom.llm.piece_tokens import BROKEN, piece_encoder
from ledgerloom.llm.tokens import tokenizer_path
from tests.llm.helpers import documents, prose

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, " ", "   ", "a", " a", "a ", "  two  blanks ", "\n", "a\nb\n\n c", "x\t y", "it's 12 34,5 !! don't", "é è ß ñandú — 漢字 🙂", "a▁b", "▁", "<s> </s> <unk>", "<|endoftext|> x", "<0x41>", "\x00", "a\xa0b　c", "ﬁn", "a" * 3000, "word " * 2000, "\r\n \r\n end", " \x1cq"]


def byte_of():
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
    return {c: b for b, c in shown.items()}


@pytest.fixture(scope="module")
def plain():
    """Per text (a ids, b ids, groups, links), by the libraries on whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, back = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def one(text):
        if not text:
            return [], [], [], []
        x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        xs, ys = [bytes(back[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if b"".join(xs) != f" {text}".encode() or b"".join(ys) != f" {text}".encode():
            return [], [], [], []
        spans = []
        for parts in (xs, ys):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append(tuple([i for i, (s, t) in zip(ids, sp, strict=True) if low <= s and t <= e] for ids, sp in zip((x, y), spans, strict=True)))
            low = e
        links, j = [], 0
        for i, (s, t) in zip(x, spans[0], strict=True):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(y) and spans[1][k][0] < t:
                links.append((i, y[k]))
                k += 1
        return x, y, groups, links

    return one


def expected(plain, texts):
    each = [plain(t) for t in texts]
    count = Counter(link for _, _, _, links in each for link in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, groups, links in each:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), shown))
    return out, count, best


def texts_of(seed):
    rng = random.Random(seed)
    pieces = [" ", "  ", "\n", ".", ",", "'s", "\t", "Ab", "zoo", "9", "é", "***", "<s>", "▁", "漢", "x'y", "_", "tion", "the", " the"]
    return [*ODD, *prose(seed, 20), *["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(150)]]


def test_pieces_are_those_of_whole_texts():
    import pyarrow as pa
    from sentencepiece import SentencePieceProcessor

    own, library = piece_encoder(B), SentencePieceProcessor(model_file=B)
    assert own.cuts
    texts = [t for t in texts_of(1) if t]
    ids, count, good = own.of(pa.array(["left out", *texts]).slice(1))
    at = 0
    for t, n, g in zip(texts, count, good, strict=True):
        if g:
            assert ids[at : at + n].tolist() == library.encode(t), repr(t)
        else:
            assert "▁" in t and BROKEN in ids[at : at + n]
        at += n


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, np.uint64))
    made = PairHash.of(keys)
    assert sorted(made.index(keys)) == list(range(len(keys)))
    again = PairHash(made.sizes, made.words)
    other = np.random.default_rng(1).integers(2**63, 2**64 - 1, 100, np.uint64)
    assert (again.index(keys) == made.index(keys)).all() and (again.index(other) < max(n, 1)).all()
    if n > 1:
        with pytest.raises(ValueError):
            PairHash.of(np.array([5, 5], np.uint64))


@pytest.mark.parametrize("limits", [{}, {"HELD": 50, "FAN": 2, "KEPT": 1, "BATCH": 10, "PART": 40}])
def test_rows_and_counts(spark, plain, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(L, k, v)
    texts = texts_of(2)
    want, count, best = expected(plain, texts)
    docs = documents(spark, texts).withColumnRenamed("lang", "groups").withColumnRenamed("source", "n_a").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in L.align(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == want
    pairs = L.pair_counts(docs, L.pair_tables(docs, A, B)).collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs} == count and len(pairs) == len(count)
    assert all(r["best"] == (r["n"] == best[r["b_id"]]) for r in pairs)


def test_slices(spark, plain, monkeypatch):
    from ledgerloom.llm import tokens

    monkeypatch.setattr(tokens, "SLICE", 300)
    import pyarrow as pa

    texts = [t or "" for t in texts_of(3)]
    want, _, _ = expected(plain, texts)
    got = []
    for k, stop, found in L.aligned(pa.array(texts), A, B):
        assert k == len(got)
        got += zip(*(x.tolist() for x in found.counts), found.groups(50257, 32000), strict=True)
        assert len(got) == stop
    assert [(*x[:4], x[4].decode()) for x in got] == [(*w[:4], w[6]) for w in want]


def test_nothing_repeats_and_null_ids(spark):
    assert L.align(documents(spark, ["x"]).limit(0), A, B).count() == 0
    assert L.align(documents(spark, [None, ""]), A, B).select("n_a", "groups").distinct().collect() == [(0, "")]
    docs = documents(spark, ["one two"] * 3, ids=[4, 4, None])
    rows = L.align(docs, A, B).withColumn("sha", L.groups_digest()).collect()
    assert sorted(r["doc_id"] is None for r in rows) == [False, False, True]
    assert {r["count_sum"] for r in rows} == {3 * rows[0]["n_links"]} and {r["sha"] for r in rows} == {hashlib.sha256(rows[0]["groups"].encode()).hexdigest()}


def test_changed_documents_are_noticed():
    import tempfile

    path = f"{tempfile.mkdtemp()}/pairs"
    keys = np.arange(10, dtype=np.uint64)
    own = PairHash.of(keys)
    kept = np.empty_like(keys)
    kept[own.index(keys)] = keys
    L._save(path, {"sizes": own.sizes}, own.words, kept)
    assert sorted(L.Pairs(path).index(keys)) == list(range(10))
    with pytest.raises(ValueError):
        L.Pairs(path).index(np.array([77], np.uint64))
