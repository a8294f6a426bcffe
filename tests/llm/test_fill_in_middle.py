"""Block rotation against plain slicing, the round trip, and odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fill_in_middle as M
from ledgerloom.llm.queries import ORACLE_SQL, op11_fill_in_middle
from tests.llm.helpers import documents, prose

ODD = ["", None, "a", "é", "漢字🙂x", "a <P> b", "<S", "<M<M", "x<", "S>", "<P><S><M>", "\n\n", "é" * 3, "ab" * 200_000, "🙂é" * 50_000]


def plain(key, text):
    """The contract by string slices."""
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    i, j = min(a % (n + 1), b % (n + 1)), max(a % (n + 1), b % (n + 1))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return "plain", None, None, text
    x, y, z = text[:i], text[i:j], text[j:]
    return ("spm", i, j - i, f"<S>{z}<P>{x}<M>{y}") if d % 100 < 20 else ("psm", i, j - i, f"<P>{x}<S>{z}<M>{y}")


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 16])
def test_rotations_are_slices_changed_about(monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        raw = rng.randbytes(rng.randrange(60))
        a, b, c = sorted(rng.randrange(len(raw) + 1) for _ in range(3))
        data = bytearray(raw)
        M.rotate(data, a, b, c)
        assert data == raw[:a] + raw[b:c] + raw[a:b] + raw[c:]
        M.rotate(data, a, a + c - b, c)
        assert data == raw


def test_every_cut_comes_back():
    for text in ("", "x", "ab<", "<S<P<M", "né🙂", "<<>>"):
        raw = text.encode()
        for i in range(len(raw) + 1):
            for j in range(i, len(raw) + 1):
                x, y, z = raw[:i], raw[i:j], raw[j:]
                for form, want in (("psm", b"<P>" + x + b"<S>" + z + b"<M>" + y), ("spm", b"<S>" + z + b"<P>" + x + b"<M>" + y), ("plain", raw)):
                    out = M.arrange(raw, i, j, form)
                    assert out == want and M.rebuild(out, form) == raw


def test_rows(spark):
    texts = [*ODD, *prose(3, 150)]
    ids = [37 * i % 1009 for i in range(len(texts))]
    docs = documents(spark, texts, ids=ids).withColumnRenamed("lang", "output").withColumnRenamed("source", "form")
    made = M.transform(docs)
    got = {r["doc_id"]: r for r in M.restore(made).collect()}
    forms = set()
    for k, t in zip(ids, texts, strict=True):
        form, first, middle, out = plain(k, t or "")
        forms.add(form)
        r = got[k]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) == (len(t or ""), form, first, middle, out, t or "")
    assert forms == {"plain", "psm", "spm"} and len(got) == len(texts)


def test_restore_takes_any_rows(spark):
    rows = spark.createDataFrame([(1, "<P>a<S>c<M>b", "psm"), (2, None, "psm"), (3, "x", None), (4, "x", "plain")], "id long, o string, f string")
    got = M.restore(rows, "o", "f", "text")
    assert got.columns == ["id", "o", "f", "text"] and [r["text"] for r in got.orderBy("id").collect()] == ["abc", None, None, "x"]
    with pytest.raises(ValueError):
        M.restore(rows, "o", "f", "F")


def test_nothing_repeats_and_null_ids(spark):
    assert M.round_trip(documents(spark, ["x"]).limit(0)).count() == 0
    docs = documents(spark, ["one two three"] * 3 + [None], ids=[5, 5, None, None])
    got = M.round_trip(docs).collect()
    assert sorted((r["doc_id"] is None, r["n"]) for r in got) == [(False, 13), (False, 13), (True, 0), (True, 13)]
    assert len({r["output_sha256"] for r in got if r["doc_id"] == 5}) == 1


def test_slices_of_output(spark, monkeypatch):
    texts = ["x" * 9_000_000, "y" * 9_000_000, "z"]
    got = M.round_trip(documents(spark, texts)).collect()
    assert {r["doc_id"]: r["restored_sha256"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


def test_query_against_sql(spark, tmp_path):
    import duckdb

    documents(spark, [*ODD, *prose(4, 60)]).withColumn("text", F.col("text")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op11_fill_in_middle"]).fetchall())
    assert sorted(map(tuple, op11_fill_in_middle(spark, str(tmp_path)).collect())) == want
