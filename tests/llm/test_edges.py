"""Rows that operators meet seldom: long texts, null ids, repeated rows, clashing columns."""

import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import packing, toxicity, warc
from ledgerloom.llm.tokens import tokenizer_path
from tests.llm.helpers import documents, prose, words


def clashing(docs):
    """Further columns under names that the operators use themselves, in either case."""
    names = ["node", "Same", "bands", "own", "kept", "KEYS", "p_toxic", "line", "first", "u", "v", "root", "n"]
    return docs.withColumns({c: F.lit(f"further {c}") for c in names})


def tables(spark, folder, docs, ids):
    docs.write.parquet(f"{folder}/documents.parquet")
    rng = random.Random(2)
    spark.createDataFrame([(i, rng.randrange(2), int(i % 9 == 0)) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one benchmark item of some words that no document holds at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_with_clashing_columns_and_long_texts(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(words(rng, 120_000, 4000))
    texts = [long, None, "", *prose(5, 60, 200), long + " end"]
    ids = [*range(len(texts) - 1), None]
    docs = clashing(documents(spark, texts, ids=ids)).repartition(3)
    tables(spark, tmp_path, docs, range(3, 60))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
            kept = out.collect()
            assert all(r["own"] == "further own" and r["Same"] == "further Same" for r in kept)
            docs = spark.createDataFrame(kept, docs.schema)
    pieces = out.where("doc_id = 0").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert pieces[0] == pieces[1] > 120_000


def test_packing_of_null_ids_repeats_and_clashing_columns(spark):
    texts, ids = ["one two three", "one two three", None, "four", ""], [1, 1, None, None, 2]
    docs = documents(spark, texts, ids=ids).withColumnsRenamed({"lang": "start", "source": "Length", "n_chars": "sequence_id"})
    got = packing.pack(docs, tokenizer_path(), 16).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (True, 0), (True, 0)]
    assert all(r["start"] == 0 and r["length"] == r["doc_tokens"] for r in got)
    end = zlib.crc32(np.array([0], "<u4").tobytes())
    assert sum(r["ids_crc32"] == end for r in got) == 2


def test_archives_with_clashing_columns(spark):
    pages = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, "http://c", "small")]
    plain = spark.createDataFrame(pages, "page_id long, url string, html string")
    names = ["payload_digest", "Digest", "response", "refers_to", "part", "payload_bytes", "path", "at"]
    ask = lambda df: sorted(map(tuple, warc.read_archives(warc.write_archives(df)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert ask(plain.withColumns({c: F.lit("further") for c in names})) == ask(plain)


def test_toxicity_of_very_long_text(spark):
    rng = random.Random(3)
    texts = [*prose(7, 80, 60), " ".join(words(rng, 150_000, 4000))]
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.score(documents(spark, texts), labels).collect()
    assert len(got) == len(texts) and all(0 <= r["p_toxic"] <= 1 for r in got)
