"""The mixed model predicts held-out documents better than unigram counts."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lm_mixing

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_held_out_above_base(spark):
    rows = lm_mixing.score(spark.read.parquet(DATA)).groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.min("bits_per_byte").alias("least")).collect()
    assert {r["held_out"] for r in rows} == {True, False}
    for r in rows:
        assert r["score"] > r["base"] and r["least"] > 0


def test_very_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b " * 300_000), (2, None), (None, "b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_mixing.score(docs).collect()}
    assert got[1]["n_tokens"] == 600_001 and got[2]["n_tokens"] == 1 and len(got) == 3
    assert lm_mixing.score(docs.limit(0)).count() == 0
