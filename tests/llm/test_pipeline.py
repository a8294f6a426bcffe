"""The pipeline on planted cases, against the same steps in plain Python."""

import random

import pytest

import corpus_pipeline
from ledgerloom.llm import line_dedup
from tests.llm.helpers import DOCS, words
from tests.llm.test_near_dedup import plain_kept
from tests.llm.test_text_operators import near, plain_lines


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng, folder = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    text = lambda: " ".join(words(rng, rng.randrange(150, 300), 4000))
    items = [(i, " ".join(words(rng, 35, 4000))) for i in range(8)]
    texts, toxic, leaks = [text() for _ in range(300)], set(range(0, 300, 6)), set(range(1, 300, 30))
    for i in toxic:
        w = texts[i].split()
        w.insert(5, "Vile"), w.insert(50, f"grobian{i}")
        texts[i] = " ".join(w)
    for i in leaks:
        texts[i] += " " + items[i % 8][1]
    for i in range(2, 60, 6):
        texts += [texts[i], near(rng, texts[i])]
    for i in range(3, 300, 6):
        texts[i] += "\nAll rights reserved, as on every site."
    docs = [(i, t, "en", f"s{i % 17}", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", None, None), (901, "", "en", "s1", 0)]
    labels = [(i, 1, int(i in toxic)) for i in range(300) if i % 2 == 0 or i % 5]
    write(spark, folder, docs, labels, items)
    return folder, docs, toxic, leaks


def test_stages_against_plain_steps(spark, planted):
    folder, docs, toxic, leaks = planted
    tables, rows = [spark.read.parquet(f"{folder}/documents.parquet")], [{d[0]: d for d in docs}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], folder).cache())
        assert tables[-1].dtypes == tables[0].dtypes
        rows.append({r["doc_id"]: tuple(r) for r in tables[-1].collect()})
    assert set(rows[1]) == set(rows[0]) - toxic
    want = plain_lines([(k, r[1], r[3]) for k, r in rows[1].items()], line_dedup.SITES)
    assert {k: r[1] for k, r in rows[2].items()} == want and any(want[k] != r[1] for k, r in rows[1].items())
    # The stage's rule: five-word shingles, similarity 0.8 or more.
    order = sorted(rows[2])
    kept = plain_kept([rows[2][k][1] for k in order])
    assert set(rows[3]) == {order[i] for i in kept} and len(rows[3]) < len(rows[2]) - 10
    assert set(rows[4]) == set(rows[3]) - leaks


def test_run(spark, planted):
    folder, *_ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)


def test_no_documents(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
