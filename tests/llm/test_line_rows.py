"""Line dedup where rows share an id and columns clash."""

from ledgerloom.llm import line_dedup
from tests.llm.helpers import documents


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    texts = ["common line\nbody %d" % i for i in range(12)] + ["precious line\ncommon line", "other\ncommon line", "other\ncommon line"]
    docs = documents(spark, texts, ids=[*range(12), 5, 5, 5])
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_boilerplate(docs).collect())
    want = [(0, "common line\nbody 0")] + [(i, f"body {i}") for i in range(1, 12)] + [(5, "precious line"), (5, "other"), (5, "other")]
    assert got == sorted(want)


def test_clashing_columns_and_long_texts(spark):
    texts = ["shared\n" + "x y\n" * 50_000 + str(i) for i in range(11)]
    docs = documents(spark, texts).selectExpr("*", "1 AS n_lines", "'u' AS n_dropped", "2 AS gone", "3 AS own_doc", "4 AS row", "5 AS _doc", "6 AS _gone")
    got = line_dedup.drop_boilerplate(docs)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    for r in got.collect():
        assert (r["n_lines"], r["n_dropped"], r["gone"], r["row"], r["_gone"]) == (1, "u", 2, 4, 6)
        assert r["text"] == (texts[0][: len("shared\nx y\n")] + "0" if r["doc_id"] == 0 else str(r["doc_id"])) and r["n_chars"] == len(r["text"])
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0
