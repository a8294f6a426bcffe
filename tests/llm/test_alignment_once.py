"""Alignment encodes each text once: the second pass reads the ids that the first kept."""

from ledgerloom.llm import alignment
from ledgerloom.llm.tokens import encoder, tokenizer_path
from tests.llm.helpers import documents, prose


def test_texts_are_read_and_encoded_once(spark, tmp_path):
    texts, path = [*prose(3, 30), "", None, " a  b ", "x\ty\n", "\U0001f600 é"], str(tmp_path / "documents")
    documents(spark, texts).write.parquet(path)
    rows = alignment.align(spark.read.parquet(path), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    assert rows.inputFiles() and not any(path in f for f in rows.inputFiles())
    got = {r["doc_id"]: r for r in rows.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        a = [int(x) for g in got[i]["groups"].split(";") for x in g.split("|")[0].split(",") if x]
        assert a == (encoder(tokenizer_path(), special=False).whole(f" {t}") if t else []), t
