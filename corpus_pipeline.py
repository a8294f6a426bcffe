"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the rows are written as Parquet and read again. All stages
but the last return the columns of documents. Every stage takes null, empty and
repeated rows, empty tables and further columns as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontam, line_dedup, near_dedup, packing, toxicity
from ledgerloom.llm.shared import table, written
from ledgerloom.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Null and empty texts stay; repeated
    rows are judged alike; a table without labels drops none."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all texts but the first; no document goes."""
    marked = line_dedup.drop_boilerplate(docs)
    return marked.drop(*marked.columns[len(docs.columns) :])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of 0.8 or more stays: the one of
    the least id. SimHash classes come first, an exact check of the sets follows. Rows with
    a null id stay."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces of 1024-token sequences; a null text is empty and packs its end
    alone."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifiers, fingerprints and byte-pair codes have no SQL form.
ORACLE_SQL = None
