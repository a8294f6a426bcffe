"""Line dedup: lines spread over many sites are boilerplate and stay only once.

Spark SQL functions only. For each line hash the sites go into HyperLogLog
sketches that merge in the aggregation; a line whose estimate lies within MARGIN
of the threshold gets an exact distinct count, the others are decided by the
sketch. Only hashes are shuffled for that; the text moves once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import fresh, written

#: A line on so many distinct sites is boilerplate. MARGIN: relative half-width of
#: the band in which estimates are checked; a sketch of 2**LOG_K registers has a
#: standard error of about 1.04 / 2**(LOG_K / 2), here 1.6 %: over 12 of them.
SITES, MARGIN, LOG_K = 10, 0.2, 12


def _lines(text: Column | str = "text") -> Column:
    return F.split(F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit("")), "\n")


def _row_key() -> Column:
    """Tells rows apart that share a doc_id: a hash of their text and site."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")))


def _line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, row key, site, position and 128 hash bits of every line with visible
    characters."""
    rows = docs.select("doc_id", _row_key().alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(_lines()).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(r"\S"))
    return rows.select("doc_id", "row", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("g"))


def boilerplate(keys: DataFrame, sites: int = SITES) -> DataFrame:
    """(h, g, first): the lines on at least `sites` distinct sites, and where each
    stands first by (doc_id, pos, row key). Null sites count as one site."""
    spread = keys.groupBy("h", "g").agg(F.hll_sketch_agg(F.xxhash64("site"), LOG_K).alias("sketch"), F.min(F.struct("doc_id", "pos", "row")).alias("first"))
    spread = spread.select("h", "g", "first", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= sites * (1 - MARGIN))
    spread = written(spread, "line-spread")
    sure = spread.where(F.col("n") > sites * (1 + MARGIN)).select("h", "g", "first")
    near = spread.where(F.col("n") <= sites * (1 + MARGIN)).select("h", "g", "first")
    exact = keys.join(near.select("h", "g"), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= sites)
    return sure.unionAll(near.join(exact.select("h", "g"), ["h", "g"], "left_semi"))


def drop_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with text (and n_chars, if there) without boilerplate, and two columns
    more: the number of lines and of dropped ones, named n_lines and n_dropped (with
    underscores after it where docs has a column of that name).

    A line is compared whole, as it stands between line feeds; lines of white
    space only are never boilerplate. Of each boilerplate line the first occurrence
    by (doc_id, position) stays, so no content is lost. A null text stays null and
    counts as one empty line. Rows that share a doc_id are told apart by their text
    and site; rows equal in all three are treated alike, as one: a line that stays in
    one stays in all. Rows with a null doc_id keep their lines (they count for the
    spread). Other columns stay as they are. An empty table gives an empty table.
    """
    n_lines, n_dropped, gone_at, own_id, own_row, row = fresh(docs, "n_lines", "n_dropped", "gone", "own_doc", "own_row", "row")
    keys = _line_keys(docs)
    common = written(boilerplate(keys, sites), "boilerplate")
    met = keys.where(F.col("doc_id").isNotNull()).join(common, ["h", "g"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")) & (F.col("row") == F.col("first.row"))
    gone = met.where(~is_first).groupBy("doc_id", "row").agg(F.collect_set("pos").alias(gone_at))
    gone = written(gone.select(F.col("doc_id").alias(own_id), F.col("row").alias(own_row), gone_at), "dropped-lines")
    joined = docs.withColumn(row, _row_key()).join(gone, (F.col("doc_id") == F.col(own_id)) & (F.col(row) == F.col(own_row)), "left")
    lines = _lines()
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_at)))
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumns({n_lines: F.size(lines).cast("long"), n_dropped: F.coalesce(F.size(gone_at), F.lit(0)).cast("long")}).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone_at).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.drop(own_id, own_row, row, gone_at)
