"""Market metadata: temporal splits, labels, reports on what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators.ranking import numbered


def temporal_split(markets: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """markets (market_id, end_ts) with a split: the oldest share is train, the next
    val, the rest test, by (end_ts, market_id), markets without an end last. Places come
    from ranges of that order, so no task orders all markets."""
    rows, n = numbered(markets, [F.col("end_ts").asc_nulls_last(), "market_id"], "_place")
    share = (F.col("_place") + 1) / F.lit(max(n, 1))
    return rows.select(*markets.columns, F.when(share <= train, "train").when(share <= train + val, "val").otherwise("test").alias("split"))


def market_meta(splits: DataFrame, labels: DataFrame) -> DataFrame:
    """(market_id, split, y) of the markets that have a label."""
    return splits.join(labels, "market_id").select("market_id", "split", F.col("y").cast("int").alias("y"))


def with_split(features: DataFrame, meta: DataFrame) -> DataFrame:
    """Features with split and label_y, null for markets without metadata."""
    return features.join(meta.select("market_id", "split", F.col("y").cast("float").alias("label_y")), "market_id", "left")


def unknown_markets(features: DataFrame, meta: DataFrame) -> DataFrame:
    return features.select("market_id").distinct().join(meta, "market_id", "left_anti")


def path_report(index: DataFrame, marker: str, path: str = "path") -> DataFrame:
    """What project_path would change, without changing it: the number of rows, of
    distinct paths before and after, of changed rows, and of rows without the marker."""
    new = S.project_path(path, marker)
    rows = index.select(F.col(path).alias("old"), new.alias("new"))
    has = F.lower(F.regexp_replace("old", r"\\", "/")).contains(marker.lower() + "/")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("old").alias("n_paths"), F.count_distinct("new").alias("n_new_paths"), F.count_if(F.col("old") != F.col("new")).alias("n_changed"), F.count_if(~has).alias("n_without_marker"))


def split_counts(features: DataFrame) -> DataFrame:
    """Rows of each split and in all (split null: the total)."""
    return features.where(F.col("split").isNotNull()).rollup("split").agg(F.count(F.lit(1)).alias("n_rows"))
