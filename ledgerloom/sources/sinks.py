"""Feature, sequence, scaler and report tables on disk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_ROWS, META = 2_000_000, "_market_meta.parquet"
#: Shards of the sequence stores.
SHARDS = {"train": 256, "val": 64, "test": 64}


def write_features(features: DataFrame, path: str, rows_per_file: int = CHUNK_ROWS) -> None:
    features.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_by_split(features: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """One folder a split; rows without a split are left out. The markets' metadata, if
    given, goes into the same folder under a name that reads of the features skip."""
    features.where(F.col("split").isNotNull()).write.partitionBy("split").parquet(path)
    if meta is not None:
        meta.write.parquet(f"{path}/{META}")


def write_sequences(tokens: DataFrame, path: str, key: str, files: int = sum(SHARDS.values()), row_group_bytes: int = 8 << 20) -> None:
    """Sharded store: files of one (split, shard), sorted by key and time, in zstd.
    One pass: rows go to their shard's task (one for each shard) and are sorted there.
    Row groups of row_group_bytes: small ones let a key be read without its neighbours."""
    rows = tokens.repartition(files, "split", "shard").sortWithinPartitions("split", "shard", key, "timestamp", "trade_uid")
    rows.write.partitionBy("split", "shard").option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(path)


def write_user_history(history: DataFrame, path: str) -> None:
    """Flat store in ranges of user_hash; a heavy user's rows are split by time."""
    rows = history.repartitionByRange("user_hash", "timestamp").sortWithinPartitions("user_hash", "timestamp")
    rows.write.option("compression", "zstd").parquet(path)


def write_scaler(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.json(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("column string, mean double, std double, count long").json(path)


def write_report(metrics: DataFrame, path: str, run: Mapping[str, str]) -> None:
    """Metrics with the run's own columns (model, checkpoint and so on) as JSON."""
    metrics.withColumns({k: F.lit(v) for k, v in run.items()}).coalesce(1).write.json(path)


def read_key(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """The rows of one market or user, in order: sorted files are skipped by their
    least and largest keys."""
    return spark.read.parquet(path).where(F.col(key) == value).orderBy("timestamp")


def write_index(index: DataFrame, path: str, key: str) -> None:
    """The index of a sequence store, sorted by key, so that a look-up reads few row groups."""
    index.repartitionByRange(key).sortWithinPartitions(key, "split").write.parquet(path)


def read_range(spark: SparkSession, path: str, index_path: str, key: str, *values: str) -> DataFrame:
    """The rows of these markets or users, with their place in their run (from 0), read by
    the index: the look-up (a row for each key and split asked for) names the shards, only
    their folders are listed, and within them row groups are skipped by their keys. Raises
    ValueError if a run has not the length that the index says."""
    index = spark.read.parquet(index_path)
    runs = index.where(F.col(key).isin(list(values))).select(key, "split", "shard", "length").collect()
    if not runs:
        return spark.read.parquet(path).limit(0).withColumn("place", F.lit(0).cast("long"))
    folders = sorted({f"{path}/split={r['split']}/shard={r['shard']}" for r in runs})
    rows = spark.read.option("basePath", path).parquet(*folders).where(F.col(key).isin(list(values)))
    w = Window.partitionBy("split", key)
    length = F.element_at(F.create_map(*[F.lit(x) for r in runs for x in (f"{r['split']}:{r[key]}", r["length"])]), F.concat("split", F.lit(":"), key))
    whole = F.count(F.lit(1)).over(w) == length
    rows = rows.withColumn("place", (F.row_number().over(w.orderBy("timestamp", "trade_uid")) - 1).cast("long"))
    return rows.withColumn("place", F.when(whole, F.col("place")).otherwise(F.raise_error(F.lit("a run is not as long as the index says")).cast("long")))


def preview(features: DataFrame, rows: int = 3) -> DataFrame:
    """Means of the target columns over the first rows, as a smoke check."""
    return features.limit(rows).agg(F.count("*").alias("n"), F.avg("label_y").alias("mean_y"), F.avg("edge").alias("mean_edge"))
