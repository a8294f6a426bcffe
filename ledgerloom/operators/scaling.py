"""Column roles, normalisation statistics, vectors and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that are no features, and features that stay as they are.
NOT_FEATURES = ("trade_uid", "user_id", "market_id", "timestamp", "label_y", "edge", "split", "market_time_since_first_trade")
UNSCALED = ("price", "outcome_index", "time_of_day_sin", "time_of_day_cos")


def feature_columns(columns: Sequence[str]) -> list[str]:
    """The features among the columns. price and edge have to be there; label_y need
    not, as it follows from them."""
    missing = {"price", "edge"} - set(columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return [c for c in columns if c not in NOT_FEATURES]


def scaled_columns(columns: Sequence[str]) -> list[str]:
    """The features that are standardised: not the bounded ones, nor marks of what is missing."""
    return [c for c in feature_columns(columns) if c not in UNSCALED and not c.endswith("_missing")]


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def norm_stats(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std, count) over finite values; std is the population's, and 1
    where there are fewer than two values or no spread. One aggregate for all."""
    parts = [F.struct(F.lit(c).alias("column"), F.avg(_finite(c)).alias("mean"), F.stddev_pop(_finite(c)).alias("std"), F.count(_finite(c)).alias("count")) for c in columns]
    rows = features.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    std = F.when((F.col("count") > 1) & (F.col("std") > 0), F.col("std")).otherwise(F.lit(1.0))
    return rows.select("column", F.coalesce("mean", F.lit(0.0)).alias("mean"), std.alias("std"), "count")


def norm_partials(features: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """(by, column, count, mean, m2) of the finite values: partial statistics that are kept,
    say for each day, and merged with those of later days. m2: squared deviations."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(_finite(c)).alias("count"), F.avg(_finite(c)).alias("mean"), (F.var_pop(_finite(c)) * F.count(_finite(c))).alias("m2")) for c in columns]
    rows = features.groupBy(*by).agg(F.array(*parts).alias("rows"))
    return rows.select(*by, F.explode("rows").alias("r")).select(*by, "r.*").where("count > 0")


def merged_partials(partials: DataFrame, *by: str) -> DataFrame:
    """Partials of several parts as one for each `by` and column, by Chan's formula: the
    parts' deviations, and how far their means lie from the mean of all."""
    keys = [*by, "column"]
    total = partials.groupBy(*keys).agg(F.sum("count").alias("_n"), (F.sum(F.col("count") * F.col("mean")) / F.sum("count")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    return partials.join(total, keys).groupBy(*keys).agg(F.sum("count").alias("count"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("count") * apart * apart).alias("m2"))


def stats_of(partials: DataFrame, columns: Sequence[str]) -> DataFrame:
    """norm_stats() from partials of any number of parts."""
    names = partials.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    rows = names.join(merged_partials(partials), "column", "left")
    std = F.sqrt(F.col("m2") / F.col("count"))
    return rows.select("column", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when((F.col("count") > 1) & (std > 0), std).otherwise(F.lit(1.0)).alias("std"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def standardised(features: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std for the columns that stats has; a bad std counts as 1. The
    statistics, a row for each column, come to the driver and become literals."""
    known = {r["column"]: (r["mean"], r["std"] if r["std"] and 0 < r["std"] < float("inf") else 1.0) for r in stats.collect()}
    return features.withColumns({c: (F.col(c) - F.lit(known[c][0])) / F.lit(known[c][1]) for c in columns if c in known})


def vectors(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    return features.select("trade_uid", F.array(*[F.col(c).cast("float") for c in columns]).alias("x"), "label_y", "edge")


def shuffled_batches(rows: DataFrame, seed: int, batch: int) -> DataFrame:
    """Rows with a batch id: a seeded order by hash, ranges of it a task each, and
    runs of `batch` rows in a task. (task, batch_id) names a batch."""
    mixed = rows.withColumn("_h", F.xxhash64(F.lit(seed), "trade_uid")).repartitionByRange("_h", "trade_uid").sortWithinPartitions("_h", "trade_uid")
    mixed = mixed.withColumn("task", F.spark_partition_id())
    n = F.row_number().over(Window.partitionBy("task").orderBy("_h", "trade_uid"))
    return mixed.withColumn("batch_id", F.floor((n - 1) / batch).cast("long")).drop("_h")


def first_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A repeatable sample: the n rows of the least hashes of seed and id."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "trade_uid")), "trade_uid").limit(n)
