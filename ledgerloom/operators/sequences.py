"""Token tables of markets and users, and their indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.sources.sinks import SHARDS


def _shard(key: str) -> Column:
    n = F.lit(None)
    for split, shards in SHARDS.items():
        n = F.when(F.col("split") == split, S.bucket(key, shards)).otherwise(n)
    return n.cast("int")


def market_tokens(features: DataFrame, meta: DataFrame) -> DataFrame:
    """A token for each trade of a labelled market, all splits at once."""
    rows = features.join(meta, "market_id")
    real = lambda c: c.cast("float")
    return rows.select(
        "market_id", "timestamp", real(F.col("p_yes")).alias("p_yes"), real(F.col("price")).alias("price"),
        F.col("outcome_index").cast("byte").alias("outcome_index"),
        real(S.clip("dp_yes", -S.DP_CLIP, S.DP_CLIP)).alias("dp_yes_clip"),
        real(S.log_above("dt_trade")).alias("log_dt"), real(F.col("log_usdc_size")).alias("log_usdc_size"),
        S.bucket("user_id", S.USER_BUCKETS).alias("user_hash"),
        real(S.asinh_pnl("user_recent_pnl_last20")).alias("user_recent_pnl_asinh"),
        real(S.log_above("user_avg_size_before")).alias("user_avg_size_log"),
        real(S.log_above("user_days_active_before")).alias("user_days_active_log"),
        real(S.asinh_pnl("user_historical_pnl_before")).alias("user_hist_pnl_asinh"),
        real(S.clip("user_historical_winrate_before", 0.0, 1.0)).alias("user_hist_winrate"),
        real(S.log_above("user_pnl_std_before")).alias("user_pnl_std_log"),
        F.col("y").cast("byte").alias("y"), "split", _shard("market_id").alias("shard"), "trade_uid",
    )


def user_tokens(features: DataFrame, market_index: DataFrame) -> DataFrame:
    """A token for each trade, with what its market resolved to and when. dt_user is
    the gap to the user's last token of the same split."""
    index = market_index.select("market_id", "split", "y", F.col("max_ts").alias("market_resolve_time"))
    rows = features.join(index, "market_id")
    w = Window.partitionBy("split", "user_id").orderBy("timestamp", "trade_uid")
    return rows.select(
        "user_id", "timestamp", "market_id", F.col("price").cast("float").alias("price"), F.col("p_yes").cast("float").alias("p_yes"),
        F.col("outcome_index").cast("byte").alias("outcome_index"), F.col("y").cast("byte").alias("y"), "market_resolve_time",
        F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w), F.lit(0)).alias("dt_user"), "split", _shard("user_id").alias("shard"), "trade_uid",
    )


def user_history(*features: DataFrame) -> DataFrame:
    """The flat history of feature tables (one for each split, or one with all of
    them): outcome -1 where there is no label."""
    rows = features[0]
    for more in features[1:]:
        rows = rows.unionByName(more)
    return rows.select(
        S.bucket("user_id", S.USER_BUCKETS).alias("user_hash"), "timestamp", "market_id", F.col("price").cast("float").alias("price"),
        F.col("log_usdc_size").cast("float").alias("log_usdc_size"), F.coalesce(F.col("label_y").cast("int"), F.lit(-1)).alias("outcome"),
        F.coalesce("edge", F.lit(0.0)).cast("float").alias("edge"), "trade_uid",
    )


def index(tokens: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Where each key's run stands in its shard, its length and times; label: a column
    whose value is the same in all of a key's rows."""
    sums = [F.count(F.lit(1)).alias("length"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")]
    rows = tokens.groupBy("split", "shard", key).agg(*sums, *([F.max(label).alias(label)] if label else []))
    w = Window.partitionBy("split", "shard").orderBy(key)
    return rows.withColumn("start", F.sum("length").over(w) - F.col("length"))


def flat_index(history: DataFrame, groups: int = 1024) -> DataFrame:
    """(user_hash, start_row, num_trades) of a history sorted by user_hash. Prefix sums
    in two levels: of ranges of hashes, then within a range, so that no task has all."""
    rows = history.groupBy("user_hash").agg(F.count(F.lit(1)).alias("num_trades"))
    rows = rows.withColumn("_range", F.floor(F.col("user_hash") / (S.USER_BUCKETS // groups)))
    ranges = rows.groupBy("_range").agg(F.sum("num_trades").alias("_all"))
    ranges = ranges.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_base"))
    within = F.sum("num_trades").over(Window.partitionBy("_range").orderBy("user_hash"))
    return rows.join(ranges, "_range").select("user_hash", (F.col("_base") + within - F.col("num_trades")).alias("start_row"), "num_trades")
