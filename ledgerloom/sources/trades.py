"""Trade and market scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2023-01-01 00:00:00 UTC.
DEFAULT_START = 1_672_531_200
COLUMNS = ["trade_uid", "proxy_wallet", "condition_id", "timestamp", "price", "size", "usdc_size", "outcome_index", "pnl_raw"]


def scan(trades: DataFrame, start_ts: int = DEFAULT_START, after: tuple[int, str] | None = None) -> DataFrame:
    """The nine trade columns from start_ts on; with `after`, only trades that come
    later than that (timestamp, trade_uid). Both are plain filters on columns, so
    the parquet scan gets them."""
    rows = trades.select(*COLUMNS).where(F.col("timestamp") >= start_ts)
    if after is not None:
        ts, uid = after
        rows = rows.where((F.col("timestamp") > ts) | ((F.col("timestamp") == ts) & (F.col("trade_uid") > uid)))
    return rows


def valid(trades: DataFrame) -> DataFrame:
    """Trades with a size, not zero, and a price."""
    return trades.where("size IS NOT NULL AND size <> 0 AND price IS NOT NULL")


def iso_seconds(column: str) -> Column:
    """UTC seconds of an ISO-8601 text (Z or an offset); empty texts give null.
    The session's time zone must be UTC for texts without a zone."""
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(F.trim(column), F.lit(""))))


def market_times(markets: DataFrame) -> DataFrame:
    """(market_id, start_ts, end_ts), from the columns that the table has: dates as
    texts before unix numbers, and effective_end_ts before either end."""
    have = set(markets.columns)
    null = F.lit(None).cast("long")
    start = iso_seconds("start_date") if "start_date" in have else F.col("start_time").cast("long") if "start_time" in have else null
    end = iso_seconds("end_date") if "end_date" in have else F.col("end_time").cast("long") if "end_time" in have else null
    if "effective_end_ts" in have:
        end = F.coalesce(F.col("effective_end_ts").cast("long"), end)
    return markets.select(F.col("condition_id").alias("market_id"), start.alias("start_ts"), end.alias("end_ts"))


def effective_ends(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """markets with effective_end_ts filled, where null, by the market's last trade
    of any kind."""
    last = trades.groupBy("condition_id").agg(F.max("timestamp").alias("_last"))
    if "effective_end_ts" not in markets.columns:
        markets = markets.withColumn("effective_end_ts", F.lit(None).cast("long"))
    return markets.join(last, "condition_id", "left").withColumn("effective_end_ts", F.coalesce("effective_end_ts", "_last")).drop("_last")


def split_table(markets: DataFrame) -> DataFrame:
    """The split table's export: condition_id becomes market_id."""
    return markets.select(F.col("condition_id").alias("market_id"), "effective_end_ts", "split")
