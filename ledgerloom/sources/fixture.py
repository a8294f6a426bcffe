"""Trades, markets and labels as views over the events table (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
NUMBER = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20"
PRICE = "(CAST(round(value * 100) AS BIGINT) % 99 + 1) / 100e0"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trades_of(rows: DataFrame) -> DataFrame:
    """The trades view; works on a batch and on a stream of events."""
    return rows.selectExpr(
        "lpad(CAST(event_id AS STRING), 10, '0') AS trade_uid",
        "concat('u', CAST(user_id AS STRING)) AS proxy_wallet",
        f"concat('m', CAST({NUMBER} AS STRING)) AS condition_id",
        f"CAST({SECONDS} DIV 600 * 600 AS BIGINT) AS timestamp",
        f"{PRICE} AS price",
        "CASE WHEN event_id % 23 = 0 THEN 0e0 WHEN event_type = 'signup' THEN -value ELSE value END AS size",
        f"CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * ({PRICE}) END AS usdc_size",
        "CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS outcome_index",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(value, 2) - 40e0 END AS pnl_raw",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of(events(spark, sf_dir))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(f"{NUMBER} AS i").distinct().union(spark.range(20, 21).selectExpr("CAST(id AS INT)"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).where("i <> 18").selectExpr(
        "concat('m', CAST(i AS STRING)) AS condition_id",
        "CASE WHEN i % 7 = 3 THEN NULL ELSE concat('2023-12-', CAST(10 + i AS STRING), 'T00:00:00Z') END AS start_date",
        "CASE WHEN i % 4 = 1 THEN NULL ELSE '2024-02-01T02:00:00+02:00' END AS end_date",
        "CASE WHEN i % 5 = 0 AND i < 20 THEN CAST(1704067200 + 86400 * (10 + i) AS BIGINT) END AS effective_end_ts",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).where("i < 19").selectExpr("concat('m', CAST(i AS STRING)) AS market_id", "CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS y")
