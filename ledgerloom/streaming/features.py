"""Features of trades as they arrive, with keyed state and checkpoints.

Two stateful queries, one keyed by user and one by market, write their columns as
they go; joined on trade_uid they equal the batch build. Input must come in the
order of time across micro-batches; a micro-batch is sorted before it is applied.
Ends are those announced by the markets table, as a stream cannot know the last
trade. Streams resume from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

USER_OUT = "trade_uid string, user_id string, timestamp long, user_total_trades_before long, user_total_volume_before double, time_since_user_last_trade long, user_historical_pnl_before double, user_historical_winrate_before double"
MARKET_OUT = "trade_uid string, market_id string, market_total_trades_before long, market_total_volume_before double, time_since_last_market_trade long, last_price_yes double, last_price_no double, market_volume_last_1h double"
HOUR = 3600
USER_STATE = "trades long, volume double, last long, pnl double, won long, lost long, due array<struct<end:long,pnl:double>>"
MARKET_STATE = "trades long, volume double, last long, yes double, no double, recent array<struct<ts:long,usdc:double>>"


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["timestamp", "trade_uid"], kind="stable")


def _user(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Profits wait until their market's end; they are counted at the user's next row,
    and only that user's rows could tell."""
    n, volume, last, pnl, won, lost, due = state.get if state.exists else (0, 0.0, None, 0.0, 0, 0, [])
    due, out = [(x["end"], x["pnl"]) if not isinstance(x, tuple) else tuple(x) for x in due], []
    for r in _rows(batches).itertuples():
        for x in sorted(x for x in due if x[0] <= r.timestamp):
            pnl, won, lost = pnl + x[1], won + (x[1] > 0), lost + (x[1] < 0)
        due = [x for x in due if x[0] > r.timestamp]
        out.append((r.trade_uid, key[0], r.timestamp, n, volume, -1 if last is None else r.timestamp - last, pnl, won / (won + lost) if won + lost else 0.0))
        n, volume, last = n + 1, volume + r.usdc, r.timestamp
        if pd.notna(r.end_ts) and pd.notna(r.pnl_raw):
            due.append((int(r.end_ts), float(r.pnl_raw)))
    state.update((n, float(volume), last, float(pnl), int(won), int(lost), due))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in USER_OUT.split(", ")])


def _market(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All rows of a micro-batch at once: work per row does not grow with the hour's trades.
    Sums of an hour are differences of prefix sums in extended precision."""
    n, volume, last, yes, no, recent = state.get if state.exists else (0, 0.0, None, 0.0, 0.0, [])
    recent = [(x["ts"], x["usdc"]) if not isinstance(x, tuple) else tuple(x) for x in recent]
    rows = _rows(batches)
    ts, usdc, price = rows["timestamp"].to_numpy(np.int64), rows["usdc"].to_numpy(float), rows["price"].to_numpy(float)
    is_yes = rows["outcome_index"].to_numpy(float) == 1
    times, sizes = np.concatenate([np.array([x[0] for x in recent], np.int64), ts]), np.concatenate([[x[1] for x in recent], usdc])
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.longdouble)])
    hour = sums[len(recent) : -1] - sums[np.searchsorted(times, ts - HOUR)]
    before = np.cumsum(np.concatenate([[volume], usdc]))
    prices = [pd.Series(np.concatenate([[x], np.where(test, price, np.nan)])).ffill().to_numpy() for x, test in ((yes, is_yes), (no, ~is_yes))]
    gap = np.diff(ts, prepend=ts[:1] + 1 if last is None else last)
    values = (rows["trade_uid"].to_numpy(), key[0], np.arange(n, n + len(ts)), before[:-1], gap, prices[0][:-1], prices[1][:-1], hour.astype(float))
    kept = times >= ts[-1] - HOUR
    state.update((n + len(ts), float(before[-1]), int(ts[-1]), float(prices[0][-1]), float(prices[1][-1]), list(zip(times[kept].tolist(), sizes[kept].tolist(), strict=True))))
    yield pd.DataFrame(dict(zip([x.split()[0] for x in MARKET_OUT.split(", ")], values, strict=True)))


def keyed_features(rows: DataFrame, key: str) -> DataFrame:
    """A stream of base() rows with the features of its key, "user_id" or "market_id"."""
    step, out, state = (_user, USER_OUT, USER_STATE) if key == "user_id" else (_market, MARKET_OUT, MARKET_STATE)
    rows = rows.select(key, "trade_uid", "timestamp", "usdc", *(("end_ts", "pnl_raw") if key == "user_id" else ("price", "outcome_index")))
    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Takes all that is there, appends it to the table at path, and gives the table.
    A later call with the same checkpoint goes on from where this one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def sliding_hours(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Trades and volume of each market in hours that begin every ten minutes. On a
    stream, trades later than `late` behind the newest are dropped."""
    timed = rows.withColumn("ts", F.timestamp_seconds("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark("ts", late)
    w = F.window("ts", "1 hour", "10 minutes")
    out = timed.groupBy("market_id", w).agg(F.count(F.lit(1)).alias("n_trades"), F.sum("usdc").alias("volume"))
    return out.select("market_id", F.unix_timestamp("window.start").alias("window_start"), "n_trades", "volume")


def user_sessions(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Stays of users in markets: trades at most an hour apart (a session takes in a
    row that begins just at its end)."""
    timed = rows.withColumn("ts", F.timestamp_seconds("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark("ts", late)
    w = F.session_window("ts", f"{HOUR} seconds")
    out = timed.groupBy("market_id", "user_id", w).agg(F.count(F.lit(1)).alias("n_trades"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    return out.drop("session_window")
